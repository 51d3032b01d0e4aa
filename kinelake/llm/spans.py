"""Substring dedup by sliding sentence spans.

A text is cut into sentences. Every shortest run of at least ``SENTENCES`` consecutive sentences with at least
``WORDS`` words is hashed, seen from its first and from its last sentence, so that each sentence of a shared passage
lies in a run inside the passage. Runs are joined globally by hash; the first occurrence by (doc_id, position) stays,
and the sentences under any other occurrence are removed.

Only hashes and positions travel for the search. Hashes are counted with partial aggregation, so a passage found in a
third of all documents sends one row per task. On the way back the few runs that are very common are joined by a
broadcast of proven size and never meet in one task; all others are joined by hash.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import query, table, texts_of, whole_text
from kinelake.sources.store import reliable

SENTENCES = 2
WORDS = 20
#: A run with more than one in HOT of all repeated runs is joined by broadcast, the others by hash.
HOT = 1000
#: A sentence of more words is cut after words whose hash is a multiple of PART, so the cuts move with the text.
LONGEST = 40
PART = 8
#: A sentence ends behind its closing mark or line, and before a capital that follows a small letter's word: there a
#: passage was set into running text. Group 1 is empty; the match is the white space between two sentences.
BREAK = re.compile(r"(?<=[.!?…:;。！？])[ \t\r\f\v]+|[ \t\r\f\v]*\n\s*|(?<=\w)[ \t]+(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])|(?<=[,)])[ \t]+(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences in order, without the white space between them."""
    out, at = [], 0
    cuts = [(m.start(), m.end()) for m in BREAK.finditer(text)]
    for a, b in [*cuts, (len(text), len(text))]:
        if a > at and not text[at:a].isspace():
            part = text[at:a]
            if part.count(" ") >= LONGEST:
                start = at
                for m in WORD.finditer(text, at, a):
                    if xxhash.xxh32_intdigest(m.group()) % PART == 0 and m.end() < a:
                        out.append((start, m.end()))
                        start = m.end()
                out.append((start, a))
            else:
                out.append((at, a))
        at = b
    return out


def runs(text: str, least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, int]]:
    """(hash, first sentence, last sentence) of every shortest run, from either end; a short text is no run."""
    cut = sentences(text)
    norm = [text[a:b].lower().split() for a, b in cut]
    names = [xxhash.xxh64_digest(" ".join(w)) for w in norm]
    total = [0, *accumulate(map(len, norm))]
    n, seen = len(cut), set()
    j = 0
    for i in range(n):  # forward: the shortest run that starts at i
        j = max(j, i + least)
        while j <= n and total[j] - total[i] < words:
            j += 1
        if j > n:
            break
        seen.add((i, j))
    i = n
    for j in range(n, 0, -1):  # backward: the shortest run that ends before j
        i = min(i, j - least)
        while i >= 0 and total[j] - total[i] < words:
            i -= 1
        if i < 0:
            break
        seen.add((i, j))
    digest = xxhash.xxh64_intdigest
    return [(digest(b"".join(names[i:j])), i, j - 1) for i, j in seen]


def spans(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, row_no, h, i, j): every run of every row; row_no tells rows of one doc_id apart by their text."""

    def run(batches):
        for b in batches:
            ids, nos, h, first, last = [], [], [], [], []
            for doc_id, no, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b)):
                found = runs(text, least, words)
                ids += [doc_id] * len(found)
                nos += [no] * len(found)
                h += [x for x, _, _ in found]
                first += [x for _, x, _ in found]
                last += [x for _, _, x in found]
            cols = [pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_no", "h", "i", "j"])

    rows = whole_text(docs).select("doc_id", F.xxhash64("text").alias("row_no"), "text")
    return rows.mapInArrow(run, "doc_id long, row_no long, h long, i int, j int")


def covered(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, row_no, spans): the runs of each row that are a repeat of an earlier run, as [first, last] pairs."""
    found = spans(docs, least, words)
    place = F.struct("doc_id", "row_no", "i", "j")
    repeated = reliable(found.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"))
    # Fewer than HOT runs can each hold more than one in HOT of all repeats: a bounded broadcast, whatever the data.
    limit = (repeated.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = repeated.filter(F.col("n") > limit).select(F.col("h").alias("hot_h"), F.col("first").alias("hot_first"))
    cold = repeated.filter(F.col("n") <= limit).select(F.col("h").alias("cold_h"), F.col("first").alias("cold_first"))
    marked = found.join(F.broadcast(hot), found["h"] == F.col("hot_h"), "left")
    # Runs of a hot hash have their first place already; a key of their own spreads them over all tasks.
    key = F.when(F.col("hot_h").isNull(), F.col("h")).otherwise(F.xxhash64("doc_id", "row_no", "i", "j"))
    joined = marked.withColumn("key", key).join(cold, F.col("key") == F.col("cold_h"), "left")
    first = F.when(F.col("hot_h").isNotNull(), F.col("hot_first")).otherwise(F.col("cold_first"))
    again = joined.withColumn("first", first).filter(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "row_no").agg(F.collect_set(F.struct("i", "j")).alias("spans"))


def without(text: str, removed: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the sentences in the runs, and how many there were; what stays keeps its own white space."""
    cut = sentences(text)
    gone = set()
    for i, j in removed:
        gone.update(range(i, j + 1))
    stay = [k for k in range(len(cut)) if k not in gone]
    if len(stay) == len(cut):
        return text, 0
    parts, before = [], None
    for k in stay:
        start = cut[k][0] if before is not None and before != k - 1 else (cut[k - 1][1] if k else 0)
        if before is not None and before != k - 1:
            parts.append("\n" if "\n" in text[cut[before][1] : cut[k][0]] else " ")
        elif before is None and k:
            start = cut[k][0]
        parts.append(text[start : cut[k][1]])
        before = k
    return "".join(parts), len(gone)


def remove_repeats(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Every row of ``docs``, all columns, with repeated sentence spans taken out of text; adds removed_sentences.

    The first occurrence by (doc_id, position) stays whole, later ones go, inside one text as well. A text that is a
    full repeat becomes empty; its row stays. Null texts stay null, repeated rows (same doc_id and text) share their
    spans and so are treated alike, an empty table gives none. A column named removed_sentences is replaced.
    """
    gone = covered(docs, least, words).select(F.col("doc_id").alias("__id"), F.col("row_no").alias("__no"), F.col("spans").alias("__spans"))
    base = docs.drop("removed_sentences")
    no = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = base.withColumn("__no_", no).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__no_") == F.col("__no")), "left")

    @F.pandas_udf("struct<text: string, n: int>")
    def rebuilt(text, taken):
        import pandas as pd

        out = [(t, 0) if s is None else without(t, [(x["i"], x["j"]) for x in s]) for t, s in zip(text, taken)]
        return pd.DataFrame(out, columns=["text", "n"])

    made = joined.withColumn("__r", F.when(F.col("__spans").isNotNull(), rebuilt("text", "__spans")))
    names = [F.coalesce(F.col("__r.text"), F.col("text")).alias("text") if c == "text" else F.col(c) for c in base.columns]
    return made.select(*names, F.coalesce(F.col("__r.n"), F.lit(0)).alias("removed_sentences"))


@query("op4_substring_dedup")
def op4(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "removed_sentences")
