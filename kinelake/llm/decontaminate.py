"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; the positions it leaves out may differ. The tokens that each mask
selects are hashed at every position of every test item and of every training text, equal hashes are joined, and each
hit is verified along its diagonal: matching tokens count +1, others -3, and the best stretch through the hit must
hold enough matches. So a passage with words replaced is found and the parts that overlap are known to the token.

The test items are the stated query set. They are taken in blocks of at most ``BLOCK_TOKENS`` tokens, so what a task
holds of them is bounded however many there are; each block is one pass over the training texts, which are never
shuffled for the search.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import query, table, texts_of, whole_text
from kinelake.sources.store import reliable

#: The masks: six tokens each, over six to eleven positions.
MASKS = ("111111", "11101011", "110110011", "10110100101", "11001000111")
LEAST = 12
SHORTEST = 8
#: Tenths of a short item's tokens that a match of it must hold.
SHARE = 8
MISS = 3
BLOCK_TOKENS = 1 << 20
#: A token is a run of ASCII letters, digits, underscores and characters beyond ASCII.
WORD = re.compile("[0-9A-Z_a-z\x80-\U0010ffff]+")
APART = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
FILTER_BITS = 22
ODDS = np.random.default_rng(7).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: str) -> list[bytes]:
    """Lower-case tokens in UTF-8, as many as there are matches of WORD in the text."""
    return text.lower().encode().translate(APART).split()


class Block:
    """Test items as token numbers, with the hashes of all masks at all positions."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST, masks: tuple[str, ...] = MASKS):
        cut = [(i, w) for i, t in items if len(w := tokens(t or "")) >= SHORTEST]
        self.items = [i for i, _ in cut]
        self.vocab = {w: k for k, w in enumerate(sorted(set(chain.from_iterable(w for _, w in cut))), 1)}
        self.ids = [np.fromiter((self.vocab[x] for x in w), np.int32, len(w)) for _, w in cut]
        self.least = least
        self.masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in masks]
        self.numbers = np.random.default_rng(42).integers(0, 1 << 64, len(self.vocab) + 1, np.uint64)
        found = []
        for k, x in enumerate(self.ids):
            for m in range(len(self.masks)):
                h = self.hashes(x, m)
                found.append(np.stack([h.view(np.int64), np.full(len(h), k), np.arange(len(h))], 1))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        rows = rows[np.argsort(rows[:, 0].view(np.uint64), kind="stable")]
        self.seeds, self.where = rows[:, 0].copy().view(np.uint64), rows[:, 1:]
        self.marks = np.zeros(1 << FILTER_BITS, bool)
        self.marks[self.seeds >> np.uint64(64 - FILTER_BITS)] = True

    def hashes(self, ids: np.ndarray, m: int) -> np.ndarray:
        """The mask's hash at every position where it fits: a sum of the selected tokens' random numbers, each times
        an odd number of its place. A window with a token of no test item has a hash of no test window."""
        mask = self.masks[m]
        n = len(ids) - int(mask[-1])
        if n <= 0:
            return np.zeros(0, np.uint64)
        drawn = self.numbers[ids]
        h = np.full(n, m + 1, np.uint64)
        for o, odd in zip(mask, ODDS):
            h += drawn[o : o + n] * odd
        return h

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, first token, last token, matching tokens) of verified overlaps, ordered, in token positions."""
        words = tokens(text)
        get = self.vocab.get
        ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        pairs = set()
        for m in range(len(self.masks)):
            h = self.hashes(ids, m)
            at = np.flatnonzero(self.marks[h >> np.uint64(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
            for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                pairs.update((int(k), p - int(q)) for k, q in self.where[a:b])
        found = set()
        for k, d in pairs:
            item = self.ids[k]
            a, b = max(0, -d), min(len(item), len(ids) - d)
            score = np.where(ids[a + d : b + d] == item[a:b], 1, -MISS)
            for first, last in _stretches(score):
                matched = int((score[first : last + 1] > 0).sum())
                if matched >= min(self.least, -(-SHARE * len(item) // 10)):
                    found.add((self.items[k], first + a + d, last + a + d, matched))
        # A null item_id comes first, as in sort_array.
        return sorted(found, key=lambda m: (m[0] is not None, m[0] or 0, m[1:]))


def _stretches(score: np.ndarray):
    """(first, last) of the best stretch of each run of positive running sum: all maximal overlaps on a diagonal."""
    total, start, best, end = 0, 0, 0, -1
    for i, s in enumerate(score.tolist()):
        if total <= 0:
            if best > 0:
                yield start, end
            total, start, best, end = 0, i, 0, -1
        total += s
        if total > best:
            best, end = total, i
    if best > 0:
        yield start, end


def cleaned(text: str, matches) -> str:
    """The text without its overlapping stretches."""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = [], 0
    for first, last in sorted((m[1], m[2]) for m in matches):
        out.append(text[at : max(at, spans[first][0])])
        at = max(at, spans[last][1])
    return "".join(out) + text[at:]


def blocks(benchmark: DataFrame, size: int = BLOCK_TOKENS):
    """The test items in parts of about ``size`` tokens, each small enough for every task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    n = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-n // (4 * size)))
    for k in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


MATCHES = "array<struct<item_id: bigint, first_token: int, last_token: int, matched: int>>"
MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("first_token", pa.int32()), ("last_token", pa.int32()), ("matched", pa.int32())]))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, size: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_ids, matches, clean_text.

    A match holds at least ``least`` matching tokens, of an item too short for that eight tenths of its tokens; items
    under ``SHORTEST`` tokens match nothing, for they cannot be told from chance. Null texts are empty and clean,
    repeated rows give equal rows, items with a null item_id match under that null and come first, an empty table gives
    no rows and an empty benchmark no matches.
    """
    found = _overlaps(docs, benchmark, least, size)

    @F.pandas_udf("string")
    def cut_out(text, matches):
        import pandas as pd

        return pd.Series([cleaned(t, [(0, x["first_token"], x["last_token"]) for x in m]) for t, m in zip(text, matches)])

    dirty = F.size("matches") > 0
    return found.select("doc_id", dirty.alias("contaminated"), F.array_distinct(F.transform("matches", lambda m: m["item_id"])).alias("item_ids"), "matches", F.when(dirty, cut_out("text", "matches")).otherwise(F.col("text")).alias("clean_text"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, least: int, size: int) -> DataFrame:
    """(doc_id, text, matches) of every row."""
    rows = whole_text(docs)
    parts = blocks(benchmark, size)
    schema = f"doc_id long, text string, matches {MATCHES}"

    def searching(block, hits_only):
        def run(batches):
            for b in batches:
                texts = texts_of(b)
                found = [block.matches(t) for t in texts]
                keep = [i for i, f in enumerate(found) if f or not hits_only]
                made = [[dict(zip(("item_id", "first_token", "last_token", "matched"), m)) for m in found[i]] for i in keep]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([texts[i] for i in keep], pa.string()), pa.array(made, MATCH)], ["doc_id", "text", "matches"])

        return run

    first, second = next(parts), next(parts, None)
    if second is None:
        return rows.mapInArrow(searching(Block(first, least), False), schema)
    hits = None
    for part in chain([first, second], parts):
        # Written before the next block is fetched: the driver and a plan hold one block, whatever the benchmark's size.
        one = rows.mapInArrow(searching(Block(part, least), True), schema).select("doc_id", F.xxhash64("text").alias("no"), F.explode("matches").alias("m"))
        one = reliable(one)
        hits = one if hits is None else hits.union(one)
    grouped = hits.groupBy("doc_id", "no").agg(F.sort_array(F.collect_set("m")).alias("matches")).withColumnRenamed("doc_id", "id")
    on = rows["doc_id"].eqNullSafe(grouped["id"]) & (F.xxhash64(rows["text"]) == grouped["no"])
    found = rows.join(grouped, on, "left").select("doc_id", "text", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no test item overlaps. Rows are told apart by doc_id and text.

    Null and empty texts stay, repeated rows stay or go together, a null doc_id is one like any other, an empty
    benchmark keeps every row and an empty table gives none.
    """
    bad = _overlaps(docs, benchmark, LEAST, BLOCK_TOKENS).filter(F.size("matches") > 0)
    bad = bad.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__no")).distinct()
    no = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, (no == F.col("__no")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti")


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
