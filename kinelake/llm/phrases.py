"""Collocations: phrases of two to five words by how much more often they occur than their parts would by chance.

Frequent phrases are found by a multikey three-way quicksort of suffix pointers. A suffix is a position in a piece of
text and the words from there on, five at most. Suffixes are dealt over the cluster by their leading words: by the
first word, or, where that one alone begins too many suffixes, by the first two, three, four or all. Inside a bucket the
pointers are split by the word at the present depth into smaller, equal and larger ones; the size of an equal part is
the count of the phrase that its suffixes begin with, and the part is split on at the next depth. A part that holds
fewer suffixes than a phrase needs is left at once. Suffixes of one bucket travel together as packed word numbers, equal
ones as one with a count.

Frequent words are numbered by a dictionary of bounded size. While it holds every frequent word, other words end a
suffix, as no frequent phrase holds them. Beyond the bound, words that are not in the dictionary travel beside the
numbers as they are written, so the result is the same.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import query, table
from kinelake.sources.store import scratch_path

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words in the dictionary, which is sent to every executor.
DICTIONARY = 1 << 18
#: Distinct words that a task counts before it sends them on, suffixes that it holds before it packs them.
COUNTED, HELD = 300_000, 1 << 19
#: Suffixes in a bucket, as far as the estimate goes; rows of an Arrow batch of words.
BUCKET, ROWS = 1 << 19, 20_000
#: Documents read at least to estimate how suffixes begin. The estimate only deals work; counts do not depend on it.
LOOK = 4000

#: Lower case for A-Z, one mark for all that ends a piece, one for all that ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c for c in range(256))


def texts_by_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def folded(batch: pa.RecordBatch) -> dict[str, bytes]:
    """The texts of a batch by language, folded, a piece's end between them."""
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault(lang, []).append(text)
    return {lang: b"\n".join(texts).translate(FOLD) for lang, texts in found.items()}


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, item, n) of words, counted in each task first."""

    def run(batches):
        counts: dict[str, Counter] = {}

        def flushed():
            langs = [lang for lang, c in counts.items() for _ in range(len(c))]
            items = [x.decode() for c in counts.values() for x in c]
            n = [k for c in counts.values() for k in c.values()]
            whole = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array(n, pa.int64())], ["lang", "item", "n"])
            counts.clear()
            yield from (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS))

        for b in batches:
            for lang, text in folded(b).items():
                counts.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, counts.values())) > COUNTED:
                yield from flushed()
        yield from flushed()

    return texts.mapInArrow(run, "lang string, item string, n long")


# ---------------------------------------------------------------- suffixes as rows of word numbers


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number (fixed values: the constants of the published splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers:
    """Word numbers of one language: 0 for the end of a piece, then the dictionary, then words met here that are not in it."""

    def __init__(self, lang: str, dictionary: list[str], complete: bool):
        self.complete, self.known = complete, len(dictionary)
        self.of = {b"\n": 0, b"": -1} | {w.encode(): i for i, w in enumerate(dictionary, 1)}
        self.words, self.extra = dictionary, []
        self.seed = np.uint64(zlib.crc32(lang.encode()) + 1)
        self.hashes = mixed(np.arange(self.known + 1, dtype=np.uint64) + (self.seed << np.uint64(32)))

    def number(self, words: list[bytes]) -> list[int]:
        """The numbers of words; an unknown word ends the piece if the dictionary has all that matter."""
        get = self.of.get
        if self.complete:
            return [get(w, 0) for w in words]
        for w in dict.fromkeys(words):
            if w not in self.of:
                self.of[w] = self.known + 1 + len(self.extra)
                self.extra.append(w)
        return list(map(get, words))

    def hashes_of(self) -> np.ndarray:
        """A hash for every number, the same in every task, whatever numbers it gives to further words."""
        if not self.extra:
            return self.hashes
        further = np.array([zlib.crc32(w) + (zlib.adler32(w) << 32) for w in self.extra], np.uint64)
        return np.concatenate((self.hashes, mixed(further ^ (self.seed << np.uint64(7)))))

    def forget(self) -> None:
        for w in self.extra:
            del self.of[w]
        self.extra = []

    def plain(self, row: np.ndarray) -> str:
        return " ".join(self.words[i - 1] if i <= self.known else self.extra[i - self.known - 1].decode() for i in row.tolist())


def suffix_rows(numbers: np.ndarray, longest: int) -> np.ndarray:
    """The suffixes of two words or more in a row of pieces: word numbers, 0 behind a suffix's end."""
    padded = np.concatenate((numbers, np.zeros(longest, numbers.dtype)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, longest)[: len(numbers)]
    rows = rows[(rows[:, 0] > 0) & (rows[:, 1] > 0)]
    for d in range(2, longest):
        rows[:, d] *= rows[:, d - 1] > 0
    return rows


def beginnings(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the first word, the first two words, ... of each row: one row for each length."""
    out = np.empty((rows.shape[1], len(rows)), np.uint64)
    state = np.zeros(len(rows), np.uint64)
    for d in range(rows.shape[1]):
        state = mixed(state * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[:, d]] + np.uint64(d + 1))
        out[d] = state
    return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def leads(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """By how many leading words each suffix is dealt: no more than needed to leave the frequent beginnings."""
    lead = np.ones(starts.shape[1], np.int64)
    still = np.ones(starts.shape[1], bool)
    for start in starts[:-1]:
        still &= among(start, many)
        lead += still
    return lead


def distinct(rows: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers to distinct rows and their counts; ``whole`` are the rows' hashes, checked against the rows themselves."""
    order = np.argsort(whole, kind="stable")
    new = np.append(True, whole[order[1:]] != whole[order[:-1]])
    first = np.flatnonzero(new)
    if not (rows[order] == rows[order[np.repeat(first, np.diff(np.append(first, len(order))))]]).all():
        order = np.lexsort(rows.T)
        new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1))
        first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


PACKED = "bucket int, lang string, extra array<binary>, n int, low binary, high binary, weight binary"


def held_suffixes(batches, words: dict[str, list[str]], complete: bool, longest: int):
    """(lang, its numbers, suffix rows) of the texts, as many at a time as a task may hold."""
    by_lang: dict[str, Numbers] = {}
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def released():
        for lang, parts in held.items():
            yield lang, by_lang[lang], np.concatenate(parts)
            by_lang[lang].forget()
        held.clear()

    for b in batches:
        for lang, text in folded(b).items():
            if lang not in by_lang:
                by_lang[lang] = Numbers(lang, words.get(lang, []), complete)
            found = np.array(by_lang[lang].number(text.replace(b"\n", b" \n ").split(b" ")), np.int32)
            rows = suffix_rows(found[found >= 0], longest)
            held.setdefault(lang, []).append(rows)
            size += len(rows)
        if size > HELD:
            yield from released()
            size = 0
    yield from released()


def many_beginnings(texts: DataFrame, shared, total: int, buckets: int, longest: int) -> np.ndarray:
    """Hashes of the beginnings of so many suffixes that one bucket should not have them all, estimated on some texts.

    At most 4 x ``buckets`` beginnings of each length are that frequent.
    """
    limit = max(1.0, total / (4 * buckets))
    share = min(1.0, max(LOOK / max(1, texts.count()), 200 / limit))

    def run(batches):
        words, complete = shared.value
        for _, numbers, rows in held_suffixes(batches, words, complete, longest):
            starts = beginnings(rows, numbers.hashes_of())
            kinds, n = np.unique(starts[:-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["start", "n"])

    seen = (texts if share == 1.0 else texts.sample(share, seed=7)).mapInArrow(run, "start long, n long")
    often = seen.groupBy("start").agg(F.sum("n").alias("n")).filter(F.col("n") > limit * share)
    return np.sort(np.array([r["start"] for r in often.select("start").collect()], np.int64).view(np.uint64))


def packed_suffixes(texts: DataFrame, shared, many: np.ndarray, buckets: int, longest: int) -> DataFrame:
    """Suffixes of a task by bucket: word numbers in two planes of 16 bits, as the upper one is mostly zero."""

    def run(batches):
        words, complete = shared.value
        for lang, numbers, rows in held_suffixes(batches, words, complete, longest):
            if not len(rows):
                continue
            starts = beginnings(rows, numbers.hashes_of())
            at, weight = distinct(rows, starts[-1])
            rows, starts = rows[at], starts[:, at]
            lead = leads(starts, many)
            bucket = (starts[lead - 1, np.arange(len(rows))] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket, weight = rows[order], bucket[order], weight[order].astype("<u4")
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
                part, extra = rows[a:z], []
                if numbers.extra:  # only those that this bucket needs
                    used = np.unique(part[part > numbers.known])
                    extra = [numbers.extra[i - numbers.known - 1] for i in used.tolist()]
                    part = np.where(part > numbers.known, numbers.known + 1 + np.searchsorted(used, part), part)
                part = part.T.astype("<u4")
                row = {"bucket": int(bucket[a]), "lang": lang, "extra": extra, "n": z - a}
                row |= {"low": (part & 0xFFFF).astype("<u2").tobytes(), "high": (part >> 16).astype("<u2").tobytes(), "weight": weight[a:z].tobytes()}
                yield pa.RecordBatch.from_pylist([row], PACKED_SCHEMA)

    return texts.mapInArrow(run, PACKED)


PACKED_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("lang", pa.string()), ("extra", pa.list_(pa.binary())), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("weight", pa.binary())]
)


def equal_parts(matrix: np.ndarray, weight: np.ndarray, least: int):
    """Multikey three-way quicksort of the rows' pointers: yields (a row, depth, count) of every beginning that is frequent.

    ``matrix`` holds a word number at each depth, 0 behind a suffix's end. A part whose weights do not reach ``least``
    holds nothing frequent and is not split any further.
    """
    depths = matrix.shape[1]
    todo = [(np.arange(len(matrix)), 0)] if weight.sum() >= least else []
    while todo:
        at, depth = todo.pop()
        here = matrix[at, depth]
        pivot = sorted((here[0], here[len(here) // 2], here[-1]))[1]
        smaller, larger = here < pivot, here > pivot
        for side in (smaller, larger):
            rest = at[side]
            if len(rest) and weight[rest].sum() >= least:
                todo.append((rest, depth))
        if pivot:
            equal = at[~(smaller | larger)]
            count = int(weight[equal].sum())
            if count >= least:
                yield int(equal[0]), depth + 1, count
                if depth + 1 < depths:
                    todo.append((equal, depth + 1))


def bucket_phrases(numbers: Numbers, rows: np.ndarray, weight: np.ndarray, many: np.ndarray, least: int):
    """(phrase, count) of one language in a bucket; counts of the ``many`` beginnings are only this bucket's part."""
    starts = beginnings(rows, numbers.hashes_of())
    often = np.stack([among(start, many) for start in starts])
    for row, depth, count in equal_parts(rows, weight, least):
        if depth > 1 and (depth == rows.shape[1] or not often[:depth, row].all()):
            yield numbers.plain(rows[row, :depth]), count
    for depth in range(2, rows.shape[1]):  # counted in each of their buckets, however few they are there
        split = often[:depth].all(axis=0) & (rows[:, depth - 1] > 0)
        if split.any():
            kinds, of = np.unique(rows[split][:, :depth], axis=0, return_inverse=True)
            for kind, count in zip(kinds, np.bincount(of.ravel(), weight[split])):
                yield numbers.plain(kind), int(count)


def sorted_buckets(packed: DataFrame, shared, many: np.ndarray, least: int, longest: int) -> DataFrame:
    """(lang, phrase, n) from packed suffixes, which come sorted by bucket."""

    def unpacked(numbers, row):
        planes = [np.frombuffer(row[c], "<u2").astype(np.int32) for c in ("high", "low")]
        rows = ((planes[0] << 16) | planes[1]).reshape(longest, row["n"]).T
        if row["extra"]:
            own = np.array(numbers.number(row["extra"]), np.int32)
            rows = np.where(rows > numbers.known, own[np.maximum(rows - numbers.known - 1, 0)], rows)
        return rows, np.frombuffer(row["weight"], "<u4").astype(np.int64)

    def run(batches):
        words, complete = shared.value
        by_lang: dict[str, Numbers] = {}
        held: dict[str, list] = {}
        now = None

        def released():
            for lang, parts in held.items():
                found = list(bucket_phrases(by_lang[lang], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), many, least))
                cols = [[lang] * len(found), [p for p, _ in found], [n for _, n in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])
                by_lang[lang].forget()
            held.clear()

        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != now:
                    yield from released()
                    now = row["bucket"]
                if row["lang"] not in by_lang:
                    by_lang[row["lang"]] = Numbers(row["lang"], words.get(row["lang"], []), complete)
                held.setdefault(row["lang"], []).append(unpacked(by_lang[row["lang"]], row))
        yield from released()

    return packed.mapInArrow(run, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, dictionary: int = DICTIONARY, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of every phrase of one to ``longest`` words that occurs ``least`` times, and (lang, n) of all words.

    Null languages are ``und``, null texts are empty; an empty table has no phrase. Rows count as often as they are
    repeated. Columns but ``lang`` and ``text`` are left behind.
    """
    spark = docs.sparkSession
    texts = texts_by_lang(docs)
    path = scratch_path(spark, "words")
    word_counts(texts).groupBy("lang", "item").agg(F.sum("n").alias("n")).write.parquet(path)
    words = spark.read.schema("lang string, item string, n long").parquet(path)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.filter(F.col("n") >= least)
    size = often.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    known: dict[str, list[str]] = {}
    for r in often.orderBy(F.desc("n"), "lang", "item").limit(dictionary).select("lang", "item").collect():
        known.setdefault(r["lang"], []).append(r["item"])
    complete = size["k"] <= dictionary
    total = size["n"] if complete else words.agg(F.sum("n")).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // bucket))
    shared = spark.sparkContext.broadcast((known, complete))
    many = many_beginnings(texts, shared, total, buckets, longest)
    packed = packed_suffixes(texts, shared, many, buckets, longest).repartition(parts, "bucket").sortWithinPartitions("bucket")
    path = scratch_path(spark, "phrases")
    sorted_buckets(packed, shared, many, least, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).write.parquet(path)
    longer = spark.read.schema("lang string, phrase string, n long").parquet(path)
    return often.select("lang", F.col("item").alias("phrase"), "n").union(longer), totals


def part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def score_phrases(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more, by the cut that scores lowest."""
    whole = phrases.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1).select("lang", "phrase", F.col("n").alias("a"), "words")
    cuts = whole.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.col("words"), 1, F.col("k")).alias("first"), part(F.col("words"), F.col("k") + 1, F.size("words")).alias("rest"))
    cuts = cuts.join(phrases.toDF("lang", "first", "l"), ["lang", "first"]).join(phrases.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(38,0)") for c in "anlr"}
    cuts = cuts.select("lang", "phrase", "a", "n", "k", "l", "r", (F.lit(1000).cast("decimal(38,0)") * exact["a"] * exact["n"]).alias("over"), (exact["l"] * exact["r"]).alias("under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def maximal(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases of two words or more without those inside a longer one that has ``percent`` of their count."""
    whole = phrases.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    lengths = whole.filter(F.size("words") > 2).select("lang", "n", "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("length"))
    inner = lengths.select("lang", "n", "words", "length", F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("start"))
    inner = inner.select("lang", part(F.col("words"), F.col("start"), F.col("length")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = whole.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n")))
    return kept.select("lang", "phrase")


def collocations(docs: DataFrame, top: int = TOP, **settings) -> DataFrame:
    """The ``top`` phrases of each language by score, count and phrase, ranked from 1."""
    phrases, totals = frequent_phrases(docs, **settings)
    found = score_phrases(phrases, totals).join(maximal(phrases), ["lang", "phrase"], "left_semi")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents),
runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM runs WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, generate_series(1, 5) AS s(k) WHERE i + k - 1 <= len(w)),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS k FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, t.n, c.k, (1000::HUGEINT * c.a * t.n) // (x.n::HUGEINT * y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = b.lang AND length(g.phrase) > length(b.phrase) AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * g.n >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


@query("op12_collocations", ORACLE)
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
