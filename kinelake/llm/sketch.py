"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions only.

A fingerprint is the k smallest distinct 64-bit hashes of a text's word shingles, ascending. Sketches merge (the k
smallest of the union), so parts of a text or of a collection may be sketched apart; the k smallest of a union's
hashes are a fair sample of its shingles, which gives resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import id_range, query, table, whole_text

K = 128
WORDS = 5
#: Rows in one range of ids when neighbours by id are looked up, and the most ranges.
RANGE_ROWS = 512
MOST_RANGES = 8192
#: Hashes are compared as signed longs, so their span is 2^64 from here.
LOWEST = -(2.0**63)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time: a lambda's variable, not an expression to repeat."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(words: Column, size: int = WORDS) -> Column:
    """Hashes of all runs of ``size`` words; fewer words are one shingle, no word none."""

    def runs(w):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))

    return once(words, runs)


def words_of(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = WORDS) -> Column:
    """The fingerprint of a text as array<bigint>; a null or wordless text has an empty one."""
    return bottom(shingles(words_of(F.coalesce(text, F.lit(""))), size), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that both hold. Two empty ones are alike."""

    def share(union):
        shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))

    return once(merged(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(a, k).cast("double") - LOWEST) / (2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds: the intersection, by resemblance and union size, over a's size."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_sketches(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from sketches of parts: hashes are made distinct and ranked, never gathered unbounded.

    A hash behind the k-th of its own part is not in the part's sketch, so a key with m parts has at most m * k rows;
    a first ranking inside (key, 64 hash buckets) keeps a key of very many parts from meeting in one task.
    """
    rows = parts.select(key, F.explode(column).alias("h")).distinct()
    first = Window.partitionBy(key, F.pmod("h", F.lit(64))).orderBy("h")
    cut = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    least = F.slice(F.sort_array(F.collect_list("h")), 1, k)
    return cut.groupBy(key).agg(least.alias(column))


def followed_by(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, bucket) of all rows, and (first_id, bucket): which document follows each bucket's last one.

    Buckets are ranges of doc_id of about equal size, cut at approximate quantiles. The document after a bucket's last
    one is the first of the next non-empty bucket; a stand-in of that row is added to the bucket it follows, so a window
    inside the bucket sees every document's successor and no window spans the table. The first document follows the
    last one.
    """
    rows = whole_text(docs).filter("doc_id IS NOT NULL")
    dealt = rows.withColumn("bucket", id_range(rows, RANGE_ROWS, MOST_RANGES))
    first = dealt.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    around = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy()))
    heads = first.select("first_id", before.alias("bucket"))  # one row per bucket
    return dealt, heads


def edited_pairs(docs: DataFrame, k: int = K, size: int = WORDS) -> DataFrame:
    """Each document with its edited text and the sketches of both and of the next document.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many of the next
    document by ascending doc_id (all of them if it has fewer); the last document is followed by the first, a single
    one by itself. Null texts are empty, rows without doc_id have no place in the order and are left out, rows of
    equal doc_id are ordered by text. Texts are shuffled once, by range of ids.
    """
    dealt, heads = followed_by(docs)
    texts = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("turn"))
    # Of rows that share the least id of a bucket, the first by text follows the bucket before.
    stand = dealt.drop("bucket").join(F.broadcast(heads), dealt["doc_id"] == heads["first_id"]).groupBy("doc_id", "bucket").agg(F.min("text").alias("text"))
    rows = texts.union(stand.select("doc_id", "text", "bucket", F.lit(1).alias("turn")))
    order = Window.partitionBy("bucket").orderBy("turn", "doc_id", "text")
    own = rows.withColumn("sketch", sketch(F.col("text"), k, size))
    found = own.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter("turn = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    found = found.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    return found.withColumn("edited_sketch", sketch(F.col("edited"), k, size))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


@query("op8_document_fingerprints")
def op8(spark, sf_dir):
    found = edited_pairs(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.round(distinct_shingles(F.col("sketch")), 3).alias("distinct_shingles"),
    )
