"""What the text operators share: registration, table access, fold marks, batch helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.sources.store import reliable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows and bytes in one Arrow batch: texts may be long, so a batch is kept to some megabytes.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; its Python operators get small Arrow batches."""

    def register(fn):
        def run(spark, sf_dir):
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are left behind, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def id_range(rows: DataFrame, per_range: int, most: int) -> Column:
    """The number of the doc_id range a row lies in: ranges of about ``per_range`` rows, at most ``most``, ascending.

    Cuts are approximate quantiles of the id column, which is all that the two small jobs read; equal ids share a
    range. The driver gets the cuts alone, at most ``most`` numbers.
    """
    ranges = min(most, max(1, rows.count() // per_range))
    if ranges == 1:
        return F.lit(0)
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 4 * most)).first()[0]
    numbers = sorted(set(found or []))
    return F.size(F.filter(F.lit(numbers), lambda c: c < F.col("doc_id"))) if numbers else F.lit(0)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from: crc32(doc_id as text) mod 5 = 0. A null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ids_list(parts: list[bytes]) -> pa.ListArray:
    """Little-endian uint16 ids of each row as list<int>."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 2 for p in parts], out=offsets[1:])
    flat = np.frombuffer(b"".join(parts), "<u2").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph given as pairs of longs: (node, root), root the smallest node reached.

    Alternates the large-star and small-star steps of map-reduce component search until the star edges stay as they
    are. Both are a grouping on one column followed by a join on it, so a node with very many neighbours is
    pre-aggregated (min) and its rows stay splittable. Each round is checkpointed in the shared folder, so a lost
    executor costs no more than the round. Nodes without an edge are not returned.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = reliable(now)
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Large star links bigger neighbours to the smallest; small star links the smaller ones and the node itself.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = reliable(small.filter("u <> v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select("root", "root").distinct().toDF("node", "root"))
