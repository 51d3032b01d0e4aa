"""Shards by jump consistent hashing, written as one folder of Parquet files a shard.

A row's shard follows from its key and the number of shards alone: a generator seeded with the key's hash jumps over
the shard numbers, and the last one below the number of shards is the row's. There is no ring table to keep or send.
When a shard is appended, a row either stays or goes to the new shard, and about one in n + 1 rows goes.

Rows are written where they are read, without an exchange: a task writes one file to each shard's folder. A row's
slot is its place within its task's file of the shard, counted while the task runs, plus the rows that tasks of lower
number gave to the shard; those counts are one row a file, so no row is sorted or moved to be numbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm.common import query, table
from kinelake.sources.store import scratch_path

SHARDS = 16
#: Fixed values of the published algorithm: the generator's multiplier and the scale of its upper 31 bits.
MULTIPLIER, SCALE = np.uint64(2862933555777941757), float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. All keys jump at once; those that have passed the last shard are put aside."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    out = np.zeros(len(keys), np.int32)
    live = np.arange(len(keys))
    state = keys.astype(np.uint64)
    at = np.zeros(len(keys), np.int64)
    while len(live):
        out[live] = at
        state = state * MULTIPLIER + np.uint64(1)
        at = ((at + 1) * (SCALE / ((state >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        inside = at < shards
        live, state, at = live[inside], state[inside], at[inside]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key of any type; a null key is a key like any other."""

    @F.pandas_udf("int")
    def assign(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards))

    return assign(F.xxhash64(key))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write whole rows under ``path``, one folder ``shard=N`` for each shard that has rows.

    Null keys share one shard, repeated rows each have a row of their own, an empty table writes no row. The rows lie
    whole in a column ``row``, so columns named like those added here (``part``, ``place``, ``shard``) are kept as well.
    """

    @F.pandas_udf("struct<shard int, place long>")
    def placed(hashes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        given = np.zeros(shards, np.int64)  # rows that this task has given to each shard
        for h in hashes:
            shard = jump(h.to_numpy(np.int64).view(np.uint64), shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pd.DataFrame({"shard": shard, "place": place + given[shard]})
            given += counts

    found = rows.select(F.struct(*(rows[c] for c in rows.columns)).alias("row"), placed(F.xxhash64(rows[key])).alias("at"), F.spark_partition_id().alias("part"))
    found.select("row", "part", "at.place", "at.shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(row, shard, slot) of what ``write_shards`` wrote: slots run from 0 without a gap in every shard.

    ``schema`` is the DDL of the written rows; it is needed only where the table may have been empty.
    """
    if schema is not None:
        stored = spark.read.schema(f"row struct<{schema}>, part int, place long, shard int").parquet(path)
    else:
        stored = spark.read.parquet(path)
    files = stored.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    return stored.join(files.select("shard", "part", before.alias("before")), ["shard", "part"]).select("row", "shard", (F.col("before") + F.col("place")).alias("slot"))


@query("op13_jump_shards")
def op13(spark, sf_dir):
    """Groups (equal texts) have no say in this law: a row's key is its doc_id, and copies have ids of their own."""
    path = scratch_path(spark, "shards")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    write_shards(docs, path)
    kept = read_shards(spark, path, "doc_id: bigint, text: string")
    data = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return kept.select(
        "row.doc_id",
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("row.doc_id"), SHARDS + 1).alias("grown_shard"),
    )
