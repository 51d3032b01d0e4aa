"""Run numpy helpers over bounded, ordered groups of rows.

Spark partitions and sorts by the group key; one Python call then walks many groups per Arrow batch,
so small groups cost microseconds and a group is never larger than its block plus halo.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest series handed to a whole-series kernel; longer ones take the blocked path.
SERIES_LIMIT = 1 << 18


def arrange(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a group together and in order; persist the result to walk the same groups repeatedly.

    A window over the groups asks for this layout, so rows that already lie by some of the keys are not moved again.
    Its column stays in the result: without it, the window would be dropped.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place)


def per_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None],
    out: str,
    arranged: bool = False,
) -> DataFrame:
    """Apply ``fn`` to each key group's ordered columns; ``out`` is the DDL of the columns it returns.

    Key columns are repeated in front of the returned columns. ``arranged`` says the input comes
    from ``arrange`` with the same keys and order.
    """
    names = [f.name for f in T.StructType.fromDDL(out).fields]

    def each(cols, starts, ends):
        parts, sizes, firsts = {n: [] for n in names}, [], []
        for s, e in zip(starts, ends):
            got = fn({c: v[s:e] for c, v in cols.items()})
            if got is None:
                continue
            size = len(np.atleast_1d(got[names[0]]))
            sizes.append(size)
            firsts.append(s)
            for n in names:
                parts[n].append(np.atleast_1d(got[n]))
        if not sizes:
            return None
        return np.repeat(np.array(firsts), sizes), {n: np.concatenate(parts[n]) for n in names}

    return per_batch(df, keys, order, each, out, arranged)


def per_batch(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]] | None],
    out: str,
    arranged: bool = False,
) -> DataFrame:
    """``per_group`` for a function that works on many whole groups at once.

    ``fn`` gets the columns of an Arrow batch's groups and where each group starts and ends; it returns, for each row of
    its result, a row number of the group it belongs to, and the columns.
    """
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(key_fields + T.StructType.fromDDL(out).fields)

    def run(batches):
        held = None
        for batch in batches:
            pdf = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(pdf) == 0:
                continue
            cut = _boundaries(pdf, keys)
            held = pdf.iloc[cut[-1] :]
            done = _apply(pdf, cut)
            if done is not None:
                yield done
        if held is not None and len(held):
            done = _apply(held.reset_index(drop=True), np.array([0]), last=True)
            if done is not None:
                yield done

    def _boundaries(pdf, keys):
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def _apply(pdf, starts, last=False):
        ends = np.append(starts[1:], len(pdf)) if last else starts[1:]
        starts = starts[: len(ends)]
        if not len(ends):
            return None
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        found = fn(cols, starts, ends)
        if found is None:
            return None
        rep, made = found
        return pd.DataFrame({k: cols[k][rep] for k in keys} | made)

    return (df if arranged else arrange(df, keys, order)).mapInPandas(run, schema)
