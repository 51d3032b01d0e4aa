"""Order-dependent primitives that do not need one task per series.

A plain ``Window.partitionBy(subject)`` puts a whole recording into one task. One recording may
hold a third of the data, so everything here first cuts the order axis:

* ``cumulate`` splits the order axis of all keys into ranges of equal depth, runs the window inside
  (key, range), and adds per-range offsets.
* ``blocked`` cuts an already indexed series into fixed-size blocks and copies a few halo rows over
  each border, so lag/lead/sliding windows run inside (key, block).

When no key exceeds ``rows_per_bucket`` (measured, one column-pruned count) the plain window is used.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.sources.store import reliable

ROWS_PER_BUCKET = 1 << 21
BLOCK = 1 << 16
BROADCAST_ROWS = 1_000_000
GLOBAL_BUCKET = 1 << 17
COLLECT_ROWS = 1 << 16  # rows of one group that may be collected in an array
VALUE_MAP = 1 << 19  # distinct values the built-in percentile may hold for one group


#: (keys, rows), the innermost last: no group of these keys, or of more keys, has more rows. Set by ``bounded`` alone.
KNOWN: list[tuple[frozenset[str], int]] = []


@contextmanager
def bounded(keys: list[str], rows: int):
    """Inside, groups of ``keys`` have at most ``rows`` rows, as the caller has counted; plans need not count again.

    The number only chooses between plans that give the same result.
    """
    KNOWN.append((frozenset(keys), rows))
    try:
        yield
    finally:
        KNOWN.pop()


def largest_known(keys: list[str]) -> int | None:
    """What ``bounded`` says about groups of these keys; None outside."""
    return KNOWN[-1][1] if KNOWN and KNOWN[-1][0] <= set(keys) else None


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows under the heaviest key, counted unless ``bounded`` (partial counts combine map-side; one row reaches the driver)."""
    known = largest_known(keys)
    if known is not None:
        return known
    counts = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.max("n").alias("m")).first()["m"] or 0)


def attach(
    df: DataFrame, keys: list[str], aggs: dict[str, Column], max_rows: int | None = None, limit: int = 1 << 18
) -> DataFrame:
    """Add per-key aggregates to every row: a window while groups are small, else aggregate and join.

    The window reuses the rows' partitioning and reads them once; the join never gathers a group.
    """
    if max_rows is None:
        max_rows = largest_group(df, keys)
    if max_rows <= limit:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: e.over(w) for n, e in aggs.items()})
    return _join_on(df, df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()]), keys)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only when a bounded count proves the side small; else leave the join to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL keys included, so that the result is that of a window over the keys."""
    if not keys:  # the statistics side is exactly one row
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys]
    return left.join(right, reduce(and_, same), how).drop(*[f"_k_{k}" for k in keys])


def cumulate(
    df: DataFrame,
    keys: list[str],
    by: Column,
    order: Iterable[Column | str],
    weights: dict[str, Column],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_rows: int | None = None,
    kind: str = "sum",
) -> DataFrame:
    """Inclusive running sums (or minima) of ``weights`` per key along ``order``.

    Rows that are equal in all of ``order`` stay in one bucket, so make them one row with a weight where many are.
    ``by`` is a number that never decreases along ``order``; callers give it, the buckets need only ``order``.
    ``max_rows`` is the largest group size if the caller already knows it.
    """
    order = list(order)
    agg = {"sum": F.sum, "min": F.min}[kind]
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if max_rows is None:
        max_rows = largest_group(df, keys)
    if not keys:  # one global order: keep it spread over tasks
        rows_per_bucket = min(rows_per_bucket, GLOBAL_BUCKET)
    if max_rows <= rows_per_bucket:
        w = running(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumns({name: agg(expr).over(w) for name, expr in weights.items()})

    # Ranges of equal depth along (keys, order), as Spark samples them: outliers, ties in the first order column and long
    # common prefixes of strings make no large bucket. They are stored, as a second sample would cut elsewhere.
    parts = -(-3 * df.count() // (2 * rows_per_bucket))
    tagged = df.repartitionByRange(parts, *keys, *order).withColumn("_b", F.spark_partition_id().cast("long"))
    tagged = reliable(tagged)
    sums = tagged.groupBy(*keys, "_b").agg(*[agg(e).alias(f"_s_{n}") for n, e in weights.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", *[agg(f"_s_{n}").over(before).alias(f"_o_{n}") for n in weights])
    w = running(Window.partitionBy(*keys, "_b").orderBy(*order))
    local = tagged.withColumns({n: agg(e).over(w) for n, e in weights.items()})
    out = _join_on(local, offsets, [*keys, "_b"])
    if kind == "sum":
        merged = {n: F.col(n) + F.coalesce(f"_o_{n}", F.lit(0)) for n in weights}
    else:  # least() skips the NULL offset of the first bucket
        merged = {n: F.least(n, f"_o_{n}") for n in weights}
    out = out.withColumns(merged)
    return out.drop("_b", *[f"_o_{n}" for n in weights])


def position(
    df: DataFrame,
    keys: list[str],
    by: Column,
    order: Iterable[Column | str],
    name: str = "frame_idx",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_rows: int | None = None,
) -> DataFrame:
    """Zero-based position of each row in its key's order (a skew-safe row_number)."""
    out = cumulate(df, keys, by, order, {name: F.lit(1).cast("long")}, rows_per_bucket, max_rows)
    return out.withColumn(name, F.col(name) - 1)


def hashed_position(df: DataFrame, u: str, order: list[Column | str], name: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Zero-based position of each row in one order of all rows that begins with ``u``, a hash spread evenly over (0, 1).

    Equal parts of (0, 1) hold about as many rows each, so nothing is sampled or stored: their rows are counted from the
    hash alone, and rows are moved once.
    """
    parts = max(1, -(-largest_group(df, []) // (rows_per_bucket or GLOBAL_BUCKET)))
    part = F.least(F.floor(F.col(u) * parts), F.lit(parts - 1)).cast("long")
    counts = df.select(part.alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = df.withColumn("_b", part).withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    out = own.join(F.broadcast(offsets), "_b", "left")  # every part has its offset
    return out.withColumn(name, F.col(name) + F.col("_o") - 1).drop("_b", "_o")


def blocked(
    df: DataFrame, idx: str = "frame_idx", before: int = 1, after: int = 1, size: int = BLOCK
) -> DataFrame:
    """Add ``_blk`` and ``_core``; border rows are copied into the neighbour block as halo.

    Window over ``partitionBy(*keys, '_blk').orderBy(idx)`` and keep rows with ``_core``.
    """
    if max(before, after) > size:
        raise ValueError("halo wider than a block")
    own = F.floor(F.col(idx) / F.lit(size)).cast("long")
    rest = F.pmod(F.col(idx), F.lit(size))
    targets = F.array_compact(
        F.array(
            own,
            F.when(rest >= size - before, own + 1),
            F.when((rest < after) & (own > 0), own - 1),
        )
    )
    out = df.withColumn("_blk", F.explode(targets))
    return out.withColumn("_core", F.col("_blk") == F.floor(F.col(idx) / F.lit(size)))


def neighbours(
    df: DataFrame,
    keys: list[str],
    shifts: dict[str, tuple[Column | str, int]],
    idx: str = "frame_idx",
    size: int = BLOCK,
    max_rows: int | None = None,
) -> DataFrame:
    """Add columns from rows k positions away: ``{'prev': ('x', -1), 'next': ('x', 1)}``.

    Groups that are known to have at most ``size`` rows (``max_rows``, or by ``bounded``) are one block each.
    """
    before = max([0] + [-k for _, k in shifts.values() if k < 0])
    after = max([0] + [k for _, k in shifts.values() if k > 0])
    if max_rows is None:
        max_rows = largest_known(keys)
    whole = max_rows is not None and max_rows <= size
    w = Window.partitionBy(*keys, *([] if whole else ["_blk"])).orderBy(idx)
    cols = {
        name: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) for name, (c, k) in shifts.items()
    }
    if whole:
        return df.filter(F.col(idx).isNotNull()).withColumns(cols)
    return blocked(df, idx, before, after, size).withColumns(cols).filter("_core").drop("_blk", "_core")


def running_sum(
    df: DataFrame, keys: list[str], cols: dict[str, Column | str], idx: str = "frame_idx", size: int = BLOCK, max_rows: int | None = None
) -> DataFrame:
    """Inclusive running sums along ``idx`` as in-block sums plus block offsets.

    Groups that are known to have at most ``size`` rows (``max_rows``) are one block each, so rows are not moved for offsets.
    """
    if max_rows is not None and max_rows <= size:
        w = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) + F.lit(0.0) for n, c in cols.items()})
    tagged = df.withColumn("_blk", F.floor(F.col(idx) / F.lit(size)).cast("long"))
    w = Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumns({n: F.sum(c).over(w) for n, c in cols.items()})
    sums = tagged.groupBy(*keys, "_blk").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in cols.items()])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in cols]
    )
    out = _join_on(local, offsets, [*keys, "_blk"])
    out = out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in cols})
    return out.drop("_blk", *[f"_o_{n}" for n in cols])


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    extra: list[Column] = (),
    rows_per_bucket: int = VALUE_MAP,
    max_rows: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, plus ``extra`` aggregates of the same rows.

    Small groups use the built-in ``percentile``. Beyond ``rows_per_bucket`` its value map would not
    fit one task, so ranks come from ``position`` and only the two rows around each rank are kept.
    """
    df = df.filter(F.col(value).isNotNull())
    if max_rows is None:
        max_rows = largest_group(df, keys)
    if max_rows <= rows_per_bucket:
        qs = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()])).alias("_q")
        out = df.groupBy(*keys).agg(qs, *extra)
        return out.select(
            "*", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(probs)]
        ).drop("_q")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = position(df, keys, F.col(value), [value], "_pos", rows_per_bucket, max_rows)
    ranked = _join_on(ranked, counts, keys)
    aggs = list(extra)
    for n, p in probs.items():
        at = F.lit(p) * (F.col("_cnt") - 1)
        lo = F.max(F.when(F.col("_pos") == F.floor(at), F.col(value)))
        hi = F.max(F.when(F.col("_pos") == F.ceil(at), F.col(value)))
        frac = F.max(at - F.floor(at))
        aggs.append((lo + (hi - lo) * frac).alias(n))
    return ranked.groupBy(*keys).agg(*aggs)


def wide_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: dict[str, float], max_rows: int | None = None, limit: int = COLLECT_ROWS
) -> DataFrame:
    """Percentiles of several columns at once as rows (keys, channel, <probs>).

    Small groups collect each row once for all columns and sort one array per column; larger groups
    are stacked and ranked by ``quantiles``.
    """
    if max_rows is None:
        max_rows = largest_group(df, keys)
    if max_rows > limit:
        long = df.select(*keys, *columns).unpivot(keys, columns, "channel", "value")
        found = quantiles(long, [*keys, "channel"], "value", probs, max_rows=max_rows)
        # A channel without values has a row of NULLs, as in small groups.
        cells = df.groupBy(*keys).agg(F.array(*[F.lit(c) for c in columns]).alias("_c"))
        return _join_on(cells.select(*keys, F.explode("_c").alias("channel")), found, [*keys, "channel"], "left")
    found = quantile_cells(df, keys, columns, probs).select(*keys, F.posexplode("_q").alias("_i", "_c"))
    channel = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_i"))
    return found.select(*keys, channel.alias("channel"), "_c.*")


def quantile_cells(df: DataFrame, keys: list[str], columns: list[str], probs: dict[str, float], also: list[str] = ()) -> DataFrame:
    """One row per key with ``_q``: for each of ``columns`` in turn a struct of its percentiles. For small groups.

    Rows are read with the columns ``also``, so that a plan that moves them for something else can use the same exchange.
    """
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*also, *columns)).alias("_r"))
    names = [f"_v{i}" for i in range(len(columns))]
    rows = rows.select(*keys, *[F.sort_array(F.array_compact(F.col("_r")[c])).alias(n) for c, n in zip(columns, names)])

    def at(v: Column, p: float) -> Column:
        x = F.lit(p) * (F.size(v) - 1)
        lo = F.get(v, F.floor(x).cast("int"))
        return lo + (F.get(v, F.ceil(x).cast("int")) - lo) * (x - F.floor(x))

    each = F.transform(F.array(*names), lambda v: F.struct(*[at(v, p).alias(n) for n, p in probs.items()]))
    return rows.select(*keys, each.alias("_q"))


def average_ranks(
    df: DataFrame, keys: list[str], value: str, name: str = "rank", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rank with ties averaged, as (keys, value, tie count, rank): one row per distinct value."""
    distinct = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    cum = cumulate(distinct, keys, F.col(value), [value], {"_cum": F.col("ties")}, rows_per_bucket)
    return cum.withColumn(name, F.col("_cum") - (F.col("ties") - 1) / F.lit(2.0)).drop("_cum")


def nearest_sides(
    events: DataFrame, points: DataFrame, keys: list[str], time: str, payload: list[str], width: float
) -> DataFrame:
    """Attach to each event the last point at or before it and the first point after it.

    Events and points are merged inside (key, time bucket); a bucket without a hit takes the carry of
    the nearest non-empty bucket from a table with one row per (key, bucket).
    """
    bucket = F.floor(F.col(time) / F.lit(float(width))).cast("long")
    item = F.struct(F.col(time).alias("t"), *payload)
    ev = events.withColumns({"_b": bucket, "_kind": F.lit(1), "_pt": F.lit(None)})
    pt = points.select(*keys, time, item.alias("_pt")).withColumns({"_b": bucket, "_kind": F.lit(0)})
    ev = ev.withColumn("_pt", F.lit(None).cast(pt.schema["_pt"].dataType))
    both = ev.unionByName(pt, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy(time, "_kind")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns(
        {"_prev": F.last("_pt", ignorenulls=True).over(back), "_next": F.first("_pt", ignorenulls=True).over(ahead)}
    ).filter("_kind = 1")
    edges = pt.groupBy(*keys, "_b").agg(F.min("_pt").alias("_lo"), F.max("_pt").alias("_hi"))
    grid = edges.unionByName(ev.select(*keys, "_b").distinct(), allowMissingColumns=True)
    grid = grid.groupBy(*keys, "_b").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    gw = Window.partitionBy(*keys).orderBy("_b")
    carry = grid.select(
        *keys,
        "_b",
        F.last("_hi", ignorenulls=True).over(gw.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
        F.first("_lo", ignorenulls=True).over(gw.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"),
    )
    out = both.join(carry, [*keys, "_b"], "left")
    out = out.withColumns({"prev": F.coalesce("_prev", "_cp"), "next": F.coalesce("_next", "_cn")})
    return out.drop("_b", "_kind", "_pt", "_prev", "_next", "_cp", "_cn")
