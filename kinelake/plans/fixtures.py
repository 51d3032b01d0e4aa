"""Motion tables derived from the driver's parquet tables.

The same expression text serves Spark and the oracle SQL, so both sides see identical inputs.
``lineitem`` stands for the frame stream: supplier = subject, ship year = task, row order = time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING
from kinelake.operators import ordering

SUBJECT = "concat(CASE WHEN l_suppkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(l_suppkey AS STRING))"
GRP = "CASE WHEN l_suppkey % 3 = 0 THEN 'control' ELSE 'patient' END"
TASK = "CAST((year(l_shipdate) - 1995) % 6 + 1 AS INT)"

FORMULAS = dict(
    zip(
        CHANNELS,
        [
            "l_quantity * 1.73205081173e-2",
            "l_extendedprice * 1.31415921173e-5",
            "l_discount * 7.31782451173e0 + l_tax * 3.17623181173e0",
            "(l_extendedprice * 3.71828181173e-3) % 3.6e2",
            "(l_quantity * 1.371828171173e1) % 3.6e2",
            "(l_discount * 2.91141421173e3 + l_tax * 1.77732051173e3) % 3.6e2",
            "(l_partkey % 97) * 2.13141591173e-2",
            "l_quantity * 9.17320511173e-3 + l_discount * 1.31415931173e0",
            "l_extendedprice * 7.18281831173e-6 - l_tax * 2.31782461173e0",
            "(l_extendedprice * 1.01980391173e-2) % 3.6e2",
            "(l_partkey * 7.34846921173e0) % 3.6e2",
            "(l_quantity * 2.93761611173e1 + l_tax * 9.11732051173e2) % 3.6e2",
            "(l_orderkey % 89) * 1.79142131173e-2",
            "l_tax * 1.17416571173e1 + l_quantity * 5.74456261173e-3",
            "l_extendedprice * 9.32737911173e-6 + l_discount * 2.91547591173e0",
            "(l_orderkey * 3.74165731173e0) % 3.6e2",
            "(l_quantity * 1.71464281173e1 + l_discount * 1.31381451173e3) % 3.6e2",
            "(l_extendedprice * 7.38241151173e-3 + l_partkey * 1.92353841173e0) % 3.6e2",
        ],
    )
)
FRAME_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def largest(df: DataFrame, sf: str, tag: str, keys: list[str]) -> int:
    """Largest group of a fixture."""
    return ordering.largest_group(df, keys)


def counted_once(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For queries whose steps work by recording, or by parts of one, and repeat no row of it.

    The longest recording is counted in the table; without that, each step that asks would run all steps before it.
    """

    @wraps(fn)
    def run(spark, sf):
        keys = table(spark, sf, "lineitem").select(F.expr(SUBJECT).alias("subject_id"), F.expr(TASK).alias("task"))
        with ordering.bounded(RECORDING, largest(keys, sf, "frames", RECORDING)):
            return fn(spark, sf)

    return run


def frames(spark: SparkSession, sf: str, channels: list[str] = CHANNELS) -> DataFrame:
    """Wide recordings: subject_id, task, grp, frame_idx, t_s and the requested channels.

    Rows are put in order as the table has them; channels are worked out behind that exchange.
    """
    raw = table(spark, sf, "lineitem")
    raw = raw.select(F.expr(SUBJECT).alias("subject_id"), F.expr(TASK).alias("task"), *raw.columns)
    by = F.unix_date(F.to_date("l_shipdate")) + F.col("l_orderkey") / F.lit(float(1 << 40))
    out = ordering.position(
        raw, ["subject_id", "task"], by, FRAME_ORDER, max_rows=largest(raw, sf, "frames", ["subject_id", "task"])
    )
    return out.withColumn("t_s", F.col("frame_idx") / F.lit(50.0)).select(
        "subject_id", "task", F.expr(GRP).alias("grp"), "frame_idx", "t_s", *[F.expr(FORMULAS[c]).alias(c) for c in channels]
    )


def frames_sql(channels: list[str] = CHANNELS) -> str:
    """The body of a ``frames`` CTE."""
    cols = ", ".join(f"{FORMULAS[c]} AS {c}" for c in channels)
    return (
        f"SELECT {SUBJECT} AS subject_id, {TASK} AS task, {GRP} AS grp, "
        "row_number() OVER (PARTITION BY l_suppkey, (year(l_shipdate) - 1995) % 6 "
        f"ORDER BY {', '.join(FRAME_ORDER)}) - 1 AS frame_idx, "
        "(row_number() OVER (PARTITION BY l_suppkey, (year(l_shipdate) - 1995) % 6 "
        f"ORDER BY {', '.join(FRAME_ORDER)}) - 1) / 5e1 AS t_s, {cols} FROM lineitem"
    )


def long_frames_sql(channels: list[str] = CHANNELS) -> str:
    """CTEs ``frames`` and ``series`` (one row per frame and channel)."""
    return (
        f"frames AS ({frames_sql(channels)}), series AS (SELECT subject_id, task, grp, frame_idx, t_s, channel, value "
        f"FROM frames UNPIVOT (value FOR channel IN ({', '.join(channels)})))"
    )


def to_series(df: DataFrame, channels: list[str], ids: list[str] | None = None) -> DataFrame:
    """Wide frames to (.., channel, value) rows; an Expand, no shuffle."""
    ids = ids or [c for c in df.columns if c not in channels]
    return df.unpivot(ids, channels, "channel", "value")


# Subject metadata from ``customer``: one row per subject, ids as in the frame stream.
SUBJECTS_SQL = """SELECT concat(CASE WHEN c_custkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(c_custkey AS STRING)) AS id,
  CAST((c_custkey * 7) % 130 AS INT) AS age, CAST(c_nationkey % 2 AS INT) AS sex,
  CAST(c_custkey % 6 AS INT) AS dia_code,
  CASE WHEN c_custkey % 5 = 0 THEN '  ' WHEN c_custkey % 5 = 1 THEN NULL ELSE c_mktsegment END AS diagnosis,
  CASE WHEN c_nationkey % 3 = 0 THEN '1' WHEN c_nationkey % 3 = 1 THEN '0' ELSE NULL END AS dia_side_r,
  CASE WHEN c_custkey % 4 = 0 THEN '1' WHEN c_custkey % 4 = 1 THEN 'x' ELSE '0' END AS dia_side_l,
  CASE c_mktsegment WHEN 'MACHINERY' THEN '1' WHEN 'BUILDING' THEN 'right' WHEN 'AUTOMOBILE' THEN '0'
    WHEN 'FURNITURE' THEN ' Left ' ELSE NULL END AS hand_xr,
  c_acctbal / 1e2 AS c_dash, c_acctbal / 3e2 AS x_dash,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 1.7e2 END AS c_and_x,
  c_mktsegment AS segment, c_nationkey AS nation FROM customer"""


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SUBJECTS_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer"))


# Survey answers from ``conversations``: one subject per conversation, one question per turn (repeats happen).
SURVEY_SQL = """SELECT CAST(conv_id AS STRING) AS subject_id, CAST(turn % 6 + 1 AS INT) AS q, turn AS row_no,
  CASE CAST(length(text) % 9 AS INT) WHEN 0 THEN ' 3 ' WHEN 1 THEN 'No Difficulty' WHEN 2 THEN 'mild_difficulty'
    WHEN 3 THEN 'so much difficulty that I can’t move' WHEN 4 THEN 'Unable' WHEN 5 THEN '4.0' WHEN 6 THEN 'banana'
    WHEN 7 THEN '' ELSE 'Can’t sleep' END AS response
  FROM conversations"""


def survey(spark: SparkSession, sf: str) -> DataFrame:
    src = SURVEY_SQL.replace("FROM conversations", "FROM {conversations}")
    return spark.sql(src, conversations=table(spark, sf, "conversations"))


# Decoded states from ``events``: subject = user, frame order = ts, state = event type code.
STATES_SQL = """SELECT user_id AS subject_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 1 ELSE 2 END AS state,
  value FROM events"""


def states(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        F.col("user_id").alias("subject_id"),
        "ts",
        "event_id",
        F.expr(
            "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 1 ELSE 2 END"
        ).alias("state"),
        "value",
    )
    out = ordering.position(
        raw, ["subject_id"], F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"],
        max_rows=largest(raw, sf, "states", ["subject_id"]),
    )
    return out.select("subject_id", "frame_idx", "state", "value")


# Binary predictions from ``orders``: one sample per order, subject = customer, fold = customer, config = priority.
PREDS_SQL = """SELECT concat(CASE WHEN o_orderstatus = 'F' THEN 'g1_' ELSE 'g0_' END, CASE WHEN o_custkey % 3 = 0 THEN 'fx' ELSE 'px' END,
    CAST(o_custkey AS STRING), '_trial', CAST(o_orderkey AS STRING)) AS sample_id,
  concat(CASE WHEN o_custkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(o_custkey AS STRING)) AS subject_id,
  CAST(o_orderkey % 6 + 1 AS INT) AS task, CAST(o_custkey % 4 + 1 AS INT) AS paradigm, o_orderpriority AS model,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true,
  CASE WHEN round((CAST(round(o_totalprice * 100) AS BIGINT) % 997) / 9.97e2 * 8e-1 + CASE WHEN o_orderstatus = 'F' THEN 2e-1 ELSE 0e0 END, 3) >= 5e-1
    THEN 1 ELSE 0 END AS y_pred,
  round((CAST(round(o_totalprice * 100) AS BIGINT) % 997) / 9.97e2 * 8e-1 + CASE WHEN o_orderstatus = 'F' THEN 2e-1 ELSE 0e0 END, 3) AS y_proba
  FROM orders"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PREDS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


# Two-label predictions from ``labels`` and ``documents``.
LABEL_PREDS_SQL = """SELECT CAST(l.doc_id AS STRING) AS sample_id, label, y_true, CASE WHEN p >= 5e-1 THEN 1 ELSE 0 END AS y_pred, p AS y_proba FROM (
    SELECT doc_id, 'quality' AS label, CAST(quality AS INT) AS y_true FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS INT) FROM labels) l
  JOIN (SELECT doc_id, 'quality' AS lb, round(((n_chars * 7 + doc_id * 13) % 101) / 1.01e2, 2) AS p FROM documents
    UNION ALL SELECT doc_id, 'toxic', round(((n_chars * 5 + doc_id * 29) % 103) / 1.03e2, 2) FROM documents) d ON d.doc_id = l.doc_id AND d.lb = l.label"""


def label_predictions(spark: SparkSession, sf: str) -> DataFrame:
    src = LABEL_PREDS_SQL.replace("FROM labels", "FROM {labels}").replace("FROM documents", "FROM {documents}")
    return spark.sql(src, labels=table(spark, sf, "labels"), documents=table(spark, sf, "documents"))


# Fold records from ``customer``: fold = customer, losses from the balance, model = market segment.
FOLDS_SQL = """SELECT c_custkey AS fold, c_mktsegment AS model, CAST(c_nationkey % 5 AS INT) AS config, CAST(c_nationkey % 3 + 1 AS INT) AS task,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE (c_acctbal - floor(c_acctbal / 9.7e1) * 9.7e1) / 3.1e2 END AS train_loss,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE (c_acctbal - floor(c_acctbal / 9.7e1) * 9.7e1) / 2.9e2 + (c_custkey % 13) / 1.7e2 END AS val_loss,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE (c_custkey % 17) / 1.7e1 END AS train_acc, (c_custkey % 19) / 1.9e1 AS val_acc,
  CAST(10 + c_custkey % 50 AS INT) AS epochs FROM customer"""


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(FOLDS_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer"))
