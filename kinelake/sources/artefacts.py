"""Experiment artefacts: checkpoints by name, summary JSON, prediction and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the shape of an experiment summary document.
SUMMARY_SCHEMA = """experiment_name STRING, config STRUCT<task: INT, paradigm: INT, model: STRING, method: STRING>,
  results STRUCT<metrics: STRUCT<ba: DOUBLE, recall: DOUBLE, precision: DOUBLE, f1: DOUBLE, auc: DOUBLE, auc_ci_low: DOUBLE, auc_ci_high: DOUBLE>,
    best_params: MAP<STRING, STRING>, feature_importance: MAP<STRING, DOUBLE>, X_shape: ARRAY<INT>>,
  evaluation STRUCT<balanced_accuracy: DOUBLE, roc_auc: DOUBLE>, diagnostics MAP<STRING, STRING>, _corrupt_record STRING"""
# Fixed value: how checkpoint names carry task, paradigm, model and balanced accuracy.
CHECKPOINT = r"T(\d+)_P(\d+)_([A-Za-z]+)_BA([0-9.]+)\.[A-Za-z]+$"


def checkpoint_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, task, paradigm, model, ba) of names that match; others are skipped."""
    part = lambda i: F.regexp_extract(path, CHECKPOINT, i)
    x = paths.filter(F.col(path).rlike(CHECKPOINT))
    return x.withColumns(
        {"task": part(1).cast("int"), "paradigm": part(2).cast("int"), "model": F.lower(part(3)), "ba": part(4).cast("double")}
    )


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified) without reading contents."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"))


def best_artefact(df: DataFrame, by: list[str], rank: list[Column]) -> DataFrame:
    """One row per key: highest by ``rank`` (a struct maximum combines map-side)."""
    cols = [c for c in df.columns if c not in by]
    top = F.max_by(F.struct(*cols), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    return df.groupBy(*by).agg(top.alias("_t")).select(*by, "_t.*")


def frequency_of(name: Column | str) -> Column:
    f = F.regexp_extract(name, r"_f(\d+)", 1)
    return F.when(f != "", f.cast("int"))


def source_of(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.contains("ABL_EW_"), "event_windows").otherwise("full_recordings")


def experiment_summaries(raw: DataFrame) -> DataFrame:
    """Flat rows of parsed summaries; broken documents dropped, metrics fall back to ``evaluation``."""
    ok = raw.filter(F.col("_corrupt_record").isNull() & F.col("config").isNotNull()) if "_corrupt_record" in raw.columns else raw
    m, e = F.col("results.metrics"), F.col("evaluation")
    return ok.select(
        "experiment_name",
        "config.task",
        "config.paradigm",
        "config.model",
        "config.method",
        F.coalesce(m["ba"], e["balanced_accuracy"]).alias("ba"),
        F.coalesce(m["auc"], e["roc_auc"]).alias("auc"),
        m["f1"].alias("f1"),
        frequency_of("experiment_name").alias("freq"),
        source_of("experiment_name").alias("data_source"),
        F.array_join(
            F.transform(F.array_sort(F.map_entries("results.best_params")), lambda kv: F.concat_ws("=", kv["key"], kv["value"])), ","
        ).alias("best_params"),
        F.col("results.feature_importance").alias("feature_importance"),
        "diagnostics",
    )


def read_experiments(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON document per file."""
    raw = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    return experiment_summaries(raw)


def importance_rows(summaries: DataFrame) -> DataFrame:
    return summaries.select("task", "paradigm", "model", F.explode("feature_importance").alias("channel", "importance"))


def finite(c: str) -> Column:
    """NaN and infinities to NULL, as JSON has no words for them."""
    v = F.col(c).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def write_json(df: DataFrame, path: str, doubles: list[str]) -> None:
    df.withColumns({c: finite(c) for c in doubles}).write.mode("overwrite").json(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """Binary prediction rows; the job fails when an id prefix contradicts its label."""
    from kinelake.operators.evaluate import check_id_labels, prediction_labels

    cols = ["sample_id", "subject", "window_desc", "y_true", "y_pred", "y_proba", "correct", "error_type"]
    prediction_labels(check_id_labels(preds)).select(*cols).write.mode("overwrite").option("header", True).csv(path)


def multilabel_wide(preds: DataFrame, labels: list[str]) -> DataFrame:
    """One row per sample with y_true_/y_pred_/y_proba_ columns per label and the match columns."""
    from kinelake.operators.evaluate import exact_matches

    cell = lambda v, l: F.max(F.when(F.col("label") == l, F.col(v))).alias(f"{v}_{l}")
    wide = preds.groupBy("sample_id").agg(*[cell(v, l) for v in ("y_true", "y_pred", "y_proba") for l in labels])
    return wide.join(exact_matches(preds).withColumn("labels_wrong", F.array_join("labels_wrong", ",")), "sample_id")


def write_feature_table(wide: DataFrame, path: str, ids: list[str]) -> DataFrame:
    """Id columns first, then the ``ext_`` columns in sorted order."""
    out = wide.select(*ids, *sorted(c for c in wide.columns if c.startswith("ext_")))
    out.write.mode("overwrite").parquet(path)
    return out


def newest(df: DataFrame, by: list[str], when: str = "modified") -> DataFrame:
    """Latest file per key, the last name winning equal times; one row a key and task leaves the scan."""
    rest = [c for c in df.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct(when, "path")).alias("_last")
    return df.groupBy(*by).agg(last).select(*by, "_last.*").select(df.columns)
