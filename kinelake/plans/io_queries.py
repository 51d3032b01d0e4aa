"""Queries that write derived logs, artefacts and results and read them back, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING
from kinelake.functions.expr import rnd
from kinelake.operators import hmm, reshape
from kinelake.plans.evaluation_queries import rounded
from kinelake.plans.fixtures import (
    FOLDS_SQL,
    LABEL_PREDS_SQL,
    PREDS_SQL,
    SUBJECTS_SQL,
    SURVEY_SQL,
    folds,
    frames,
    frames_sql,
    label_predictions,
    predictions,
    subjects,
    survey,
    table,
)
from kinelake.plans.model_queries import CH, MODEL0, MODEL1, SCORE_SQL
from kinelake.plans.registry import query
from kinelake.sources import artefacts, logs, store
from kinelake.streaming import live


def as_csv(df, name, **options):
    path = store.scratch_path(df.sparkSession, name)
    df.write.options(header=True, **options).csv(path)
    return path


@query(
    "movement_log_scan",
    "SELECT concat('px', CAST(l_suppkey AS STRING)) AS subject_id, count(*) AS n, round(sum(l_quantity), 4) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1",
)
def movement_log_scan(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.concat(F.lit("px"), F.col("l_suppkey").cast("string")).alias("subject_id"),
        F.when(F.col("l_orderkey") % 9 == 0, "bad").otherwise(F.col("l_orderkey").cast("string")).alias(" TimeElapsed "),
        F.col("l_quantity").alias("HPosX "),
        F.col("l_extendedprice").alias(" HPosY"),
        F.col("l_tax").alias("unused"),
    )
    log = logs.movement_log(logs.read_csv_any(spark, as_csv(raw, "movement")), "TimeElapsed", ["HPosX", "HPosY"])
    return log.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("HPosX"), 4).alias("q"), rnd(F.avg("HPosY"), 4).alias("p")
    )


@query(
    "mixed_encoding_scan",
    "SELECT o_custkey AS subject_id, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1",
)
def mixed_encoding_scan(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_totalprice").cast("string").alias("v"))
    even = F.col("subject_id").cast("long") % 2 == 0
    a, b = as_csv(raw.filter(even), "utf8"), as_csv(raw.filter(~even), "utf16", encoding="UTF-16")
    both = logs.validate_columns(logs.read_csv_any(spark, [a, b]), ["subject_id", "v"], 1)
    return both.groupBy(F.col("subject_id").cast("long").alias("subject_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("v").cast("double")).alias("top")
    )


@query("marker_log_scan", "SELECT o_orderpriority AS name, count(*) AS n, CAST(min(o_orderkey) AS DOUBLE) AS first_ts FROM orders GROUP BY 1")
def marker_log_scan(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Timestamp"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("Marker Name")
    )
    m = logs.marker_log(logs.read_csv_any(spark, as_csv(raw, "markers")))
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query(
    "event_log_scan",
    """SELECT concat('u', CAST(user_id AS STRING)) AS subject_id, event_type AS event, count(*) AS n, round(sum(value), 4) AS progress,
      count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS with_hand FROM events WHERE event_id % 10 <> 3 GROUP BY ALL""",
)
def event_log_scan(spark, sf):
    raw = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.col("event_id").cast("string")).alias("Timestamp"),
        F.concat(F.lit("  "), "event_type").alias("Event"), F.col("value").alias("Progress"),
        F.when(F.col("event_id") % 2 == 0, "Left hand used").alias("Hand Used"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" ")).alias("Subject ID"),
    )
    e = logs.event_log(logs.read_csv_any(spark, as_csv(raw, "events")).drop("_file"))
    return e.groupBy("subject_id", "event").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("progress"), 4).alias("progress"), F.count("hand_used").alias("with_hand")
    )


@query(
    "survey_log_scan",
    f"SELECT subject_id, q, count(*) AS n, max(trim(response)) AS last_text FROM ({SURVEY_SQL}) WHERE trim(response) <> '' GROUP BY ALL",
)
def survey_log_scan(spark, sf):
    raw = survey(spark, sf).select(
        "subject_id", F.col("row_no").alias("Timestamp"), F.concat(F.lit("q"), F.col("q").cast("string")).alias("Question"), F.col("response").alias("Response")
    )
    # Files of two sources, one without headers, are one scan: columns go by place, and a header line is no answer.
    even = F.pmod(F.xxhash64("subject_id"), F.lit(2)) == 0
    bare = store.scratch_path(spark, "survey-bare")
    raw.filter(~even).write.csv(bare)
    both = logs.read_csv_any(spark, [as_csv(raw.filter(even), "survey"), bare], header=False)
    s = logs.survey_log(both.withColumnRenamed("_c0", "subject_id"))
    return s.groupBy("subject_id", "q").agg(F.count(F.lit(1)).alias("n"), F.max("response").alias("last_text"))


@query(
    "new_recording_scan",
    """SELECT CAST(user_id AS DOUBLE) AS user_id, count(*) AS n, count(CASE WHEN user_id % 2 = 0 THEN 1 END) AS n_timed, round(sum(value), 4) AS value,
      CAST(max(CASE WHEN user_id % 2 = 0 THEN event_id END) AS DOUBLE) AS last_t, 0 AS n_doubled FROM events GROUP BY 1""",
)
def new_recording_scan(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").alias("t"), "user_id", "value")
    path, timed = store.scratch_path(spark, "recordings"), F.col("user_id") % 2 == 0
    # Four kinds of files in one folder: with and without a header, with and without a time column.
    for header, third in ((True, 0), (False, 1)):
        part = raw.filter(F.pmod(F.floor(F.col("user_id") / 2), F.lit(2)) == third)
        part.filter(timed).write.mode("append").option("header", header).csv(path)
        part.filter(~timed).drop("t").write.mode("append").option("header", header).csv(path)
    x = logs.read_new_recordings(spark, path, ["user_id", "value"])
    same = x.groupBy("subject_id", "frame_idx").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("n_doubled"))
    found = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("n_timed"), rnd(F.sum("value"), 4).alias("value"), F.max("t").alias("last_t"))
    return found.join(F.broadcast(same))  # one row


@query("metadata_scan", f"SELECT id, age, dia_code, round(c_dash, 6) + 0 AS c_dash FROM ({SUBJECTS_SQL})")
def metadata_scan(spark, sf):
    px = subjects(spark, sf).select("id", "age", "dia_code", "c_dash")
    lines = px.select(F.concat_ws(",", *[F.col(c).cast("string") for c in px.columns]).alias("value"))
    # A title and a blank line come before the header, as in exported sheets.
    path = store.scratch_path(spark, "metadata")
    top = spark.createDataFrame([("Subject sheet,,,",), (" ,,,",), ("id,age,dia_code,c_dash",)], "value STRING")
    lines.write.text(path + "/rows")
    top.coalesce(1).write.text(path + "/head")
    names = logs.metadata_table(spark, path + "/head", ["dia_code"]).columns
    cells = F.from_csv("value", ", ".join(f"`{n}` STRING" for n in names))
    rows = spark.read.text(path + "/rows").select(cells.alias("r")).select("r.*")
    return rows.select("id", F.col("age").cast("int").alias("age"), F.col("dia_code").cast("int").alias("dia_code"), rnd(F.col("c_dash").cast("double")).alias("c_dash"))


@query(
    "subject_file_roster",
    f"""SELECT concat(CASE WHEN s_suppkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(s_suppkey AS STRING)) AS subject_id, CASE WHEN s_suppkey % 3 = 0 THEN 'control' ELSE 'patient' END AS grp,
      m.n AS n_movement, o.n AS n_markers, a.n AS n_survey FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) m ON m.l_suppkey = s_suppkey
      LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1) o ON o.o_custkey = s_suppkey
      LEFT JOIN (SELECT CAST(subject_id AS BIGINT) AS number, count(*) AS n FROM ({SURVEY_SQL}) GROUP BY 1) a ON a.number = s_suppkey""",
)
def subject_file_roster(spark, sf):
    name = lambda c: F.concat(F.when(F.col(c) % 3 == 0, "fx").otherwise("px"), F.col(c).cast("string"))
    roster = table(spark, sf, "supplier").select(
        name("s_suppkey").alias("subject_id"), F.when(F.col("s_suppkey") % 3 == 0, "control").otherwise("patient").alias("grp")
    )
    move = table(spark, sf, "lineitem").select(name("l_suppkey").alias("subject_id"))
    marks = table(spark, sf, "orders").filter("o_custkey % 5 <> 0").select(name("o_custkey").alias("subject_id"))
    answers = survey(spark, sf).withColumn("number", F.col("subject_id").cast("long")).select(name("number").alias("subject_id"))
    return logs.subject_files(move, marks, answers, roster)


@query(
    "recording_store_round_trip",
    f"WITH frames AS ({frames_sql(CHANNELS[:2])}) SELECT subject_id, count(*) AS n, round(sum(head_pos_x), 5) AS s FROM frames WHERE task = 4 AND grp = 'patient' GROUP BY 1",
)
def recording_store_round_trip(spark, sf):
    path = store.scratch_path(spark, "recordings")
    store.write_recordings(frames(spark, sf, CHANNELS[:2]), path)
    x = store.read_recordings(spark, path, 4, "patient")
    return x.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("head_pos_x"), 5).alias("s"))


CKPT_SQL = """ck AS (SELECT o_orderkey AS k, CAST(o_orderkey % 6 + 1 AS INT) AS task, CAST(o_custkey % 4 + 1 AS INT) AS paradigm, CASE o_orderkey % 3 WHEN 0 THEN 'hmm' WHEN 1 THEN 'rnn' ELSE 'cnn' END AS model,
  CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1e3 AS ba, o_orderdate AS modified,
  concat('runs/k', o_orderkey, '/T', o_orderkey % 6 + 1, '_P', o_custkey % 4 + 1, '_', upper(model), '_BA', format('{:.3f}', ba), '.json') AS path FROM orders WHERE o_orderkey % 7 <> 0)"""


def checkpoint_names(spark, sf):
    ba = F.format_string("%.3f", F.floor("o_totalprice") % 1000 / F.lit(1000.0))
    model = F.when(F.col("o_orderkey") % 3 == 0, "HMM").when(F.col("o_orderkey") % 3 == 1, "RNN").otherwise("CNN")
    name = F.concat(
        F.lit("runs/k"), F.col("o_orderkey").cast("string"), F.lit("/T"), (F.col("o_orderkey") % 6 + 1).cast("string"), F.lit("_P"),
        (F.col("o_custkey") % 4 + 1).cast("string"), F.lit("_"), model, F.lit("_BA"), ba, F.lit(".json"),
    )
    other = F.concat(F.lit("runs/notes_"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    return table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, other).otherwise(name).alias("path"), F.col("o_orderdate").alias("modified"))


@query("checkpoint_index", f"WITH {CKPT_SQL} SELECT task, paradigm, model, count(*) AS n, round(avg(ba), 6) AS ba FROM ck GROUP BY ALL")
def checkpoint_index(spark, sf):
    x = artefacts.checkpoint_index(checkpoint_names(spark, sf))
    return x.groupBy("task", "paradigm", "model").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("ba")).alias("ba"))


@query("best_checkpoint", f"""WITH {CKPT_SQL} SELECT task, paradigm, model, max(ba) AS ba, max(modified) AS newest,
  arg_max(path, concat(CAST(modified AS STRING), path)) AS newest_path, arg_max(path, concat(format('{{:.3f}}', ba), path)) AS best_path FROM ck GROUP BY ALL""")
def best_checkpoint(spark, sf):
    x = artefacts.checkpoint_index(checkpoint_names(spark, sf))
    by = ["task", "paradigm", "model"]
    best = artefacts.best_artefact(x, by, [F.col("ba"), F.col("path")]).select(*by, "ba", F.col("path").alias("best_path"))
    late = artefacts.newest(x, by).select(*by, F.col("modified").alias("newest"), F.col("path").alias("newest_path"))
    return best.join(late, by)


@query(
    "experiment_summaries",
    f"""SELECT concat(CASE WHEN fold % 2 = 0 THEN 'ABL_EW_' ELSE '' END, 'run', CAST(fold AS STRING), '_f', CAST(10 * (config + 1) AS STRING)) AS experiment_name, task, model,
      round(val_acc, 6) AS ba, round(val_loss, 6) AS f1, CAST(10 * (config + 1) AS INT) AS freq, CASE WHEN fold % 2 = 0 THEN 'event_windows' ELSE 'full_recordings' END AS data_source,
      concat('epochs=', CAST(epochs AS STRING), ',n=', CAST(config AS STRING)) AS best_params FROM ({FOLDS_SQL}) WHERE fold % 10 <> 4""",
)
def experiment_summaries(spark, sf):
    f = folds(spark, sf)
    name = F.concat(F.when(F.col("fold") % 2 == 0, "ABL_EW_").otherwise(""), F.lit("run"), F.col("fold").cast("string"), F.lit("_f"), (10 * (F.col("config") + 1)).cast("string"))
    metrics = F.struct(F.when(F.col("fold") % 3 != 0, F.col("val_acc")).alias("ba"), F.col("val_loss").alias("f1"))
    doc = F.to_json(
        F.struct(
            name.alias("experiment_name"),
            F.struct("task", F.lit(1).alias("paradigm"), "model", F.lit("pad").alias("method")).alias("config"),
            F.struct(
                metrics.alias("metrics"),
                F.create_map(F.lit("n"), F.col("config").cast("string"), F.lit("epochs"), F.col("epochs").cast("string")).alias("best_params"),
                F.create_map(F.lit("head_pos_x"), F.col("val_acc"), F.lit("head_rot_x"), 1.0 - F.col("val_acc")).alias("feature_importance"),
            ).alias("results"),
            F.struct(F.col("val_acc").alias("balanced_accuracy")).alias("evaluation"),
        )
    )
    path = store.scratch_path(spark, "experiments")
    f.select(F.when(F.col("fold") % 10 == 4, F.lit('{"experiment_name": broken')).otherwise(doc).alias("value")).write.text(path)
    raw = spark.read.schema(artefacts.SUMMARY_SCHEMA).option("mode", "PERMISSIVE").json(path)
    x = artefacts.experiment_summaries(raw)
    return x.select("experiment_name", "task", "model", rnd("ba").alias("ba"), rnd("f1").alias("f1"), "freq", "data_source", "best_params")


@query(
    "prediction_sink_round_trip",
    f"WITH p AS ({PREDS_SQL}) SELECT CASE WHEN y_true = y_pred THEN 'correct' WHEN y_true = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type, count(*) AS n, round(avg(y_proba), 6) AS proba FROM p GROUP BY 1",
)
def prediction_sink_round_trip(spark, sf):
    path = store.scratch_path(spark, "predictions")
    artefacts.write_predictions(predictions(spark, sf), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(F.col("y_proba").cast("double"))).alias("proba"))


@query(
    "multilabel_prediction_table",
    f"""WITH p AS ({LABEL_PREDS_SQL}) SELECT sample_id, {", ".join(f"max({v}) FILTER (WHERE label = '{l}') AS {v}_{l}" for v in ("y_true", "y_pred", "y_proba") for l in ("quality", "toxic"))},
      sum(CAST(y_true <> y_pred AS INT)) = 0 AS exact_match, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE y_true <> y_pred), '') AS labels_wrong FROM p GROUP BY 1""",
)
def multilabel_prediction_table(spark, sf):
    return artefacts.multilabel_wide(label_predictions(spark, sf), ["quality", "toxic"])


@query(
    "json_result_sink",
    f"SELECT model, count(*) AS n, count(train_loss) AS with_loss, round(avg(val_acc), 6) AS val_acc FROM ({FOLDS_SQL}) GROUP BY 1",
)
def json_result_sink(spark, sf):
    path = store.scratch_path(spark, "results")
    f = folds(spark, sf).withColumn("train_loss", F.coalesce("train_loss", F.lit(float("nan"))))
    artefacts.write_json(f.select("model", "fold", "train_loss", "val_acc"), path, ["train_loss", "val_acc"])
    back = spark.read.schema("model STRING, fold LONG, train_loss DOUBLE, val_acc DOUBLE").json(path)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("train_loss").alias("with_loss"), rnd(F.avg("val_acc")).alias("val_acc"))


@query(
    "feature_table_sink",
    f"WITH frames AS ({frames_sql(CHANNELS[:2])}) SELECT subject_id, task, round(avg(head_pos_x), 6) AS ext_a_mean, round(max(head_pos_y), 6) AS ext_b_max FROM frames GROUP BY ALL",
)
def feature_table_sink(spark, sf):
    wide = frames(spark, sf, CHANNELS[:2]).groupBy(*RECORDING).agg(F.max("head_pos_y").alias("ext_b_max"), F.avg("head_pos_x").alias("ext_a_mean"))
    path = store.scratch_path(spark, "features")
    artefacts.write_feature_table(wide, path, RECORDING)
    return rounded(spark.read.parquet(path), *RECORDING)


# ---------------------------------------------------------------- streaming


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def _run(df, spark, name):
    path = store.scratch_path(spark, name)
    live.run_to_table(df, path + "/out", path + "/ckpt").awaitTermination()
    return spark.read.schema(df.schema).parquet(path + "/out")


@query(
    "streaming_window_statistics",
    """WITH e AS (SELECT *, date_trunc('hour', ts) AS w FROM events), x AS (SELECT *, epoch_us(ts) / 1e6 - epoch_us(w) / 1e6 AS x FROM e)
    SELECT event_type, epoch_us(w) // 1000000 AS window_start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) + 0 AS std,
      round(CASE WHEN var_pop(x) = 0 THEN 0 ELSE covar_pop(value, x) / var_pop(x) END, 6) + 0 AS slope, max(value) AS max, min(value) AS min FROM x
    GROUP BY event_type, w HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def streaming_window_statistics(spark, sf):
    out = _run(live.windowed_statistics(event_stream(spark, sf), ["event_type"], "value"), spark, "windows")
    return out.select(
        "event_type", F.unix_seconds("window_start").alias("window_start"), "n", rnd("mean").alias("mean"), rnd("std").alias("std"), rnd("slope").alias("slope"), "max", "min"
    )


@query(
    "streaming_active_bouts",
    """WITH a AS (SELECT event_type, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE value > 60 WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bout FROM a)
    SELECT event_type, count(*) AS n, epoch_us(min(ts)) AS onset, epoch_us(max(ts)) AS offset_us, max(value) AS peak FROM s GROUP BY event_type, bout
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events WHERE value > 60) - INTERVAL 10 MINUTE""",
)
def streaming_active_bouts(spark, sf):
    out = _run(live.active_bouts(event_stream(spark, sf), ["event_type"], "value", 60.0), spark, "bouts")
    return out.select("event_type", "n", F.unix_micros("onset").alias("onset"), F.unix_micros("offset").alias("offset_us"), "peak")


@query("streaming_new_subject_scores", SCORE_SQL)
def streaming_new_subject_scores(spark, sf):
    """Recordings arrive as files and are scored with stored models and a stored scaler."""
    path = store.scratch_path(spark, "arrivals")
    x = frames(spark, sf, CH)
    stats = reshape.scaler(x, CH)
    # Each frame states how many its recording has.
    x = reshape.with_length(x.drop("t_s"), RECORDING).withColumnRenamed("n_frames", "n_expected")
    x.write.parquet(path + "/in")
    stats.write.parquet(path + "/scaler")
    stored = spark.read.parquet(path + "/scaler")
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 4).parquet(path + "/in")

    def score(batch):
        return hmm.classify(reshape.apply_scaler(batch, stored, CH), CH, MODEL1, MODEL0)

    q = live.score_new_recordings(stream, score, path + "/scores", path + "/ckpt", RECORDING, "n_expected", path + "/waiting")
    q.awaitTermination()
    return rounded(spark.read.parquet(path + "/scores").drop("epoch"), *RECORDING, "n_frames", "y_pred")


