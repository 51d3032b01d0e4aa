import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake import config
from kinelake.operators import classify, cohort
from kinelake.sources import adapters, artefacts, logs, store

CONFIG = {
    "name": "xr_motion", "sampling_rate": 50, "channels": config.CHANNELS, "tasks": {"1": "jar", "2": "key"},
    "paradigms": {"1": {"g1_filter": "all", "g0_filter": {"source": "control", "filter": "all"}}, "2": {"labels": {}}},
}


def _raw(root, subject, n, rot, encoding="utf-8"):
    d = root / subject
    d.mkdir()
    head = [" TimeElapsed", *[config.RAW_NAMES[c] for c in config.CHANNELS]]
    rows = [",".join(head)]
    for i in range(n):
        rows.append(",".join([f"{i / 50:.2f}", *[str(rot(i)) if "rot" in c else str(i * 0.1) for c in config.CHANNELS]]))
    rows.insert(3, ",".join(["oops"] + ["1"] * 18))
    (d / "PlayerMovement.csv").write_text("\n".join(rows) + "\n", encoding=encoding)
    (d / "Master.csv").write_text("Timestamp,Name\n0.1,Task 1\n1.0, Task 2\n1.4,Task 1\n1.6,Done\n")


def test_raw_folder_to_recordings(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    _raw(raw, "PX1", 100, lambda i: (350 + i) % 360)
    _raw(raw, "fx2", 100, lambda i: 5 + i * 0.1, "utf-16")
    cfg = config.dataset_config(CONFIG)
    out = adapters.ingest(spark, cfg, str(raw), str(tmp_path / "store"))
    got = store.read_recordings(spark, str(tmp_path / "store"), 1).toPandas().sort_values(["subject_id", "frame_idx"])
    px = got[got.subject_id == "PX1"]
    assert len(px) == 45 and px.t_s.iloc[-1] == pytest.approx(44 / 50)  # [0.1, 1.0)
    # The repaired angle runs on without the jump at 360 and starts near 0.
    np.testing.assert_allclose(np.diff(px.head_rot_x), 1.0)
    assert px.head_rot_x.iloc[0] == pytest.approx(-5.0)
    assert out.filter("task = 2 AND subject_id = 'fx2'").count() == 20  # ends at the next row of any kind, 1.4
    assert store.read_recordings(spark, str(tmp_path / "store"), 1, "control").count() == 45
    found = [r.subject_id for r in logs.discover_subjects(spark, str(raw) + "/*/Master.csv").collect()]
    assert sorted(found) == ["PX1", "fx2"]


def test_config_rules(tmp_path):
    cfg = config.dataset_config(CONFIG)
    assert cfg.paradigm_type(1) == "binary" and cfg.paradigm_type(2) == "multilabel" and cfg.tasks == {1: "jar", 2: "key"}
    assert config.RAW_NAMES["left_hand_rot_z"] == "LRotZ" and len(cfg.frame_schema()) == 23
    with pytest.raises(ValueError):
        cfg.paradigm(9)
    with pytest.raises(ValueError):
        config.check_method("hmm", "dtw", 50, None)
    assert config.check_method("hmm", "variable_length", 50, 25) == ["resample", "variable_length"]


def test_headerless_recordings_and_metadata(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "s9.csv").write_text("0.0,1,2\n0.1,3,4\n")
    x = logs.read_new_recordings(spark, str(tmp_path / "new"), ["a", "b"]).orderBy("frame_idx").collect()
    assert [(r.subject_id, r.frame_idx, r.a) for r in x] == [("s9", 0, 1.0), ("s9", 1, 3.0)]
    (tmp_path / "meta.csv").write_text("Sheet,,\n,,\nID,dia_code,age\nPX1,1,50\nPX2,2,60\n")
    m = logs.metadata_table(spark, str(tmp_path / "meta.csv"), ["dia_code"]).orderBy("ID").collect()
    assert [(r.ID, r.dia_code) for r in m] == [("PX1", "1"), ("PX2", "2")]
    assert logs.read_csv_any(spark, str(tmp_path / "absent.csv")) is None


def test_validation_and_sinks_fail_loudly(spark, tmp_path):
    df = spark.createDataFrame([("g1_px1_t", 1, 1, 0.9), ("g0_fx1_t", 0, 0, 0.1)], "sample_id STRING, y_true INT, y_pred INT, y_proba DOUBLE")
    artefacts.write_predictions(df, str(tmp_path / "ok"))
    with pytest.raises(Exception, match="id prefix"):
        artefacts.write_predictions(df.withColumn("y_true", F.lit(1)), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        logs.validate_columns(df, ["nope"])
    with pytest.raises(ValueError):
        logs.validate_columns(df.limit(0), ["y_true"], 1)


def test_experiment_files(spark, tmp_path):
    doc = {
        "experiment_name": "ABL_EW_x_f25", "config": {"task": 1, "paradigm": 2, "model": "hmm", "method": "pad"},
        "results": {"metrics": {"ba": None, "f1": 0.5}, "best_params": {"k": 3}, "feature_importance": {"head_pos_x": 0.25}},
        "evaluation": {"balanced_accuracy": 0.75},
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{broken")
    rows = artefacts.read_experiments(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].ba == 0.75 and rows[0].freq == 25 and rows[0].data_source == "event_windows"


def test_survey_answers(spark):
    texts = {"2": 2, " 3.0 ": 3, "No Difficulty": 1, "can’t sleep": 5, "SO_MUCH difficulty that I can't move": 5, "9": None, "": None, "perhaps": None}
    df = spark.createDataFrame([(t,) for t in texts], "response STRING")
    got = {r.response: r.v for r in df.select("response", cohort.parse_response("response").alias("v")).collect()}
    assert got == texts


def test_spark_ml_fold(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 8}", float(y), float(rng.normal() + 3 * y)) for i, y in enumerate([0, 1] * 40)]
    df = spark.createDataFrame(rows, "subject_id STRING, y DOUBLE, f DOUBLE")
    out = classify.logistic_fold(df.filter("subject_id <> 's1'"), df.filter("subject_id = 's1'"), ["f"])
    assert out.filter("y_pred = y_true").count() >= 8


def test_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t, x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,t\n20,10\n")
    (tmp_path / "c.csv").write_bytes("t,x\n100,200\n".encode("utf-16"))
    got = logs.read_csv_any(spark, str(tmp_path / "*.csv")).select("t", "x").collect()
    assert sorted((float(r.t), float(r.x)) for r in got) == [(1, 2), (10, 20), (100, 200)]


def test_recordings_of_all_layouts_in_one_folder(spark, tmp_path, monkeypatch):
    folder = tmp_path / "new recordings"
    folder.mkdir()
    (folder / "s1.csv").write_text("t,a,b\n0.0,1,2\n0.1,x,4\n")
    (folder / "s2.csv").write_text("5,6\n\n7,\n9\n")
    (folder / "s3.csv").write_text("a,b\r\n8,9\r\n")
    (folder / "s4.csv").write_text("0.5, 1,2\n")
    (folder / "s5.csv").write_text("a,b\n")
    (folder / "s6.csv").write_text("")
    want = [
        ("s1", 0, 0.0, 1.0, 2.0), ("s1", 1, 0.1, None, 4.0), ("s2", 0, None, 5.0, 6.0), ("s2", 1, None, 7.0, None), ("s2", 2, None, 9.0, None),
        ("s3", 0, None, 8.0, 9.0), ("s4", 0, 0.5, 1.0, 2.0),
    ]
    read = lambda: sorted((r.subject_id, r.frame_idx, r.t, r.a, r.b) for r in logs.read_new_recordings(spark, str(folder), ["a", "b"]).collect())
    assert read() == want
    # The same by the path of recordings too large for one task.
    whole = logs.ordering.cumulate
    monkeypatch.setattr(logs.ordering, "cumulate", lambda df, keys, by, order, w, rows=2, max_rows=None, kind="sum": whole(df, keys, by, order, w, 2, max_rows, kind))
    assert read() == want


def test_first_lines_of_any_file(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("t,x\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "c.csv").write_bytes("t,x\n100,200\n".encode("utf-16"))
    found = logs.encodings(spark, str(tmp_path / "*.csv"))
    assert sorted((enc, [p.rsplit("/", 1)[1] for p in paths]) for (enc, _), paths in found.items()) == [("UTF-16", ["c.csv"]), ("UTF-8", ["a b.csv"])]
    assert sorted(float(r.x) for r in logs.read_csv_any(spark, str(tmp_path / "*.csv")).filter("x IS NOT NULL").collect()) == [2, 200]


def test_answers_of_headered_and_headerless_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Question,Response\n1,q1,3\n2,Q2, \n")
    (tmp_path / "b.csv").write_text("1,Q4,no difficulty\n\n")
    got = logs.survey_log(logs.read_csv_any(spark, str(tmp_path / "*.csv"), header=False)).collect()
    assert sorted((r.q, r.response) for r in got if r.response) == [(1, "3"), (4, "no difficulty")]


def test_metadata_lines_equal_to_leading_lines_stay(spark, tmp_path):
    (tmp_path / "m.csv").write_text("note,1\nid,dia_code\nPX1,3\nnote,1\n\n")
    got = logs.metadata_table(spark, str(tmp_path / "m.csv"), ["dia_code"]).collect()
    assert sorted((r["id"], r["dia_code"]) for r in got) == [("PX1", "3"), ("note", "1")]


def test_missing_features_take_the_training_mean(spark):
    import numpy as np

    from kinelake.operators import classify

    rng = np.random.default_rng(1)
    rows = [(f"s{i}", i % 2, float(i % 2 + rng.normal()), None if i % 5 == 0 else float(rng.normal())) for i in range(30)]
    df = spark.createDataFrame(rows, "subject_id string, y int, a double, b double")
    out = classify.logistic_fold(df.filter("subject_id <> 's0'"), df.filter("subject_id IN ('s0', 's1')"), ["a", "b"]).toPandas()
    assert len(out) == 2 and out.y_proba.between(0, 1).all()
    got = classify.loso_ridge(df, ["a", "b"], [0.5]).toPandas().set_index("subject_id")
    for k, (s, y, *_x) in enumerate(rows):
        rest = np.array([[np.nan if v is None else v for v in r[2:]] for j, r in enumerate(rows) if j != k], float)
        t = np.array([2.0 * r[1] - 1 for j, r in enumerate(rows) if j != k])
        fill = np.nanmean(rest, 0)
        full = np.where(np.isnan(rest), fill, rest)
        m, sd = full.mean(0), full.std(0)
        z = (full - m) / sd
        w = np.linalg.solve(z.T @ z / len(z) + 0.5 * np.eye(2), z.T @ (t - t.mean()) / len(z)) / sd
        own = np.array([fill[i] if v is None else v for i, v in enumerate(rows[k][2:])])
        want = 1 / (1 + np.exp(-4 * (t.mean() + (own - m) @ w)))
        assert abs(got.loc[s, "y_proba"] - want) < 1e-9


def test_a_recording_split_over_batches_is_scored_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinelake.streaming import live

    x = spark.range(40).selectExpr("id % 4 AS k", "id AS v", "10L AS n")
    for part in range(4):  # each file holds some frames of every recording
        x.filter(F.floor(F.col("v") / 10) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score = lambda d: d.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    live.score_new_recordings(stream, score, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["k"], "n", str(tmp_path / "wait")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.c, r.s) for r in got) == [(k, 10, sum(range(k, 40, 4))) for k in range(4)]


def test_a_scratch_path_can_be_written_without_overwrite(spark):
    from kinelake.sources import store

    path = store.scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
