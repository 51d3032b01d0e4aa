import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import estimators as es
from kinelake.operators import hmm


@pytest.fixture(scope="module")
def frames(spark, make_series):
    df, _ = make_series({(f"{g}{i}", 1): 60 + 5 * i for g in ("px", "fx") for i in range(4)}, seed=3, smooth=False)
    y = F.col("subject_id").startswith("px").cast("int")
    return df.withColumn("y", y).withColumn("x", F.col("x") + 1.5 * y * (F.col("frame_idx") % 20 > 9).cast("int")).cache()


def rows(df):
    return sorted((r["subject_id"], round(r["y_proba"], 9), r["y_pred"], r["y_true"]) for r in df.collect())


@pytest.mark.parametrize("make", [lambda: es.HmmClassifier(["x", "y2"], nStates=2, maxIter=3), lambda: es.HsmmClassifier(["x", "y2"], nStates=2, maxIter=2, maxDuration=20)])
def test_frame_classifiers_score_alike_after_storing(spark, frames, tmp_path, make):
    df = frames.withColumn("y2", F.sin("x"))
    model, found, metrics = es.train_and_evaluate(make(), df, df)
    assert metrics.first()["ba"] >= 0.75 and found.count() == 8
    model.save(spark, str(tmp_path / "m"))
    again = es.load_model(spark, str(tmp_path / "m"))
    assert type(again) is type(model) and rows(again.transform(df)) == rows(found)
    assert "y_true" not in again.transform(df.drop("y")).columns
    top = model.importance(spark).orderBy("rank").collect()
    assert top[0]["channel"] == "x" and abs(sum(r["importance"] for r in top) - 1) < 1e-9


def test_hsmm_classifier_uses_its_durations(frames):
    model = es.HsmmClassifier(["x"], nStates=2, maxIter=2, maxDuration=20).fit(frames)
    got = {r["subject_id"]: r["ll_1"] for r in model.transform(frames).collect()}
    want = hmm.hsmm_log_likelihood(frames, ["x"], model.model_of(1), model.arrays["1/rates"], 20, full_start=True).collect()
    assert len(want) == 8 and all(abs(got[r["subject_id"]] - r["ll"]) < 1e-9 for r in want)


def test_ridge_classifier_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=40) > 0).astype(int)
    x[3, 1], x[7, 0] = np.nan, np.nan
    data = [(f"s{i}", 1, None if i == 9 else int(y[i]), float(x[i, 0]), None if i == 3 else float(x[i, 1])) for i in range(40)]
    df = spark.createDataFrame(data, "subject_id STRING, task INT, y INT, a DOUBLE, b DOUBLE")
    model = es.RidgeClassifier(["a", "b"], regParam=0.5).fit(df)
    use = np.array([i for i in range(40) if i != 9])
    mean = np.nanmean(x[use], axis=0)
    filled = np.where(np.isnan(x), mean, x)
    z = (filled[use] - mean) / filled[use].std(axis=0)
    t = 2 * y[use] - 1
    w = np.linalg.solve(z.T @ z / len(use) + 0.5 * np.eye(2), z.T @ (t - t.mean()) / len(use)) / filled[use].std(axis=0)
    want = 1 / (1 + np.exp(-4 * (t.mean() + (filled - mean) @ w)))
    model.save(spark, str(tmp_path / "r"))
    got = {r["subject_id"]: r for r in es.load_model(spark, str(tmp_path / "r")).transform(df).collect()}
    assert all(abs(got[f"s{i}"]["y_proba"] - want[i]) < 1e-9 for i in range(40)) and got["s9"]["y_true"] is None
    assert model.importance(spark).orderBy("rank").first()["channel"] == "a"


def test_one_class_or_no_rows_are_refused(spark, frames):
    with pytest.raises(ValueError, match="both classes"):
        es.HmmClassifier(["x"], nStates=2, maxIter=1).fit(frames.filter("y = 1"))
    with pytest.raises(ValueError, match="no labelled"):
        es.RidgeClassifier(["x"]).fit(frames.limit(0))
