"""Rows that lie by recording are moved once, or not at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.config import RECORDING
from kinelake.operators import classify, evaluate, features, ordering, reshape


def moves(df):
    """Exchanges that an operator asked for, in the plan before its run."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


@pytest.fixture(scope="module")
def series(make_series):
    lengths = {(f"px{i}", 1 + i % 2): 5 + 9 * i for i in range(6)}
    df, pdf = make_series(lengths, ("x", "y", "z"), seed=3)
    return df.repartition(4, *RECORDING), pdf


def test_channel_first_does_not_move_rows_by_channel(series):
    """every value crossed the network in a row of its own."""
    df, pdf = series
    found = reshape.channel_first(df, ["x", "y", "z"], chunk=20)
    assert moves(found) == 0
    rows = found.collect()
    assert len(rows) == 3 * sum(-(-len(g) // 20) for _, g in pdf.groupby(RECORDING))
    for r in rows:
        own = pdf[(pdf.subject_id == r["subject_id"]) & (pdf.task == r["task"])].sort_values("frame_idx")
        assert np.array_equal(r["values"], own[r["channel"]].to_numpy()[20 * r["chunk"] : 20 * r["chunk"] + 20])


def test_channel_first_orders_repeated_frames_by_value(spark):
    df = spark.createDataFrame([("a", 1, 0, 2.0, 1.0), ("a", 1, 0, 1.0, 2.0), ("a", 1, 1, 0.0, None)], "subject_id string, task int, frame_idx int, x double, y double")
    assert {r["channel"]: r["values"] for r in reshape.channel_first(df, ["x", "y"]).collect()} == {"x": [1.0, 2.0, 0.0], "y": [1.0, 2.0, None]}


def test_time_domain_moves_rows_once_for_statistics_and_percentiles(spark, series):
    """percentiles had an exchange of all rows of their own, and both sides one more for their join."""
    df, pdf = series
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = features.time_domain(df, ["x", "y", "z"], max_rows=100)
        assert moves(found) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for r in found.collect():
        own = pdf[(pdf.subject_id == r["subject_id"]) & (pdf.task == r["task"])].sort_values("frame_idx")[r["channel"]]
        assert np.allclose([r["median"], r["percentile_95"], r["std"]], [own.median(), own.quantile(0.95), own.std(ddof=0)])
        assert np.isclose(r["autocorr_lag1"], np.corrcoef(own[1:], own[:-1])[0, 1])


def counting(df):
    """The same rows, and an accumulator that counts how often one is made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(len(part))
            yield part

    return df.mapInPandas(count, df.schema), made


def test_group_summary_makes_its_features_once(spark):
    """F16: all steps before the summary ran again for each pass of the exact medians."""
    rows = [("f" + str(i % 2), "g", float(i * 37 % 101) if i % 10 else None) for i in range(60)]
    long, made = counting(spark.createDataFrame(rows, "feature string, grp string, value double"))
    found = {r["feature"]: r for r in features.group_summary(long, rows_per_bucket=8).collect()}
    assert made.value == 60
    for f, r in found.items():
        own = np.array([v for g, _, v in rows if g == f and v is not None])
        assert np.allclose([r["median"], r["mean"], r["std"], r["min"], r["max"], r["n"]], [np.median(own), own.mean(), own.std(ddof=1), own.min(), own.max(), len(own)])
    assert len(found) == 2


def test_config_metrics_make_their_samples_once(spark):
    """the samples were made anew for the means, the sums, the scores and each metric."""
    rows = [(f"s{i % 8}", i, i % 8 % 2, float(i % 8 % 2 + i * 7 % 5), float(i * 11 % 13) if i % 6 else None) for i in range(40)]
    df, made = counting(spark.createDataFrame(rows, "subject_id string, task int, y int, a double, b double"))
    found = classify.nested_metrics(classify.loso_ridge(df, ["a", "b"], [0.1, 1.0])).collect()
    assert made.value == 40 and sorted(r["config"] for r in found) == [0, 1]
    assert all(0 < r["auc"] <= 1 for r in found)


def test_twins_are_placed_without_storing_the_rows(spark, monkeypatch):
    """all rows with all columns were sampled, sorted by range and written to a checkpoint for their places."""
    monkeypatch.setattr(ordering, "GLOBAL_BUCKET", 16)
    monkeypatch.setattr(ordering, "reliable", lambda df: pytest.fail("rows are stored"))
    df = spark.range(100).selectExpr("id AS k", "id % 7 AS x", "id AS y", "'long' AS other").repartition(3)
    placed = ordering.hashed_position(df.selectExpr("*", "(k * 37 % 100 + 0.5) / 100D AS u"), "u", ["u"], "p").collect()
    assert all(r["p"] == r["k"] * 37 % 100 for r in placed) and len(placed) == 100
    found = evaluate.shuffled_twins(df, ["x", "y"], ["k"], 2, keep=["y"]).collect()
    assert found[0].asDict().keys() == {"y", "repeat", "twin"}
    for r in range(2):
        own = [f for f in found if f["repeat"] == r]
        assert sorted(f["y"] for f in own) == sorted(f["twin"]["y"] for f in own) == list(range(100))
        assert all(f["twin"]["x"] == f["twin"]["y"] % 7 and f["twin"]["y"] != f["y"] for f in own)


@pytest.fixture
def subjects(spark):
    rows = [(f"px{i * 7 % 23}", 1 + i % 3) for i in range(60)] + [(None, 1), ("ü|x", 2)]
    return spark.createDataFrame(rows, "subject_id string, task int").repartition(3)


def both_ways(make, monkeypatch):
    """The rows made where a fold is, and those of pairs moved by fold, for more subjects than can be broadcast."""
    near = make()
    assert moves(near) == 0
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 3)
    return sorted(map(str, near.collect())), sorted(map(str, make().collect()))


@pytest.mark.parametrize("folds", [None, [0, 5, 99]])
def test_inner_holdout_moves_no_pair_of_fold_and_subject(subjects, folds, monkeypatch):
    """folds x subjects rows were moved by fold and sorted there."""
    near, moved = both_ways(lambda: evaluate.inner_holdout(subjects, folds), monkeypatch)
    assert near == moved and len(near) == (25 * 24 if folds is None else 24 + 24 + 25)



def test_inner_kfold_moves_no_pair_of_fold_and_subject(subjects, monkeypatch):
    """as above."""
    near, moved = both_ways(lambda: evaluate.inner_kfold(subjects, k=4), monkeypatch)
    assert near == moved and len(near) == 25 * 24


def test_fold_roles_are_made_by_ranges_of_folds_in_many_tasks(spark, monkeypatch):
    """one task made all rows, and each sample's folds ran through, beyond the reach of a file's compression."""
    monkeypatch.setattr(evaluate, "FOLD_RANGE", 4)
    samples = spark.createDataFrame([(f"s{i % 11:02}", i) for i in range(22)], "subject_id string, task int").coalesce(1)
    rows = evaluate.fold_roles(samples).withColumn("at", F.spark_partition_id()).collect()
    assert len({r["at"] for r in rows}) > 1
    assert {(r["fold"], r["subject_id"], r["task"], r["role"]) for r in rows} == {
        (f, f"s{i % 11:02}", i, "test" if f == i % 11 else "train") for i in range(22) for f in range(11)
    } and len(rows) == 242
    run = 1
    for a, b in zip(rows, rows[1:]):
        run = run + 1 if (a["at"], a["subject_id"], a["task"]) == (b["at"], b["subject_id"], b["task"]) else 1
        assert run <= 4 or a["at"] != b["at"]
