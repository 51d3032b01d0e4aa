"""Leave-one-subject-out training: nothing of the held-out subject, no dependence on blocks, parts that can be resumed."""

import hashlib
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import hmm, loso
from kinelake.operators.blocks import arrange

CH, KEYS = ["x", "y"], ["subject_id", "task"]
GRID = [loso.Setting(2, "diag", 2), loso.Setting(2, "full", 2)]


@pytest.fixture(scope="module")
def data(make_series):
    df, _ = make_series({(f"s{i}", t): 70 + 5 * i for i in range(5) for t in (1, 2)}, smooth=False)
    df = df.withColumn("cl", F.substring("subject_id", 2, 1).cast("int") % 2)
    return df.withColumn("x", F.col("x") + F.col("cl") * (F.floor(F.col("frame_idx") / 20) % 2)).cache()


def models(df, setting, steps):
    own = loso.subject_sums(df, CH, ["task"], "subject_id", "cl").collect()
    totals = {}
    for r in own:
        n, s, q = totals.get((r["task"], r["cl"]), (0.0, np.zeros(2), np.zeros(3)))
        totals[(r["task"], r["cl"])] = (n + r["n"], s + np.array(r["s"]), q + np.array(r["q"]))
    folds = loso.fold_starts(own, totals, ["task"], "subject_id", "cl", setting)
    flat, most = loso.packed(df, CH, KEYS, "subject_id", "cl", ["task"], 1000)
    units = arrange(flat, ["task", "cl", "_pack"], [*KEYS, "_blk", "frame_idx"]).cache()
    for _ in range(steps):
        folds = loso.trained(units, CH, folds, ["task"], KEYS, "subject_id", "cl", most > 1)
    return folds


@pytest.mark.parametrize("setting", GRID)
def test_a_fold_knows_nothing_of_its_subject(data, setting):
    other = data.withColumn("x", F.when(F.col("subject_id") == "s1", F.col("x") * 7 + 100).otherwise(F.col("x")))
    a, b = models(data, setting, 2), models(other, setting, 2)
    for key in a:
        same = all(np.allclose(a[key].by_class[c][n], b[key].by_class[c][n], rtol=1e-6, atol=1e-9) for c in (0, 1) for n in ("start", "trans", "means", "covars"))
        assert same == (key[-1] == "s1"), key


@pytest.mark.parametrize("setting", GRID)
def test_fold_models_equal_a_fit_on_the_training_rows_alone(spark, data, setting):
    folds = models(data, setting, 2)
    f, start = folds[(1, "s2")], models(data, setting, 0)[(1, "s2")]
    rows = data.filter("task = 1 AND subject_id <> 's2'")
    mean, std = (np.array(rows.agg(*[g(c) for c in CH]).first()) for g in (F.avg, F.stddev_pop))
    np.testing.assert_allclose([f.shift, f.scale], [mean, std])
    scaled = rows.withColumns({c: (F.col(c) - float(m)) / float(s) for c, m, s in zip(CH, mean, std)})
    want, _ = hmm.fit_many(scaled, CH, ["cl"], {(c,): start.by_class[c] for c in (0, 1)}, 2, KEYS, tol=-1e9)
    for c in (0, 1):
        for n in ("start", "trans", "means", "covars"):
            np.testing.assert_allclose(f.by_class[c][n], want[(c,)][n], rtol=1e-7, atol=1e-9)


def test_scores_do_not_depend_on_blocks(data, tmp_path):
    got = [loso.evaluate_grid(data, CH, str(tmp_path / str(n)), GRID, cls="cl", group=["task"], size=n).toPandas().sort_values(["setting", *KEYS]) for n in (1000, 13)]
    assert len(got[0]) == 20 and (got[0]["n_frames"].to_numpy() == got[1]["n_frames"].to_numpy()).all()
    assert sorted(got[0]["n_frames"].unique()) == [70, 75, 80, 85, 90]
    for col in ("ll_0", "ll_1", "y_proba"):
        np.testing.assert_allclose(got[0][col], got[1][col], rtol=1e-8)


def test_finished_parts_are_kept_and_missing_ones_named(spark, data, tmp_path):
    path, setting = str(tmp_path / "p"), GRID[:1]
    first = loso.evaluate_grid(data, CH, path, setting, cls="cl", group=["task"], fold_block=3).toPandas().sort_values(KEYS)
    parts = sorted((tmp_path / "p" / "parts" / f"setting={setting[0].name}").glob("block=*"))
    kept = {p: (p / "_SUCCESS").stat().st_mtime_ns for p in parts}
    assert len(parts) > 1
    shutil.rmtree(parts[0])
    assert loso.missing_parts(spark, path, setting) == [(setting[0].name, int(parts[0].name[6:]))]
    with pytest.raises(ValueError, match="not finished"):
        loso.merge(spark, path, setting, "cl")
    again = loso.evaluate_grid(data, CH, path, setting, cls="cl", group=["task"], fold_block=3).toPandas().sort_values(KEYS)
    np.testing.assert_allclose(again["y_proba"], first["y_proba"])
    assert all((p / "_SUCCESS").stat().st_mtime_ns == t for p, t in kept.items() if p != parts[0])


def test_one_class_gives_no_fold_and_the_best_setting_is_chosen(spark, data, tmp_path):
    assert loso.evaluate_grid(data.filter("cl = 1"), CH, str(tmp_path / "one"), GRID[:1], cls="cl", group=["task"]).count() == 0
    rows = [("a", 1, 1), ("a", 0, 1), ("b", 1, 1), ("b", 0, 0), ("c", 1, 1), ("c", 0, 0)]
    best = loso.best_setting(spark.createDataFrame(rows, "setting string, y_true int, y_pred int")).first()
    assert (best["setting"], best["ba"]) == ("b", 1.0)


def test_twins_are_a_permutation_of_the_rows(spark):
    from kinelake.operators.evaluate import shuffled_twins

    df = spark.createDataFrame([(f"s{i}", i, float(i % 7), -float(i)) for i in range(101)], "k string, i int, x double, y double").repartition(4)
    found = shuffled_twins(df, ["i", "x", "y"], ["k"], 3).collect()
    for r in range(3):
        rows = [f for f in found if f["repeat"] == r]
        assert sorted(f["twin"]["i"] for f in rows) == sorted(f["i"] for f in rows) == list(range(101))
        assert all(f["twin"]["i"] != f["i"] and f["twin"]["y"] == -f["twin"]["i"] for f in rows)
    assert len({(f["i"], f["twin"]["i"]) for f in found}) == 303
    assert shuffled_twins(df.limit(0), ["x"], ["k"], 3).count() == 0


def test_importance_names_the_channels_that_carry_the_label(spark):
    from kinelake.operators.evaluate import fit_linear, permutation_importance

    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 3))
    rows = [(i, float(a), float(b), float(c), int(a + 0.3 * b > 0), 1.0) for i, (a, b, c) in enumerate(v)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, label int, d double")
    channels = ["a", "b", "c", "d"]
    found = {r["channel"]: r for r in permutation_importance(df, channels, ["i"], "label", fit_linear(df, channels, "label"), 4).collect()}
    assert found["a"]["rank"] == 1 and found["a"]["importance"] > 0.3 > found["b"]["importance"] > 0.02
    assert abs(found["c"]["importance"]) < 0.02 and found["d"]["importance"] == 0.0


def test_channel_drops_are_shares(data, tmp_path):
    found = loso.channel_drops(data, CH, str(tmp_path / "d"), GRID[0], cls="cl", group=["task"]).toPandas()
    assert len(found) == 4 and np.allclose(found.groupby("task")["importance"].sum(), 1.0) and (found["importance"] >= 0).all()


@pytest.mark.parametrize("block", [6, 1 << 17])
def test_twins_meet_in_blocks_after_one_exchange(spark, monkeypatch, block):
    """Each row crosses the network once for all repeats; block borders and lengths that no arc divides lose no twin."""
    from kinelake.operators import evaluate

    monkeypatch.setattr(evaluate, "TWIN_BLOCK", block)
    for n in (1, 3, 100, 101, 107):
        df = spark.createDataFrame([(f"s{i}", i) for i in range(n)], "k string, i int").repartition(3)
        found = evaluate.shuffled_twins(df, ["i"], ["k"], 3)
        order = sorted(range(n), key=lambda i: hashlib.md5(f"s{i}|42".encode()).hexdigest()[:13])
        want = {(i, r, order[(p + (2 * r + 1) * n // 6) % n]) for p, i in enumerate(order) for r in range(3)}
        rows = found.collect()
        assert len(rows) == 3 * n and {(f["i"], f["repeat"], f["twin"]["i"]) for f in rows} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join Inner" not in plan.replace("Join Inner\n", "")
