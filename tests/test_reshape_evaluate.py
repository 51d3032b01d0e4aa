"""Fold rows, augmented copies and bootstrap draws on small inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import evaluate, kernel_ops, reshape

CH = ["x", "y"]


def test_rows_of_a_fold_are_scaled_by_its_training_rows(make_series):
    df, _ = make_series({("a", 1): 40, ("b", 1): 30, ("c", 1): 25}, CH)
    scalers = reshape.fold_scalers(df, CH).cache()
    train = reshape.fold_rows(df, scalers, "b", CH)
    got = train.agg(*[F.avg(c) for c in CH], *[F.stddev_pop(c) for c in CH], F.count("*"), F.max("frame_idx"), F.countDistinct("subject_id")).first()
    assert np.allclose(got[:4], [0, 0, 1, 1]) and tuple(got[4:]) == (50, 24, 2)
    held = reshape.fold_rows(df, scalers, "b", CH, held_out=True)
    assert held.select("subject_id").distinct().collect()[0][0] == "b" and held.count() == 25
    assert reshape.fold_rows(df, scalers, "nobody", CH).count() == 0
    free = reshape.fold_rows(df, reshape.fold_scalers(df, CH, trim=False), "c", CH, trim=False)
    assert free.count() == 70 and free.columns == df.columns


def test_copies_have_their_own_method_and_seed_and_keep_their_subject(make_series):
    df, _ = make_series({("a", 1): 30, ("b", 2): 20}, CH)
    got = kernel_ops.augmented(df, CH, ["jitter", "magnitude_warp", "time_warp"], 2).toPandas()
    assert got.groupby("sample_id").size().to_dict() == {f"{s}{c}": n for s, n in (("a", 30), ("b", 20)) for c in ["", *(f"_aug{i}_{m}" for i, m in enumerate(["Jitter", "Magnitude_warp", "Time_warp"] * 2))]}
    own = df.toPandas()
    first = got[got.copy_no < 0].merge(own, on=["subject_id", "task", "frame_idx"])
    assert (first.x_x == first.x_y).all()
    wide = got[got.subject_id == "a"].pivot(index="frame_idx", columns="copy_no", values="x")
    assert all(not np.allclose(wide[i], wide[j]) for i in wide for j in wide if i < j)
    assert np.allclose(wide[0], wide[-1], atol=0.1) and not np.allclose(wide[0], wide[-1], atol=1e-4)
    with pytest.raises(ValueError, match="unknown"):
        kernel_ops.augmented(df, CH, ["rotate"])
    assert kernel_ops.augmented(df.limit(0), CH, ["jitter", "time_warp"]).count() == 0


def test_bootstrap_of_counts_has_the_spread_of_the_rows(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y_true int, y_proba double")
    got = evaluate.bootstrap_auc(df, draws=300).first()
    aucs = []
    for _ in range(300):
        w = rng.poisson(1.0, 400)
        pos, neg = (np.repeat(score[y == k], w[y == k]) for k in (1, 0))
        aucs.append((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert got["n_draws"] == 300 and abs(got["auc_mean"] - np.mean(aucs)) < 0.01
    assert abs((got["auc_ci_high"] - got["auc_ci_low"]) / (np.quantile(aucs, 0.975) - np.quantile(aucs, 0.025)) - 1) < 0.25
    # Counts beyond the table: the same scores many times over give a narrow interval.
    many = df.groupBy("y_true").agg(F.count("*").alias("n")).select("y_true", F.col("y_true").cast("double").alias("y_proba"), F.explode(F.sequence(F.lit(1), F.lit(600))))
    assert evaluate.bootstrap_auc(many, draws=20).first()["auc_mean"] == 1.0


def test_bootstrap_with_a_key_draws_every_row_by_itself(spark):
    """Many rows of one score and class each have a weight of their own, as the plain bootstrap of rows gives them."""
    rows = [(f"s{i}", i % 2, 0.25 * (i % 3) + 0.25 * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, y_true int, y_proba double").repartition(3)
    draws, aucs = 8, []
    for r in range(draws):
        digest = [hashlib.md5(f"{k}|{r // 4}|42".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8] for k, _, _ in rows]
        w = [sum((int(h, 16) + 0.5) / 2**32 > c for c in evaluate.POISSON_CDF) for h in digest]
        pos, neg = ([(p, n) for (_, y, p), n in zip(rows, w) if y == k] for k in (1, 0))
        wins = sum(a * b * ((p > q) + 0.5 * (p == q)) for p, a in pos for q, b in neg)
        aucs.append(wins / (sum(a for _, a in pos) * sum(b for _, b in neg)))
    got = evaluate.bootstrap_auc(df, draws=draws, key="sample_id").first()
    assert got["n_draws"] == draws and got["auc_mean"] == pytest.approx(np.mean(aucs))
    assert got["auc_ci_low"] == pytest.approx(np.quantile(aucs, 0.025)) and got["auc_ci_high"] == pytest.approx(np.quantile(aucs, 0.975))
