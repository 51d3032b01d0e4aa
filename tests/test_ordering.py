"""Bucketed and blocked paths must equal the plain window, whatever the bucket and block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.operators import align, complexity, features, ordering, posthoc, reshape, states

KEYS = ["subject_id", "task"]
SIZES = {("a", 1): 400, ("a", 2): 37, ("b", 1): 12}


@pytest.fixture(scope="module")
def data(make_series):
    return make_series(SIZES)


def same(a, b, by):
    a, b = (d.toPandas().sort_values(by).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(b.columns)], check_dtype=False, rtol=1e-9, atol=1e-9)


def test_position_matches_row_number_on_a_hot_key(data):
    df, _ = data
    by, order = F.col("x"), ["x", "frame_idx"]
    same(ordering.position(df, KEYS, by, order, "p"), ordering.position(df, KEYS, by, order, "p", rows_per_bucket=7), [*KEYS, "p"])
    same(ordering.position(df, [], by, order, "p"), ordering.position(df, [], by, order, "p", rows_per_bucket=11), ["p"])


def test_position_with_tied_leading_value(spark):
    df = spark.range(50).select(F.lit("k").alias("k"), F.lit(1.0).alias("v"), "id")
    got = ordering.position(df, ["k"], F.col("v"), ["v", "id"], "p", rows_per_bucket=5).toPandas()
    assert (got.p == got.id).all()


@pytest.mark.parametrize("size", [5, 16])
def test_neighbours_and_running_sums_cross_block_borders(data, size):
    df, _ = data
    shifts = {"p2": ("x", -2), "n1": ("x", 1)}
    same(ordering.neighbours(df, KEYS, shifts), ordering.neighbours(df, KEYS, shifts, size=size), [*KEYS, "frame_idx"])
    same(ordering.running_sum(df, KEYS, {"s": "x"}), ordering.running_sum(df, KEYS, {"s": "x"}, size=size), [*KEYS, "frame_idx"])


def test_quantiles_agree_on_all_paths(data):
    df, pdf = data
    probs = {"q1": 0.25, "q95": 0.95}
    plain = ordering.quantiles(df, KEYS, "x", probs)
    same(plain, ordering.quantiles(df, KEYS, "x", probs, rows_per_bucket=9), KEYS)
    wide = ordering.wide_quantiles(df, KEYS, ["x", "y"], probs)
    same(wide, ordering.wide_quantiles(df, KEYS, ["x", "y"], probs, limit=1), [*KEYS, "channel"])
    g = pdf[(pdf.subject_id == "a") & (pdf.task == 1)].x
    assert plain.filter("subject_id = 'a' AND task = 1").first()["q95"] == pytest.approx(np.percentile(g, 95))


def test_attach_join_equals_window(data):
    df, _ = data
    agg = {"n": F.count(F.lit(1)), "m": F.avg("x")}
    same(ordering.attach(df, KEYS, agg), ordering.attach(df, KEYS, agg, limit=1), [*KEYS, "frame_idx"])


def test_nearest_sides_does_not_depend_on_the_bucket(spark):
    rng = np.random.default_rng(3)
    ev = pd.DataFrame({"subject_id": rng.integers(0, 3, 60), "t": rng.uniform(0, 50, 60).round(2)})
    pt = pd.DataFrame({"subject_id": rng.integers(0, 2, 25), "t": rng.uniform(0, 50, 25).round(2)})
    pt["before"], pt["after"] = 1, np.arange(25)
    pt = pt.drop_duplicates(["subject_id", "t"])
    e, p = spark.createDataFrame(ev.assign(event_id=range(60))), spark.createDataFrame(pt)
    got = [states.align_events(e, p, width=w).select("event_id", "temporal_error_s", "matched") for w in (0.5, 7.0, 1000.0)]
    same(got[0], got[2], ["event_id"])
    same(got[1], got[2], ["event_id"])
    one = got[2].toPandas().set_index("event_id").temporal_error_s
    for i, r in ev.iterrows():
        own = pt[pt.subject_id == r.subject_id].t
        assert (np.isnan(one[i]) and not len(own)) or one[i] == pytest.approx((own - r.t).abs().min())


def test_unwrap_matches_numpy(make_series):
    df, pdf = make_series({("a", 1): 90, ("b", 1): 40}, ("rx",))
    df, pdf = df.withColumn("rx", F.pmod(F.col("rx") * 140, F.lit(360.0))), pdf.assign(rx=np.mod(pdf.rx * 140, 360.0))
    got = align.unwrap_rotations(df, ["rx"], KEYS, size=8).toPandas().sort_values([*KEYS, "frame_idx"])
    for key, g in pdf.groupby(KEYS):
        want = np.rad2deg(np.unwrap(np.deg2rad(g.rx.to_numpy())))
        want = want - 360 if want[0] > 180 else want
        np.testing.assert_allclose(got[(got.subject_id == key[0])].rx, want, atol=1e-8)


def test_runs_across_blocks(spark):
    s = np.repeat([0, 1, 0, 2, 2, 1], [9, 1, 2, 30, 3, 1])
    df = spark.createDataFrame(pd.DataFrame({"subject_id": "a", "frame_idx": np.arange(len(s)), "state": s}))
    same(states.runs(df), states.runs(df, size=4), ["run_no"])
    got = states.merged_segments(df, 3).toPandas().sort_values("start_frame")
    assert list(got.state) == ["0", "0+1", "2", "1"]


def test_benjamini_hochberg_buckets(spark):
    p = np.array([0.01, 0.04, 0.03, 0.5, 0.2, 0.011, 0.9])
    df = spark.createDataFrame(pd.DataFrame({"fam": "f", "p": p, "i": range(7)}))
    same(posthoc.benjamini_hochberg(df, "p", ["fam"]), posthoc.benjamini_hochberg(df, "p", ["fam"], 2), ["i"])
    o = np.argsort(p)
    want = np.empty(7)
    want[o] = np.minimum.accumulate((p[o] * 7 / np.arange(1, 8))[::-1])[::-1]
    got = posthoc.benjamini_hochberg(df, "p", ["fam"]).toPandas().sort_values("i").q
    np.testing.assert_allclose(got, want)


def test_student_t_tail():
    # Table values of the two-sided 5 % and 1 % points.
    assert posthoc.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert posthoc.t_two_sided(3.169, 10) == pytest.approx(0.01, abs=1e-4)
    assert posthoc.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_features_do_not_depend_on_row_order(data):
    df, _ = data
    a = features.time_domain(df, ["x", "y"], KEYS)
    b = features.time_domain(df.orderBy(F.desc("x")).repartition(7), ["x", "y"], KEYS)
    same(a, b, [*KEYS, "channel"])
    same(complexity.higuchi(df, ["x"], KEYS), complexity.higuchi(df.repartition(5), ["x"], KEYS), [*KEYS, "channel"])


def test_fold_scaler_never_sees_the_held_out_subject(data):
    df, pdf = data
    s = reshape.fold_scalers(df, ["x"], KEYS, trim=False).toPandas().set_index("fold")
    for subject in ("a", "b"):
        rest = pdf[pdf.subject_id != subject].x
        assert s.loc[subject, "x__m"] == pytest.approx(rest.mean())
        assert s.loc[subject, "x__s"] == pytest.approx(rest.std(ddof=0))


def test_augmentation_keeps_the_cross_validation_key(data):
    df, _ = data
    out = reshape.augmentation_plan(df, ["jitter"], 2).select("sample_id", "subject_id").distinct().toPandas()
    assert set(out.subject_id) == {"a", "b"} and len(out) == 6


def test_seeded_draws_ignore_partitioning(data):
    df, _ = data
    same(reshape.jitter(df, ["x"], KEYS), reshape.jitter(df.repartition(9), ["x"], KEYS), [*KEYS, "frame_idx"])
    cut = reshape.random_slice(df, 20, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("a"), F.max("frame_idx").alias("z")).toPandas()
    assert ((cut.n >= 20) | (cut.n == 12)).all() and (cut.a == 0).all() and (cut.z == cut.n - 1).all()
    noise = reshape.jitter(df, ["x"], KEYS).select((F.col("x")).alias("j"), *KEYS, "frame_idx").join(df, [*KEYS, "frame_idx"])
    sd = noise.agg(F.stddev(F.col("j") - F.col("x"))).first()[0]
    assert 0.008 < sd < 0.012


def test_null_keys_are_kept_on_every_path(spark):
    from pyspark.sql import functions as F

    from kinelake.operators import ordering

    rows = [(k, i, float(i)) for k in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    whole = ordering.attach(df, ["k"], {"m": F.max("v")}, limit=1000).toPandas()
    joined = ordering.attach(df, ["k"], {"m": F.max("v")}, limit=1).toPandas()
    assert len(whole) == len(joined) == 80 and whole.m.sum() == joined.m.sum()
    runs = [ordering.cumulate(df, ["k"], F.col("i"), ["i"], {"s": F.col("v")}, rows_per_bucket=n).toPandas() for n in (1000, 7)]
    assert len(runs[1]) == 80 and sorted(runs[0].s) == sorted(runs[1].s)


def test_group_sizes_are_counted_anew(spark, tmp_path):
    from kinelake.operators import ordering

    path = str(tmp_path / "t")
    for n in (10, 500):
        spark.range(n).selectExpr("1 AS k").write.mode("overwrite").parquet(path)
        assert ordering.largest_group(spark.read.parquet(path), ["k"]) == n


def test_cluster_without_shared_folder_is_an_error(spark):
    import pytest

    from kinelake.sources import store

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        store.shared_folder(Elsewhere)


def test_channels_without_values_and_null_keys_stay_at_any_size(spark):
    rows = [(k, i, float(i), None) for k in ("a", None) for i in range(12)]
    df = spark.createDataFrame(rows, "k STRING, frame_idx LONG, x DOUBLE, y DOUBLE")
    probs = {"low": 0.25, "mid": 0.5}
    small, large = (ordering.wide_quantiles(df, ["k"], ["x", "y"], probs, limit=n).select("k", "channel", "low", "mid") for n in (100, 5))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and large.count() == 4
    for size in (4, 100):
        sums = ordering.running_sum(df, ["k"], {"s": "x"}, size=size)
        assert sorted((str(r["k"]), r["frame_idx"], r["s"]) for r in sums.collect()) == sorted((str(k), i, i * (i + 1) / 2) for k, i, _, _ in rows)


@pytest.mark.parametrize("kind", ["outlier", "zeros", "prefix"])
def test_buckets_are_of_equal_depth(spark, monkeypatch, kind):
    """An outlier, nine tenths of one value and strings with a long common prefix make no bucket above twice the target."""
    make = {"outlier": lambda i: 1e12 if i == 7 else i / 1e3, "zeros": lambda i: max(0.0, i - 3600.0), "prefix": lambda i: f"a-common-prefix-of-strings-{i:06d}"}[kind]
    rows = [("k" if i % 3 else "j", make(i), i, 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, f"key string, v {'string' if kind == 'prefix' else 'double'}, i int, w double").repartition(6)
    sizes = []
    store = ordering.reliable

    def seen(tagged):
        out = store(tagged)
        sizes.extend(r["count"] for r in out.groupBy("_b").count().collect())
        return out

    monkeypatch.setattr(ordering, "reliable", seen)
    found = ordering.cumulate(df, ["key"], F.lit(0.0), ["v", "i"], {"c": F.col("w")}, 200).collect()
    assert len(sizes) > 15 and max(sizes) <= 400
    rank = {}
    for r in sorted(found, key=lambda r: (r["key"], r["v"], r["i"])):
        rank[r["key"]] = rank.get(r["key"], 0) + 1
        assert r["c"] == rank[r["key"]]
