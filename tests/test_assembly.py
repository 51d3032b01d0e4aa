"""The feature table: modules isolated from each other, finished ones kept, frames moved once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING
from kinelake.operators import assembly, features, ordering


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    parts = []
    for s, n in (("px1", 60), ("px2", 45), ("fx3", 1), ("fx6", 80), ("fx9", 30)):
        d = {"subject_id": s, "task": 1, "grp": "x", "frame_idx": np.arange(n), "t_s": np.arange(n) / 50}
        parts.append(pd.DataFrame(d | {c: np.cumsum(rng.normal(size=n)) for c in CHANNELS}))
    return spark.createDataFrame(pd.concat(parts)).withColumn("task", F.col("task").cast("int")).repartition(3)


def broken(rows):
    """Fails in the executors where it meets px2."""
    bad = F.when(F.col("subject_id") == "px2", F.raise_error(F.lit("no such recording"))).otherwise(F.lit(1.0))
    return [rows.groupBy(*RECORDING).agg(F.max(bad.cast("double")).alias("value")).select(*RECORDING, F.lit("one").alias("feature"), "value")]


def hopeless(rows):
    return [rows.groupBy(*RECORDING).agg(F.max(F.raise_error(F.lit("never")).cast("double")).alias("value")).select(*RECORDING, F.lit("two").alias("feature"), "value")]


def test_a_failing_module_costs_no_recording_and_no_other_module(frames, tmp_path, monkeypatch):
    monkeypatch.setattr(assembly, "SPLITS", 2)
    modules = {"joint": assembly.joint, "broken": broken, "hopeless": hopeless}
    long, left_out = assembly.assemble(frames, str(tmp_path / "t"), modules)
    wide = assembly.wide_table(frames, long, left_out).toPandas().set_index("subject_id")
    assert len(wide) == 5 and wide["ext_Head_roll_rom"].notna().all() and len([c for c in wide if c.startswith("ext_")]) == 37
    assert wide["ext_one"].notna().sum() == 4 and pd.isna(wide.loc["px2", "ext_one"])
    assert set(wide.loc["px2", "left_out"]) == {"broken", "hopeless"} and "no such recording" in wide.loc["px2", "left_out"]["broken"]
    assert all(set(w) == {"hopeless"} for s, w in wide["left_out"].items() if s != "px2")


def test_a_failing_module_is_no_result_of_composite_metrics(frames, tmp_path, monkeypatch):
    """zeros in place of the values of a module that failed."""
    from kinelake.plans import assembly_queries

    monkeypatch.setattr(assembly, "SPLITS", 1)
    modules = {"joint": assembly.joint, "broken": broken}
    with pytest.raises(assembly.ModuleFailed, match="no such recording"):
        assembly.assemble(frames, str(tmp_path / "t"), modules, strict=True)
    long, left_out = assembly.assemble(frames, str(tmp_path / "t"), modules)
    found = features.composite_metrics(assembly.wide_table(frames, long, left_out)).toPandas().set_index("subject_id")
    lost = [s for s in found.index if found.drop(columns="task").loc[s].isna().all()]
    assert "px2" in lost and set(lost) == {r["subject_id"] for r in left_out.collect()}
    assert (found.drop(index=lost)["max_speed"] == 0).all() and len(lost) < 5
    monkeypatch.setattr(assembly_queries, "frames", lambda *_: frames)
    monkeypatch.setitem(assembly.MODULES, "temporal", hopeless)
    with pytest.raises(assembly.ModuleFailed, match="never"):
        assembly_queries.composite_metrics.__wrapped__(frames.sparkSession, "")


def test_finished_modules_are_kept(frames, tmp_path):
    calls = []

    def counted(name):
        def build(rows):
            calls.append(name)
            return [rows.groupBy(*RECORDING).agg(F.count("*").cast("double").alias("value")).select(*RECORDING, F.lit(name).alias("feature"), "value")]

        return build

    path = str(tmp_path / "t")
    assembly.assemble(frames, path, {"a": counted("a")})
    long, left_out = assembly.assemble(frames, path, {"a": counted("a"), "b": counted("b")})
    assert calls == ["a", "b"] and long.count() == 10 and left_out.count() == 0


def test_a_recording_without_values_has_a_reason(frames, tmp_path):
    long, left_out = assembly.assemble(frames, str(tmp_path / "t"), {"frequency": assembly.frequency})
    assert [(r["subject_id"], r["reason"]) for r in left_out.collect()] == [("fx3", "no value")]
    assert long.filter("subject_id = 'px1'").count() > 50


def test_modules_do_not_move_the_stored_frames(frames):
    stored, longest = assembly.by_recording(frames)
    with ordering.bounded(RECORDING, longest):
        for found in (*assembly.time_domain(stored), *assembly.joint(stored), *assembly.biomechanical(stored), *assembly.asymmetry(stored)):
            assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_recordings_give_the_same_values(frames, tmp_path, monkeypatch):
    modules = {m: assembly.MODULES[m] for m in ("joint", "movement_quality", "time_domain")}
    one = assembly.assemble(frames, str(tmp_path / "a"), modules)[0].toPandas()
    monkeypatch.setattr(assembly, "BUCKET_FRAMES", 10)
    two = assembly.assemble(frames, str(tmp_path / "b"), modules)[0].toPandas()
    both = one.merge(two, on=["subject_id", "task", "module", "feature"])
    assert len(both) == len(one) == len(two) and np.allclose(both["value_x"], both["value_y"], equal_nan=True)


def test_bounds_hold_inside_only(frames):
    with ordering.bounded(RECORDING, 7):
        assert ordering.largest_group(frames, [*RECORDING, "grp"]) == 7 and ordering.largest_group(frames, ["task"]) == 216
    assert ordering.largest_group(frames, RECORDING) == 80
    assert features.time_domain(frames, CHANNELS[:2]).count() == 10
