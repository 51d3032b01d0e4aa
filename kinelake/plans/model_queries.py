"""Queries for hidden-state models and leave-one-subject-out classification."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING
from kinelake.functions.expr import rnd
from kinelake.operators import classify, estimators, evaluate, features, hmm, loso, reshape, states
from kinelake.plans.evaluation_queries import rounded, twins_sql
from kinelake.plans.fixtures import frames, frames_sql
from kinelake.plans.registry import query
from kinelake.sources.store import scratch_path

CH = ["head_pos_x", "left_hand_pos_y"]
# A fixed two-state model on scaled channels: deterministic input for scoring and decoding.
MODEL1 = {
    "start": np.array([0.5, 0.5]),
    "trans": np.array([[0.7, 0.3], [0.4, 0.6]]),
    "means": np.array([[-0.8, -0.7], [0.9, 0.8]]),
    "covars": np.array([[0.5, 0.6], [0.4, 0.5]]),
}
MODEL0 = {**MODEL1, "trans": np.array([[0.5, 0.5], [0.5, 0.5]])}


def scaled(spark, sf):
    x = frames(spark, sf, CH).withColumn("y", F.col("subject_id").startswith("px").cast("int"))
    return reshape.standardize(x, CH)


def _density_sql(k: int) -> str:
    """Gaussian density of one state on the scaled channels x0, x1."""
    m, v = MODEL1["means"][k], MODEL1["covars"][k]
    quad = " + ".join(f"pow(x{i} - ({float(m[i])!r}), 2) / {float(v[i])!r}" for i in range(2))
    return f"exp(-0.5::DOUBLE * ({quad})) / (2 * pi() * sqrt({float(v[0])!r}::DOUBLE * {float(v[1])!r}::DOUBLE))"


def _step_sql(a: str, b: str, trans) -> tuple[str, str]:
    return tuple(f"({a} * {float(trans[0, j])!r}::DOUBLE + {b} * {float(trans[1, j])!r}::DOUBLE) * e{j}" for j in range(2))


_u, _v = _step_sql("a0", "a1", MODEL1["trans"]), _step_sql("c0", "c1", MODEL0["trans"])
# Emissions and the scaled forward recursion of both models, frame by frame.
FORWARD_SQL = f"""frames AS ({frames_sql(CH)}), sc AS (SELECT subject_id, task, frame_idx, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(CH))} FROM frames),
  e AS MATERIALIZED (SELECT subject_id, task, frame_idx, {_density_sql(0)} AS e0, {_density_sql(1)} AS e1, count(*) OVER (PARTITION BY subject_id, task) AS n FROM sc),
  f AS (SELECT subject_id, task, n, frame_idx AS i, e0 / (e0 + e1) AS a0, e1 / (e0 + e1) AS a1, ln((e0 + e1) / 2) AS ll1, e0 / (e0 + e1) AS c0, e1 / (e0 + e1) AS c1, ln((e0 + e1) / 2) AS ll0
      FROM e WHERE frame_idx = 0
    UNION ALL SELECT subject_id, task, n, i, u0 / (u0 + u1), u1 / (u0 + u1), ll1 + ln(u0 + u1), v0 / (v0 + v1), v1 / (v0 + v1), ll0 + ln(v0 + v1) FROM (
      SELECT f.subject_id, f.task, f.n, e.frame_idx AS i, ll1, ll0, {_u[0]} AS u0, {_u[1]} AS u1, {_v[0]} AS v0, {_v[1]} AS v1
      FROM f JOIN e ON e.subject_id = f.subject_id AND e.task = f.task AND e.frame_idx = f.i + 1))"""
SCORE_SQL = f"""WITH RECURSIVE {FORWARD_SQL} SELECT subject_id, task, n AS n_frames, round(ll1, 6) AS ll_1, round(ll0, 6) AS ll_0,
  round(1 / (1 + exp(-(ll1 - ll0) / n)), 6) AS y_proba, CAST(ll1 - ll0 >= 0 AS INT) AS y_pred FROM f WHERE i = n - 1"""
_t = [[float(x) for x in row] for row in MODEL1["trans"]]
# Backward messages and the best path (kept as a list per end state) under the first model.
DECODE_SQL = f"""WITH RECURSIVE {FORWARD_SQL},
  b AS (SELECT subject_id, task, frame_idx AS i, 0.5::DOUBLE AS b0, 0.5::DOUBLE AS b1 FROM e WHERE frame_idx = n - 1
    UNION ALL SELECT subject_id, task, i, w0 / (w0 + w1), w1 / (w0 + w1) FROM (SELECT b.subject_id, b.task, b.i - 1 AS i,
      {_t[0][0]}::DOUBLE * e0 * b0 + {_t[0][1]}::DOUBLE * e1 * b1 AS w0, {_t[1][0]}::DOUBLE * e0 * b0 + {_t[1][1]}::DOUBLE * e1 * b1 AS w1
      FROM b JOIN e ON e.subject_id = b.subject_id AND e.task = b.task AND e.frame_idx = b.i WHERE b.i > 0)),
  v AS (SELECT subject_id, task, n, frame_idx AS i, ln(0.5::DOUBLE) + ln(e0) AS d0, ln(0.5::DOUBLE) + ln(e1) AS d1, [0] AS p0, [1] AS p1 FROM e WHERE frame_idx = 0
    UNION ALL SELECT v.subject_id, v.task, v.n, e.frame_idx,
      greatest(d0 + ln({_t[0][0]}::DOUBLE), d1 + ln({_t[1][0]}::DOUBLE)) + ln(e0), greatest(d0 + ln({_t[0][1]}::DOUBLE), d1 + ln({_t[1][1]}::DOUBLE)) + ln(e1),
      list_append(CASE WHEN d0 + ln({_t[0][0]}::DOUBLE) >= d1 + ln({_t[1][0]}::DOUBLE) THEN p0 ELSE p1 END, 0),
      list_append(CASE WHEN d0 + ln({_t[0][1]}::DOUBLE) >= d1 + ln({_t[1][1]}::DOUBLE) THEN p0 ELSE p1 END, 1)
      FROM v JOIN e ON e.subject_id = v.subject_id AND e.task = v.task AND e.frame_idx = v.i + 1),
  path AS (SELECT subject_id, task, unnest(CASE WHEN d0 >= d1 THEN p0 ELSE p1 END) AS state, unnest(range(0, n)) AS i FROM v WHERE i = n - 1)
  SELECT p.subject_id, p.task, p.i AS frame_idx, p.state, round(CASE p.state WHEN 0 THEN a0 * b0 ELSE a1 * b1 END / (a0 * b0 + a1 * b1), 6) + 0 AS posterior
  FROM path p JOIN f ON f.subject_id = p.subject_id AND f.task = p.task AND f.i = p.i JOIN b ON b.subject_id = p.subject_id AND b.task = p.task AND b.i = p.i"""


@query("hmm_fit")
def hmm_fit(spark, sf):
    """EM over all recordings of each class; one row per class, state and channel."""
    x = scaled(spark, sf)
    models = hmm.class_models(x, CH, 2, n_iter=4)
    rows = [
        (key[0], s, c, float(m["means"][s, i]), float(m["covars"][s, i]), [float(v) for v in m["trans"][s]])
        for key, m in sorted(models.items()) for s in range(2) for i, c in enumerate(CH)
    ]
    return spark.createDataFrame(rows, "y INT, state INT, channel STRING, mean DOUBLE, variance DOUBLE, trans ARRAY<DOUBLE>")


@query("hmm_class_score", SCORE_SQL)
def hmm_class_score(spark, sf):
    return rounded(hmm.classify(scaled(spark, sf), CH, MODEL1, MODEL0), *RECORDING, "n_frames", "y_pred")


@query("hmm_decode", DECODE_SQL)
def hmm_decode(spark, sf):
    return rounded(hmm.decode(scaled(spark, sf), CH, MODEL1), *RECORDING, "frame_idx", "state")


@query("hmm_label_pairs")
def hmm_label_pairs(spark, sf):
    """One-vs-rest pairs: a model per (label, flag), all fitted in the same jobs."""
    x = scaled(spark, sf)
    flags = F.array(
        *[
            F.struct(F.lit(n).alias("label"), e.cast("int").alias("flag"))
            for n, e in (("patient", F.col("y") == 1), ("even_task", F.col("task") % 2 == 0))
        ]
    )
    long = x.withColumn("_l", F.explode(flags)).select("*", "_l.*").drop("_l")
    models = hmm.class_models(long, CH, 2, "flag", ["label"], n_iter=3)
    rows = [(k[0], k[1], s, float(m["means"][s, 0])) for k, m in sorted(models.items()) for s in range(2)]
    return spark.createDataFrame(rows, "label STRING, flag INT, state INT, mean DOUBLE")


def labelled(spark, sf):
    return frames(spark, sf, CH).withColumn("y", F.col("subject_id").startswith("px").cast("int"))


@query("hmm_loso_metrics")
def hmm_loso_metrics(spark, sf):
    """Per task: every subject held out once, scaler, start values and both models without it, then the metrics."""
    p = loso.evaluate_grid(labelled(spark, sf), CH, scratch_path(spark, "loso"), [loso.Setting(2, "diag", 2)], group=["task"])
    return rounded(evaluate.binary_metrics(p, ["task"], None), "task")


_Q = loso.PLACES[2][1]
# One EM step of every fold's models from equal transitions, where a frame's posterior needs no other frame; then the
# scaled forward recursion of the held-out recordings under both models.
def step_sql(source: str) -> str:
    """Predictions after one step; ``source`` are CTEs that end in x (subject_id, task, frame_idx, y, a, b)."""
    return f"""WITH RECURSIVE {source},
  own AS (SELECT task, subject_id, y, CAST(count(*) AS DOUBLE) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM x GROUP BY ALL),
  tot AS (SELECT task, y, sum(n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb FROM own GROUP BY ALL),
  lft AS (SELECT f.task, f.subject_id AS fold, t.y, {", ".join(f"t.{c} - CASE WHEN f.y = t.y THEN f.{c} ELSE 0 END AS {c}" for c in ("n", "sa", "sb", "aa", "ab", "bb"))}
    FROM own f JOIN tot t ON t.task = f.task),
  sc AS (SELECT task, fold, sum(sa) / sum(n) AS ha, sum(sb) / sum(n) AS hb, sqrt(sum(aa) / sum(n) - pow(sum(sa) / sum(n), 2)) AS da, sqrt(sum(bb) / sum(n) - pow(sum(sb) / sum(n), 2)) AS db FROM lft GROUP BY ALL),
  cl AS (SELECT l.*, ha, hb, da, db, (sa / n - ha) / da AS ma, (sb / n - hb) / db AS mb, (aa / n - pow(sa / n, 2)) / (da * da) AS va, (bb / n - pow(sb / n, 2)) / (db * db) AS vb,
    (ab / n - sa / n * sb / n) / (da * db) AS co FROM lft l JOIN sc s ON s.task = l.task AND s.fold = l.fold),
  st AS (SELECT task, fold, y, ha, hb, da, db, va + 1e-3 AS va, vb + 1e-3 AS vb, ma - {_Q} * sqrt(va) AS a0, ma + {_Q} * sqrt(va) AS a1,
    mb - {_Q} * sqrt(va) * co / va AS b0, mb + {_Q} * sqrt(va) * co / va AS b1 FROM cl),
  z AS (SELECT s.task, s.fold, s.y, x.subject_id, x.frame_idx, (x.a - ha) / da AS a, (x.b - hb) / db AS b, va, vb, a0, a1, b0, b1 FROM st s JOIN x ON x.task = s.task AND x.y = s.y AND x.subject_id <> s.fold),
  g AS (SELECT *, 1 / (1 + exp(-0.5 * ((pow(a - a1, 2) - pow(a - a0, 2)) / va + (pow(b - b1, 2) - pow(b - b0, 2)) / vb))) AS g0 FROM z),
  gl AS (SELECT *, lag(g0) OVER (PARTITION BY task, fold, y, subject_id ORDER BY frame_idx) AS p0 FROM g),
  m AS (SELECT task, fold, y, {", ".join(f"sum({w} * {v}) / sum({w}) AS m{v}{k}, greatest(sum({w} * {v} * {v}) / sum({w}) - pow(sum({w} * {v}) / sum({w}), 2), 0) + 1e-3 AS v{v}{k}" for k, w in enumerate(("g0", "(1 - g0)")) for v in "ab")},
    sum(p0 * g0) / sum(CASE WHEN p0 IS NOT NULL THEN p0 END) AS t00, sum((1 - p0) * g0) / sum(1 - p0) AS t10, avg(g0) FILTER (WHERE p0 IS NULL) AS s0 FROM gl GROUP BY ALL),
  e AS MATERIALIZED (SELECT x.subject_id, x.task, x.y AS y_true, m.y, x.frame_idx, t00, t10, s0, count(*) OVER (PARTITION BY x.subject_id, x.task, m.y) AS n,
    {", ".join(f"exp(-0.5 * (pow((x.a - ha) / da - ma{k}, 2) / va{k} + pow((x.b - hb) / db - mb{k}, 2) / vb{k})) / (2 * pi() * sqrt(va{k} * vb{k})) AS e{k}" for k in (0, 1))}
    FROM x JOIN m ON m.task = x.task AND m.fold = x.subject_id JOIN sc ON sc.task = x.task AND sc.fold = x.subject_id),
  f AS (SELECT subject_id, task, y_true, y, n, frame_idx AS i, s0 * e0 / (s0 * e0 + (1 - s0) * e1) AS f0, ln(s0 * e0 + (1 - s0) * e1) AS ll FROM e WHERE frame_idx = 0
    UNION ALL SELECT subject_id, task, y_true, y, n, i, u0 / (u0 + u1), ll + ln(u0 + u1) FROM (SELECT f.subject_id, f.task, f.y_true, f.y, f.n, e.frame_idx AS i, ll,
      (f0 * t00 + (1 - f0) * t10) * e0 AS u0, (f0 * (1 - t00) + (1 - f0) * (1 - t10)) * e1 AS u1 FROM f JOIN e ON e.subject_id = f.subject_id AND e.task = f.task AND e.y = f.y AND e.frame_idx = f.i + 1)),
  p AS (SELECT subject_id, task, y_true, n AS n_frames, max(ll) FILTER (WHERE y = 0) AS ll_0, max(ll) FILTER (WHERE y = 1) AS ll_1 FROM f WHERE i = n - 1 GROUP BY ALL)
  SELECT subject_id, task, y_true, n_frames, round(ll_0, 4) + 0 AS ll_0, round(ll_1, 4) + 0 AS ll_1, round(1 / (1 + exp(-(ll_1 - ll_0) / n_frames)), 6) AS y_proba,
    CAST(ll_1 >= ll_0 AS INT) AS y_pred FROM p"""


def step_source(a: str = CH[0], b: str = CH[1], src: str = "frames") -> str:
    return f"x AS (SELECT subject_id, task, frame_idx, CASE WHEN subject_id LIKE 'px%' THEN 1 ELSE 0 END AS y, {a} AS a, {b} AS b FROM {src})"


STEP_SQL = step_sql(f"frames AS ({frames_sql(CH)}), {step_source()}")
_TWINS = f"frames AS ({frames_sql(CH)}), {twins_sql('frames', 'tw', CH, 1)}"


def _ba_by_task(sql: str) -> str:
    return f"SELECT task, (avg(y_pred::DOUBLE) FILTER (WHERE y_true = 1) + avg(1 - y_pred::DOUBLE) FILTER (WHERE y_true = 0)) / 2 AS ba FROM ({sql}) GROUP BY task"


@query("hmm_loso_one_step", STEP_SQL)
def hmm_loso_one_step(spark, sf):
    """Every subject held out once per task, both class models of its fold after one EM step, and its recordings' scores."""
    p = loso.evaluate_grid(labelled(spark, sf), CH, scratch_path(spark, "loso"), [loso.Setting(2, "diag", 1)], group=["task"])
    out = p.select(*RECORDING, "y_true", "n_frames", rnd("ll_0", 4).alias("ll_0"), rnd("ll_1", 4).alias("ll_1"), rnd("y_proba").alias("y_proba"), "y_pred")
    return out


_SHUFFLED = {CH[0]: step_source(f"t_{CH[0]}", CH[1], "tw"), CH[1]: step_source(CH[0], f"t_{CH[1]}", "tw")}


@query(
    "hmm_channel_drops",
    f"""WITH base AS ({_ba_by_task(STEP_SQL)}), c AS ({" UNION ALL ".join(f"SELECT '{c}' AS channel, * FROM ({_ba_by_task(step_sql(f'{_TWINS}, {source}'))})" for c, source in _SHUFFLED.items())}),
    d AS (SELECT c.task, channel, c.ba, base.ba - c.ba AS fall FROM c JOIN base ON base.task = c.task),
    s AS (SELECT *, sum(greatest(fall, 0)) OVER (PARTITION BY task) AS total FROM d)
    SELECT task, channel, round(ba, 6) AS ba, round(fall, 6) + 0 AS "drop", round(CASE WHEN total > 1e-12 THEN greatest(fall, 0) / total ELSE 0.5 END, 6) + 0 AS importance FROM s""",
)
def hmm_channel_drops(spark, sf):
    """Per task: the fall of held-out accuracy with each channel of the model permuted, as shares."""
    out = loso.channel_drops(labelled(spark, sf), CH, scratch_path(spark, "drops"), loso.Setting(2, "diag", 1), group=["task"])
    return rounded(out, "task", "channel")


@query("hmm_loso_grid")
def hmm_loso_grid(spark, sf):
    """Per task: the best of four settings by the balanced accuracy of its held-out predictions."""
    grid = [loso.Setting(k, cov, 2) for k in (2, 3) for cov in ("diag", "full")]
    p = loso.evaluate_grid(labelled(spark, sf), CH, scratch_path(spark, "loso"), grid, group=["task"])
    return rounded(loso.best_setting(p, ["task"]), "task", "setting")


@query(
    "hsmm_duration_rates",
    DECODE_SQL.replace("SELECT p.subject_id, p.task, p.i AS frame_idx", ", dec AS (SELECT p.subject_id, p.task, p.i AS frame_idx")
    + """), fl AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY subject_id, task ORDER BY frame_idx) IS DISTINCT FROM state THEN 1 ELSE 0 END AS new FROM dec),
    r AS (SELECT *, sum(new) OVER (PARTITION BY subject_id, task ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS k FROM fl),
    d AS (SELECT subject_id, task, k, any_value(state) AS state, count(*) AS c FROM r GROUP BY ALL) SELECT state, round(avg(c), 6) AS rate FROM d GROUP BY 1""",
)
def hsmm_duration_rates(spark, sf):
    d = hmm.decode(scaled(spark, sf), CH, MODEL1)
    return rounded(states.duration_rates(d, 2, RECORDING), "state")


RATES, LONGEST = np.array([3.0, 2.0]), 30
_runs = [[math.exp(-r) * r**d / math.factorial(d) for d in range(1, LONGEST + 1)] for r in RATES.tolist()]
# For each state and duration the score of the segment under way (l0, l1) and of one that starts at the next frame (in0, in1),
# divided by the sum of the frame's scores, whose logarithms add up. A first segment of more than one frame does not count.
HSMM_SQL = f"""WITH RECURSIVE {FORWARD_SQL}, pmf AS (SELECT {_runs[0]}::DOUBLE[] AS p0, {_runs[1]}::DOUBLE[] AS p1),
  h AS (SELECT subject_id, task, n, frame_idx AS i, []::DOUBLE[] AS l0, []::DOUBLE[] AS l1, ln(s0 + s1) AS ll, s1 / (s0 + s1) * {_t[1][0]}::DOUBLE AS in0, s0 / (s0 + s1) * {_t[0][1]}::DOUBLE AS in1
      FROM (SELECT *, 0.5::DOUBLE * p0[1] * e0 AS s0, 0.5::DOUBLE * p1[1] * e1 AS s1 FROM e, pmf WHERE frame_idx = 0)
    UNION ALL SELECT subject_id, task, n, i, list_transform(m0, lambda x: x / (s0 + s1)), list_transform(m1, lambda x: x / (s0 + s1)), ll + ln(s0 + s1),
      s1 / (s0 + s1) * {_t[1][0]}::DOUBLE, s0 / (s0 + s1) * {_t[0][1]}::DOUBLE
      FROM (SELECT *, list_inner_product(m0, p0[1:len(m0)]) AS s0, list_inner_product(m1, p1[1:len(m1)]) AS s1
        FROM (SELECT h.subject_id, h.task, h.n, e.frame_idx AS i, h.ll, list_prepend(in0 * e0, list_transform(l0[1:{LONGEST - 1}], lambda x: x * e0)) AS m0,
          list_prepend(in1 * e1, list_transform(l1[1:{LONGEST - 1}], lambda x: x * e1)) AS m1
          FROM h JOIN e ON e.subject_id = h.subject_id AND e.task = h.task AND e.frame_idx = h.i + 1), pmf))
  SELECT subject_id, task, round(ll, 4) AS ll FROM h WHERE i = n - 1"""


@query("hsmm_log_likelihood", HSMM_SQL)
def hsmm_log_likelihood(spark, sf):
    ll = hmm.hsmm_log_likelihood(scaled(spark, sf), CH, MODEL1, RATES, LONGEST)
    return rounded(ll, *RECORDING, digits=4)


@query("hsmm_decode")
def hsmm_decode(spark, sf):
    return hmm.hsmm_decode(scaled(spark, sf), CH, MODEL1, RATES, LONGEST)


FEATS = ["rom_asymmetry_x", "rom_ratio_y", "mean_hand_separation", "path_length_ratio"]
HAND_POS = [c for c in CHANNELS if "hand_pos" in c]


def _features(spark, sf):
    wide = features.position_asymmetry(frames(spark, sf, HAND_POS)).select(*RECORDING, *FEATS)
    return wide.withColumn("y", F.col("subject_id").startswith("px").cast("int"))


_l, _r = [c for c in HAND_POS if "left" in c], [c for c in HAND_POS if "right" in c]
_rng = lambda c: f"(max({c}) - min({c}))"


@query(
    "loso_classification",
    f"""WITH frames AS ({frames_sql(HAND_POS)}), ft AS (SELECT subject_id, task, CASE WHEN subject_id LIKE 'px%' THEN 1 ELSE 0 END AS y, {_rng(_l[0])} - {_rng(_r[0])} AS f1,
      avg(sqrt({" + ".join(f"pow({a} - {b}, 2)" for a, b in zip(_l, _r))})) AS f2 FROM frames GROUP BY subject_id, task),
    m AS (SELECT a.subject_id AS fold, count(*) AS n, avg(b.f1) AS m1, avg(b.f2) AS m2, avg(2 * b.y - 1) AS mt, var_pop(b.f1) AS v1, var_pop(b.f2) AS v2, covar_pop(b.f1, b.f2) AS c12,
      covar_pop(b.f1, 2 * b.y - 1) AS t1, covar_pop(b.f2, 2 * b.y - 1) AS t2 FROM (SELECT DISTINCT subject_id FROM ft) a JOIN ft b ON b.subject_id <> a.subject_id GROUP BY 1),
    s AS (SELECT fold, ridge, m1, m2, mt, sqrt(v1) AS s1, sqrt(v2) AS s2, c12 / sqrt(v1 * v2) AS r, t1 / sqrt(v1) AS q1, t2 / sqrt(v2) AS q2 FROM m, (VALUES (0.1::DOUBLE), (1.0::DOUBLE)) k(ridge)),
    w AS (SELECT *, ((1 + ridge) * q1 - r * q2) / ((1 + ridge) * (1 + ridge) - r * r) / s1 AS w1, ((1 + ridge) * q2 - r * q1) / ((1 + ridge) * (1 + ridge) - r * r) / s2 AS w2 FROM s)
    SELECT ft.subject_id, ft.task, ridge, y AS y_true, round(1 / (1 + exp(-4 * (mt + w1 * (f1 - m1) + w2 * (f2 - m2)))), 6) AS y_proba FROM ft JOIN w ON fold = ft.subject_id""",
)
def loso_classification(spark, sf):
    x = _features(spark, sf).withColumnsRenamed({"rom_asymmetry_x": "f1", "mean_hand_separation": "f2"})
    p = classify.loso_ridge(x.select(*RECORDING, "y", "f1", "f2"), ["f1", "f2"], [0.1, 1.0])
    return p.select(*RECORDING, "ridge", "y_true", rnd("y_proba").alias("y_proba"))


@query(
    "stored_ridge_scores",
    f"""WITH frames AS ({frames_sql(HAND_POS)}), ft AS (SELECT subject_id, task, CASE WHEN subject_id LIKE 'px%' THEN 1 ELSE 0 END AS y, {_rng(_l[0])} - {_rng(_r[0])} AS f1,
      avg(sqrt({" + ".join(f"pow({a} - {b}, 2)" for a, b in zip(_l, _r))})) AS f2 FROM frames GROUP BY subject_id, task),
    m AS (SELECT avg(f1) AS m1, avg(f2) AS m2, avg(2 * y - 1) AS mt, var_pop(f1) AS v1, var_pop(f2) AS v2, covar_pop(f1, f2) AS c12, covar_pop(f1, 2 * y - 1) AS t1, covar_pop(f2, 2 * y - 1) AS t2
      FROM ft WHERE task <= 3),
    s AS (SELECT m1, m2, mt, sqrt(v1) AS s1, sqrt(v2) AS s2, c12 / sqrt(v1 * v2) AS r, t1 / sqrt(v1) AS q1, t2 / sqrt(v2) AS q2 FROM m),
    w AS (SELECT *, (1.5 * q1 - r * q2) / (1.5 * 1.5 - r * r) / s1 AS w1, (1.5 * q2 - r * q1) / (1.5 * 1.5 - r * r) / s2 AS w2 FROM s)
    SELECT ft.subject_id, ft.task, y AS y_true, round(1 / (1 + exp(-4 * (mt + w1 * (f1 - m1) + w2 * (f2 - m2)))), 6) AS y_proba FROM ft, w WHERE task > 3""",
)
def stored_ridge_scores(spark, sf):
    """Fitted on tasks 1 to 3, written, read again and applied to the other tasks."""
    x = _features(spark, sf).withColumnsRenamed({"rom_asymmetry_x": "f1", "mean_hand_separation": "f2"}).select(*RECORDING, "y", "f1", "f2")
    path = scratch_path(spark, "ridge")
    estimators.RidgeClassifier(["f1", "f2"], regParam=0.5).fit(x.filter("task <= 3")).save(spark, path)
    p = estimators.load_model(spark, path).transform(x.filter("task > 3"))
    return p.select(*RECORDING, "y_true", rnd("y_proba").alias("y_proba"))


@query("stored_hmm_scores", SCORE_SQL)
def stored_hmm_scores(spark, sf):
    """A hidden Markov classifier's parameters as a table, read again and applied."""
    arrays = {f"{c}/{name}": a for c, m in ((1, MODEL1), (0, MODEL0)) for name, a in m.items()}
    path = scratch_path(spark, "hmm")
    estimators.HmmClassifierModel(CH, "label", RECORDING, arrays).save(spark, path)
    p = estimators.load_model(spark, path).transform(scaled(spark, sf))
    return rounded(p, *RECORDING, "n_frames", "y_pred")


@query("loso_config_metrics")
def loso_config_metrics(spark, sf):
    p = classify.loso_ridge(_features(spark, sf), FEATS, [0.01, 0.1, 1.0])
    return rounded(classify.nested_metrics(p), "config")
