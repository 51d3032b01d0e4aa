"""Queries for decoded states, event alignment and post-hoc statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS
from kinelake.functions.expr import rnd
from kinelake.operators import cohort, posthoc
from kinelake.operators import evaluate as ev
from kinelake.operators import states as st
from kinelake.plans.evaluation_queries import rounded
from kinelake.plans.fixtures import (
    FOLDS_SQL,
    PREDS_SQL,
    STATES_SQL,
    folds,
    frames,
    frames_sql,
    predictions,
    states,
    subjects,
    table,
)
from kinelake.plans.registry import query
from kinelake.plans.relational import LATERALITY_SQL

ST = f"states AS ({STATES_SQL})"
RUNS = f"""{ST}, flagged AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS new FROM states WINDOW w AS (PARTITION BY subject_id ORDER BY frame_idx)),
  numbered AS (SELECT *, sum(new) OVER (PARTITION BY subject_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) - 1 AS run_no FROM flagged),
  runs AS (SELECT subject_id, CAST(run_no AS BIGINT) AS run_no, any_value(state) AS state, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame FROM numbered GROUP BY subject_id, run_no)"""


@query(
    "state_segments",
    f"WITH {RUNS} SELECT subject_id, run_no, state, start_frame, end_frame, start_frame / 5e1 AS start_time, end_frame / 5e1 AS end_time, (end_frame - start_frame + 1) / 5e1 AS duration_s FROM runs",
)
def state_segments(spark, sf):
    return st.segments(states(spark, sf))


MERGED = f"""{RUNS}, sh AS (SELECT *, end_frame - start_frame + 1 < 3 AS short FROM runs),
  isl AS (SELECT *, CASE WHEN short AND coalesce(lag(short) OVER w, false) THEN 0 ELSE 1 END AS new FROM sh WINDOW w AS (PARTITION BY subject_id ORDER BY run_no)),
  seg AS (SELECT *, sum(new) OVER (PARTITION BY subject_id ORDER BY run_no ROWS UNBOUNDED PRECEDING) - 1 AS seg_no FROM isl),
  merged AS (SELECT subject_id, seg_no, string_agg(DISTINCT CAST(state AS STRING), '+' ORDER BY CAST(state AS STRING)) AS state, min(start_frame) AS start_frame, max(end_frame) AS end_frame
    FROM seg GROUP BY subject_id, seg_no)"""


@query(
    "merged_segments",
    f"""WITH {MERGED} SELECT subject_id, start_frame, end_frame, round(start_frame / 5e1, 3) AS start_s, round(end_frame / 5e1, 3) AS end_s,
      round((end_frame - start_frame + 1) / 5e1, 3) AS duration_s, state, lag(state) OVER w AS from_state, lead(state) OVER w AS to_state FROM merged
    WINDOW w AS (PARTITION BY subject_id ORDER BY seg_no)""",
)
def merged_segments(spark, sf):
    return st.merged_segments(states(spark, sf), 3).drop("seg_no")


# Shares and seconds round half up to one digit; whole-number arithmetic decides the ties.
SUMMARY = f"""{ST}, l AS (SELECT *, lag(state) OVER (PARTITION BY subject_id ORDER BY frame_idx) AS p FROM states),
  summ AS (SELECT subject_id, count(*) AS n_frames, ((2 * count(*) + 5) // 10) / 1e1 AS total_s, CAST(sum(CASE WHEN p <> state THEN 1 ELSE 0 END) AS BIGINT) AS n_transitions,
    {", ".join(f"((2000 * count(*) FILTER (WHERE state = {s}) + count(*)) // (2 * count(*))) / 1e1 AS state{s}_pct" for s in range(3))} FROM l GROUP BY 1)"""


@query("state_summary", f"WITH {SUMMARY} SELECT * FROM summ")
def state_summary(spark, sf):
    return st.state_summary(states(spark, sf), 3)


@query(
    "state_group_means",
    f"WITH {SUMMARY} SELECT subject_id % 2 AS grp, round(avg(n_transitions), 1) AS n_transitions FROM summ GROUP BY 1",
)
def state_group_means(spark, sf):
    s = st.state_summary(states(spark, sf), 3).withColumn("grp", F.col("subject_id") % 2)
    return st.group_means(s, "grp", ["n_transitions"])


TRANS = f"""{ST}, nx AS (SELECT *, lead(state) OVER (PARTITION BY subject_id ORDER BY frame_idx) AS after FROM states),
  tr AS (SELECT subject_id, frame_idx / 5e1 AS t, state AS before, after FROM nx WHERE after <> state)"""
# Annotated events: customer orders on the same subjects, time folded into the recording length.
EVENTS = """ev AS (SELECT o_custkey AS subject_id, o_orderkey AS event_id, ((o_orderkey * 7) % 211) / 1.37e2 AS t, o_orderpriority AS event FROM orders)"""
ALIGNED = f"""{TRANS}, {EVENTS}, near AS (SELECT e.subject_id, e.event_id, e.event, e.t, r.t AS rt, r.before, r.after,
    row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - r.t), r.t) AS k FROM ev e LEFT JOIN tr r ON r.subject_id = e.subject_id),
  al AS (SELECT subject_id, event_id, event, t, rt AS nearest_transition_s, abs(t - rt) AS temporal_error_s, coalesce(before, -1) AS state_before,
    coalesce(after, -1) AS state_after, coalesce(abs(t - rt) <= 0.5, false) AS matched FROM near WHERE k = 1)"""


def annotated(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_orderkey") * 7 % 211 / F.lit(137.0)).alias("t"),
        F.col("o_orderpriority").alias("event"),
    )


def aligned(spark, sf):
    return st.align_events(annotated(spark, sf), st.transitions(states(spark, sf)), width=0.5)


@query("event_alignment", f"WITH {ALIGNED} SELECT * REPLACE (round(t, 6) AS t, round(temporal_error_s, 6) AS temporal_error_s) FROM al")
def event_alignment(spark, sf):
    return aligned(spark, sf).withColumns({"t": rnd("t"), "temporal_error_s": rnd("temporal_error_s")})


_ASUM = """count(*) AS n_events, CAST(sum(CAST(matched AS INT)) AS BIGINT) AS n_matched, round(avg(CAST(matched AS INT)), 6) AS match_rate, round(avg(temporal_error_s), 6) AS mean_error_s,
  round(stddev_pop(temporal_error_s), 6) + 0 AS std_error_s, round(quantile_cont(temporal_error_s, 0.5), 6) AS median_error_s"""


@query("alignment_by_subject", f"WITH {ALIGNED} SELECT subject_id, {_ASUM} FROM al GROUP BY 1")
def alignment_by_subject(spark, sf):
    return rounded(st.alignment_summary(aligned(spark, sf), ["subject_id"]), "subject_id", "n_events", "n_matched")


@query("alignment_by_event", f"WITH {ALIGNED} SELECT event, {_ASUM} FROM al GROUP BY 1")
def alignment_by_event(spark, sf):
    return rounded(st.alignment_summary(aligned(spark, sf), ["event"]), "event", "n_events", "n_matched")


AT = f"""{ST}, {EVENTS}, lens AS (SELECT subject_id, max(frame_idx) + 1 AS n FROM states GROUP BY 1),
  e AS (SELECT ev.*, n, CAST(greatest(least(floor(t * 50), n - 1), 0) AS BIGINT) AS f FROM ev JOIN lens USING (subject_id)),
  c AS (SELECT e.event_id, e.subject_id, e.event, s.state, count(*) AS n, count(*) FILTER (WHERE s.frame_idx >= f - 25 AND s.frame_idx < f + 25) AS h,
    max(CASE WHEN s.frame_idx = f THEN 1 ELSE 0 END) AS here FROM e JOIN states s ON s.subject_id = e.subject_id AND s.frame_idx >= f - 50 AND s.frame_idx < f + 50 GROUP BY ALL),
  atev AS (SELECT subject_id, event_id, event, max(state) FILTER (WHERE here = 1) AS state_at, arg_min(state, -n * 1000 + state) AS dominant_state,
    round(100.0 * max(n) / sum(n), 4) AS dominant_pct, arg_min(state, -h * 1000 + state) AS profile_state, count(*) FILTER (WHERE h > 0) > 1 AS has_transition FROM c GROUP BY ALL)"""


@query("state_at_event", f"WITH {AT} SELECT * FROM atev")
def state_at_event(spark, sf):
    x = st.states_at_events(annotated(spark, sf), states(spark, sf))
    return x.withColumn("dominant_pct", rnd("dominant_pct", 4))


@query("state_profiles", f"WITH {AT} SELECT profile_state, event, count(*) AS n FROM atev GROUP BY ALL")
def state_profiles(spark, sf):
    return st.state_profiles(st.states_at_events(annotated(spark, sf), states(spark, sf)))


# Decoded frames with channels: the state follows head height.
EC = ["head_pos_x", "left_hand_pos_y", "right_hand_pos_z", "head_rot_x"]
DECODED = f"""frames AS ({frames_sql(EC)}), dec AS (SELECT *, CASE WHEN head_pos_x < 0.3 THEN 0 WHEN head_pos_x < 0.6 THEN 1 ELSE 2 END AS state,
    CASE WHEN subject_id LIKE 'px%' THEN 1 ELSE 0 END AS y FROM frames),
  means AS (SELECT y, state, channel, avg(value) AS mean FROM dec UNPIVOT (value FOR channel IN ({", ".join(EC)})) GROUP BY y, state, channel)"""


def decoded(spark, sf):
    s = F.when(F.col("head_pos_x") < 0.3, 0).when(F.col("head_pos_x") < 0.6, 1).otherwise(2)
    return frames(spark, sf, EC).withColumns({"state": s, "y": F.col("subject_id").startswith("px").cast("int")})


def class_means(spark, sf):
    return st.state_means(decoded(spark, sf), EC, ["y"])


EMI = f"""{DECODED}, ch AS (SELECT y, channel, avg(mean) AS a, max(mean) - min(mean) AS r FROM means GROUP BY ALL),
  per AS (SELECT y, state, channel, abs(mean - a) * (r + 1e-8) AS s FROM means JOIN ch USING (y, channel)),
  pern AS (SELECT y, state, channel, s / (sum(s) OVER (PARTITION BY y, state) + 1e-12) AS importance FROM per)"""


@query("emission_importance_global", f"WITH {EMI} SELECT y, channel, round(r / (sum(r) OVER (PARTITION BY y) + 1e-12), 6) AS importance FROM ch")
def emission_importance_global(spark, sf):
    return rounded(st.emission_importance(class_means(spark, sf), ["y"])[0], "y", "channel")


@query("emission_importance_by_state", f"WITH {EMI} SELECT y, state, channel, round(importance, 6) AS importance FROM pern")
def emission_importance_by_state(spark, sf):
    return rounded(st.emission_importance(class_means(spark, sf), ["y"])[1], "y", "state", "channel")


@query(
    "state_averaged_importance",
    f"""WITH {EMI}, a AS (SELECT y, channel, avg(importance) AS v FROM pern GROUP BY ALL)
    SELECT y, channel, round(v / sum(v) OVER (PARTITION BY y), 6) AS importance, row_number() OVER (PARTITION BY y ORDER BY v DESC, channel) AS rank FROM a""",
)
def state_averaged_importance(spark, sf):
    per = st.emission_importance(class_means(spark, sf), ["y"])[1]
    return rounded(st.state_averaged_importance(per, ["y"]), "y", "channel", "rank")


@query("class_mean_difference", f"WITH {DECODED} SELECT a.state, a.channel, round(a.mean - b.mean, 6) + 0 AS difference FROM means a JOIN means b ON b.state = a.state AND b.channel = a.channel AND a.y = 1 AND b.y = 0")
def class_mean_difference(spark, sf):
    return rounded(st.class_difference(class_means(spark, sf), 1, 0), "state", "channel")


@query("top_state_channels", f"WITH {DECODED}, r AS (SELECT *, row_number() OVER (PARTITION BY y, state ORDER BY abs(mean) DESC, channel) AS rank FROM means) SELECT y, state, channel, rank FROM r WHERE rank <= 2")
def top_state_channels(spark, sf):
    return st.top_channels(class_means(spark, sf), 2, ["y"]).select("y", "state", "channel", "rank")


@query(
    "transition_matrix",
    f"""WITH {ST}, nx AS (SELECT *, lead(state) OVER (PARTITION BY subject_id ORDER BY frame_idx) AS nxt FROM states),
    c AS (SELECT state AS from_state, nxt AS to_state, count(*) AS n FROM nx WHERE nxt IS NOT NULL GROUP BY ALL)
    SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS probability FROM c""",
)
def transition_matrix(spark, sf):
    return rounded(st.transition_matrix(states(spark, sf)), "from_state", "to_state", "n")


@query(
    "merged_importance_parts",
    f"""WITH f AS ({FOLDS_SQL}), p AS (SELECT CAST(config AS BIGINT) AS channel_id, avg(val_acc) - 0.5 AS d FROM f GROUP BY 1)
    SELECT channel_id, round(CASE WHEN (SELECT sum(greatest(d, 0)) FROM p) > 1e-12 THEN greatest(d, 0) / (SELECT sum(greatest(d, 0)) FROM p) ELSE 0.2 END, 6) AS importance FROM p""",
)
def merged_importance_parts(spark, sf):
    parts = folds(spark, sf).groupBy(F.col("config").cast("long").alias("channel_id")).agg((F.avg("val_acc") - 0.5).alias("drop"))
    return rounded(st.merge_parts(parts, 5), "channel_id")


@query(
    "duration_rates",
    f"""WITH {RUNS} SELECT g.state, round(coalesce(avg(CAST(end_frame - start_frame + 1 AS DOUBLE)), 1), 6) AS rate FROM range(0, 4) g(state) LEFT JOIN runs r ON r.state = g.state GROUP BY 1""",
)
def duration_rates(spark, sf):
    return rounded(st.duration_rates(states(spark, sf), 4), "state")


DWELL = f"""{RUNS}, lam AS (SELECT subject_id % 2 AS cls, state, avg(CAST(end_frame - start_frame + 1 AS DOUBLE)) / 50 AS l FROM runs GROUP BY ALL),
  occ AS (SELECT subject_id % 2 AS cls, state, count(*) AS n FROM states GROUP BY ALL),
  dw AS (SELECT a.cls, a.state, a.l AS lambda_s, o.n / sum(o.n) OVER (PARTITION BY a.cls) AS empirical_occupancy,
    a.l >= 1.2 * (SELECT max(b.l) FROM lam b WHERE b.cls = a.cls AND b.state <> a.state) AS is_outlier FROM lam a JOIN occ o ON o.cls = a.cls AND o.state = a.state)"""


def dwell(spark, sf):
    s = states(spark, sf).withColumn("cls", F.col("subject_id") % 2)
    return st.dwell_table(s, 3, "cls", factor=1.2)


@query("dwell_table", f"WITH {DWELL} SELECT cls, state, round(lambda_s, 6) AS lambda_s, round(empirical_occupancy, 6) AS empirical_occupancy, is_outlier FROM dw")
def dwell_table(spark, sf):
    return rounded(dwell(spark, sf), "cls", "state", "is_outlier")


@query("dwell_difference", f"WITH {DWELL} SELECT a.state, round(a.lambda_s - b.lambda_s, 6) + 0 AS difference_s, round(a.lambda_s / b.lambda_s, 6) AS ratio FROM dw a JOIN dw b ON a.state = b.state AND a.cls = 1 AND b.cls = 0")
def dwell_difference(spark, sf):
    return rounded(st.dwell_difference(dwell(spark, sf), "cls", 1, 0), "state")


# ---------------------------------------------------------------- post-hoc

P = f"preds AS ({PREDS_SQL})"
SP = f"""{P}, sp AS (SELECT upper(subject_id) AS subject_id, task, paradigm, CASE WHEN subject_id LIKE 'px%' THEN 1 ELSE 0 END AS y_true,
  CASE WHEN avg(y_proba) >= 0.5 THEN 1 ELSE 0 END AS y_pred, avg(y_proba) AS y_proba FROM preds GROUP BY subject_id, task, paradigm)"""
IMP_FR = f"frames AS ({frames_sql()}), ser AS (SELECT task, channel, value FROM frames UNPIVOT (value FOR channel IN ({', '.join(CHANNELS)})))"
IMP = f"{IMP_FR}, imp AS (SELECT task, paradigm, channel, avg(value / CASE WHEN channel LIKE '%rot%' THEN 900e0 + paradigm ELSE 5e0 * paradigm END) AS importance FROM ser CROSS JOIN (VALUES (1), (2), (3), (4)) v(paradigm) GROUP BY ALL)"


def subject_preds(spark, sf):
    p = predictions(spark, sf).groupBy("subject_id", "task", "paradigm").agg(F.avg("y_proba").alias("y_proba"))
    return p.select(
        F.upper("subject_id").alias("subject_id"), "task", "paradigm", F.col("subject_id").startswith("px").cast("int").alias("y_true"),
        (F.col("y_proba") >= 0.5).cast("int").alias("y_pred"), "y_proba",
    )


def importance_map(spark, sf):
    m = frames(spark, sf).groupBy("task").agg(*[F.avg(c).alias(c) for c in CHANNELS])
    long = m.unpivot(["task"], CHANNELS, "channel", "m").withColumn("paradigm", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    scale = F.when(F.col("channel").contains("rot"), 900.0 + F.col("paradigm")).otherwise(5.0 * F.col("paradigm"))
    return long.select("task", "paradigm", "channel", (F.col("m") / scale).alias("importance"))


def patient_meta(spark, sf):
    return cohort.patient_laterality(subjects(spark, sf))


LAT = f"""{SP}, {LATERALITY_SQL}, {IMP}, rk AS (SELECT *, row_number() OVER (PARTITION BY task, paradigm ORDER BY importance DESC, channel) AS rank,
    CASE WHEN channel LIKE '%head%' THEN 'h' WHEN channel LIKE '%right%' THEN 'r' ELSE 'l' END AS g FROM imp),
  ti AS (SELECT task, paradigm, sum(importance) FILTER (WHERE g = 'l') AS li, sum(importance) FILTER (WHERE g = 'r') AS ri, sum(importance) FILTER (WHERE g = 'h') AS hi,
    avg(rank) FILTER (WHERE g = 'l') AS lr, avg(rank) FILTER (WHERE g = 'r') AS rr_, avg(rank) FILTER (WHERE g = 'h') AS hr,
    string_agg(concat(channel, format('({{:.3f}})', importance)), ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS top3_features FROM rk GROUP BY ALL),
  latimp AS (SELECT sp.task, sp.paradigm, sp.subject_id, m.laterality, y_pred, y_proba, y_true = y_pred AS correct,
    CASE WHEN m.laterality = 'Right' THEN ri ELSE li END AS ipsi, CASE WHEN m.laterality = 'Right' THEN li ELSE ri END AS contra, hi,
    CASE WHEN m.laterality = 'Right' THEN rr_ ELSE lr END AS ipsi_r, CASE WHEN m.laterality = 'Right' THEN lr ELSE rr_ END AS contra_r, hr, top3_features
    FROM sp JOIN pmeta m ON m.subject_id = sp.subject_id AND m.laterality IN ('Right', 'Left') JOIN ti ON ti.task = sp.task AND ti.paradigm = sp.paradigm WHERE y_true = 1)"""


@query(
    "laterality_importance",
    f"""WITH {LAT} SELECT task, paradigm, subject_id, laterality, y_pred, round(y_proba, 6) AS y_proba, correct, round(ipsi, 4) AS ipsi_imp, round(contra, 4) AS contra_imp, round(hi, 4) AS head_imp,
      round(ipsi_r, 2) AS ipsi_rank, round(contra_r, 2) AS contra_rank, round(hr, 2) AS head_rank, ipsi > contra AS ipsi_dominates, hi > greatest(ipsi, contra) AS head_dominates, top3_features FROM latimp""",
)
def laterality_importance(spark, sf):
    x = posthoc.laterality_importance(importance_map(spark, sf), subject_preds(spark, sf), patient_meta(spark, sf))
    return x.withColumn("y_proba", rnd("y_proba"))


@query(
    "laterality_summary",
    f"""WITH {LAT}, s AS (SELECT task, count(*) AS n_unilateral_px, count(*) FILTER (WHERE laterality = 'Right') AS n_right, count(*) FILTER (WHERE laterality = 'Left') AS n_left,
      {", ".join(f"sum(CAST(round(round({c}, 4) * 1e4) AS BIGINT))::DOUBLE / (1e4 * count({c})) AS m{c[0]}" for c in ("ipsi", "contra", "hi"))}, avg(CAST(ipsi > contra AS INT)) AS pi, avg(CAST(hi > greatest(ipsi, contra) AS INT)) AS ph, avg(CAST(correct AS INT)) AS pc FROM latimp WHERE paradigm = 1 GROUP BY 1)
    SELECT task, n_unilateral_px, n_right, n_left, mi AS mean_ipsi_imp, mc AS mean_contra_imp, mh AS mean_head_imp, round(pi, 6) AS pct_ipsi_dom, round(ph, 6) AS pct_head_dom, round(pc, 6) AS pct_correct,
      CASE WHEN ph > 0.5 THEN 'head' WHEN pi > 0.5 THEN 'ipsilateral' ELSE 'mixed' END AS interpretation FROM s""",
)
def laterality_summary(spark, sf):
    x = posthoc.laterality_importance(importance_map(spark, sf), subject_preds(spark, sf), patient_meta(spark, sf))
    return rounded(posthoc.laterality_summary(x, 1), "task", "n_unilateral_px", "n_right", "n_left", "interpretation", "mean_ipsi_imp", "mean_contra_imp", "mean_head_imp")


CELL_SQL = """CASE WHEN m.laterality = 'Bilateral' THEN 'Bilateral' WHEN m.hand IS NULL THEN concat(m.laterality, '_Unknown')
  WHEN m.laterality IN ('Right', 'Left') AND left(m.laterality, 1) = m.hand THEN concat(m.laterality, '_DomInjured')
  WHEN m.laterality IN ('Right', 'Left') AND m.hand IN ('R', 'L') THEN concat(m.laterality, '_DomUnaffected') ELSE concat(m.laterality, '_', m.hand) END"""


@query(
    "hand_crosstab",
    f"""WITH {SP}, {LATERALITY_SQL}, x AS (SELECT sp.*, {CELL_SQL} AS cell FROM sp JOIN pmeta m ON m.subject_id = sp.subject_id WHERE y_true = 1),
    g AS (SELECT * FROM (VALUES (1), (2), (3), (4)) p(paradigm) CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) t(task)
      CROSS JOIN (VALUES ('Right_DomInjured'), ('Right_DomUnaffected'), ('Left_DomInjured'), ('Left_DomUnaffected'), ('Bilateral')) c(cell))
    SELECT g.paradigm, g.task, g.cell, count(x.subject_id) AS n, CAST(sum(CAST(y_proba AS DECIMAL(28,12))) AS DOUBLE) / count(y_proba) AS mean_proba, round(avg(CAST(y_true = y_pred AS INT)), 6) AS pct_correct,
      CAST(coalesce(sum(CAST(y_true = y_pred AS INT)), 0) AS BIGINT) AS n_correct FROM g LEFT JOIN x ON x.paradigm = g.paradigm AND x.task = g.task AND x.cell = g.cell GROUP BY ALL""",
)
def hand_crosstab(spark, sf):
    rows = posthoc.hand_rows(subject_preds(spark, sf), patient_meta(spark, sf))
    return rounded(posthoc.hand_crosstab(rows, list(range(1, 7)), [1, 2, 3, 4]), "paradigm", "task", "cell", "n", "n_correct", "mean_proba")


SCORED = f"{SP}, {LATERALITY_SQL}, sc AS (SELECT sp.task, sp.paradigm, sp.subject_id, sp.y_proba, round(m.avg_dash, 0) AS q FROM sp JOIN pmeta m ON m.subject_id = sp.subject_id)"


def scored_preds(spark, sf):
    m = patient_meta(spark, sf).select("subject_id", F.round("avg_dash", 0).alias("q"))
    return subject_preds(spark, sf).join(m, "subject_id")


@query(
    "spearman_scores",
    f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY task, paradigm ORDER BY y_proba) + (count(*) OVER (PARTITION BY task, paradigm, y_proba) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY task, paradigm ORDER BY q) + (count(*) OVER (PARTITION BY task, paradigm, q) - 1) / 2.0 AS ry FROM sc WHERE q IS NOT NULL)
    SELECT task, paradigm, count(*) AS n, CASE WHEN count(*) >= 4 THEN round(corr(rx, ry), 6) + 0 END AS rho FROM r GROUP BY ALL""",
)
def spearman_scores(spark, sf):
    return rounded(posthoc.spearman(scored_preds(spark, sf), "y_proba", "q", ["task", "paradigm"]), "task", "paradigm", "n")


# With rho = sin(a) the p-value is the part of the integral of cos^(n - 3) over 0 .. pi / 2 that lies beyond a (Simpson's rule).
@query(
    "spearman_significance",
    f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY task, paradigm ORDER BY y_proba) + (count(*) OVER (PARTITION BY task, paradigm, y_proba) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY task, paradigm ORDER BY q) + (count(*) OVER (PARTITION BY task, paradigm, q) - 1) / 2.0 AS ry FROM sc WHERE q IS NOT NULL),
    s AS (SELECT task, paradigm, count(*) AS n, CASE WHEN count(*) >= 4 THEN corr(rx, ry) END AS rho FROM r GROUP BY ALL),
    w AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 4001) t(i)),
    p AS (SELECT task, paradigm, any_value(n) AS n, any_value(rho) AS rho, (pi() / 2 - any_value(asin(abs(rho)))) * sum(w * pow(greatest(cos(asin(abs(rho)) + (pi() / 2 - asin(abs(rho))) * i / 4000), 0), n - 3))
      / (pi() / 2 * sum(w * pow(greatest(cos(pi() / 2 * i / 4000), 0), n - 3))) AS p_value FROM s, w GROUP BY task, paradigm),
    k AS (SELECT *, row_number() OVER (PARTITION BY paradigm ORDER BY p_value, task) AS k, count(*) OVER (PARTITION BY paradigm) AS m FROM p WHERE p_value IS NOT NULL),
    b AS (SELECT task, paradigm, least(1, min(p_value * m / k) OVER (PARTITION BY paradigm ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)
    SELECT p.task, p.paradigm, n, round(rho, 6) + 0 AS rho, round(p_value, 6) AS p_value, round(b.q, 6) AS q FROM p LEFT JOIN b ON b.task = p.task AND b.paradigm = p.paradigm""",
)
def spearman_significance(spark, sf):
    s = posthoc.spearman(scored_preds(spark, sf), "y_proba", "q", ["task", "paradigm"])
    return rounded(posthoc.benjamini_hochberg(posthoc.spearman_p(s), "p_value", ["paradigm"]), "task", "paradigm", "n")


@query(
    "benjamini_hochberg",
    f"""WITH {P}, h AS (SELECT model, sample_id, CASE WHEN task = 6 THEN NULL ELSE y_proba * y_proba END AS p FROM preds), n AS (SELECT * FROM h WHERE p IS NOT NULL),
    r AS (SELECT *, p * count(*) OVER (PARTITION BY model) / row_number() OVER (PARTITION BY model ORDER BY p, sample_id) AS raw,
      row_number() OVER (PARTITION BY model ORDER BY p, sample_id) AS k FROM n),
    q AS (SELECT model, sample_id, least(1, min(raw) OVER (PARTITION BY model ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
    SELECT h.model, h.sample_id, round(h.p, 6) AS p, round(q.q, 6) AS q FROM h LEFT JOIN q USING (model, sample_id)""",
)
def benjamini_hochberg(spark, sf):
    x = predictions(spark, sf).select("model", "sample_id", F.when(F.col("task") != 6, F.col("y_proba") * F.col("y_proba")).alias("p"))
    return rounded(posthoc.benjamini_hochberg(x, "p", ["model"]), "model", "sample_id")


@query(
    "missed_patients",
    f"""WITH {SP}, px AS (SELECT DISTINCT subject_id, task, CAST(length(subject_id) + task - 3 AS DOUBLE) AS q_score FROM sp WHERE task <> 5)
    SELECT sp.subject_id, sp.task, sp.paradigm, round(y_proba, 6) AS y_proba, q_score, CASE WHEN q_score <= 2 THEN 'low self-reported difficulty'
      WHEN q_score >= 4 THEN 'high self-reported difficulty' ELSE '' END AS note FROM sp LEFT JOIN px ON px.subject_id = sp.subject_id AND px.task = sp.task WHERE y_true = 1 AND y_pred = 0""",
)
def missed_patients(spark, sf):
    p = subject_preds(spark, sf)
    scores = p.filter("task <> 5").select("subject_id", "task", (F.length("subject_id") + F.col("task") - 3).cast("double").alias("q_score")).distinct()
    x = posthoc.missed_patients(p, scores)
    return x.select("subject_id", "task", "paradigm", rnd("y_proba").alias("y_proba"), "q_score", "note")


@query("cohort_overview", f"WITH {LATERALITY_SQL} SELECT laterality, dia_code, count(*) AS n, round(avg(avg_dash), 6) + 0 AS mean_avg_dash FROM pmeta GROUP BY ALL")
def cohort_overview(spark, sf):
    return rounded(posthoc.cohort_overview(patient_meta(spark, sf), ["laterality", "dia_code"], ["avg_dash"]), "laterality", "dia_code", "n")


# Experiment rows from fold records: method and frequency from the config, metric = validation accuracy.
EXPS = f"exps AS (SELECT *, CAST(10 * (config + 1) AS INT) AS freq, CASE WHEN fold % 2 = 0 THEN 'truncate' ELSE 'pad' END AS method FROM ({FOLDS_SQL}))"


def experiments(spark, sf):
    return folds(spark, sf).withColumns(
        {"freq": 10 * (F.col("config") + 1), "method": F.when(F.col("fold") % 2 == 0, "truncate").otherwise("pad")}
    )


@query("metric_by_frequency", f"WITH {EXPS} SELECT method, model, freq, round(avg(val_acc), 6) AS mean, round(stddev_samp(val_acc), 6) AS std, count(val_acc) AS n FROM exps GROUP BY ALL")
def metric_by_frequency(spark, sf):
    return rounded(posthoc.metric_by(experiments(spark, sf), "val_acc", ["method", "model", "freq"]), "method", "model", "freq", "n")


@query(
    "best_runs",
    f"""WITH {EXPS}, b AS (SELECT method, freq, model, avg(val_acc) AS mean, coalesce(stddev_samp(val_acc), 0) AS std, max(val_acc) AS best FROM exps GROUP BY ALL),
    k AS (SELECT method, freq, model, epochs, fold, row_number() OVER (PARTITION BY method, freq, model ORDER BY val_acc DESC, epochs DESC, fold DESC) AS r FROM exps)
    SELECT b.method, b.freq, b.model, round(mean, 6) AS mean, round(std, 6) AS std, round(best, 6) AS best, epochs, fold FROM b JOIN k USING (method, freq, model) WHERE r = 1""",
)
def best_runs(spark, sf):
    return rounded(posthoc.best_runs(experiments(spark, sf), "val_acc", ["method", "freq", "model"], ["epochs", "fold"]), "method", "freq", "model", "epochs", "fold")


@query(
    "importance_columns",
    f"""WITH {IMP}, r AS (SELECT *, row_number() OVER (PARTITION BY task, paradigm ORDER BY importance DESC, channel) AS rank FROM imp)
    SELECT task, paradigm, {", ".join(f"round(max(importance) FILTER (WHERE channel = '{c}'), 6) AS imp_{c}, max(rank) FILTER (WHERE channel = '{c}') AS rank_{c}" for c in CHANNELS)} FROM r GROUP BY ALL""",
)
def importance_columns(spark, sf):
    x = posthoc.importance_columns(importance_map(spark, sf), ["task", "paradigm"], CHANNELS)
    return rounded(x, "task", "paradigm", *[f"rank_{c}" for c in CHANNELS])


@query(
    "top_features",
    f"""WITH {IMP}, r AS (SELECT *, row_number() OVER (PARTITION BY task, paradigm ORDER BY importance DESC, channel) AS rank FROM imp)
    SELECT task, paradigm, {", ".join(f"max(channel) FILTER (WHERE rank = {k}) AS top{k}" for k in (1, 2, 3))} FROM r GROUP BY ALL""",
)
def top_features(spark, sf):
    return posthoc.top_features(importance_map(spark, sf), ["task", "paradigm"])


@query(
    "subject_analysis_table",
    f"""WITH {SP}, {LATERALITY_SQL}, {SUMMARY}, c AS (SELECT subject_id, laterality FROM pmeta),
    p1 AS (SELECT subject_id, max(y_true) AS y_true, CASE WHEN avg(y_proba) >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM sp GROUP BY 1),
    s1 AS (SELECT concat('PX', CAST(subject_id AS STRING)) AS subject_id, n_frames, n_transitions FROM summ),
    e1 AS (SELECT concat('PX', CAST(user_id AS STRING)) AS subject_id, count(*) AS n_events FROM events GROUP BY 1)
    SELECT c.subject_id, c.laterality, round(m.avg_dash, 6) AS avg_dash, y_true, y_pred, n_frames, n_transitions, n_events, y_true = y_pred AS correct,
      coalesce(y_true = 1 AND y_pred = 0, false) AS false_negative, coalesce(y_true = 0 AND y_pred = 1, false) AS false_positive, coalesce(n_transitions = 0, false) AS flat
    FROM c LEFT JOIN pmeta m ON m.subject_id = c.subject_id LEFT JOIN p1 ON p1.subject_id = c.subject_id LEFT JOIN s1 ON s1.subject_id = c.subject_id LEFT JOIN e1 ON e1.subject_id = c.subject_id""",
)
def subject_analysis_table(spark, sf):
    meta = patient_meta(spark, sf)
    p = subject_preds(spark, sf).groupBy("subject_id").agg(F.max("y_true").alias("y_true"), (F.avg("y_proba") >= 0.5).cast("int").alias("y_pred"))
    name = F.concat(F.lit("px"), F.col("subject_id").cast("string"))
    s = st.state_summary(states(spark, sf), 3).select(name.alias("subject_id"), "n_frames", "n_transitions")
    e = states(spark, sf).groupBy(name.alias("subject_id")).agg(F.count(F.lit(1)).alias("n_events"))
    scores = meta.select("subject_id", rnd("avg_dash").alias("avg_dash"))
    return posthoc.subject_table(meta.select("subject_id", "laterality"), scores, p, s, e)


@query("alignment_per_subject_row", f"WITH {ALIGNED} SELECT subject_id, count(*) AS n_events, round(avg(CAST(matched AS INT)), 6) AS match_rate, round(avg(temporal_error_s), 6) AS mean_error_s FROM al GROUP BY 1")
def alignment_per_subject_row(spark, sf):
    x = st.alignment_summary(aligned(spark, sf), ["subject_id"]).select("subject_id", "n_events", "match_rate", "mean_error_s")
    return rounded(x, "subject_id", "n_events")


@query(
    "state_percent_long",
    f"WITH {SUMMARY} {' UNION ALL '.join(f'SELECT subject_id, n_frames, CAST({s} AS INT) AS state, state{s}_pct AS percent FROM summ' for s in range(3))}",
)
def state_percent_long(spark, sf):
    return posthoc.state_percent_long(st.state_summary(states(spark, sf), 3), 3, ["subject_id", "n_frames"])


@query(
    "importance_sheet",
    f"""WITH {IMP}, r AS (SELECT *, row_number() OVER (PARTITION BY task, paradigm ORDER BY importance DESC, channel) AS rank FROM imp)
    SELECT task, paradigm, channel, rank, round(rank / 18.0, 6) AS normalised_rank, rank <= 6 AS in_top FROM r""",
)
def importance_sheet(spark, sf):
    x = posthoc.importance_sheet(importance_map(spark, sf), ["task", "paradigm"])
    return x.select("task", "paradigm", "channel", "rank", rnd("normalised_rank").alias("normalised_rank"), "in_top")


MODELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "best_model_table",
    f"""WITH {EXPS} SELECT task, config, {", ".join(f"round(max(val_acc) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in MODELS)},
      arg_max(model, concat(format('{{:.9f}}', val_acc), model)) AS best_model FROM exps GROUP BY ALL""",
)
def best_model_table(spark, sf):
    return rounded(posthoc.best_model_table(experiments(spark, sf), "val_acc", MODELS, ["task", "config"]), "task", "config", "best_model")


@query(
    "coverage_report",
    f"""WITH {P}, g AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7)) t(task) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) p(paradigm) CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('none')) m(model))
    SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM preds WHERE preds.task = g.task AND preds.paradigm = g.paradigm AND preds.model = g.model)""",
)
def coverage_report(spark, sf):
    return posthoc.coverage_report(predictions(spark, sf), list(range(1, 8)), list(range(1, 6)), ["1-URGENT", "2-HIGH", "none"])


@query(
    "sensor_shares",
    f"""WITH {IMP}, s AS (SELECT task, paradigm, concat(CASE WHEN channel LIKE '%head%' THEN 'head' WHEN channel LIKE '%right%' THEN 'right_hand' ELSE 'left_hand' END, '_',
      CASE WHEN channel LIKE '%pos%' THEN 'pos' ELSE 'rot' END) AS sensor_group, sum(importance) AS v FROM imp GROUP BY ALL)
    SELECT task, paradigm, sensor_group, round(v / sum(v) OVER (PARTITION BY task, paradigm), 6) AS share FROM s""",
)
def sensor_shares(spark, sf):
    return rounded(posthoc.sensor_shares(importance_map(spark, sf), ["task", "paradigm"]), "task", "paradigm", "sensor_group")
