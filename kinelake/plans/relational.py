"""Queries for slicing, repair, metadata, cohorts and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING, rotation_channels
from kinelake.functions.expr import rnd
from kinelake.operators import align, cohort, ordering, quality
from kinelake.plans.fixtures import FORMULAS, SUBJECTS_SQL, SURVEY_SQL, frames, frames_sql, largest, subjects, survey, table
from kinelake.plans.registry import query
from kinelake.sources import logs

TASK_LABELS = {1: "1-URGENT", 2: "2-HIGH", 3: "3-MEDIUM", 4: "4-NOT SPECIFIED", 5: "5-LOW"}
MARKERS_SQL = """markers AS (SELECT o_custkey AS subject_id, CAST(datediff('day', TIMESTAMP '1970-01-01', o_orderdate) AS DOUBLE) AS ts,
  o_orderpriority AS name, o_orderkey AS row_no FROM orders)"""
INTERVALS_SQL = (
    MARKERS_SQL
    + """, firsts AS (SELECT subject_id, name, ts, row_no FROM (SELECT *, row_number() OVER (
      PARTITION BY subject_id, name ORDER BY row_no) AS k FROM markers) WHERE k = 1),
  labels(task, name) AS (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM'), (4, '4-NOT SPECIFIED'), (5, '5-LOW')),
  starts AS (SELECT subject_id, task, ts, row_no FROM firsts JOIN labels USING (name)),
  tail AS (SELECT s.subject_id, arg_min(m.ts, m.row_no) AS ts FROM starts s JOIN markers m
    ON m.subject_id = s.subject_id AND m.row_no > s.row_no WHERE s.task = 5 GROUP BY 1),
  intervals AS (
    SELECT a.subject_id, a.task, a.ts AS start_s, b.ts AS end_s FROM starts a JOIN starts b
      ON b.subject_id = a.subject_id AND b.task = a.task + 1
    UNION ALL SELECT s.subject_id, 5, s.ts, coalesce(t.ts, CAST('inf' AS DOUBLE)) FROM starts s
      LEFT JOIN tail t ON t.subject_id = s.subject_id WHERE s.task = 5)"""
)


def markers(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.unix_date(F.to_date("o_orderdate")).cast("double").alias("ts"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("row_no"),
    )


@query(
    "task_intervals",
    f"WITH {INTERVALS_SQL} SELECT subject_id, task, start_s, CASE WHEN isinf(end_s) THEN -1 ELSE end_s END AS end_s FROM intervals",
)
def task_intervals(spark, sf):
    out = align.task_intervals(markers(spark, sf), TASK_LABELS)
    return out.withColumn("end_s", F.when(F.col("end_s") == float("inf"), -1.0).otherwise(F.col("end_s")))


@query(
    "slice_recordings",
    f"""WITH {INTERVALS_SQL}, movement AS (SELECT l_suppkey AS subject_id,
      CAST(datediff('day', TIMESTAMP '1970-01-01', l_shipdate) AS DOUBLE) AS t, l_extendedprice AS v, l_orderkey AS k FROM lineitem)
    SELECT m.subject_id, i.task, m.t, m.v, m.k FROM movement m JOIN intervals i ON m.subject_id = i.subject_id
      AND m.t >= i.start_s AND m.t < i.end_s""",
)
def slice_recordings(spark, sf):
    movement = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"),
        F.unix_date(F.to_date("l_shipdate")).cast("double").alias("t"),
        F.col("l_extendedprice").alias("v"),
        F.col("l_orderkey").alias("k"),
    )
    cut = align.slice_recordings(movement, align.task_intervals(markers(spark, sf), TASK_LABELS))
    return cut.select("subject_id", "task", "t", "v", "k")


ROT = rotation_channels(CHANNELS)[:4]


def _unwrap_sql(c: str) -> str:
    d = f"({c} - p_{c})"
    w = f"(({d} + 180) - 360 * floor(({d} + 180) / 360) - 180)"
    return (
        f"CASE WHEN p_{c} IS NULL OR abs({d}) < 180 THEN 0 ELSE (CASE WHEN {w} = -180 AND {d} > 0 THEN 180 "
        f"ELSE {w} END) - {d} END"
    )


@query(
    "repair_rotations",
    f"""WITH frames AS ({frames_sql(ROT)}),
    l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p_{c}, first_value({c}) OVER w AS f_{c}" for c in ROT)} FROM frames
      WINDOW w AS (PARTITION BY subject_id, task ORDER BY frame_idx)),
    s AS (SELECT *, {", ".join(f"{_unwrap_sql(c)} AS d_{c}" for c in ROT)} FROM l)
    SELECT subject_id, task, frame_idx, {", ".join(
        f"round({c} + sum(d_{c}) OVER w - CASE WHEN f_{c} > 180 THEN 360 ELSE 0 END, 6) + 0 AS {c}" for c in ROT)}
    FROM s WINDOW w AS (PARTITION BY subject_id, task ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""",
)
def repair_rotations(spark, sf):
    out = align.unwrap_rotations(frames(spark, sf, ROT), ROT, RECORDING)
    return out.select(*RECORDING, "frame_idx", *[rnd(c).alias(c) for c in ROT])


@query(
    "semantic_projection",
    """SELECT l_suppkey AS subject_id, l_quantity AS head_pos_x, l_extendedprice AS head_pos_y, l_orderkey AS k
    FROM lineitem WHERE l_quantity IS NOT NULL""",
)
def semantic_projection(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.col("l_quantity").alias("HPosX"),
        F.col("l_extendedprice").alias("HPosY"), F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("t_s"),
    )
    named = align.semantic_names(
        align.drop_time(raw).withColumn("t_s", F.lit(0.0)), {"head_pos_x": "HPosX", "head_pos_y": "HPosY"}, ["subject_id", "k"]
    )
    return align.complete_channels(named, ["head_pos_x", "head_pos_y"], ["subject_id"])


@query(
    "subject_keys_and_frame_time",
    f"""WITH frames AS ({frames_sql(CHANNELS[:1])}), keyed AS (SELECT concat(subject_id, '_task', CAST(task AS STRING), '_trial1') AS window_id,
      frame_idx FROM frames)
    SELECT split_part(window_id, '_', 1) AS subject_id, count(*) AS n, max(frame_idx) / 5e1 AS last_t FROM keyed GROUP BY 1""",
)
def subject_keys(spark, sf):
    x = frames(spark, sf, CHANNELS[:1]).select(
        F.concat_ws("_", "subject_id", F.concat(F.lit("task"), F.col("task").cast("string")), F.lit("trial1")).alias(
            "window_id"
        ),
        "frame_idx",
    )
    return x.groupBy(align.subject_of("window_id").alias("subject_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max(align.frame_time("frame_idx")).alias("last_t")
    )


EVENTS_SQL = """ev AS (SELECT concat('u', CAST(user_id AS STRING)) AS subject_id, epoch_us(ts) / 1e6 AS ts, event_type AS event,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Left hand used' WHEN 1 THEN 'RIGHT hand used' WHEN 2 THEN 'both hands'
    WHEN 3 THEN 'used left' ELSE NULL END AS hand_used, event_id FROM events)"""


def event_log(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"),
        F.col("event_type").alias("event"),
        F.expr(
            "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Left hand used' WHEN 1 THEN 'RIGHT hand used' "
            "WHEN 2 THEN 'both hands' WHEN 3 THEN 'used left' ELSE NULL END"
        ).alias("hand_used"),
        "event_id",
    )


@query(
    "relative_events_with_hand",
    f"""WITH {EVENTS_SQL} SELECT upper(subject_id) AS subject_id, event_id, round(ts - min(ts) OVER (PARTITION BY subject_id), 5) + 0 AS rel_s,
      CASE WHEN hand_used IS NULL OR NOT lower(split_part(hand_used, ' ', 1)) IN ('left', 'right') THEN event
        ELSE concat(event, ' - ', lower(split_part(hand_used, ' ', 1))) END AS label,
      CASE WHEN lower(hand_used) LIKE '%left%' THEN 'left' WHEN lower(hand_used) LIKE '%right%' THEN 'right' END AS hand
    FROM ev""",
)
def relative_events_with_hand(spark, sf):
    e = align.relative_events(event_log(spark, sf))
    return e.select(
        "subject_id",
        "event_id",
        rnd("rel_s", 5).alias("rel_s"),
        align.event_label("event", "hand_used").alias("label"),
        align.parse_hand("hand_used").alias("hand"),
    )


@query(
    "single_subject_slice",
    f"""WITH {INTERVALS_SQL}, movement AS (SELECT l_suppkey AS subject_id,
      CAST(datediff('day', TIMESTAMP '1970-01-01', l_shipdate) AS DOUBLE) + l_orderkey / 1e9 AS t,
      l_quantity AS head_pos_x, {FORMULAS["head_rot_x"]} AS head_rot_x FROM lineitem WHERE l_suppkey = 7),
    cut AS (SELECT m.subject_id, i.task, row_number() OVER (PARTITION BY i.task ORDER BY m.t) - 1 AS frame_idx, m.t, m.head_pos_x, m.head_rot_x
    FROM movement m JOIN intervals i ON m.subject_id = i.subject_id AND m.t >= i.start_s AND m.t < i.end_s),
    l AS (SELECT *, lag(head_rot_x) OVER w AS p_head_rot_x, first_value(head_rot_x) OVER w AS f FROM cut WINDOW w AS (PARTITION BY task ORDER BY frame_idx)),
    s AS (SELECT *, {_unwrap_sql("head_rot_x")} AS d FROM l)
    SELECT subject_id, task, frame_idx, round(t, 6) + 0 AS t, head_pos_x,
      round(head_rot_x + sum(d) OVER (PARTITION BY task ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) - CASE WHEN f > 180 THEN 360 ELSE 0 END, 6) + 0 AS head_rot_x FROM s""",
)
def single_subject_slice(spark, sf):
    movement = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"),
        (F.unix_date(F.to_date("l_shipdate")) + F.col("l_orderkey") / F.lit(1e9)).alias("t"),
        F.col("l_quantity").alias("head_pos_x"),
        F.expr(FORMULAS["head_rot_x"]).alias("head_rot_x"),
    )
    marks = logs.marker_log(markers(spark, sf).withColumnsRenamed({"ts": "Timestamp", "name": "Name"}), strict=True)
    out = align.subject_test_slice(movement, marks, TASK_LABELS, 7, ["head_pos_x", "head_rot_x"], ["subject_id", "task"])
    return out.select("subject_id", "task", "frame_idx", rnd("t").alias("t"), "head_pos_x", rnd("head_rot_x").alias("head_rot_x"))


@query(
    "stored_vector_order",
    """WITH ids AS (SELECT o_custkey AS experiment, concat('t', CAST(o_orderkey AS STRING)) AS tag, o_totalprice AS value FROM orders),
    vec AS (SELECT experiment, list(value ORDER BY tag) AS vals FROM ids GROUP BY 1)
    SELECT i.experiment, i.tag, v.vals[row_number() OVER (PARTITION BY i.experiment ORDER BY i.tag)] AS value
    FROM ids i JOIN vec v ON v.experiment = i.experiment""",
)
def stored_vector_order(spark, sf):
    ids = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("experiment"),
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tag"),
        F.col("o_totalprice").alias("v"),
    )
    # The stored layout of old result files: one value array per experiment, in tag order.
    packed = ids.groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct("tag", "v"))).alias("p"))
    vectors = packed.select("experiment", F.transform("p", lambda s: s["v"]).alias("values"))
    return align.order_stored_vectors(vectors, ids.drop("v")).select("experiment", "tag", "value")


# ---------------------------------------------------------------- metadata and survey

SIDES = """coalesce(CAST(try_cast(dia_side_r AS DOUBLE) AS INT), 0) AS rr, coalesce(CAST(try_cast(dia_side_l AS DOUBLE) AS INT), 0) AS ll"""
INJURY = """CASE dia_code WHEN 0 THEN 'healthy' WHEN 1 THEN 'rotator_cuff' WHEN 2 THEN 'glenohumeral_arthritis'
  WHEN 3 THEN 'biceps_tendonitis' WHEN 4 THEN 'shoulder_bursitis' END"""
CLINICAL_SQL = f"""px AS ({SUBJECTS_SQL}), sided AS (SELECT *, {SIDES} FROM px),
  clinical AS (SELECT id, age, CASE WHEN sex = 1 THEN 'male' ELSE 'female' END AS gender, dia_code AS diagnosis_code,
    coalesce({INJURY}, 'unknown') AS injury_type,
    CASE WHEN rr = 1 AND ll = 1 THEN 'bilateral' WHEN rr = 1 THEN 'right' WHEN ll = 1 THEN 'left' ELSE 'none' END AS laterality,
    CASE WHEN try_cast(hand_xr AS DOUBLE) = 1 THEN 'right' ELSE 'left' END AS dominant_hand,
    rr = 1 AS affected_side_right, ll = 1 AS affected_side_left, c_dash, x_dash, c_and_x FROM sided)"""


@query(
    "clinical_metadata",
    f"""WITH {CLINICAL_SQL} SELECT id, age, gender, diagnosis_code, injury_type, laterality, dominant_hand, affected_side_right,
      affected_side_left, round(c_dash, 6) + 0 AS dash, round(x_dash, 6) + 0 AS quick_dash, round(c_and_x, 6) + 0 AS combined FROM clinical""",
)
def clinical_metadata(spark, sf):
    s = F.col("baseline_scores")
    return cohort.parse_clinical(subjects(spark, sf)).select(
        "id", "age", "gender", "diagnosis_code", "injury_type", "laterality", "dominant_hand", "affected_side_right",
        "affected_side_left", rnd(s["dash"]).alias("dash"), rnd(s["quick_dash"]).alias("quick_dash"),
        rnd(s["combined"]).alias("combined"),
    )


@query(
    "clinical_issues",
    f"""WITH {CLINICAL_SQL} SELECT id, CASE WHEN age NOT BETWEEN 0 AND 120 THEN concat('age:', CAST(age AS STRING))
      ELSE '' END AS issues FROM clinical""",
)
def clinical_issues(spark, sf):
    return cohort.parse_clinical(subjects(spark, sf)).select(
        "id", F.array_join(cohort.clinical_issues(), "; ").alias("issues")
    )


@query(
    "control_defaults",
    f"""WITH {CLINICAL_SQL}, pat AS (SELECT * FROM clinical WHERE id LIKE 'px%')
    SELECT DISTINCT concat(CASE WHEN s_suppkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(s_suppkey AS STRING)) AS id,
      coalesce(diagnosis_code, 0) AS diagnosis_code, coalesce(injury_type, 'healthy') AS injury_type, age,
      coalesce(affected_side_right, false) AS affected_side_right
    FROM supplier LEFT JOIN pat ON pat.id = concat(CASE WHEN s_suppkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(s_suppkey AS STRING))""",
)
def control_defaults(spark, sf):
    ids = table(spark, sf, "supplier").select(
        F.expr("concat(CASE WHEN s_suppkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(s_suppkey AS STRING))").alias("id")
    )
    patients = cohort.parse_clinical(subjects(spark, sf)).filter(F.col("id").startswith("px"))
    return cohort.with_control_defaults(ids, patients).select(
        "id", "diagnosis_code", "injury_type", "age", "affected_side_right"
    )


KEYED = "translate(lower(trim(response)), ' _''’‘', '')"
ANSWER_SQL = f"""answers AS ({SURVEY_SQL}), scored AS (SELECT *, CASE
  WHEN CAST(trunc(try_cast(trim(response) AS DOUBLE)) AS INT) BETWEEN 1 AND 5 THEN CAST(trunc(try_cast(trim(response) AS DOUBLE)) AS INT)
  WHEN {KEYED} IN ('nodifficulty', 'none', 'no', '1') THEN 1 WHEN {KEYED} IN ('milddifficulty', 'mild', '2') THEN 2
  WHEN {KEYED} IN ('moderatedifficulty', 'moderate', '3') THEN 3 WHEN {KEYED} IN ('severedifficulty', 'severe', '4') THEN 4
  WHEN {KEYED} IN ('unable', 'extreme', '5', 'cantsleep', 'cantmove', 'somuchdifficulty') THEN 5
  WHEN {KEYED} LIKE 'nodifficulty%' THEN 1 WHEN {KEYED} LIKE 'milddifficulty%' THEN 2
  WHEN {KEYED} LIKE 'moderate%' THEN 3 WHEN {KEYED} LIKE 'severe%' THEN 4
  WHEN {KEYED} LIKE 'unable%' OR {KEYED} LIKE 'extreme%' OR {KEYED} LIKE 'cantsleep%' OR {KEYED} LIKE 'cantmove%'
    OR {KEYED} LIKE 'somuchdifficulty%' THEN 5 END AS v FROM answers)"""
QS = cohort.QUESTIONS[:6]
WIDE_SQL = (
    "wide AS (SELECT subject_id, "
    + ", ".join(f"arg_max(v, row_no) FILTER (WHERE q = {i + 1} AND v IS NOT NULL) AS {n}" for i, n in enumerate(QS))
    + " FROM scored GROUP BY 1)"
)


@query("survey_answers", f"WITH {ANSWER_SQL} SELECT subject_id, q, row_no, v FROM scored")
def survey_answers(spark, sf):
    return survey(spark, sf).select("subject_id", "q", "row_no", cohort.parse_response("response").alias("v"))


@query(
    "survey_scores",
    f"""WITH {ANSWER_SQL}, {WIDE_SQL}, m AS (SELECT *, list_filter([{", ".join(QS)}], lambda x: x IS NOT NULL) AS a FROM wide)
    SELECT subject_id, {", ".join(QS)}, CASE WHEN len(a) = 6 THEN round((list_sum(a) / 6.0 - 1) * 25, 6) END AS score_all,
      CASE WHEN len(a) > 0 THEN round((CAST(list_sum(a) AS DOUBLE) / len(a) - 1) * 25, 6) END AS score_present FROM m""",
)
def survey_scores(spark, sf):
    wide = cohort.survey_wide(survey(spark, sf), QS)
    return wide.select(
        "subject_id",
        *QS,
        rnd(cohort.survey_score(QS, True)).alias("score_all"),
        rnd(cohort.survey_score(QS, False)).alias("score_present"),
    )


@query(
    "diagnosis_text",
    f"""WITH px AS ({SUBJECTS_SQL}) SELECT id, coalesce(CASE WHEN trim(diagnosis) = '' THEN NULL ELSE trim(diagnosis) END,
      {INJURY}, 'healthy') AS diagnosis, try_cast(dia_side_l AS DOUBLE) AS side_l FROM px""",
)
def diagnosis_text(spark, sf):
    px = subjects(spark, sf)
    return px.select(
        "id",
        cohort.diagnosis_text().alias("diagnosis"),
        cohort.numeric_alias(px, ["left_side", "DIA_SIDE_L"], "side_l"),
    )


LATERALITY_SQL = f"""px AS ({SUBJECTS_SQL}), sided AS (SELECT *, {SIDES}, CASE upper(trim(hand_xr)) WHEN 'R' THEN 'R' WHEN 'RIGHT' THEN 'R'
    WHEN '1' THEN 'R' WHEN 'L' THEN 'L' WHEN 'LEFT' THEN 'L' WHEN '0' THEN 'L' WHEN '2' THEN 'L' WHEN '3' THEN 'B' END AS hand FROM px),
  lat AS (SELECT *, CASE WHEN rr = 1 AND ll = 1 THEN 'Bilateral' WHEN rr = 1 THEN 'Right' WHEN ll = 1 THEN 'Left' ELSE 'Unknown' END
    AS laterality FROM sided WHERE upper(id) LIKE 'PX%'),
  pmeta AS (SELECT upper(id) AS subject_id, dia_code, rr AS dia_side_r, ll AS dia_side_l, hand, laterality,
    coalesce(c_and_x, (c_dash + x_dash) / 2) AS avg_dash, laterality = 'Bilateral' AS is_bilateral,
    laterality IN ('Right', 'Left') AS is_unilateral,
    CASE WHEN laterality IN ('Right', 'Left') AND hand IN ('R', 'L') THEN left(laterality, 1) = hand END AS dom_congruent FROM lat)"""


@query(
    "patient_laterality",
    f"WITH {LATERALITY_SQL} SELECT * REPLACE (round(avg_dash, 6) + 0 AS avg_dash) FROM pmeta",
)
def patient_laterality(spark, sf):
    return cohort.patient_laterality(subjects(spark, sf)).withColumn("avg_dash", rnd("avg_dash"))


@query(
    "metadata_join",
    f"""WITH px AS ({SUBJECTS_SQL}), frames AS ({frames_sql(CHANNELS[:1])}), recs AS (SELECT subject_id, task, count(*) AS n FROM frames GROUP BY ALL)
    SELECT r.subject_id, r.task, r.n, p.age, round(CASE r.task WHEN 1 THEN c_dash WHEN 2 THEN x_dash WHEN 3 THEN c_and_x END, 6) + 0 AS task_score
    FROM recs r LEFT JOIN px p ON upper(p.id) = upper(r.subject_id)""",
)
def metadata_join(spark, sf):
    recs = frames(spark, sf, CHANNELS[:1]).groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))
    meta = subjects(spark, sf).select("id", "age", "c_dash", "x_dash", "c_and_x")
    out = cohort.attach_metadata(recs, meta, {1: "c_dash", 2: "x_dash", 3: "c_and_x"})
    return out.withColumn("task_score", rnd("task_score"))


# ---------------------------------------------------------------- cohorts

# The paradigm shapes of the dataset: all / prefix / metadata / metadata_exclude.
PARADIGMS = {
    1: {"g1_filter": "all", "g0_filter": {"source": "control", "filter": "all"}},
    2: {
        "g1_filter": {"source": "patient", "filter": "metadata", "column": "dia_code", "values": [1]},
        "g0_filter": {"source": "control", "filter": "subject_prefix", "prefix": "fx"},
    },
    3: {
        "g1_filter": {"source": "patient", "filter": "metadata_exclude", "column": "dia_code", "values": [1]},
        "g0_filter": {"source": "control", "filter": "subject_prefix", "prefix": "fx"},
    },
    4: {
        "g1_filter": {"source": "patient", "filter": "metadata", "column": "dia_code", "values": [1]},
        "g0_filter": {"source": "patient", "filter": "metadata_exclude", "column": "dia_code", "values": [1]},
    },
}
ROSTER_SQL = f"""roster AS (SELECT DISTINCT concat(CASE WHEN l_suppkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(l_suppkey AS STRING)) AS id,
    CASE WHEN l_suppkey % 3 = 0 THEN 'control' ELSE 'patient' END AS grp FROM lineitem),
  meta AS (SELECT * FROM ({SUBJECTS_SQL}) WHERE nation <> 4)"""
PICK_SQL = {
    ("g1", 1): "grp = 'patient'",
    ("g0", 1): "grp = 'control'",
    ("g1", 2): "grp = 'patient' AND id IN (SELECT id FROM meta WHERE dia_code IN (1))",
    ("g0", 2): "grp = 'control' AND id LIKE 'fx%'",
    ("g1", 3): "grp = 'patient' AND NOT EXISTS (SELECT 1 FROM meta WHERE meta.id = roster.id AND dia_code IN (1))",
    ("g0", 3): "grp = 'control' AND id LIKE 'fx%'",
    ("g1", 4): "grp = 'patient' AND id IN (SELECT id FROM meta WHERE dia_code IN (1))",
    ("g0", 4): "grp = 'patient' AND NOT EXISTS (SELECT 1 FROM meta WHERE meta.id = roster.id AND dia_code IN (1))",
}
SKIP = {"g1": ["px1", "px2"], "g0": ["fx3"]}


def roster(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .select("l_suppkey")
        .distinct()
        .select(
            F.expr("concat(CASE WHEN l_suppkey % 3 = 0 THEN 'fx' ELSE 'px' END, CAST(l_suppkey AS STRING))").alias("id"),
            F.expr("CASE WHEN l_suppkey % 3 = 0 THEN 'control' ELSE 'patient' END").alias("grp"),
        )
    )


def _cohort_sql(p: int) -> str:
    parts = []
    for g, y in (("g1", 1), ("g0", 0)):
        drop = ", ".join(f"'{i}'" for i in SKIP[g])
        parts.append(
            f"SELECT '{g}_' || id AS sample_id, id AS subject_id, {y} AS y FROM roster WHERE {PICK_SQL[(g, p)]} AND id NOT IN ({drop})"
        )
    return " UNION ALL ".join(parts)


def _register_paradigm(p: int) -> None:
    @query(f"paradigm_{p}_cohort", f"WITH {ROSTER_SQL} {_cohort_sql(p)}")
    def run(spark, sf):
        meta = subjects(spark, sf).filter("nation <> 4")
        return cohort.binary_cohort(roster(spark, sf), meta, PARADIGMS[p], SKIP)


for _p in PARADIGMS:
    _register_paradigm(_p)

LABEL_FILTERS = {
    "cuff": {"source": "patient", "filter": "metadata", "column": "dia_code", "values": [1, 2]},
    "other": {"source": "patient", "filter": "metadata_exclude", "column": "dia_code", "values": [1]},
    "control": {"source": "control", "filter": "all"},
}


@query(
    "multilabel_cohort",
    f"""WITH {ROSTER_SQL}, l AS (
      SELECT id, 'cuff' AS label FROM roster WHERE grp = 'patient' AND id IN (SELECT id FROM meta WHERE dia_code IN (1, 2))
      UNION ALL SELECT id, 'other' FROM roster WHERE grp = 'patient' AND NOT EXISTS (SELECT 1 FROM meta WHERE meta.id = roster.id AND dia_code = 1)
      UNION ALL SELECT id, 'control' FROM roster WHERE grp = 'control')
    SELECT id AS subject_id, max(CAST(label = 'cuff' AS INT)) AS cuff, max(CAST(label = 'other' AS INT)) AS other,
      max(CAST(label = 'control' AS INT)) AS control FROM l GROUP BY 1""",
)
def multilabel_cohort(spark, sf):
    return cohort.multilabel_cohort(roster(spark, sf), subjects(spark, sf).filter("nation <> 4"), LABEL_FILTERS)


@query(
    "stored_cohort_sizes",
    f"""WITH {ROSTER_SQL}, c AS ({_cohort_sql(4)}) SELECT y, count(*) AS n,
      count(*) = CASE y WHEN 1 THEN 10 WHEN 0 THEN 55 END AS matches FROM c GROUP BY y""",
)
def stored_cohort_sizes(spark, sf):
    meta = subjects(spark, sf).filter("nation <> 4")
    return cohort.check_sizes(cohort.binary_cohort(roster(spark, sf), meta, PARADIGMS[4], SKIP), {1: 10, 0: 55})


# ---------------------------------------------------------------- quality and outliers

GAPPY = ["c1", "c2", "c3"]
GAPPY_SQL = """gappy AS (SELECT user_id AS subject_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS c1,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE value * 2e0 END AS c2, value AS c3 FROM events)"""


def gappy(spark, sf):
    """An irregular series with holes: subject = user."""
    raw = table(spark, sf, "events").select(
        F.col("user_id").alias("subject_id"), "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END").alias("c1"),
        F.expr("CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE value * 2e0 END").alias("c2"),
        F.col("value").alias("c3"),
    )
    return ordering.position(
        raw, ["subject_id"], F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"],
        max_rows=largest(raw, sf, "states", ["subject_id"]),
    ).drop("ts", "event_id")


COMPLETE_SQL = """comp AS (SELECT subject_id, count(*) AS total_frames, 100.0 * count(c1) / count(*) AS c1_pct,
  100.0 * count(c2) / count(*) AS c2_pct, 100.0 * count(c3) / count(*) AS c3_pct FROM gappy GROUP BY 1)"""
GAPS_SQL = """gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY subject_id ORDER BY frame_idx) AS gap FROM gappy),
  temporal AS (SELECT subject_id, CASE WHEN sum(gap) > 0 THEN count(*) / sum(gap) END AS sampling_rate, avg(gap) AS mean_frame_interval,
    stddev_pop(gap) AS frame_interval_std, coalesce(sum(gap), 0) AS duration,
    CASE WHEN count(*) >= 2 AND avg(gap) > 0 THEN 1 - stddev_pop(gap) / avg(gap) ELSE 0 END AS frame_interval_consistency
    FROM gaps GROUP BY 1)"""


@query(
    "channel_completeness",
    f"""WITH {GAPPY_SQL}, {COMPLETE_SQL} SELECT subject_id, total_frames, 0.0::DOUBLE AS missing_frames_pct, round(c1_pct, 6) AS c1_pct,
      round(c2_pct, 6) AS c2_pct, round(c3_pct, 6) AS c3_pct, round((c1_pct + c2_pct + c3_pct) / 3, 6) AS overall_quality_score FROM comp""",
)
def channel_completeness(spark, sf):
    out = quality.completeness(gappy(spark, sf), GAPPY, ["subject_id"])
    return out.select(
        "subject_id", "total_frames", "missing_frames_pct",
        *[rnd(c).alias(c) for c in ("c1_pct", "c2_pct", "c3_pct", "overall_quality_score")],
    )


@query(
    "temporal_quality",
    f"""WITH {GAPPY_SQL}, {GAPS_SQL} SELECT subject_id, round(sampling_rate, 9) AS sampling_rate, round(mean_frame_interval, 3) AS mean_frame_interval,
      round(frame_interval_std, 3) AS frame_interval_std, round(duration, 3) AS duration,
      round(frame_interval_consistency, 6) + 0 AS frame_interval_consistency FROM temporal""",
)
def temporal_quality(spark, sf):
    out = quality.temporal_quality(gappy(spark, sf), "t", ["subject_id"])
    return out.select(
        "subject_id", rnd("sampling_rate", 9).alias("sampling_rate"),
        *[rnd(c, 3).alias(c) for c in ("mean_frame_interval", "frame_interval_std", "duration")],
        rnd("frame_interval_consistency").alias("frame_interval_consistency"),
    )


@query(
    "quality_report",
    f"""WITH {GAPPY_SQL}, {COMPLETE_SQL}, {GAPS_SQL}, j AS (SELECT c.*, t.duration, (c1_pct + c2_pct + c3_pct) / 3 AS q FROM comp c
      JOIN temporal t ON t.subject_id = c.subject_id), r AS (SELECT *, list_filter([
        CASE WHEN q < 100 THEN format('quality:{{:.1f}}', q) END,
        CASE WHEN total_frames < 25 THEN concat('frames:', total_frames) END,
        CASE WHEN duration < 0.1 THEN format('duration:{{:.3f}}', duration) END], lambda x: x IS NOT NULL) AS reasons FROM j)
    SELECT subject_id, total_frames, round(duration, 3) AS duration, len(reasons) = 0 AS passes_quality_check,
      array_to_string(reasons, '; ') AS failure_reasons FROM r""",
)
def quality_report(spark, sf):
    out = quality.quality_report(gappy(spark, sf), GAPPY, "t", ["subject_id"])
    return out.select(
        "subject_id",
        F.col("movement_quality.total_frames").alias("total_frames"),
        rnd(F.col("temporal_quality.duration"), 3).alias("duration"),
        "passes_quality_check",
        F.array_join("failure_reasons", "; ").alias("failure_reasons"),
    )


@query(
    "recording_validator",
    f"""WITH {GAPPY_SQL}, {GAPS_SQL} SELECT subject_id, CAST(count(*) - count(t) AS BIGINT) AS length_mismatch,
      round(100.0 * (3 * count(*) - count(c1) - count(c2) - count(c3)) / (3 * count(*)), 6) AS nan_pct, CAST(0 AS BIGINT) AS inf_count,
      coalesce(min(gap) >= 0, true) AS time_ordered FROM gaps GROUP BY 1""",
)
def recording_validator(spark, sf):
    out = quality.validate(gappy(spark, sf), GAPPY, "t", ["subject_id"])
    return out.withColumn("nan_pct", rnd("nan_pct"))


TRIALS_SQL = """trials AS (SELECT concat('w', CAST(l_orderkey AS STRING)) AS window_id, concat('s', CAST(any_value(o_custkey) AS STRING)) AS subject_id,
  CAST(l_orderkey % 6 + 1 AS INT) AS task_number, sum(l_quantity) / 5e1 AS duration_seconds
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)"""


def trials(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    d = li.groupBy("l_orderkey").agg((F.sum("l_quantity") / F.lit(50.0)).alias("duration_seconds"))
    return d.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("w"), F.col("l_orderkey").cast("string")).alias("window_id"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("subject_id"),
        F.expr("CAST(l_orderkey % 6 + 1 AS INT)").alias("task_number"),
        "duration_seconds",
    )


IQR_SQL = """b AS (SELECT quantile_cont(duration_seconds, 0.25) AS q1, quantile_cont(duration_seconds, 0.75) AS q3 FROM trials),
  f AS (SELECT t.*, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi, (duration_seconds < q1 - 3 * (q3 - q1))
    OR (duration_seconds > q3 + 3 * (q3 - q1)) AS is_outlier FROM trials t, b)"""


@query("iqr_outliers", f"WITH {TRIALS_SQL}, {IQR_SQL} SELECT window_id, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, is_outlier FROM f")
def iqr_outliers(spark, sf):
    out = quality.flag_outliers(trials(spark, sf), "iqr")
    return out.select("window_id", rnd("lower_bound").alias("lower_bound"), rnd("upper_bound").alias("upper_bound"), "is_outlier")


@query(
    "zscore_outliers",
    f"""WITH {TRIALS_SQL}, b AS (SELECT avg(duration_seconds) AS m, stddev_pop(duration_seconds) AS s FROM trials)
    SELECT window_id, round(CASE WHEN s > 0 THEN abs((duration_seconds - m) / s) ELSE 0 END, 6) AS zscore,
      CASE WHEN s > 0 THEN abs((duration_seconds - m) / s) ELSE 0 END > 3 AS is_outlier FROM trials, b""",
)
def zscore_outliers(spark, sf):
    out = quality.flag_outliers(trials(spark, sf), "zscore")
    return out.select("window_id", rnd("zscore").alias("zscore"), "is_outlier")


@query(
    "percentile_outliers",
    f"""WITH {TRIALS_SQL}, b AS (SELECT quantile_cont(duration_seconds, 0.01) AS lo, quantile_cont(duration_seconds, 1.0) AS hi FROM trials)
    SELECT window_id, duration_seconds < lo OR duration_seconds > hi AS is_outlier FROM trials, b""",
)
def percentile_outliers(spark, sf):
    return quality.flag_outliers(trials(spark, sf), "percentile").select("window_id", "is_outlier")


@query(
    "task_duration_caps",
    f"""WITH {TRIALS_SQL}, caps(task_number, cap) AS (VALUES (1, 3.0), (2, 4.5), (3, NULL), (4, 1.0), (5, 6.0), (6, NULL))
    SELECT t.task_number, CAST(cap AS DOUBLE) AS max_allowed, count(*) AS n_trials, CAST(sum(CASE WHEN duration_seconds > cap THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
      max(duration_seconds) AS actual_max FROM trials t JOIN caps ON caps.task_number = t.task_number GROUP BY ALL""",
)
def task_duration_caps(spark, sf):
    caps = {1: 3.0, 2: 4.5, 3: None, 4: 1.0, 5: 6.0, 6: None}
    return quality.task_caps_report(quality.flag_outliers(trials(spark, sf), "task_specific", caps))


@query(
    "outlier_summary",
    f"""WITH {TRIALS_SQL}, {IQR_SQL} SELECT count(*) AS n_trials, CAST(sum(CAST(is_outlier AS INT)) AS BIGINT) AS n_outliers,
      round(avg(CAST(is_outlier AS INT)), 6) AS outlier_rate, CAST(sum(CAST(duration_seconds < lo AS INT)) AS BIGINT) AS n_lower_outliers,
      CAST(sum(CAST(duration_seconds > hi AS INT)) AS BIGINT) AS n_upper_outliers FROM f""",
)
def outlier_summary(spark, sf):
    out = quality.outlier_counts(quality.flag_outliers(trials(spark, sf), "iqr"))
    return out.withColumn("outlier_rate", rnd("outlier_rate"))


@query(
    "outlier_report",
    f"""WITH {TRIALS_SQL}, b AS (SELECT avg(duration_seconds) AS m, stddev_pop(duration_seconds) AS s FROM trials)
    SELECT window_id, subject_id, task_number, duration_seconds, 'statistical outlier' AS reason FROM trials, b
    WHERE abs((duration_seconds - m) / s) > 3 ORDER BY window_id LIMIT 20""",
)
def outlier_report(spark, sf):
    return quality.outlier_report(quality.flag_outliers(trials(spark, sf), "zscore"))
