"""Subject metadata, survey scores and cohort selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Diagnosis codes, hand codes and survey answers.
INJURY_NAMES = {
    0: "healthy", 1: "rotator_cuff", 2: "glenohumeral_arthritis", 3: "biceps_tendonitis", 4: "shoulder_bursitis",
}
HAND_CODES = {
    "R": "R", "L": "L", "B": "B", "RIGHT": "R", "LEFT": "L", "BOTH": "B", "BILATERAL": "B",
    "0": "L", "1": "R", "2": "L", "3": "B",
}
ANSWERS = {
    "nodifficulty": 1, "none": 1, "no": 1, "1": 1,
    "milddifficulty": 2, "mild": 2, "2": 2,
    "moderatedifficulty": 3, "moderate": 3, "3": 3,
    "severedifficulty": 4, "severe": 4, "4": 4,
    "unable": 5, "extreme": 5, "5": 5,
    "cantsleep": 5, "cantmove": 5, "somuchdifficulty": 5,
}
QUESTIONS = [
    "q1_jar", "q2_key", "q3_household", "q4_back_wash", "q5_knife", "q6_recreational", "q7_social", "q8_work",
    "q9_pain", "q10_tingling", "q11_sleep",
]


def lookup(key: Column, table: dict, default=None) -> Column:
    """Literal map lookup (constant-folded, no join)."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def flag(c: str) -> Column:
    """Side flag: numeric-or-zero."""
    return F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)").cast("int"), F.lit(0))


def laterality(right: Column, left: Column, names=("bilateral", "right", "left", "none")) -> Column:
    both, r, l, none = names
    return (
        F.when((right == 1) & (left == 1), both).when(right == 1, r).when(left == 1, l).otherwise(none)
    )


def parse_clinical(df: DataFrame) -> DataFrame:
    """Typed clinical rows: injury name, sex, laterality, dominant hand and a score struct."""
    right, left = flag("dia_side_r"), flag("dia_side_l")
    return df.select(
        "id",
        "age",
        F.when(F.col("sex") == 1, "male").otherwise("female").alias("gender"),
        F.col("dia_code").alias("diagnosis_code"),
        lookup(F.col("dia_code"), INJURY_NAMES, "unknown").alias("injury_type"),
        laterality(right, left).alias("laterality"),
        F.when(F.expr("try_cast(hand_xr AS DOUBLE)") == 1, "right").otherwise("left").alias("dominant_hand"),
        (right == 1).alias("affected_side_right"),
        (left == 1).alias("affected_side_left"),
        F.struct(
            F.col("c_dash").alias("dash"), F.col("x_dash").alias("quick_dash"), F.col("c_and_x").alias("combined")
        ).alias("baseline_scores"),
    )


def clinical_issues() -> Column:
    """Array of problems of a parsed clinical row."""
    return F.array_compact(
        F.array(
            F.when(~F.col("age").between(0, 120), F.concat(F.lit("age:"), "age")),
            F.when(
                F.col("gender").isNotNull() & ~F.col("gender").isin("male", "female"),
                F.concat(F.lit("gender:"), "gender"),
            ),
            F.when(F.coalesce(F.length("injury_type"), F.lit(0)) == 0, "injury_type:"),
        )
    )


def with_control_defaults(subjects: DataFrame, clinical: DataFrame) -> DataFrame:
    """Left join; subjects without a clinical row get the healthy-control defaults."""
    j = subjects.join(clinical, "id", "left")
    fill = {
        "diagnosis_code": F.lit(0),
        "injury_type": F.lit("healthy"),
        "affected_side_right": F.lit(False),
        "affected_side_left": F.lit(False),
    }
    return j.withColumns({c: F.coalesce(c, v) for c, v in fill.items()})


def parse_response(text: Column | str) -> Column:
    """Survey answer to 1-5: a number, else a normalised phrase, else a phrase prefix (key length >= 6)."""
    t = F.trim(text)
    number = F.expr("try_cast(trim({}) AS DOUBLE)".format(text)).cast("int") if isinstance(text, str) else None
    key = F.translate(F.lower(t), " _'’‘", "")
    prefix = F.coalesce(*[F.when(key.startswith(k), v) for k, v in ANSWERS.items() if len(k) >= 6])
    return F.coalesce(F.when(number.between(1, 5), number), lookup(key, ANSWERS), prefix)


def survey_wide(answers: DataFrame, questions: list[str]) -> DataFrame:
    """One column per question, last valid answer wins."""
    scored = answers.withColumn("v", parse_response("response"))
    return scored.groupBy("subject_id").agg(
        *[
            F.max_by("v", F.when((F.col("q") == i + 1) & F.col("v").isNotNull(), F.col("row_no"))).alias(name)
            for i, name in enumerate(questions)
        ]
    )


def survey_score(questions: list[str], require_all: bool = True) -> Column:
    """(mean answer - 1) * 25, over all answers or over the ones present."""
    a = F.array_compact(F.array(*questions))
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    score = (F.try_divide(total, F.size(a).cast("double")) - 1.0) * 25.0
    return F.when(F.size(a) == len(questions), score) if require_all else score


def diagnosis_text() -> Column:
    """Free text unless blank, else the code's name, else the control label."""
    text = F.nullif(F.trim("diagnosis"), F.lit(""))
    return F.coalesce(text, lookup(F.col("dia_code"), INJURY_NAMES), F.lit("healthy"))


def numeric_alias(df: DataFrame, aliases: list[str], name: str) -> Column:
    """First column whose name matches an alias ignoring case, as a number or NULL."""
    have = {c.lower(): c for c in df.columns}
    for a in aliases:
        if a.lower() in have:
            return F.expr(f"try_cast(`{have[a.lower()]}` AS DOUBLE)").alias(name)
    return F.lit(None).cast("double").alias(name)


def patient_laterality(df: DataFrame) -> DataFrame:
    """Patients with side flags, dominant hand, laterality, congruence and mean score."""
    right, left = flag("dia_side_r"), flag("dia_side_l")
    out = df.filter(F.upper("id").startswith("PX")).select(
        F.upper("id").alias("subject_id"),
        "dia_code",
        right.alias("dia_side_r"),
        left.alias("dia_side_l"),
        lookup(F.upper(F.trim("hand_xr")), HAND_CODES).alias("hand"),
        laterality(right, left, ("Bilateral", "Right", "Left", "Unknown")).alias("laterality"),
        F.coalesce("c_and_x", (F.col("c_dash") + F.col("x_dash")) / 2.0).alias("avg_dash"),
    )
    lat, hand = F.col("laterality"), F.col("hand")
    one_side = lat.isin("Right", "Left")
    return out.withColumns(
        {
            "is_bilateral": lat == "Bilateral",
            "is_unilateral": one_side,
            "dom_congruent": F.when(one_side & hand.isin("R", "L"), F.left(lat, F.lit(1)) == hand),
        }
    )


def attach_metadata(rows: DataFrame, meta: DataFrame, task_columns: dict[int, str]) -> DataFrame:
    """Left join on the upper-cased id and pick the row's per-task question column."""
    m = meta.withColumn("_id", F.upper("id")).drop("id")
    j = rows.withColumn("_id", F.upper("subject_id")).join(m, "_id", "left").drop("_id")
    pick = F.create_map(*[x for t, c in task_columns.items() for x in (F.lit(t), F.col(c).cast("double"))])
    return j.withColumn("task_score", F.try_element_at(pick, F.col("task"))).drop(*set(task_columns.values()))


def select_group(subjects: DataFrame, meta: DataFrame, spec: dict) -> DataFrame:
    """Subjects (id, grp) that pass one cohort filter; semi/anti joins, never NOT IN."""
    if isinstance(spec, str):
        if spec != "all":
            raise ValueError(f"unknown cohort filter {spec!r}")
        return subjects.filter(F.col("grp") == "patient")
    rows = subjects.filter(F.col("grp") == spec.get("source", "patient"))
    kind = spec.get("filter", "all")
    if kind == "all":
        return rows
    if kind == "subject_prefix":
        return rows.filter(F.col("id").startswith(spec["prefix"]))
    if kind in ("metadata", "metadata_exclude"):
        hit = meta.filter(F.col(spec["column"]).isin(spec["values"])).select("id")
        return rows.join(hit, "id", "left_semi" if kind == "metadata" else "left_anti")
    raise ValueError(f"unknown cohort filter {kind!r}")


def exclude(subjects: DataFrame, ids: list[str]) -> DataFrame:
    return subjects.filter(~F.col("id").isin(ids)) if ids else subjects


def binary_cohort(subjects: DataFrame, meta: DataFrame, paradigm: dict, drop: dict[str, list[str]] = {}) -> DataFrame:
    """g1 (y=1) and g0 (y=0) with class-prefixed sample ids."""
    parts = []
    for tag, y in (("g1", 1), ("g0", 0)):
        part = exclude(select_group(subjects, meta, paradigm[f"{tag}_filter"]), drop.get(tag, []))
        parts.append(
            part.select(
                F.concat(F.lit(f"{tag}_"), "id").alias("sample_id"), F.col("id").alias("subject_id"), F.lit(y).alias("y")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def multilabel_cohort(subjects: DataFrame, meta: DataFrame, labels: dict[str, dict]) -> DataFrame:
    """Multi-hot rows over the union of all label filters; a subject may carry several labels."""
    parts = [
        select_group(subjects, meta, spec).select(F.col("id").alias("subject_id"), F.lit(name).alias("label"))
        for name, spec in labels.items()
    ]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("subject_id").pivot("label", list(labels)).agg(F.max(F.lit(1))).fillna(0, list(labels))


def check_sizes(cohort: DataFrame, expected: dict[int, int]) -> DataFrame:
    """Class sizes against the stored result's sizes."""
    sizes = cohort.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("matches", F.col("n") == lookup(F.col("y"), expected, -1))
