"""Queries for cross-validation plans and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING
from kinelake.functions.expr import rnd, unit_sql
from kinelake.operators import evaluate as ev
from kinelake.operators import features
from kinelake.plans.fixtures import (
    FOLDS_SQL,
    LABEL_PREDS_SQL,
    PREDS_SQL,
    folds,
    frames,
    frames_sql,
    label_predictions,
    predictions,
    table,
)
from kinelake.plans.registry import query

P = f"preds AS ({PREDS_SQL})"
LP = f"preds AS ({LABEL_PREDS_SQL})"
FR = f"folds AS ({FOLDS_SQL})"
SAMPLES = f"frames AS ({frames_sql(CHANNELS[:1])}), samples AS (SELECT subject_id, task, count(*) AS n FROM frames GROUP BY ALL)"
LOSO = "loso AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS fold FROM (SELECT DISTINCT subject_id FROM samples))"


def samples(spark, sf):
    return frames(spark, sf, CHANNELS[:1]).groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))


def rounded(df, *keep, digits=6):
    return df.select(*keep, *[rnd(c, digits).alias(c) for c in df.columns if c not in keep])


@query("loso_folds", f"WITH {SAMPLES}, {LOSO} SELECT s.subject_id, s.task, fold FROM samples s JOIN loso USING (subject_id)")
def loso_folds(spark, sf):
    s = samples(spark, sf)
    return s.join(ev.subject_folds(s), "subject_id").select("subject_id", "task", "fold")


@query(
    "fold_roles",
    f"""WITH {SAMPLES}, {LOSO} SELECT k AS fold, s.subject_id, s.task, CASE WHEN k = l.fold THEN 'test' ELSE 'train' END AS role
    FROM samples s JOIN loso l USING (subject_id), (SELECT fold AS k FROM loso) v""",
)
def fold_roles(spark, sf):
    return ev.fold_roles(samples(spark, sf)).select("fold", "subject_id", "task", "role")


@query(
    "fold_sizes",
    f"WITH {SAMPLES} SELECT subject_id, count(*) AS n_test, (SELECT count(*) FROM samples) - count(*) AS n_train FROM samples GROUP BY 1",
)
def fold_sizes(spark, sf):
    return ev.fold_sizes(samples(spark, sf))


INNER = f"""{LOSO}, pairs AS (SELECT k AS fold, subject_id, {unit_sql("subject_id", "42 + k")} AS u FROM loso l, (SELECT fold AS k FROM loso) v WHERE k <> l.fold),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY u, subject_id) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS n FROM pairs)"""


@query(
    "inner_holdout",
    f"WITH {SAMPLES}, {INNER} SELECT fold, subject_id, CASE WHEN pos < greatest(round_even(n * 0.15, 0), 1) THEN 'validation' ELSE 'train' END AS role FROM ordered",
)
def inner_holdout(spark, sf):
    return ev.inner_holdout(samples(spark, sf))


@query("inner_kfold", f"WITH {SAMPLES}, {INNER} SELECT fold, subject_id, ntile(5) OVER (PARTITION BY fold ORDER BY u, subject_id) - 1 AS inner_fold FROM ordered")
def inner_kfold(spark, sf):
    return ev.inner_kfold(samples(spark, sf))


@query(
    "parameter_grid",
    f"""WITH {P}, k AS (SELECT DISTINCT task, paradigm FROM preds), o AS (SELECT task, paradigm, 100 AS max_duration FROM k WHERE task = 4)
    SELECT DISTINCT k.task, k.paradigm, n_components, covariance_type, coalesce(o.max_duration, d) AS max_duration FROM k
      CROSS JOIN (VALUES (2), (3), (4)) a(n_components) CROSS JOIN (VALUES ('diag'), ('full')) b(covariance_type) CROSS JOIN (VALUES (200), (250)) c(d)
      LEFT JOIN o ON o.task = k.task AND o.paradigm = k.paradigm""",
)
def parameter_grid(spark, sf):
    keys = predictions(spark, sf).select("task", "paradigm").distinct()
    override = keys.filter("task = 4").withColumn("max_duration", F.lit(100))
    grid = {"n_components": [2, 3, 4], "covariance_type": ["diag", "full"], "max_duration": [200, 250]}
    return ev.parameter_grid(keys, grid, override)


CHOSEN = f"""{FR}, means AS (SELECT model, fold % 20 AS fold, config, avg(val_acc) AS score, avg(epochs) AS mean_epochs FROM folds GROUP BY ALL),
  chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY -score, config) AS k FROM means) WHERE k = 1)"""


def chosen(spark, sf):
    f = folds(spark, sf).withColumn("fold", F.col("fold") % 20)
    return ev.choose_config(f, "val_acc", "config", ["model", "fold"], lower=False)


@query("choose_config", f"WITH {CHOSEN} SELECT model, fold, config, round(score, 6) AS score, round(mean_epochs, 6) AS mean_epochs FROM chosen")
def choose_config(spark, sf):
    return rounded(chosen(spark, sf), "model", "fold", "config")


@query("most_common_config", f"WITH {CHOSEN} SELECT config, count(*) AS n, min(fold) AS first_fold FROM chosen GROUP BY 1 ORDER BY n DESC, first_fold LIMIT 1")
def most_common_config(spark, sf):
    return ev.most_common_config(chosen(spark, sf), "config")


@query(
    "fold_records",
    f"""WITH {P}, {FR}, n AS (SELECT CAST(regexp_replace(subject_id, '[a-z]+', '') AS BIGINT) AS fold, * FROM preds)
    SELECT n.fold, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS n_pos, arg_min(y_proba, sample_id) AS first_proba, round(any_value(f.val_acc), 6) AS val_acc
    FROM n LEFT JOIN folds f ON f.fold = n.fold GROUP BY 1""",
)
def fold_records(spark, sf):
    p = predictions(spark, sf).withColumn("fold", F.regexp_replace("subject_id", "[a-z]+", "").cast("long"))
    r = ev.fold_records(p, folds(spark, sf).select("fold", "val_acc"))
    return r.select(
        "fold",
        F.size("y_true").cast("long").alias("n"),
        F.aggregate("y_true", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_pos"),
        F.get("y_proba", F.lit(0)).alias("first_proba"),
        rnd("val_acc").alias("val_acc"),
    )


CONF = """c AS (SELECT model, CAST(sum(CAST(y_true = 1 AND y_pred = 1 AS INT)) AS DOUBLE) AS tp, CAST(sum(CAST(y_true = 0 AND y_pred = 1 AS INT)) AS DOUBLE) AS fp,
  CAST(sum(CAST(y_true = 1 AND y_pred = 0 AS INT)) AS DOUBLE) AS fn, CAST(sum(CAST(y_true = 0 AND y_pred = 0 AS INT)) AS DOUBLE) AS tn FROM preds GROUP BY 1)"""


@query(
    "binary_metrics",
    f"WITH {P}, {CONF} SELECT model, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 3) AS ba, round(tp / (tp + fn), 3) AS recall, round(tp / (tp + fp), 3) AS precision, round(2 * tp / (2 * tp + fp + fn), 3) AS f1 FROM c",
)
def binary_metrics(spark, sf):
    return ev.binary_metrics(predictions(spark, sf), ["model"])


AUC_SQL = """ranked AS (SELECT model, y_true, rank() OVER (PARTITION BY model ORDER BY y_proba) + (count(*) OVER (PARTITION BY model, y_proba) - 1) / 2.0 AS r FROM preds),
  auc AS (SELECT model, (sum(r) FILTER (WHERE y_true = 1) - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2.0)
    / (count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true = 0)) AS auc FROM ranked GROUP BY 1)"""


@query("roc_auc", f"WITH {P}, {AUC_SQL} SELECT model, round(auc, 6) AS auc FROM auc")
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(predictions(spark, sf), ["model"]), "model")


_POIS = " + ".join(f"CAST(u > {c!r} AS INT)" for c in ev.POISSON_CDF)


@query(
    "bootstrap_auc",
    f"""WITH {LP}, b AS (SELECT label, r, y_true, y_proba, (('0x' || substr(md5(concat_ws('|', sample_id, r // 4, 42)), CAST(8 * (r % 4) + 1 AS INT), 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE AS u
      FROM preds, range(0, 1000) t(r)),
    s AS (SELECT label, r, y_proba, CAST(sum(CASE WHEN y_true = 1 THEN {_POIS} ELSE 0 END) AS DOUBLE) AS pos,
      CAST(sum(CASE WHEN y_true = 0 THEN {_POIS} ELSE 0 END) AS DOUBLE) AS neg FROM b GROUP BY ALL),
    c AS (SELECT *, sum(neg) OVER (PARTITION BY label, r ORDER BY y_proba) - neg / 2 AS below FROM s),
    a AS (SELECT label, r, sum(pos * below) / nullif(sum(pos) * sum(neg), 0) AS auc FROM c GROUP BY ALL)
    SELECT label, round(quantile_cont(auc, 0.025), 6) AS auc_ci_low, round(quantile_cont(auc, 0.975), 6) AS auc_ci_high, round(avg(auc), 6) AS auc_mean,
      count(auc) AS n_draws FROM a WHERE auc IS NOT NULL GROUP BY 1""",
)
def bootstrap_auc(spark, sf):
    return rounded(ev.bootstrap_auc(label_predictions(spark, sf), ["label"], key="sample_id"), "label", "n_draws")


DESC_SQL = """s AS (SELECT model, y_proba, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM preds GROUP BY ALL),
  cum AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER p AS DOUBLE) AS np, CAST(sum(neg) OVER p AS DOUBLE) AS nn FROM s
    WINDOW w AS (PARTITION BY model ORDER BY y_proba DESC), p AS (PARTITION BY model))"""


@query("average_precision", f"WITH {P}, {DESC_SQL} SELECT model, round(sum(pos * tp / (tp + fp)) / any_value(np), 6) AS average_precision FROM cum GROUP BY 1")
def average_precision(spark, sf):
    return rounded(ev.average_precision(predictions(spark, sf), ["model"]), "model")


@query("roc_points", f"WITH {P}, {DESC_SQL} SELECT model, y_proba AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM cum")
def roc_points(spark, sf):
    return rounded(ev.roc_points(predictions(spark, sf), ["model"]), "model", "threshold")


@query(
    "confusion_matrix",
    f"WITH {P}, c AS (SELECT model, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL) SELECT model, y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY model, y_true), 6) AS share FROM c",
)
def confusion_matrix(spark, sf):
    return rounded(ev.confusion_matrix(predictions(spark, sf), ["model"]), "model", "y_true", "y_pred", "n")


@query(
    "class_report",
    f"""WITH {P}, k AS (SELECT task, cls, sum(CAST(y_true = cls AS INT)) AS support, sum(CAST(y_pred = cls AS INT)) AS predicted,
      sum(CAST(y_true = cls AND y_pred = cls AS INT)) AS hits FROM preds, (VALUES (0), (1)) v(cls) GROUP BY ALL)
    SELECT task, cls, round(coalesce(hits / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall,
      round(coalesce(2 * hits / nullif(support + predicted, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM k""",
)
def class_report(spark, sf):
    return rounded(ev.class_report(predictions(spark, sf), ["task"]), "task", "cls", "support")


ML = f"""{LP}, ps AS (SELECT sample_id, min(CAST(y_true = y_pred AS INT)) AS exact, avg(CAST(y_true <> y_pred AS INT)) AS wrong FROM preds GROUP BY 1),
  c AS (SELECT label, CAST(sum(CAST(y_true = 1 AND y_pred = 1 AS INT)) AS DOUBLE) AS tp, CAST(sum(CAST(y_true = 0 AND y_pred = 1 AS INT)) AS DOUBLE) AS fp,
    CAST(sum(CAST(y_true = 1 AND y_pred = 0 AS INT)) AS DOUBLE) AS fn, CAST(sum(CAST(y_true = 0 AND y_pred = 0 AS INT)) AS DOUBLE) AS tn FROM preds GROUP BY 1)"""


@query(
    "multilabel_metrics",
    f"""WITH {ML} SELECT round((SELECT avg(exact) FROM ps), 6) AS subset_accuracy, round((SELECT avg(wrong) FROM ps), 6) AS hamming_loss,
      round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1,
      round(avg((tp / (tp + fn) + tn / (tn + fp)) / 2), 6) AS macro_balanced_accuracy FROM c""",
)
def multilabel_metrics(spark, sf):
    return rounded(ev.multilabel_metrics(label_predictions(spark, sf))[0])


@query("multilabel_per_label", f"WITH {ML} SELECT label, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS ba, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def multilabel_per_label(spark, sf):
    return rounded(ev.multilabel_metrics(label_predictions(spark, sf))[1].select("label", "ba", "f1"), "label")


@query("one_vs_rest_confusion", f"WITH {LP} SELECT label, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL")
def one_vs_rest_confusion(spark, sf):
    return ev.one_vs_rest_confusion(label_predictions(spark, sf))


@query("score_histogram", f"WITH {P}, h AS (SELECT y_true, CAST(least(floor(y_proba * 30), 29) AS INT) AS bin FROM preds) SELECT y_true, bin, count(*) AS n FROM h GROUP BY ALL")
def score_histogram(spark, sf):
    return features.histogram(predictions(spark, sf), "y_proba", 30, ["y_true"], 0.0, 1.0)


@query(
    "score_density",
    f"""WITH {P}, s AS (SELECT y_true, count(*) AS n, stddev_samp(y_proba) * pow(count(*), -0.2) AS h FROM preds GROUP BY 1)
    SELECT p.y_true, g AS point, round(sum(exp(-0.5 * pow((g / 199.0 - y_proba) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 5) + 0 AS density
    FROM preds p JOIN s ON s.y_true = p.y_true, range(0, 200) t(g) GROUP BY ALL""",
)
def score_density(spark, sf):
    return rounded(ev.score_density(predictions(spark, sf), ["y_true"]), "y_true", "point", digits=5)


@query("subject_vote", f"WITH {P} SELECT subject_id, round(avg(y_proba), 6) AS y_proba, count(*) AS n_windows, CAST(avg(y_proba) >= 0.5 AS INT) AS y_pred FROM preds GROUP BY 1")
def subject_vote(spark, sf):
    return rounded(ev.subject_vote(predictions(spark, sf)), "subject_id", "n_windows", "y_pred")


@query(
    "prediction_labels",
    f"""WITH {P} SELECT sample_id, split_part(sample_id, '_', 2) AS subject, split_part(sample_id, '_', 3) AS window_desc, y_true = y_pred AS correct,
      CASE WHEN y_true = y_pred THEN 'correct' WHEN y_true = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type FROM preds""",
)
def prediction_labels(spark, sf):
    p = ev.prediction_labels(ev.check_id_labels(predictions(spark, sf)))
    return p.select("sample_id", "subject", "window_desc", "correct", "error_type")


@query(
    "multilabel_exact_match",
    f"""WITH {LP} SELECT sample_id, sum(CAST(y_true <> y_pred AS INT)) = 0 AS exact_match,
      coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE y_true <> y_pred), '') AS labels_wrong FROM preds GROUP BY 1""",
)
def multilabel_exact_match(spark, sf):
    x = ev.exact_matches(label_predictions(spark, sf))
    return x.withColumn("labels_wrong", F.array_join("labels_wrong", ","))


@query(
    "calibration",
    f"""WITH {P}, c AS (SELECT model, count(*) AS n_subjects, avg(abs(y_true - y_proba)) AS e, stddev_pop(abs(y_true - y_proba)) AS se,
      coalesce(avg(CASE WHEN y_true = 1 THEN y_proba ELSE 1 - y_proba END) FILTER (WHERE y_true = y_pred), 0) AS cc,
      coalesce(avg(CASE WHEN y_true = 1 THEN y_proba ELSE 1 - y_proba END) FILTER (WHERE y_true <> y_pred), 0) AS cw,
      coalesce(avg(y_proba) FILTER (WHERE y_true = 1), 0) AS pp, coalesce(avg(y_proba) FILTER (WHERE y_true = 0), 0) AS pc, abs(pp - pc) AS sep,
      count(*) FILTER (WHERE y_true <> y_pred AND ((y_true = 1 AND y_proba < 1 - 0.85::DOUBLE) OR (y_true = 0 AND y_proba > 0.85::DOUBLE))) AS over_n FROM preds GROUP BY 1)
    SELECT model, n_subjects, round(e, 6) AS mean_calibration_error, round(se, 6) AS std_calibration_error, round(cc, 6) AS mean_conf_when_correct,
      round(cw, 6) AS mean_conf_when_wrong, round(pp, 6) AS mean_prob_patients, round(pc, 6) AS mean_prob_controls, round(sep, 6) AS group_separation, over_n AS n_overconfident_errors,
      CASE WHEN e < 0.2 THEN 'WELL CALIBRATED' WHEN e < 0.4 THEN 'MODERATELY CALIBRATED' ELSE 'POORLY CALIBRATED' END AS calibration_verdict,
      CASE WHEN sep > 0.3 THEN 'GOOD' WHEN sep > 0.1 THEN 'MODERATE' ELSE 'POOR' END AS separation_verdict,
      CASE WHEN over_n = 0 THEN 'NONE' WHEN over_n <= 3 THEN 'MONITOR' ELSE 'DANGEROUS' END AS overconfidence_verdict FROM c""",
)
def calibration(spark, sf):
    c = ev.calibration(predictions(spark, sf), ["model"])
    keep = ["model", "n_subjects", "n_overconfident_errors", "calibration_verdict", "separation_verdict", "overconfidence_verdict"]
    return rounded(c, *keep)


@query(
    "generalisation_report",
    f"""WITH {FR}, a AS (SELECT model, avg(train_loss) AS tl, avg(val_loss) AS vl, avg(train_acc) AS ta, avg(val_acc) AS va, sum(epochs) / (100.0::DOUBLE + 1500 * (length(model) - 8)) AS r FROM folds GROUP BY 1),
    g AS (SELECT *, coalesce(vl - tl, ta - va, 0) AS gap, CASE WHEN tl IS NOT NULL AND vl IS NOT NULL THEN 'loss' WHEN ta IS NOT NULL THEN 'accuracy' ELSE 'validation_only' END AS metric FROM a),
    p AS (SELECT *, CASE WHEN gap > 0.15 THEN 3 WHEN gap > 0.08 THEN 2 WHEN gap > 0.03 THEN 1 ELSE 0 END + CASE WHEN r < 5 THEN 3 WHEN r < 10 THEN 1 ELSE 0 END AS risk_points FROM g),
    k AS (SELECT *, CASE WHEN risk_points >= 5 THEN 'HIGH' WHEN risk_points >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM p)
    SELECT model, metric, round(gap, 6) + 0 AS gap, CASE WHEN abs(gap) > 0.15 THEN 'SEVERE' WHEN abs(gap) > 0.08 THEN 'MODERATE' WHEN abs(gap) > 0.03 THEN 'MILD' ELSE 'GOOD' END AS severity,
      round(r, 6) AS ratio, CASE WHEN r < 5 THEN 'OVERPARAMETERIZED' WHEN r < 10 THEN 'BORDERLINE' ELSE 'ACCEPTABLE' END AS complexity, risk_points, risk,
      concat_ws(',', CASE WHEN risk = 'HIGH' AND gap > 0.15 THEN 'regularise' END, CASE WHEN risk = 'HIGH' AND r < 5 THEN 'fewer_parameters' END,
        CASE WHEN risk = 'MEDIUM' AND gap > 0.08 THEN 'more_dropout' END, CASE WHEN risk = 'MEDIUM' AND r < 10 THEN 'fewer_parameters_or_more_samples' END,
        CASE WHEN risk = 'LOW' THEN 'keep' END) AS recommendations FROM k""",
)
def generalisation_report(spark, sf):
    f = folds(spark, sf)
    # A model's epochs stand for its training samples, the length of its name for its parameters.
    sizes = f.groupBy("model").agg(F.sum("epochs").alias("n_samples"))
    f = f.join(sizes, "model").withColumn("n_parameters", 100 + 1500 * (F.length("model") - 8))
    g = ev.generalisation(f, ["model", "n_samples", "n_parameters"], F.col("n_samples"), F.col("n_parameters"))
    return g.select(
        "model", "metric", rnd("gap").alias("gap"), "severity", rnd("ratio").alias("ratio"), "complexity", "risk_points", "risk",
        F.array_join("recommendations", ",").alias("recommendations"),
    )


@query(
    "train_val_correlation",
    f"""WITH {FR}, x AS (SELECT model, coalesce(train_loss, train_acc) AS t, coalesce(val_loss, val_acc) AS v FROM folds)
    SELECT model, round(corr(t, v), 6) AS train_val_correlation FROM x WHERE t IS NOT NULL AND v IS NOT NULL GROUP BY 1""",
)
def train_val_correlation(spark, sf):
    return rounded(ev.train_val_correlation(folds(spark, sf), ["model"]), "model")


REPEATED = f"""{P}, rep AS (SELECT subject_id AS sample_id, task, y_proba AS pred, CASE WHEN subject_id LIKE 'px%' THEN 1 ELSE 0 END AS y_true FROM preds)"""


@query(
    "bias_variance",
    f"""WITH {REPEATED}, s AS (SELECT task, sample_id, pow(avg(pred) - any_value(y_true), 2) AS b, var_pop(pred) AS v FROM rep GROUP BY ALL)
    SELECT task, round(avg(b), 6) AS bias_squared, round(avg(v), 6) AS variance, round(avg(b) + avg(v), 6) AS total_error FROM s GROUP BY 1""",
)
def bias_variance(spark, sf):
    p = predictions(spark, sf).select(
        "task", F.col("subject_id").alias("sample_id"), F.col("y_proba").alias("pred"),
        F.col("subject_id").startswith("px").cast("int").alias("y_true"),
    )
    return rounded(ev.bias_variance(p, ["task"]), "task")


CONS = f"{FR}, s AS (SELECT avg(val_loss) AS mean, stddev_pop(val_loss) AS std, min(val_loss) AS min, max(val_loss) AS max FROM folds)"


@query(
    "fold_consistency",
    f"WITH {CONS} SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, CASE WHEN std > 0.5 THEN 'VERY HIGH' WHEN std > 0.15 THEN 'HIGH' WHEN std > 0.08 THEN 'MODERATE' ELSE 'CONSISTENT' END AS band FROM s",
)
def fold_consistency(spark, sf):
    return rounded(ev.fold_consistency(folds(spark, sf))[0], "band")


OUTF = f"{FR}, o AS (SELECT fold, epochs, avg(epochs) OVER () AS m, stddev_pop(epochs) OVER () AS s FROM folds)"


@query("outlier_folds", f"WITH {FR}, o AS (SELECT fold, pow(val_loss, 4) AS v FROM folds), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM o) SELECT fold, round(v, 6) AS v, round(abs(v - m) / s, 6) AS deviation FROM o, s WHERE abs(v - m) > 2 * s")
def outlier_folds(spark, sf):
    f = folds(spark, sf).withColumn("v", F.pow("val_loss", F.lit(4.0)))
    return rounded(ev.fold_consistency(f, "v")[1], "fold")


# ---------------------------------------------------------------- importance

def twins_sql(source: str, name: str, channels: list[str], repeats: int, seed: int = 42) -> str:
    """CTE ``name``: rows of ``source`` (subject_id, task, frame_idx, ..) once per repeat with t_<channel> of their twins."""
    u = unit_sql("subject_id", "CAST(task AS STRING)", "CAST(frame_idx AS STRING)", str(seed))
    return f"""{name}_p AS (SELECT *, row_number() OVER (ORDER BY {u}) - 1 AS pos, count(*) OVER () AS n FROM {source}),
    {name} AS (SELECT a.*, r, {", ".join(f"b.{c} AS t_{c}" for c in channels)} FROM {name}_p a, range(0, {repeats}) t(r), {name}_p b
      WHERE b.pos = (a.pos + (2 * r + 1) * a.n // {2 * repeats}) % a.n)"""


REPEATS = 5
_LABEL = "head_pos_x * 1.1 + right_hand_pos_z > 1"


def _rule(shuffled: str = "") -> str:
    terms = " + ".join(f"coalesce(w_{c} * ({'t_' if c == shuffled else ''}{c} - h_{c}), 0)" for c in CHANNELS)
    return f"CASE WHEN 0e0 + {terms} > 0 THEN 1 ELSE 0 END"


def _ba(rule: str) -> str:
    return " + ".join(f"avg(CASE WHEN label = {y} THEN CAST({rule} = {y} AS INT)::DOUBLE END) / 2" for y in (1, 0))


@query(
    "permutation_importance",
    f"""WITH frames AS ({frames_sql(CHANNELS)}), lab AS (SELECT *, CASE WHEN {_LABEL} THEN 1 ELSE 0 END AS label FROM frames),
    m AS (SELECT {", ".join(f"(avg({c}) FILTER (WHERE label = 1) - avg({c}) FILTER (WHERE label = 0)) / var_pop({c}) AS w_{c}, (avg({c}) FILTER (WHERE label = 1) + avg({c}) FILTER (WHERE label = 0)) / 2 AS h_{c}" for c in CHANNELS)} FROM lab),
    {twins_sql("lab", "tw", CHANNELS, REPEATS)},
    s AS (SELECT r, {_ba(_rule())} AS base, {", ".join(f"{_ba(_rule(c))} AS {c}" for c in CHANNELS)} FROM tw, m GROUP BY r),
    d AS (SELECT channel, base - score AS fall FROM s UNPIVOT (score FOR channel IN ({", ".join(CHANNELS)}))),
    i AS (SELECT channel, avg(fall) AS importance, stddev_pop(fall) AS std FROM d GROUP BY 1)
    SELECT channel, round(importance, 6) + 0 AS importance, round(std, 6) + 0 AS std, row_number() OVER (ORDER BY importance DESC, channel) AS rank FROM i""",
)
def permutation_importance(spark, sf):
    """All channels, five repeats, a linear rule fitted to the frames."""
    x = frames(spark, sf).withColumn("label", F.expr(_LABEL).cast("int"))
    imp = ev.permutation_importance(x, CHANNELS, [*RECORDING, "frame_idx"], "label", ev.fit_linear(x, CHANNELS, "label"), REPEATS)
    return imp.select("channel", rnd("importance").alias("importance"), rnd("std").alias("std"), "rank")


IMPORT_SQL = f"imp AS (SELECT task, model, channel, value FROM (SELECT config AS task, model, avg(epochs) / 7e1 AS head_pos_x, avg(train_acc) AS left_hand_rot_y, avg(val_acc) AS right_hand_pos_z, max(val_acc) / 3 AS head_rot_x, min(val_acc) - 0.1 AS head_pos_z FROM folds GROUP BY ALL) UNPIVOT (value FOR channel IN (head_pos_x, left_hand_rot_y, right_hand_pos_z, head_rot_x, head_pos_z)))"


def importances(spark, sf):
    w = folds(spark, sf).groupBy(F.col("config").alias("task"), "model").agg(
        (F.avg("epochs") / 70.0).alias("head_pos_x"), F.avg("train_acc").alias("left_hand_rot_y"),
        F.avg("val_acc").alias("right_hand_pos_z"), (F.max("val_acc") / 3).alias("head_rot_x"), (F.min("val_acc") - 0.1).alias("head_pos_z"),
    )
    names = ["head_pos_x", "left_hand_rot_y", "right_hand_pos_z", "head_rot_x", "head_pos_z"]
    return w.unpivot(["task", "model"], names, "channel", "importance").filter("importance IS NOT NULL")


@query(
    "normalized_drops",
    f"""WITH {FR}, {IMPORT_SQL} SELECT task, model, channel, round(CASE WHEN sum(greatest(value, 0)) OVER w > 1e-12 THEN greatest(value, 0) / sum(greatest(value, 0)) OVER w
      ELSE 1.0 / count(*) OVER w END, 6) AS importance FROM imp WINDOW w AS (PARTITION BY task, model)""",
)
def normalized_drops(spark, sf):
    return rounded(ev.normalize_drops(importances(spark, sf), ["task", "model"]), "task", "model", "channel")


@query(
    "weight_importance",
    f"""WITH {FR}, {IMPORT_SQL}, a AS (SELECT task, channel, avg(abs(value - 0.4)) AS v FROM imp GROUP BY ALL)
    SELECT task, channel, round(v / sum(v) OVER (PARTITION BY task), 6) AS importance FROM a""",
)
def weight_importance(spark, sf):
    w = importances(spark, sf).withColumn("weight", F.col("importance") - 0.4)
    return rounded(ev.weight_importance(w, "mean", ["task"]), "task", "channel")


@query(
    "importance_comparison",
    f"""WITH {FR}, {IMPORT_SQL} SELECT task, model AS method, channel, row_number() OVER (PARTITION BY task, model ORDER BY value DESC, channel) AS rank,
      round(value / max(value) OVER (PARTITION BY model), 6) + 0 AS scaled FROM imp""",
)
def importance_comparison(spark, sf):
    imp = ev.rank_importance(importances(spark, sf), ["task", "model"]).withColumnRenamed("model", "method")
    return ev.compare_methods(imp).select("task", "method", "channel", "rank", rnd("scaled").alias("scaled"))


@query(
    "sensor_insights",
    f"""WITH {FR}, {IMPORT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY task, model ORDER BY value DESC, channel) AS k FROM imp)
    SELECT task, model, count(*) FILTER (WHERE channel LIKE '%head%') AS n_head, count(*) FILTER (WHERE channel LIKE '%left%') AS n_left_hand,
      count(*) FILTER (WHERE channel LIKE '%right%') AS n_right_hand, round(sum(value), 6) AS top_importance,
      count(*) FILTER (WHERE channel LIKE '%head%') >= 3 AS compensation,
      count(*) FILTER (WHERE channel LIKE '%right%') > count(*) FILTER (WHERE channel LIKE '%left%') AS right_dominant FROM r WHERE k <= 3 GROUP BY ALL""",
)
def sensor_insights(spark, sf):
    x = ev.sensor_insights(importances(spark, sf), ["task", "model"], 3)
    return x.withColumn("top_importance", rnd("top_importance"))


@query(
    "model_verdict",
    f"""WITH {P} SELECT task, paradigm, CAST(sum(y_pred) AS BIGINT) AS patient_votes, count(*) AS n_models, round(avg(y_proba), 6) AS mean_proba,
      CASE WHEN sum(y_pred) > count(*) / 2.0 THEN 'patient' ELSE 'control' END AS verdict FROM preds GROUP BY ALL""",
)
def model_verdict(spark, sf):
    return rounded(ev.model_verdict(predictions(spark, sf), ["task", "paradigm"]), "task", "paradigm", "patient_votes", "n_models", "verdict")


@query("metric_table", f"WITH {FR} SELECT model, round(avg(val_acc), 3) AS val_acc, round(avg(val_loss), 3) AS val_loss FROM folds GROUP BY 1")
def metric_table(spark, sf):
    return ev.metric_table(folds(spark, sf), "model", ["val_acc", "val_loss"])
