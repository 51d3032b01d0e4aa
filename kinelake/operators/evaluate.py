"""Cross-validation plans and evaluation tables.

Predictions are rows (sample_id, subject_id, y_true, y_pred, y_proba, ..). Curves and ranks first
reduce to distinct scores, so no operator ranks raw rows in one task.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.expr import corr, normal_hash, text_order_key, unit_hash
from kinelake.operators import ordering
from kinelake.sources.store import reliable

# ---------------------------------------------------------------- folds


#: Folds that follow each other for one sample before the next sample's.
FOLD_RANGE = 512


def subject_folds(samples: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(subject_id, fold): fold = position of the subject in sorted order."""
    subjects = samples.select(subject).distinct()
    return ordering.position(subjects, [], text_order_key(subject), [subject], "fold")


def _in_folds(own: DataFrame, folds: list[int] | None) -> DataFrame:
    """Every row of ``own`` once for each listed fold; None lists all folds, one for each subject."""
    if folds is not None:
        return own.withColumn("fold", F.explode(F.array(*[F.lit(f).cast("long") for f in folds])))
    last = F.broadcast(own.agg(F.max("_own").alias("_last")))  # one row
    return own.join(last).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).drop("_last")


def fold_roles(samples: DataFrame, folds: list[int] | None = None, subject: str = "subject_id") -> DataFrame:
    """Train/test role of every sample for the listed folds, or all (a fold is one pass over the samples).

    All folds go by ranges of ``FOLD_RANGE``: samples are dealt by range before they are multiplied, so many tasks make
    the rows, and a column of fold numbers repeats within the reach of a file's compression.
    """
    x = samples.join(subject_folds(samples, subject).withColumnRenamed("fold", "_own"), subject)
    if folds is None:
        last = F.broadcast(x.agg(F.max("_own").alias("_last")))  # one row
        ranges = x.join(last).withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), "_last", F.lit(FOLD_RANGE).cast("long"))))
        parts = 4 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        x = ranges.repartition(parts, "_lo").sortWithinPartitions("_lo", subject)
        x = x.withColumn("fold", F.explode(F.sequence("_lo", F.least("_last", F.col("_lo") + (FOLD_RANGE - 1))))).drop("_lo", "_last")
    else:
        x = _in_folds(x, folds)
    return x.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")


def fold_sizes(samples: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Train/test sample counts of every fold as total minus held-out (no fold x sample product)."""
    own = samples.groupBy(subject).agg(F.count(F.lit(1)).alias("n_test"))
    total = own.agg(F.sum("n_test").alias("_all"))
    return own.crossJoin(F.broadcast(total)).select(subject, "n_test", (F.col("_all") - F.col("n_test")).alias("n_train"))


def _shuffled_train(samples: DataFrame, folds: list[int] | None, seed: int, subject: str) -> DataFrame:
    """Training subjects of each listed fold with their position in a seeded order.

    While the subjects are few enough to be broadcast (counted first), each fold's order is made where the fold is, and
    no pair of a fold and a subject is moved.
    """
    own = reliable(subject_folds(samples, subject).withColumnRenamed("fold", "_own"))
    known = own.select("_own", F.col(subject).cast("string").alias("name"))
    if known.limit(ordering.BROADCAST_ROWS + 1).count() <= ordering.BROADCAST_ROWS:
        return _orders(own, known, folds, seed, subject)
    s = _in_folds(own, folds).filter("fold <> _own")
    s = s.withColumn("_u", unit_hash(subject, seed=F.lit(seed) + F.col("fold")))
    s = ordering.position(s, ["fold"], F.col("_u"), ["_u", subject], "_pos")
    n = s.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    return s.join(n, "fold")


def _orders(own: DataFrame, known: DataFrame, folds: list[int] | None, seed: int, subject: str) -> DataFrame:
    """(fold, subject, _pos, _n) by the order of ``unit_hash``: its first 13 hexadecimal digits, then the subject."""
    spark = own.sparkSession
    rows = known.orderBy("_own").collect()  # counted by the caller
    names = spark.sparkContext.broadcast([None if r["name"] is None else r["name"].encode() for r in rows])
    n = len(rows)
    listed = spark.range(n) if folds is None else spark.createDataFrame([(f,) for f in folds], "id long")
    parts = max(1, min(n if folds is None else len(folds), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        known_ = names.value
        for batch in batches:
            for f in batch.column(0).to_pylist():
                end = str(seed + f).encode()
                digests = b"".join([md5(end if x is None else b"%b|%b" % (x, end)).digest() for x in known_])
                u = np.frombuffer(digests, ">u8")[::2] >> 12
                at = np.argsort(u, kind="stable")
                at = at[at != f]
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, f)), pa.array(at), pa.array(np.arange(m)), pa.array(np.full(m, m))], ["fold", "_own", "_pos", "_n"])

    orders = listed.repartition(parts, "id").mapInArrow(run, "fold long, _own long, _pos long, _n long")
    return orders.join(F.broadcast(own), "_own").select("fold", subject, "_pos", "_n")


def inner_holdout(
    samples: DataFrame, folds: list[int] | None = None, fraction: float = 0.15, seed: int = 42, subject: str = "subject_id"
) -> DataFrame:
    """(fold, subject_id, role): a seeded share of each fold's training subjects becomes 'validation'."""
    s = _shuffled_train(samples, folds, seed, subject)
    n_val = F.greatest(F.bround(F.col("_n") * fraction), F.lit(1.0))
    return s.select("fold", subject, F.when(F.col("_pos") < n_val, "validation").otherwise("train").alias("role"))


def inner_kfold(
    samples: DataFrame, folds: list[int] | None = None, k: int = 5, seed: int = 42, subject: str = "subject_id"
) -> DataFrame:
    """(fold, subject_id, inner_fold) with k reduced when a fold has fewer training subjects."""
    s = _shuffled_train(samples, folds, seed, subject)
    kk = F.least(F.lit(k).cast("long"), F.col("_n"))
    # The first n mod k inner folds take one subject more.
    big, size = F.pmod(F.col("_n"), kk), F.floor(F.col("_n") / kk)
    cut = big * (size + 1)
    inner = F.when(F.col("_pos") < cut, F.floor(F.col("_pos") / (size + 1))).otherwise(
        big + F.floor((F.col("_pos") - cut) / F.nullif(size, F.lit(0)))
    )
    return s.select("fold", subject, inner.cast("int").alias("inner_fold"))


def parameter_grid(keys: DataFrame, grid: dict[str, list], override: DataFrame | None = None) -> DataFrame:
    """Every parameter combination per key row; ``override`` replaces values where its keys match."""
    out = keys
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    if override is not None:
        on = [c for c in override.columns if c in keys.columns]
        repl = [c for c in override.columns if c not in on]
        o = override.select(*on, *[F.col(c).alias(f"_o_{c}") for c in repl])
        out = out.join(o, on, "left").withColumns({c: F.coalesce(f"_o_{c}", c) for c in repl})
        out = out.drop(*[f"_o_{c}" for c in repl]).distinct()
    return out


def choose_config(scores: DataFrame, metric: str, config: str, by: list[str], lower: bool) -> DataFrame:
    """Best config per key by mean metric; ties go to the smaller config key."""
    means = scores.groupBy(*by, config).agg(F.avg(metric).alias("score"), F.avg("epochs").alias("mean_epochs"))
    key = F.struct((F.col("score") if lower else -F.col("score")).alias("k"), F.col(config))
    best = means.groupBy(*by).agg(F.min_by(F.struct(config, "score", "mean_epochs"), key).alias("b"))
    return best.select(*by, "b.*")


def most_common_config(chosen: DataFrame, config: str, fold: str = "fold") -> DataFrame:
    """The config most folds chose; the one seen first wins ties."""
    counts = chosen.groupBy(config).agg(F.count(F.lit(1)).alias("n"), F.min(fold).alias("first_fold"))
    return counts.orderBy(F.desc("n"), "first_fold").limit(1)


def fold_records(preds: DataFrame, losses: DataFrame, chunk_rows: int = ordering.BLOCK) -> DataFrame:
    """One nested record per fold; a fold with very many samples continues in further chunks."""
    p = ordering.position(preds, ["fold"], text_order_key(F.col("sample_id").cast("string")), [F.col("sample_id").cast("string")], "_pos")
    p = p.withColumn("chunk", F.floor(F.col("_pos") / F.lit(chunk_rows)).cast("long"))
    item = F.struct("_pos", "y_true", "y_pred", "y_proba")
    rows = p.groupBy("fold", "chunk").agg(
        F.array_sort(F.collect_list(item)).alias("s"), F.array_sort(F.collect_set("subject_id")).alias("test_subjects")
    )
    vectors = [F.col("s")[c].alias(c) for c in ("y_true", "y_pred", "y_proba")]
    return rows.select("fold", "chunk", "test_subjects", *vectors).join(losses, "fold", "left")


# ---------------------------------------------------------------- binary metrics


def _count(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def confusion_counts() -> list[Column]:
    t, p = F.col("y_true"), F.greatest(F.least(F.col("y_pred"), F.lit(1)), F.lit(0))
    return [
        _count((t == 1) & (p == 1)).alias("tp"),
        _count((t == 0) & (p == 1)).alias("fp"),
        _count((t == 1) & (p == 0)).alias("fn"),
        _count((t == 0) & (p == 0)).alias("tn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(preds: DataFrame, by: list[str] = (), digits: int | None = 3) -> DataFrame:
    """Balanced accuracy (classes present in y_true), recall, precision, F1."""
    c = preds.groupBy(*by).agg(*confusion_counts())
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    ba = (F.coalesce(sens, F.lit(0.0)) + F.coalesce(spec, F.lit(0.0))) / (
        sens.isNotNull().cast("double") + spec.isNotNull().cast("double")
    )
    cols = {
        "ba": ba,
        "recall": _ratio(tp, tp + fn),
        "precision": _ratio(tp, tp + fp),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    return c.select(*by, *[(F.round(e, digits) if digits is not None else e).alias(n) for n, e in cols.items()])


def _by_score(preds: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return preds.groupBy(*by, "y_proba").agg(
        F.sum(F.when(F.col("y_true") == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("y_true") == 0, w).otherwise(0.0)).alias("neg"),
    )


def roc_auc(preds: DataFrame, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve with ties at half weight (NULL when one class is missing)."""
    by = list(by)
    s = _by_score(preds, by, weight)
    s = ordering.cumulate(s, by, F.col("y_proba"), ["y_proba"], {"_cn": F.col("neg")})
    below = F.col("_cn") - F.col("neg") / 2.0
    return s.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.sum("pos") * F.sum("neg")).alias("auc")
    )


# Cumulative Poisson(1) probabilities for 0..11.
POISSON_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
    0.9999999899522336, 0.9999999991683892,
]
#: Largest count whose Poisson distribution is written out; larger ones are drawn by their normal limit.
POISSON_TABLE = 500


def poisson_table(count: Column) -> Column:
    """The cumulative distribution of a Poisson count as an array, NULL for counts over ``POISSON_TABLE``."""
    top = F.ceil(count + 10.0 * F.sqrt(count) + 20.0).cast("int")
    first = F.exp(-count)

    def step(a, k):
        p = a["p"] * count / k
        return F.struct(p.alias("p"), F.concat(a["cum"], F.array(F.element_at(a["cum"], -1) + p)).alias("cum"))

    whole = F.aggregate(F.sequence(F.lit(1), top), F.struct(first.alias("p"), F.array(first).alias("cum")), step)["cum"]
    return F.when(count <= POISSON_TABLE, whole)


def _row_draws(preds: DataFrame, draws: int, seed: int, key: str) -> DataFrame:
    """Every row once per replicate with its weight ``_w``, a Poisson(1) number from a hash of (key, replicate)."""
    # One digest serves four replicates (eight hex digits each).
    x = preds.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))))
    x = x.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("_q").cast("string"), F.lit(str(seed)))))
    part = [
        F.struct(
            (F.col("_q") * 4 + i).alias("replicate"),
            ((F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))).alias("_u"),
        )
        for i in range(4)
    ]
    x = x.select(*preds.columns, F.inline(F.array(*part))).filter(F.col("replicate") < draws)
    return x.withColumn("_w", sum(((F.col("_u") > c).cast("double") for c in POISSON_CDF), F.lit(0.0)))


def _count_draws(cells: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """Every (by, score, class) with its number of rows ``_c`` once per replicate, with ``_w``, one Poisson draw of that number."""
    # The cells are dealt anew before they fan out: there may be few of them in one task.
    x = cells.withColumn("_table", poisson_table(F.col("_c"))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 50))))
    x = x.repartition(*by, "y_proba", "y_true", "_part")

    def draw(r):
        name = [*by, F.col("y_proba"), F.col("y_true"), r]
        far = F.when(F.col("_table").isNull(), normal_hash(*name, seed=seed))
        return F.struct(r.alias("replicate"), unit_hash(*name, seed=seed).alias("_u"), far.alias("_z"))

    # A generator's columns are computed once; written into the search below, the hash would be taken for each of its steps.
    mine = F.sequence(F.col("_part") * 50, F.least(F.col("_part") * 50 + 49, F.lit(draws - 1)))
    x = x.select(*by, "y_proba", "y_true", "_c", "_table", F.inline(F.transform(mine, draw)))
    hit = F.size(F.filter("_table", lambda v: v < F.col("_u"))).cast("double")
    far = F.greatest(F.round(F.col("_c") + F.sqrt("_c") * F.col("_z")), F.lit(0.0))
    return x.withColumn("_w", F.when(F.col("_table").isNotNull(), hit).otherwise(far)).drop("_table", "_c", "_u", "_z")


def bootstrap_auc(
    preds: DataFrame, by: list[str] = (), draws: int = 1000, seed: int = 42, ci: float = 0.95, key: str | None = None
) -> DataFrame:
    """Mean AUC and percentile interval over Poisson bootstrap replicates.

    With ``key``, every row is drawn by itself: its weight in a replicate is a hash of (key, replicate), so the result
    does not depend on partitioning; replicates combine map-side into (replicate, score) sums before any shuffle. Rows
    that no column names are drawn together by score and class, as one Poisson number of their count.
    """
    by = list(by)
    cells = _by_score(preds, by)
    if key is not None:
        x = _row_draws(preds.select(*by, key, "y_true", "y_proba"), draws, seed, key)
    else:
        both = F.array(F.struct(F.lit(1).alias("y_true"), F.col("pos").alias("_c")), F.struct(F.lit(0).alias("y_true"), F.col("neg").alias("_c")))
        x = _count_draws(cells.select(*by, "y_proba", F.inline(both)).filter("_c > 0"), by, draws, seed)
    # A replicate has at most the scores of all rows, and ``by`` at most ``draws`` replicates: neither needs the draws to be counted.
    with ordering.bounded([*by, "replicate"], ordering.largest_group(cells, by)):
        aucs = roc_auc(x, [*by, "replicate"], F.col("_w")).filter("auc IS NOT NULL")
    tail = (1.0 - ci) / 2.0
    return ordering.quantiles(
        aucs, by, "auc", {"auc_ci_low": tail, "auc_ci_high": 1.0 - tail},
        [F.avg("auc").alias("auc_mean"), F.count(F.lit(1)).alias("n_draws")], max_rows=draws,
    )


def _descending(preds: DataFrame, by: list[str]) -> DataFrame:
    s = _by_score(preds, by)
    return ordering.cumulate(
        s, by, -F.col("y_proba"), [F.desc("y_proba")], {"tp": F.col("pos"), "fp": F.col("neg")}
    )


def average_precision(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    by = list(by)
    s = _descending(preds, by)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos")).alias("average_precision"))


def roc_points(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from the highest down."""
    by = list(by)
    s = _descending(preds, by)
    totals = preds.groupBy(*by).agg(
        F.sum((F.col("y_true") == 1).cast("double")).alias("_p"), F.sum((F.col("y_true") == 0).cast("double")).alias("_n")
    )
    s = s.join(totals, by) if by else s.crossJoin(F.broadcast(totals))
    return s.select(
        *by,
        F.col("y_proba").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("_p")).alias("tpr"),
    )


def confusion_matrix(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts and row shares per (y_true, y_pred)."""
    c = preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    # At most (classes x classes) rows per key reach this window.
    row = Window.partitionBy(*by, "y_true")
    return c.withColumn("share", F.col("n") / F.sum("n").over(row))


def class_report(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    """precision / recall / F1 / support per class."""
    rows = F.array(
        F.struct(F.col("y_true").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("h")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")),
    )
    c = preds.select(*by, F.inline(rows)).groupBy(*by, "cls").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits")
    )
    return c.select(
        *by,
        "cls",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


# ---------------------------------------------------------------- multilabel


def multilabel_metrics(preds: DataFrame, draws: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(summary row, per-label table) from long rows (sample_id, label, y_true, y_pred, y_proba)."""
    ok = (F.col("y_true") == F.col("y_pred")).cast("int")
    per_sample = preds.groupBy("sample_id").agg(F.min(ok).alias("exact"), F.avg(1.0 - ok).alias("wrong"))
    top = per_sample.agg(F.avg("exact").alias("subset_accuracy"), F.avg("wrong").alias("hamming_loss"))
    conf = preds.groupBy("label").agg(*confusion_counts())
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    per = conf.withColumns(
        {
            "f1": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
            "ba": F.when(
                both,
                (
                    F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
                    + F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
                )
                / 2.0,
            ),
        }
    )
    micro = _ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    agg = per.agg(F.avg("f1").alias("macro_f1"), micro.alias("micro_f1"), F.avg("ba").alias("macro_balanced_accuracy"))
    summary = top.crossJoin(agg)
    labels = per.select("label", "ba", "f1").join(bootstrap_auc(preds, ["label"], draws, key="sample_id"), "label", "left")
    return summary, labels


def one_vs_rest_confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("label", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def exact_matches(preds: DataFrame) -> DataFrame:
    """Per sample: exact match flag and the labels that were wrong."""
    wrong = F.col("y_true") != F.col("y_pred")
    return preds.groupBy("sample_id").agg(
        (F.sum(wrong.cast("int")) == 0).alias("exact_match"),
        F.array_sort(F.collect_list(F.when(wrong, F.col("label")))).alias("labels_wrong"),
    )


# ---------------------------------------------------------------- score distributions and labels


def score_density(preds: DataFrame, by: list[str], points: int = 200) -> DataFrame:
    """Gaussian kernel density of y_proba on an even grid over [0, 1] (Scott bandwidth)."""
    scores = preds.groupBy(*by, "y_proba").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    m = F.sum(F.col("c") * F.col("y_proba")) / n
    ss = F.sum(F.col("c") * F.col("y_proba") * F.col("y_proba")) - n * m * m
    stats = scores.groupBy(*by).agg(n.alias("_n"), F.sqrt(F.try_divide(ss, n - 1)).alias("_s"))
    x = scores.join(stats, by).withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    x = x.filter("_h > 0").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("point") / F.lit(float(points - 1)) - F.col("y_proba")) / F.col("_h")
    k = F.col("c") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * F.sqrt(2.0 * F.pi()))
    return x.groupBy(*by, "point").agg(F.sum(k).alias("density"))


def subject_vote(preds: DataFrame, by: list[str] = ("subject_id",)) -> DataFrame:
    """Mean window probability per subject; class at 0.5."""
    p = preds.groupBy(*by).agg(F.avg("y_proba").alias("y_proba"), F.count(F.lit(1)).alias("n_windows"))
    return p.withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int"))


def prediction_labels(preds: DataFrame) -> DataFrame:
    """correct flag, error type and the subject / window parts of a class-prefixed id."""
    t, p = F.col("y_true"), F.col("y_pred")
    bare = F.regexp_replace("sample_id", "^g[01]_", "")
    kind = F.when(t == p, "correct").when((t == 0) & (p == 1), "false_positive").otherwise("false_negative")
    return preds.withColumns(
        {
            "subject": F.split(bare, "_")[0],
            "window_desc": F.regexp_extract(bare, "^[^_]*_(.*)$", 1),
            "correct": t == p,
            "error_type": kind,
        }
    )


def check_id_labels(preds: DataFrame) -> DataFrame:
    """Fail the job when a g1_/g0_ id prefix disagrees with y_true."""
    want = F.when(F.col("sample_id").startswith("g1_"), 1).when(F.col("sample_id").startswith("g0_"), 0)
    bad = F.concat(F.lit("id prefix disagrees with label: "), "sample_id")
    return preds.filter(F.when(F.coalesce(want == F.col("y_true"), F.lit(False)), True).otherwise(F.raise_error(bad).isNull()))


# ---------------------------------------------------------------- diagnostics over folds


def calibration(preds: DataFrame, by: list[str] = (), overconfident: float = 0.85) -> DataFrame:
    """Calibration error, confidence when right/wrong, group separation and verdicts."""
    t, p = F.col("y_true"), F.col("y_proba")
    right = t == F.col("y_pred")
    err, conf = F.abs(t - p), F.when(t == 1, p).otherwise(1.0 - p)
    over = ~right & (((t == 1) & (p < 1 - overconfident)) | ((t == 0) & (p > overconfident)))
    zero = F.lit(0.0)
    c = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.avg(err).alias("mean_calibration_error"),
        F.stddev_pop(err).alias("std_calibration_error"),
        F.coalesce(F.avg(F.when(right, conf)), zero).alias("mean_conf_when_correct"),
        F.coalesce(F.avg(F.when(~right, conf)), zero).alias("mean_conf_when_wrong"),
        F.coalesce(F.avg(F.when(t == 1, p)), zero).alias("mean_prob_patients"),
        F.coalesce(F.avg(F.when(t == 0, p)), zero).alias("mean_prob_controls"),
        F.sum(over.cast("long")).alias("n_overconfident_errors"),
    )
    e, s, n = F.col("mean_calibration_error"), F.col("group_separation"), F.col("n_overconfident_errors")
    c = c.withColumn("group_separation", F.abs(F.col("mean_prob_patients") - F.col("mean_prob_controls")))
    return c.withColumns(
        {
            "calibration_verdict": F.when(e < 0.2, "WELL CALIBRATED")
            .when(e < 0.4, "MODERATELY CALIBRATED")
            .otherwise("POORLY CALIBRATED"),
            "separation_verdict": F.when(s > 0.3, "GOOD").when(s > 0.1, "MODERATE").otherwise("POOR"),
            "overconfidence_verdict": F.when(n == 0, "NONE").when(n <= 3, "MONITOR").otherwise("DANGEROUS"),
        }
    )


def generalisation(folds: DataFrame, by: list[str], n_samples: int | Column, n_parameters: int | Column) -> DataFrame:
    """Gap (loss, else accuracy, else validation only), severity, capacity ratio, risk and advice."""
    a = folds.groupBy(*by).agg(
        F.avg("train_loss").alias("tl"), F.avg("val_loss").alias("vl"), F.avg("train_acc").alias("ta"), F.avg("val_acc").alias("va")
    )
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    gap = F.coalesce(F.col("vl") - F.col("tl"), F.col("ta") - F.col("va"), F.lit(0.0))
    kind = (
        F.when(F.col("tl").isNotNull() & F.col("vl").isNotNull(), "loss")
        .when(F.col("ta").isNotNull() & F.col("va").isNotNull(), "accuracy")
        .otherwise("validation_only")
    )
    a = a.withColumns({"metric": kind, "gap": gap, "ratio": F.try_divide(lit(n_samples), lit(n_parameters))})
    g, m, r = F.col("gap"), F.abs("gap"), F.col("ratio")
    points = F.when(g > 0.15, 3).when(g > 0.08, 2).when(g > 0.03, 1).otherwise(0) + F.when(r < 5, 3).when(
        r < 10, 1
    ).otherwise(0)
    risk = F.when(F.col("risk_points") >= 5, "HIGH").when(F.col("risk_points") >= 3, "MEDIUM").otherwise("LOW")
    hint = F.array_compact(
        F.array(
            F.when((F.col("risk") == "HIGH") & (g > 0.15), "regularise"),
            F.when((F.col("risk") == "HIGH") & (r < 5), "fewer_parameters"),
            F.when((F.col("risk") == "MEDIUM") & (g > 0.08), "more_dropout"),
            F.when((F.col("risk") == "MEDIUM") & (r < 10), "fewer_parameters_or_more_samples"),
            F.when(F.col("risk") == "LOW", "keep"),
        )
    )
    out = a.withColumns(
        {
            "severity": F.when(m > 0.15, "SEVERE").when(m > 0.08, "MODERATE").when(m > 0.03, "MILD").otherwise("GOOD"),
            "complexity": F.when(r < 5, "OVERPARAMETERIZED").when(r < 10, "BORDERLINE").otherwise("ACCEPTABLE"),
            "risk_points": points,
        }
    )
    out = out.withColumn("risk", risk).withColumn("recommendations", hint)
    return out.select(*by, "metric", "gap", "severity", "ratio", "complexity", "risk_points", "risk", "recommendations")


def train_val_correlation(folds: DataFrame, by: list[str], min_folds: int = 6) -> DataFrame:
    t, v = F.coalesce("train_loss", "train_acc"), F.coalesce("val_loss", "val_acc")
    return folds.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) >= min_folds, corr(t, v)).alias("train_val_correlation")
    )


def bias_variance(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Decomposition over repeated predictions (sample_id, pred, y_true)."""
    per = preds.groupBy(*by, "sample_id").agg(
        F.pow(F.avg("pred") - F.first("y_true"), F.lit(2.0)).alias("b"), F.var_pop("pred").alias("v")
    )
    out = per.groupBy(*by).agg(F.avg("b").alias("bias_squared"), F.avg("v").alias("variance"))
    return out.withColumn("total_error", F.col("bias_squared") + F.col("variance"))


def fold_consistency(folds: DataFrame, score: str = "val_loss") -> tuple[DataFrame, DataFrame]:
    """(summary with a stability band, outlier folds beyond 2 std by deviation)."""
    s = folds.agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max")
    )
    band = F.when(F.col("std") > 0.5, "VERY HIGH").when(F.col("std") > 0.15, "HIGH").when(F.col("std") > 0.08, "MODERATE")
    dev = F.abs(F.col(score) - F.col("mean"))
    out = folds.crossJoin(F.broadcast(s)).filter(dev > 2 * F.col("std"))
    out = out.select("fold", score, F.try_divide(dev, F.col("std")).alias("deviation"))
    return s.withColumn("band", F.coalesce(band, F.lit("CONSISTENT"))), out.orderBy(F.desc("deviation"))


# ---------------------------------------------------------------- importance


#: Rows of a block in which twins meet.
TWIN_BLOCK = 1 << 17


def shuffled_twins(df: DataFrame, columns: list[str], key: list[str], repeats: int = 1, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Every row once per ``repeat``, with ``twin``: a struct of the columns of another row.

    One hashed order of all rows serves all columns and repeats: in repeat r, the twin of a row is the one (2 r + 1) / (2
    repeats) of the whole order behind it, in a circle. So the values of a repeat are a permutation of the rows' own, all
    columns move together in one exchange, and with 2 x ``repeats`` rows or more none is its own twin. ``key`` names
    the row and must be unique. ``keep`` names the columns that the result has of a row's own; None keeps all.
    """
    keep = keep or df.columns
    needed = df.select(*dict.fromkeys([*key, *keep, *columns])).withColumn("_u", unit_hash(*key, seed=seed))
    placed = ordering.hashed_position(needed, "_u", ["_u", *key], "_pos")
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    arcs, depth = 2 * repeats, max(1, TWIN_BLOCK // (2 * repeats))
    n = F.col("_n")

    def floor_div(a: Column, b: Column | int) -> Column:
        b = F.lit(b) if isinstance(b, int) else b
        return ((a - F.pmod(a, b)) / b).cast("long")

    def block(pos: Column) -> Column:
        # A row's place in its arc; its twins lie at the same place of other arcs, or one beside it.
        arc = floor_div((pos + 1) * arcs - 1, n)
        return floor_div(pos - floor_div(arc * n, arcs), depth)

    def target(r: Column) -> Column:
        return F.pmod(F.col("_pos") - floor_div((2 * r + 1) * n, arcs), n)

    placed = placed.select("_pos", F.struct(*dict.fromkeys([*keep, *columns])).alias("_row")).crossJoin(F.broadcast(size))  # exactly one row
    # A row goes once to the block of its own place and of those whose twin it is: nearly always one block.
    goes = F.array_distinct(F.array(block(F.col("_pos")), *[block(target(F.lit(r))) for r in range(repeats)]))
    sent = placed.withColumn("_blk", F.explode(goes)).repartition("_blk")
    # Repeat -1 is the row itself.
    turns = sent.withColumn("repeat", F.explode(F.sequence(F.lit(-1), F.lit(repeats - 1))))
    at = F.when(F.col("repeat") < 0, F.col("_pos")).otherwise(target(F.col("repeat")))
    items = turns.withColumn("_at", at).filter(block(F.col("_at")) == F.col("_blk"))
    # The rows lie by block already, so the grouping moves nothing.
    values = F.struct(*[F.col(f"_row.{c}").alias(c) for c in columns])
    own = F.first(F.when(F.col("repeat") < 0, F.col("_row")), True).alias("_own")
    twins = F.collect_list(F.when(F.col("repeat") >= 0, F.struct("repeat", values.alias("twin")))).alias("_twins")
    return items.groupBy("_blk", "_at").agg(own, twins).select(*[F.col(f"_own.{c}").alias(c) for c in keep], F.inline("_twins"))


def fit_linear(df: DataFrame, channels: list[str], label: str):
    """A linear rule from the classes' means and the channels' variances: column values -> predicted 0 / 1.

    One pass; three numbers a channel reach the driver. A constant channel has no weight, NULL counts as the mean.
    """
    one, zero = (F.col(label) == y for y in (1, 0))
    cols = []
    for c in channels:
        cols += [F.avg(F.when(one, F.col(c))).alias(f"{c}__1"), F.avg(F.when(zero, F.col(c))).alias(f"{c}__0"), F.var_pop(c).alias(f"{c}__v")]
    r = df.agg(*cols).first()
    weights, middle = {}, {}
    for c in channels:
        a, b, v = r[f"{c}__1"], r[f"{c}__0"], r[f"{c}__v"]
        if a is not None and b is not None and v > 1e-18:
            weights[c], middle[c] = (a - b) / v, (a + b) / 2

    def predict(values: dict[str, Column]) -> Column:
        terms = [F.coalesce(F.lit(w) * (values[c] - F.lit(middle[c])), F.lit(0.0)) for c, w in weights.items()]
        return (sum(terms, F.lit(0.0)) > 0).cast("int")

    return predict


def permutation_importance(df: DataFrame, channels: list[str], key: list[str], label: str, predict, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(channel, importance, std, rank): how much balanced accuracy falls when a channel's values are permuted.

    ``predict`` makes a prediction of a dict channel -> column, e.g. ``fit_linear``'s. All channels and repeats come from
    one exchange of the rows and one aggregate over them.
    """
    twins = shuffled_twins(df, channels, key, repeats, seed, keep=[*channels, label])
    own = {c: F.col(c) for c in channels}
    rules = {"": predict(own)} | {c: predict(own | {c: F.col("twin")[c]}) for c in channels}

    def hits(rule: Column, y: int) -> Column:
        return F.avg(F.when(F.col(label) == y, (rule == y).cast("double")))

    def accuracy(rule: Column) -> Column:
        one, zero = hits(rule, 1), hits(rule, 0)
        return F.coalesce((one + zero) / 2.0, one, zero)

    found = twins.groupBy("repeat").agg(*[accuracy(rule).alias(f"_{i}") for i, rule in enumerate(rules.values())])
    drops = [F.struct(F.lit(c).alias("channel"), (F.col("_0") - F.col(f"_{i}")).alias("drop")) for i, c in enumerate(channels, 1)]
    long = found.select("repeat", F.inline(F.array(*drops)))
    return rank_importance(long.groupBy("channel").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std")))


def rank_importance(imp: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rank 1 = most important; at most one row per channel and key reaches the window."""
    w = Window.partitionBy(*by).orderBy(F.desc("importance"), "channel")
    return imp.withColumn("rank", F.row_number().over(w))


def normalize_drops(imp: DataFrame, by: list[str] = ()) -> DataFrame:
    """Clip at 0 and normalise to shares; uniform when every drop is 0."""
    w = Window.partitionBy(*by)
    x = imp.withColumn("importance", F.greatest("importance", F.lit(0.0)))
    total, n = F.sum("importance").over(w), F.count(F.lit(1)).over(w)
    return x.withColumn("importance", F.when(total > 1e-12, F.try_divide(F.col("importance"), total)).otherwise(1.0 / n))


def weight_importance(weights: DataFrame, how: str = "mean", by: list[str] = ()) -> DataFrame:
    """Mean / sum / max of |weight| per input channel, as shares."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return normalize_drops(weights.groupBy(*by, "channel").agg(f(F.abs("weight")).alias("importance")), by)


def compare_methods(imp: DataFrame) -> DataFrame:
    """Importances of several methods scaled by each method's maximum."""
    top = imp.groupBy("method").agg(F.max("importance").alias("_max"))
    return imp.join(top, "method").withColumn("scaled", F.try_divide(F.col("importance"), F.col("_max"))).drop("_max")


def sensor_of(channel: Column | str) -> Column:
    c = F.col(channel) if isinstance(channel, str) else channel
    return F.when(c.contains("head"), "head").when(c.contains("right"), "right_hand").when(c.contains("left"), "left_hand")


def sensor_insights(imp: DataFrame, by: list[str], top_k: int = 10) -> DataFrame:
    """Sensors among the top-k channels and the rules read from them."""
    top = rank_importance(imp, by).filter(F.col("rank") <= top_k).withColumn("sensor", sensor_of("channel"))
    n = lambda s: F.sum((F.col("sensor") == s).cast("long")).alias(f"n_{s}")
    out = top.groupBy(*by).agg(n("head"), n("left_hand"), n("right_hand"), F.sum("importance").alias("top_importance"))
    return out.withColumns(
        {
            "compensation": F.col("n_head") >= 3,
            "right_dominant": F.col("n_right_hand") > F.col("n_left_hand"),
        }
    )


def model_verdict(preds: DataFrame, by: list[str]) -> DataFrame:
    """Votes, mean probability and majority over models."""
    out = preds.groupBy(*by).agg(
        F.sum("y_pred").alias("patient_votes"), F.count(F.lit(1)).alias("n_models"), F.avg("y_proba").alias("mean_proba")
    )
    return out.withColumn("verdict", F.when(F.col("patient_votes") > F.col("n_models") / 2.0, "patient").otherwise("control"))


def metric_table(metrics: DataFrame, model: str, names: list[str], digits: int = 3) -> DataFrame:
    """model x metric table of means."""
    return metrics.groupBy(model).agg(*[F.round(F.avg(n), digits).alias(n) for n in names])
