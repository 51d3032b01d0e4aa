"""Leave-one-subject-out classification of feature rows.

The training set of a fold is everything minus one subject, so a classifier with additive sufficient
statistics needs one pass over the rows for all folds: fold statistics = total - held-out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators import evaluate
from kinelake.sources.store import stored


def loso_ridge(
    df: DataFrame, features: list[str], lambdas: list[float], subject: str = "subject_id", label: str = "y", by: list[str] = ()
) -> DataFrame:
    """Held-out probabilities per (by, fold, config) of a ridge classifier on fold-scaled features.

    Statistics are a (d + 2) x (d + 2) product sum per subject, summed map-side; each fold solves its
    own small system inside an Arrow UDF. Probabilities are the score (target -1/+1) through a sigmoid.

    A missing feature takes the mean of the fold's training rows. The product sums are therefore kept over values and
    presence flags apart; with the fold's means they give the sums of the filled features exactly. The rows are read for
    the means, the sums and the scores, so they are stored first.
    """
    by, df = list(by), stored(df, "samples")
    here = [f"_p_{f}" for f in features]
    names = ["_one", *features, *here, "_t"]
    centre = df.agg(*[F.avg(f).alias(f"_c_{f}") for f in features])
    x = df.crossJoin(F.broadcast(centre)).withColumns(
        {
            **{f: F.coalesce(F.col(f) - F.col(f"_c_{f}"), F.lit(0.0)) for f in features},
            **{p: F.col(f).isNotNull().cast("double") for p, f in zip(here, features)},
            "_one": F.lit(1.0),
            "_t": 2.0 * F.col(label) - 1.0,
        }
    )
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    own = x.groupBy(*by, subject).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in cells])
    sums = [f"s{i}_{j}" for i, j in cells]
    total = own.groupBy(*by).agg(*[F.sum(s).alias(f"all_{s}") for s in sums]) if by else own.agg(*[F.sum(s).alias(f"all_{s}") for s in sums])
    rest = own.join(total, by) if by else own.crossJoin(F.broadcast(total))
    rest = rest.select(*by, subject, F.array(*[F.col(f"all_{s}") - F.col(s) for s in sums]).alias("stats"))
    d = len(features)

    @F.pandas_udf("array<array<double>>")
    def solve(stats: pd.Series) -> pd.Series:
        out = []
        for flat in stats:
            held = np.zeros((2 * d + 2, 2 * d + 2))
            for (i, j), v in zip(cells, flat):
                held[i, j] = held[j, i] = v
            n = held[0, 0]
            if n < 2:
                out.append([[0.0] * (2 * d + 1) for _ in lambdas])
                continue
            seen = held[0, d + 1 : 2 * d + 1]
            fill = np.where(seen > 0.5, held[0, 1 : d + 1] / np.maximum(seen, 1.0), 0.0)
            # A filled feature is value + fill * (1 - flag): a linear map of (1, values, flags).
            to = np.zeros((d + 2, 2 * d + 2))
            to[0, 0] = to[d + 1, 2 * d + 1] = 1.0
            to[1 : d + 1, 1 : d + 1] = np.eye(d)
            to[1 : d + 1, 0], to[1 : d + 1, d + 1 : 2 * d + 1] = fill, -np.diag(fill)
            m = to @ held @ to.T
            mean = m[0, 1 : d + 1] / n
            cov = m[1 : d + 1, 1 : d + 1] / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
            sd[sd < 1e-12] = 1.0
            corr = cov / np.outer(sd, sd)
            ty = (m[1 : d + 1, d + 1] / n - mean * m[0, d + 1] / n) / sd
            fits = []
            for lam in lambdas:
                w = np.linalg.solve(corr + lam * np.eye(d), ty) / sd
                fits.append([float(m[0, d + 1] / n - w @ mean), *map(float, w), *map(float, fill)])
            out.append(fits)
        return pd.Series(out)

    weights = rest.select(*by, subject, solve("stats").alias("fits"))
    scored = x.join(weights, [*by, subject])
    configs = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(float(lam)).alias("ridge")) for i, lam in enumerate(lambdas)])
    scored = scored.withColumn("_k", F.explode(configs)).select("*", "_k.*")
    w = F.element_at("fits", F.col("config") + 1)
    given = [F.when(F.col(p) > 0, F.col(f)).otherwise(w[i + d + 1]) for i, (f, p) in enumerate(zip(features, here))]
    score = w[0] + sum((v * w[i + 1] for i, v in enumerate(given)), F.lit(0.0))
    proba = 1.0 / (1.0 + F.exp(-4.0 * score))
    drop = ["_one", "_t", "fits", "_k", *[f"_c_{f}" for f in features], *here, *features]
    out = scored.withColumn("y_proba", proba).withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int"))
    return out.withColumn("y_true", F.col(label)).drop(*drop)


def logistic_fold(train: DataFrame, test: DataFrame, features: list[str], label: str = "y", reg: float = 0.1) -> DataFrame:
    """One fold with Spark ML: scaler and logistic regression fitted on the training rows only.

    A missing feature, in training or test, takes the mean of the training rows (0 if they have none), so no row is lost.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    present = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    means = train.agg(*[F.avg(present[f]).alias(f) for f in features]).first()  # one number per feature
    filled = [f"_f{i}" for i in range(len(features))]
    fill = {n: F.coalesce(present[f], F.lit(float(means[f] or 0.0))) for n, f in zip(filled, features)}
    stages = [
        VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg),
    ]
    out = Pipeline(stages=stages).fit(train.withColumns(fill)).transform(test.withColumns(fill))
    p = vector_to_array("probability")[1]
    return out.withColumns({"y_proba": p, "y_pred": (p >= 0.5).cast("int"), "y_true": F.col(label)}).drop(
        "_raw", "_x", "rawPrediction", "probability", "prediction", *filled
    )


def nested_metrics(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per-config metrics of held-out predictions and the rank of each config."""
    preds = stored(preds.select(*by, "config", "y_true", "y_pred", "y_proba"), "predictions")
    m = evaluate.binary_metrics(preds, [*by, "config"], None).join(evaluate.roc_auc(preds, [*by, "config"]), [*by, "config"])
    return m


