"""Classifiers of recordings as ``pyspark.ml`` estimators: one surface to fit, score, store, load and explain them.

``HmmClassifier`` and ``HsmmClassifier`` read frames, one model per class; ``RidgeClassifier`` reads one row of features
per recording. ``fit`` returns a model whose parameters are small arrays: K states, C channels, no number of rows. They
are kept as a table, one row per array, so a stored model is read wherever Spark reads Parquet. ``transform`` returns
y_proba and y_pred, and y_true where the label column is there: the form that ``evaluate`` takes.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.base import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.config import RECORDING
from kinelake.operators import evaluate, hmm, ordering, states

CLASSES = (0, 1)


class _Settings(HasInputCols, HasLabelCol):
    """Input columns, label column (0 or 1, the same in all frames of a recording) and the names of a recording."""

    keys = Param(Params._dummy(), "keys", "columns that name a recording", TypeConverters.toListString)

    def _given(self, inputCols: list[str], labelCol: str, keys: list[str], **more) -> None:
        self._set(inputCols=list(inputCols), labelCol=labelCol, keys=list(keys), **more)

    def getKeys(self) -> list[str]:
        return self.getOrDefault(self.keys)

    def _labelled(self, df: DataFrame) -> list[str]:
        """The names of a recording, with its label where there is one."""
        label = self.getLabelCol()
        return [*self.getKeys(), *([label] if label in df.columns and label not in self.getKeys() else [])]


class FittedClassifier(Model, _Settings):
    """Fitted parameters by name; subclasses score and explain."""

    def __init__(self, inputCols: list[str], labelCol: str = "y", keys: list[str] = RECORDING, arrays: dict[str, np.ndarray] | None = None):
        super().__init__()
        self._given(inputCols, labelCol, keys)
        self.arrays = {name: np.asarray(a, dtype=float) for name, a in (arrays or {}).items()}

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(name, shape, cells): one row per array, cells in row order."""
        rows = [(name, list(a.shape), a.ravel().tolist()) for name, a in sorted(self.arrays.items())]
        return spark.createDataFrame(rows, "name STRING, shape ARRAY<INT>, cells ARRAY<DOUBLE>")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write parameters and settings; a model that is there already is replaced."""
        settings = [(type(self).__name__, self.getInputCols(), self.getLabelCol(), self.getKeys())]
        kind = "kind STRING, input_cols ARRAY<STRING>, label_col STRING, keys ARRAY<STRING>"
        self.parameters(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")
        spark.createDataFrame(settings, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    def importance(self, spark: SparkSession) -> DataFrame:
        """(channel, importance, rank): each input's share of the model's weights, the largest first."""
        w = np.abs(self._weights())
        share = w / w.sum() if w.sum() > 0 else w
        rows = sorted(zip(self.getInputCols(), share.tolist()), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame([(c, v, i + 1) for i, (c, v) in enumerate(rows)], "channel STRING, importance DOUBLE, rank INT")

    def _finish(self, scored: DataFrame, proba: Column) -> DataFrame:
        out = scored.withColumn("y_proba", proba).withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int"))
        label = self.getLabelCol()
        return out.withColumn("y_true", F.col(label).cast("int")) if label in scored.columns else out


class HmmClassifierModel(FittedClassifier):
    """Recordings by the likelihoods of two hidden Markov models, per frame, through a sigmoid."""

    def model_of(self, cls: int) -> hmm.Model:
        return {name: self.arrays[f"{cls}/{name}"] for name in ("start", "trans", "means", "covars")}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        models = {str(c): self.model_of(c) for c in CLASSES}
        scored = hmm.log_likelihood(dataset, self.getInputCols(), models, self._labelled(dataset))
        return self._finish(scored, hmm.class_probability())

    def _weights(self) -> np.ndarray:
        return np.abs(self.arrays["1/means"] - self.arrays["0/means"]).mean(axis=0)


class HsmmClassifierModel(HmmClassifierModel):
    """As above with explicit durations: the mean run of each state and the longest one."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keys, channels = self._labelled(dataset), self.getInputCols()
        scored = dataset.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
        for c in CLASSES:
            ll = hmm.hsmm_log_likelihood(dataset, channels, self.model_of(c), self.arrays[f"{c}/rates"], int(self.arrays["longest"][0]), keys, full_start=True)
            scored = ordering._join_on(scored, ll.withColumnRenamed("ll", f"ll_{c}"), keys)
        return self._finish(scored, hmm.class_probability())


class RidgeClassifierModel(FittedClassifier):
    """A linear score through a sigmoid, as column expressions; a missing or NaN feature takes its training mean."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = F.lit(float(self.arrays["intercept"][0]))
        for f, w, fill in zip(self.getInputCols(), self.arrays["weights"].tolist(), self.arrays["means"].tolist()):
            score = score + F.lit(w) * F.coalesce(present(f), F.lit(fill))
        return self._finish(dataset, 1.0 / (1.0 + F.exp(-4.0 * score)))

    def _weights(self) -> np.ndarray:
        return self.arrays["weights"] * self.arrays["deviations"]


def present(c: str) -> Column:
    """The value as a number, NULL where it is NaN."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


class HmmClassifier(Estimator, _Settings):
    """One Gaussian hidden Markov model for each class, all fitted in the same jobs."""

    nStates = Param(Params._dummy(), "nStates", "states of each class's model", TypeConverters.toInt)
    covariance = Param(Params._dummy(), "covariance", "diag or full", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "steps of expectation maximisation", TypeConverters.toInt)

    def __init__(self, inputCols: list[str], labelCol: str = "y", keys: list[str] = RECORDING, nStates: int = 3, covariance: str = "diag", maxIter: int = 10):
        super().__init__()
        self._given(inputCols, labelCol, keys, nStates=nStates, covariance=covariance, maxIter=maxIter)

    def _fit(self, dataset: DataFrame) -> HmmClassifierModel:
        return HmmClassifierModel(self.getInputCols(), self.getLabelCol(), self.getKeys(), self._arrays(dataset))

    def _arrays(self, dataset: DataFrame) -> dict[str, np.ndarray]:
        label = self.getLabelCol()
        known = dataset.filter(F.col(label).isin(*CLASSES))
        n, cov, steps = (self.getOrDefault(p) for p in (self.nStates, self.covariance, self.maxIter))
        found = {int(k[0]): m for k, m in hmm.class_models(known, self.getInputCols(), n, label, (), cov, steps, self.getKeys()).items()}
        if set(found) != set(CLASSES):
            raise ValueError(f"training rows of both classes are needed; found {sorted(found)}")
        return {f"{c}/{name}": a for c, m in found.items() for name, a in m.items()}


class HsmmClassifier(HmmClassifier):
    """Hidden Markov models whose states' mean runs are then read off the decoded training recordings."""

    maxDuration = Param(Params._dummy(), "maxDuration", "longest run of a state in frames", TypeConverters.toInt)

    def __init__(self, inputCols: list[str], labelCol: str = "y", keys: list[str] = RECORDING, nStates: int = 3, covariance: str = "diag", maxIter: int = 10, maxDuration: int = 100):
        super().__init__(inputCols, labelCol, keys, nStates, covariance, maxIter)
        self._set(maxDuration=maxDuration)

    def _fit(self, dataset: DataFrame) -> HsmmClassifierModel:
        arrays = self._arrays(dataset)
        fitted = HmmClassifierModel(self.getInputCols(), self.getLabelCol(), self.getKeys(), arrays)
        n, label = self.getOrDefault(self.nStates), self.getLabelCol()
        for c in CLASSES:
            path = hmm.decode(dataset.filter(F.col(label) == c), self.getInputCols(), fitted.model_of(c), self.getKeys())
            rates = states.duration_rates(path, n, self.getKeys()).collect()  # one row per state
            arrays[f"{c}/rates"] = np.array([r["rate"] for r in sorted(rates, key=lambda r: r["state"])])
        arrays["longest"] = np.array([self.getOrDefault(self.maxDuration)])
        return HsmmClassifierModel(self.getInputCols(), label, self.getKeys(), arrays)


class RidgeClassifier(Estimator, _Settings):
    """Ridge regression of -1 / +1 on scaled features, from one aggregate of products; rows without a label are left out."""

    regParam = Param(Params._dummy(), "regParam", "ridge added to each scaled feature", TypeConverters.toFloat)

    def __init__(self, inputCols: list[str], labelCol: str = "y", keys: list[str] = RECORDING, regParam: float = 0.1):
        super().__init__()
        self._given(inputCols, labelCol, keys, regParam=regParam)

    def _fit(self, dataset: DataFrame) -> RidgeClassifierModel:
        features, d = self.getInputCols(), len(self.getInputCols())
        known = dataset.filter(F.col(self.getLabelCol()).isin(*CLASSES))
        target = 2.0 * F.col(self.getLabelCol()) - 1.0
        first = known.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("t"), *[F.avg(present(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
        if not first["n"]:
            raise ValueError("no labelled training rows")
        mean = np.array([first[f"m{i}"] or 0.0 for i in range(d)])
        x = [F.coalesce(present(f) - F.lit(float(m)), F.lit(0.0)) for f, m in zip(features, mean)]
        x.append(target - F.lit(first["t"]))
        cells = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        sums = known.agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in cells]).first()
        cov = np.zeros((d + 1, d + 1))
        for i, j in cells:
            cov[i, j] = cov[j, i] = sums[f"s{i}_{j}"] / first["n"]
        sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0.0))
        sd[sd < 1e-12] = 1.0
        w = np.linalg.solve(cov[:d, :d] / np.outer(sd, sd) + self.getOrDefault(self.regParam) * np.eye(d), cov[:d, d] / sd) / sd
        arrays = {"weights": w, "intercept": [first["t"] - w @ mean], "means": mean, "deviations": sd}
        return RidgeClassifierModel(features, self.getLabelCol(), self.getKeys(), arrays)


KINDS = {k.__name__: k for k in (HmmClassifierModel, HsmmClassifierModel, RidgeClassifierModel)}


def load_model(spark: SparkSession, path: str) -> FittedClassifier:
    """The model that ``save`` wrote under ``path``."""
    s = spark.read.parquet(f"{path}/settings").first()
    rows = spark.read.parquet(f"{path}/parameters").collect()  # one row per array
    arrays = {r["name"]: np.array(r["cells"], dtype=float).reshape(r["shape"]) for r in rows}
    return KINDS[s["kind"]](s["input_cols"], s["label_col"], s["keys"], arrays)


def train_and_evaluate(estimator: Estimator, train: DataFrame, test: DataFrame, by: list[str] = ()) -> tuple[FittedClassifier, DataFrame, DataFrame]:
    """(model, predictions of ``test``, their metrics for each ``by``)."""
    model = estimator.fit(train)
    found = model.transform(test)
    return model, found, evaluate.binary_metrics(found, by, None)
