"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and cover all of it. Bytes are
embedded, learned filters of ``KERNEL`` bytes slide over each chunk and are max-pooled over it; the mean and the
maximum of the chunks' pooled filters go through one hidden layer to a single probability for the text.

The network is fitted on the driver from at most ``SAMPLE`` labelled texts (those with the smallest id hashes), of which
at most ``SAMPLE_CHUNKS`` evenly spread chunks are read. Scoring reads every chunk of every text, in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import held_out, query, table, texts_of, whole_text

CHUNK, OVERLAP = 512, 64
KERNEL, STRIDE = 8, 4
EMBED, FILTERS, HIDDEN = 8, 32, 16
SAMPLE, SAMPLE_CHUNKS = 4000, 4
EPOCHS, BATCH, RATE = 8, 64, 0.004
PAD = 256
#: Chunks computed at a time, so that the arrays stay in a core's cache.
AT_ONCE = 128


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) byte numbers; the last chunk is filled up with PAD. An empty text is one chunk of PAD."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    flat = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


class ByteNetwork:
    """The weights, forward pass and gradient."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        width = STRIDE * EMBED
        self.w = {
            "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)),
            "early": rng.normal(0, 0.18, (width, FILTERS)),
            "late": rng.normal(0, 0.18, (width, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": rng.normal(0, 0.15, (2 * FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": rng.normal(0, 0.3, HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def filters(self, x: np.ndarray, keep: bool = False):
        """Max-pooled filters of chunks x (n, CHUNK): (n, FILTERS); with ``keep`` also what the gradient needs."""
        w = self.w
        r = w["embed"][x].reshape(len(x), CHUNK // STRIDE, STRIDE * EMBED)
        # A filter of eight bytes is the sum of two half filters on neighbouring groups of four.
        both = r.reshape(-1, STRIDE * EMBED) @ np.concatenate([w["early"], w["late"]], 1)
        both = both.reshape(len(x), CHUNK // STRIDE, 2 * FILTERS)
        a = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
        # Windows that begin behind the text's end do not count.
        short = np.flatnonzero(x[:, -1] == PAD)
        for i in short:
            a[i, max(1, -(-int((x[i] != PAD).sum()) // STRIDE)) :] = -np.inf
        if not keep:
            return np.maximum(a.max(axis=1) + w["bias"], 0)
        top = a.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(a, top[:, None], 1)[:, 0] + w["bias"], 0)
        return pooled, (r, top)

    def probability(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One probability per text; its chunks' pooled filters begin at ``starts``."""
        return self._head(pooled, starts)[0]

    def _head(self, pooled, starts):
        w = self.w
        count = np.diff(np.append(starts, len(pooled)))[:, None]
        z = np.concatenate([np.add.reduceat(pooled, starts) / count, np.maximum.reduceat(pooled, starts)], 1)
        h = np.maximum(z @ w["hidden"] + w["hidden_bias"], 0)
        logit = h @ w["out"] + w["out_bias"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), z, h, count

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        pooled, (r, top) = self.filters(x, keep=True)
        p, z, h, count = self._head(pooled, starts)
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"out": h.T @ d, "out_bias": d.sum(keepdims=True)}
        dh = np.outer(d, w["out"]) * (h > 0)
        g["hidden"], g["hidden_bias"] = z.T @ dh, dh.sum(0)
        dz = dh @ w["hidden"].T
        of = np.repeat(np.arange(len(starts)), count[:, 0])
        dp = (dz[:, :FILTERS] / count)[of] + dz[of, FILTERS:] * (pooled == z[of, FILTERS:])
        dp *= pooled > 0
        g["bias"] = dp.sum(0)
        rows = np.arange(len(x))[:, None]
        g["embed"] = np.zeros_like(w["embed"])
        for name, at in (("early", top), ("late", top + 1)):
            g[name] = np.einsum("cf,cfk->kf", dp, r[rows, at])
            back = dp[:, :, None] * w[name].T[None]
            at_bytes = x.reshape(len(x), -1, STRIDE)[rows, at]
            flat, back = at_bytes.ravel(), back.reshape(-1, EMBED)
            for k in range(EMBED):
                g["embed"][:, k] += np.bincount(flat, back[:, k], PAD + 1)
        return g


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> ByteNetwork | None:
    """Fit by Adam on the cross entropy; None without labels of both kinds."""
    if len(set(labels.tolist())) < 2:
        return None
    net, rng = ByteNetwork(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    # Few texts get more rounds, so that the number of steps does not fall away.
    rounds = max(epochs, min(50, 20_000 // max(1, len(texts))))
    total = rounds * -(-len(texts) // BATCH)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = np.concatenate([texts[i] for i in some])
            starts = np.cumsum([0, *(len(texts[i]) for i in some[:-1])])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in net.gradient(x, starts, labels[some]).items():
                g = g + 1e-4 * net.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, y, text) of at most ``size`` labelled rows outside the held-out fold, those with the smallest id hashes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most ``size`` rows of two numbers: a bounded broadcast.
    return whole_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> ByteNetwork | None:
    def read(batches):
        for b in batches:
            made = []
            for t in texts_of(b):
                x = chunks(t.encode())
                pick = np.unique(np.linspace(0, len(x) - 1, min(len(x), SAMPLE_CHUNKS)).round().astype(int))
                made.append(x[pick].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, "quality", size).mapInArrow(read, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    texts = [np.frombuffer(r["x"], "<i2").reshape(-1, CHUNK) for r in rows]
    return train(texts, np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1, from all chunks. Without a network 0.5."""

    def run(batches):
        for b in batches:
            texts = texts_of(b)
            if net is None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0.5] * len(texts), pa.float64())], ["doc_id", "score"])
                continue
            out, pooled, starts, n = [], [], [], 0
            waiting, held = [], 0

            def flush():
                nonlocal waiting, held
                if waiting:
                    x = np.concatenate(waiting)
                    pooled.extend(net.filters(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE))
                    waiting, held = [], 0

            for t in texts:
                x = chunks(t.encode())
                starts.append(n)
                n += len(x)
                waiting.append(x)
                held += len(x)
                if held >= 16 * AT_ONCE:
                    flush()
            flush()
            if starts:
                out = net.probability(np.concatenate(pooled), np.array(starts)).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return whole_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts are empty and get a score like any other, repeated rows give equal rows, null or other labels are left
    out, a label given twice counts as its larger value; an empty table gives none.
    """
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more.

    Scores are joined by id and text hash, so rows that share an id are judged each by its own text.
    """
    net = fit(docs, labels)

    @F.pandas_udf("double")
    def judged(text):
        import pandas as pd

        parts = [chunks((t or "").encode()) for t in text]
        if net is None or not parts:
            return pd.Series([0.5] * len(parts))
        starts = np.cumsum([0, *map(len, parts[:-1])])
        pooled = []
        for at in range(0, len(parts), 16):
            x = np.concatenate(parts[at : at + 16])
            pooled += [net.filters(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)]
        return pd.Series(net.probability(np.concatenate(pooled), starts).astype(float))

    return docs.filter(judged(F.col("text").cast("string")) >= threshold)


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
