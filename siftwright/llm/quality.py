"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance (POOL) and towards its own mean
variance times the identity (RIDGE). The score is the logistic of the difference of the two log densities,
each a Mahalanobis distance through a Cholesky factor that is inverted once and kept, plus the log of the
class odds.

The moments are exact sums over all labelled rows, made on the executors; the driver gets one number per class
and pair of features.

Defined results. Null or blank text: the statistics of an empty document, scored like any other. A null id:
scored, held_out null. A repeated row gives a row each. Several labels for one id: the smallest counts. A null label isn't learnt
from. If either class has no labelled row, every score is the smoothed share of label 1. Columns beside the
id and text columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_pieces

FEATURES = ("words", "word_len", "upper", "symbols", "digits", "stops", "marks", "distinct", "repeat_next", "repeat_lines", "line_len", "entropy")
POOL = 0.1
RIDGE = 0.05
THRESHOLD = 0.7
#: Statistics enter the moments in steps of 1 / SCALE.
SCALE = 1 << 16

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>~^=_{}[]\\/@+")] = True


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    text = text or b""
    words = text.split()
    n = len(words)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    count[0x80:0xC0] = 0  # continuation bytes
    chars = max(count.sum(), 1.0)
    upper = count[65:91].sum()
    letters = upper + count[97:123].sum() + count[0xC0:].sum()
    share = count[count > 0] / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = count.sum() - count[9:14].sum() - count[32]
    return [
        np.log1p(n),
        np.log1p(solid / max(n, 1)),
        upper / max(letters, 1.0),
        np.log(count[_SYMBOLS].sum() / chars + 0.002),
        np.log(count[48:58].sum() / chars + 0.002),
        np.log((count[46] + count[44]) / max(n, 1) + 0.01),
        np.log((count[33] + count[63]) / max(n, 1) + 0.01),
        np.log(len(set(words)) + 1.0) / np.log(n + 2.0),
        np.log(sum(map(eq, words, words[1:])) / max(n, 1) + 0.01),
        np.log(1.0 - len(set(lines)) / max(len(lines), 1) + 0.01) if lines else np.log(0.01),
        np.log1p(n / max(len(lines), 1)),
        float(-(share * np.log(share)).sum()) if len(share) else 0.0,
    ]


def _features(batches):
    for batch in batches:
        for ids, texts in text_pieces(batch):
            rows = [statistics(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every document."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_features, "id long, x array<double>")


def _moments(batches):
    """Sums of products by class in whole numbers of SCALE**-2: exact, so their order doesn't show."""
    d = len(FEATURES)
    i, j = np.triu_indices(d + 1)
    total = np.zeros((2, len(i)), object)
    for batch in batches:
        if batch.num_rows:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = np.rint(np.column_stack([np.ones(len(x)), x]) * SCALE).astype(np.int64)
            for c in (0, 1):
                total[c] += (x[y == c].T @ x[y == c])[i, j].astype(object)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(i)).astype(np.int32)), pa.array(np.tile(np.arange(len(i)), 2).astype(np.int32)), pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))], names=["y", "at", "v"])


class Qda:
    """A fitted model: class counts, means, inverted Cholesky factors and log determinants."""

    def __init__(self, moments: np.ndarray):
        d = len(FEATURES)
        self.n = moments[:, 0].copy()
        self.share = float((self.n[1] + 1) / (self.n.sum() + 2))
        self.fitted = bool((self.n > 0).all())
        if not self.fitted:
            return
        i, j = np.triu_indices(d + 1)
        full = np.zeros((2, d + 1, d + 1))
        full[:, i, j] = moments
        full[:, j, i] = moments
        mean = full[:, 0, 1:] / self.n[:, None]
        cov = full[:, 1:, 1:] / self.n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = np.tensordot(self.n / self.n.sum(), cov, 1)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.mean = mean / self.scale
        cov, pooled = cov / np.outer(self.scale, self.scale), pooled / np.outer(self.scale, self.scale)
        self.factor, self.logdet = [], []
        for c in (0, 1):
            s = (1 - POOL) * cov[c] + POOL * pooled
            s = (1 - RIDGE) * s + RIDGE * max(np.trace(s) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(s)
            self.factor.append(np.linalg.inv(low).T)
            self.logdet.append(2 * np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of statistics."""
        if not self.fitted:
            return np.full(len(x), self.share)
        x = x / self.scale
        density = [-0.5 * ((((x - self.mean[c]) @ self.factor[c]) ** 2).sum(1) + self.logdet[c]) for c in (0, 1)]
        odds = density[1] - density[0] + np.log(self.n[1] / self.n[0])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Qda:
    """Fit on the rows of ``stats`` (id, x) that ``labels`` marks and whose crc32(id) mod 4 is not 2."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1) AND crc32(cast(id AS string)) % 4 <> 2").groupBy("id").agg(F.min("y").alias("y"))
    sums = stats.join(known, "id").select("y", "x").mapInArrow(_moments, "y int, at int, v decimal(38,0)").groupBy("y", "at").agg(F.sum("v").alias("v"))
    d = len(FEATURES) + 1
    moments = np.zeros((2, d * (d + 1) // 2))
    for r in sums.collect():
        moments[r.y, r["at"]] = float(r.v) / SCALE**2
    return Qda(moments)


def score(stats: DataFrame, model: Qda, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``stats``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], names=["id", "score"])

    out = stats.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), F.expr("crc32(cast(id AS string)) % 4 = 2").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Fit on the labelled documents and score all of them."""
    stats = cut(features(docs, id_col, text_col), "quality-stats")
    return score(stats, fit(stats, labels, id_col, label_col), id_col)


def accepted(docs: DataFrame, model: Qda, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, all columns as they are: one pass, no join."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column(at).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array(model.score(np.array([statistics(t) for t in texts])) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
