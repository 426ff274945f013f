"""Document quality by a regularised quadratic discriminant.

Each class has a Gaussian over transformed statistics of the text; its covariance is shrunk towards a scaled identity.
A score is the difference of the two Mahalanobis log densities, taken with cached Cholesky factors, tempered and put
through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.llm.common import cut, table, text_or_empty

THRESHOLD = 0.3
#: Byte classes that are counted; other bytes count in the text's length alone.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"$%&#*@^~", b"|<>{}[]()=_/\\", bytes(range(128, 256)), b"\n", b" ")
_COUNTED = np.array([[b in c for c in CLASSES] for b in range(256)], dtype=np.float64)
N_FEATURES = len(CLASSES) + 6


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of one whole text: logs of its length, of its shares of byte classes, and of its words' and lines'."""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = text.split(), text.split("\n")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _COUNTED / (len(raw) + 1)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    mean = lengths.mean() if n else 0.0
    rest = (
        np.log1p(len(raw)),
        np.log1p(mean),
        np.log1p(lengths.std() if n else 0.0),
        (len(set(words)) + 1) / (n + 1),
        (len(set(lines)) + 1) / (len(lines) + 1),
        np.log1p(len(raw) / len(lines)),
    )
    return np.concatenate([np.log(shares + 2e-3), rest])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of both classes over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [self.offsets[c] - 0.5 * np.square((z - self.means[c]) @ self.factors[c].T).sum(axis=1) for c in (0, 1)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -700, 700)))


def from_moments(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float) -> Discriminant | None:
    """The discriminant from each class's count, sums and sums of products; None unless both classes have rows."""
    if n.min() < 2:
        return None
    centre = sums.sum(axis=0) / n.sum()
    pooled = squares.sum(axis=0) / n.sum() - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    means, factors, offsets = [], [], []
    for c in (0, 1):
        mean = sums[c] / n[c]
        cov = (squares[c] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        d = len(cov)
        cov = (1 - shrinkage) * (cov + cov.T) / 2 + shrinkage * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(offsets))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.concatenate([np.empty(0), *(statistics(t) for t in batch.column(1).to_pylist())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(flat.reshape(-1, N_FEATURES)), pa.list_(pa.float64()))], names=["doc_id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return pairs.mapInArrow(_statistics, "doc_id long, x array<double>")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(known: DataFrame, shrinkage: float = 0.1, temperatures: tuple[float, ...] = (1, 2, 4, 8, 16)) -> Discriminant | None:
    """Fits on rows (x, label). Executors sum the moments of all labelled rows; the driver gets the sums of each class.
    The temperature is the one with the least log loss on the same rows."""
    d = N_FEATURES
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(x[i]) for i in range(d)] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]
    rows = {r[0]: r[1:] for r in known.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)), *sums).collect()}
    if set(rows) != {0, 1}:
        return None
    upper = np.triu_indices(d)
    squares = np.zeros((2, d, d))
    for c in (0, 1):
        squares[c][upper] = rows[c][1 + d :]
        squares[c] += np.triu(squares[c], 1).T
    model = from_moments(np.array([rows[c][0] for c in (0, 1)], float), np.array([rows[c][1 : 1 + d] for c in (0, 1)]), squares, shrinkage)
    if model is None:
        return None

    @F.pandas_udf(T.DoubleType())
    def margin(x: pd.Series) -> pd.Series:
        return pd.Series(model.margin(np.stack(x.to_numpy())))

    signed = known.where(F.col("label").isin(0, 1)).select(margin("x").alias("m"), "label")
    z = F.when(F.col("label") == 1, F.col("m")).otherwise(-F.col("m"))
    softplus = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    loss = signed.agg(*[F.avg(softplus(-z / t)).alias(str(t)) for t in temperatures]).first()
    best = min(temperatures, key=lambda t: loss[str(t)])
    return Discriminant(model.centre, model.scale, model.means, model.factors, model.offsets, float(best))


def labelled(stats: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Training rows: statistics of documents with one label and a non-zero remainder. Documents with contradicting
    labels are not learnt from."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("most"))
    one = one.where(F.col("label") == F.col("most")).select("doc_id", F.col("label").cast("int").alias("label"))
    return stats.where(~held_out()).join(one, "doc_id").select("x", "label")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def of_text(texts: pd.Series) -> pd.Series:
    """The statistics of texts, beside the columns they stand with."""
    return texts.map(statistics)


def scorer(model: Discriminant | None):
    """A UDF of the statistics that gives the score; 0.5 where there was nothing to learn from."""

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(0.5, index=x.index)
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """doc_id, held_out, score (that label 1 holds), predicted (score >= 0.3).

    Null text counts as empty and is scored like any text; a null id is scored, and held_out is false for it; repeated
    rows each give a row; without labels of both classes every score is 0.5; empty tables give no rows. Only the id and
    the text are read; the id decides which labels are learnt, never a score.
    """
    stats = cut(document_statistics(docs))
    model = fit(labelled(stats, labels), shrinkage)
    out = stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), scorer(model)("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold."""
    stats = cut(document_statistics(docs))
    model = fit(labelled(stats, table(spark, sf_dir, "labels")))
    # Statistics are worked out again: carried along, a copy of the texts would stay on disk through all later stages.
    return docs.where(scorer(model)(of_text(text_or_empty())) >= THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
