"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text (shares of character kinds, lengths, repetition) are transformed to tame their tails,
and summed per class (count, sums, cross products) on the executors; the driver gets one row for each class. Class
covariances are shrunk towards the pooled one, with a ridge of a share of each feature's pooled variance, factored once by Cholesky, and the factors go to
the executors with the scoring function: score = logistic(log-density difference + log prior odds), with
Mahalanobis terms from triangular solves.

Empty and null texts have the usual shares (see ``_BYTES``) and a score like any other. Without labelled rows of both classes every score is the
share of class 1 (0.5 without any label). Labels that occur several times for a document count as the smallest; null ones not at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "comma_dot", "pipe", "bang", "symbol", "line_bytes",
    "distinct_words", "distinct_lines", "distinct_sentences", "compressed", "capital_words", "short_words",
)
#: Shares are smoothed as if so many usual bytes, words and lines came on top, so that short texts look usual.
_BYTES, _WORDS, _PIECES = 200, 20, 8
_UPPER = slice(65, 91)
_SYMBOLS = [ord(c) for c in "#$%&*@^~<>=+_\\/{}[]"]


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ink = n - int(counts[32]) - int(counts[9:14].sum())
    lines = [x for x in raw.split(b"\n") if x]
    sentences = [x for x in raw.replace(b"\n", b". ").split(b". ") if x]
    share = lambda k, usual=0.0: np.sqrt((k + usual * _BYTES) / (ink + _BYTES))
    kinds = lambda x: (len(set(x)) + _PIECES) / (len(x) + _PIECES)
    words_like = lambda k, usual: np.sqrt((k + usual * _WORDS) / (m + _WORDS))
    out[:] = (
        np.log1p(n + _BYTES), np.log1p(m + _WORDS), np.log((ink + 5 * _WORDS) / (m + _WORDS)), share(counts[_UPPER].sum(), 0.03),
        share(counts[48:58].sum()), share(counts[44] + counts[46], 0.03), share(counts[124]), share(counts[33]),
        share(counts[_SYMBOLS].sum()), np.log((n + _BYTES) / (len(lines) + 1)), (len(set(words)) + _WORDS) / (m + _WORDS),
        kinds(lines), kinds(sentences), np.log((len(zlib.compress(raw, 1)) + _BYTES) / (n + _BYTES)),
        words_like(sum(w[:1].isupper() for w in words), 0.1), words_like(sum(len(w) <= 3 for w in words), 0.3),
    )
    return out


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with an array of the transformed statistics; no shuffle."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            flat = [np.array([statistics(t) for t in col.slice(k, 256).to_pylist()]).ravel() for k in range(0, len(col), 256)]
            ends = np.arange(len(col) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0)))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, "array<double>")(F.col(text)))


def _inverse(low: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(low)
    for i in range(len(low)):
        own = -low[i, :i] @ out[:i]
        own[i] += 1
        out[i] = own / low[i, i]
    return out


@dataclass
class Model:
    """Means and Cholesky factors of classes 0 and 1, and the log prior odds; ``only`` is a constant score.

    The factors' inverses (triangular too) and log-determinants are made once and kept; scoring only multiplies.
    """

    means: list | None
    factors: list | None
    odds: float
    only: float | None = None

    def __post_init__(self) -> None:
        self.inverses = [_inverse(low) for low in self.factors or []]
        self.logs = [float(np.log(np.diag(low)).sum()) for low in self.factors or []]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of ``x``, in (0, 1)."""
        if self.only is not None:
            return np.full(len(x), self.only)
        density = []
        for mean, inverse, log in zip(self.means, self.inverses, self.logs, strict=True):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * (z * z).sum(axis=1) - log)
        d = np.clip(density[1] - density[0] + self.odds, -40, 40)
        return 1 / (1 + np.exp(-d))


def fit(rows: DataFrame, shrink: float = 0.3, ridge: float = 0.05) -> Model:
    """Fit on columns stats and label (0, 1). Sums are made on the executors; two rows come to the driver."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = np.asarray(b.column(0).flatten()).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(axis=0)
                p[c] += own.T @ own
        for c in (0, 1):
            flat = np.concatenate([[n[c]], s[c], p[c].ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["c", "i", "v"]
            )

    got = np.zeros((2, 1 + d + d * d))
    for r in rows.select("stats", "label").where("label in (0, 1)").mapInArrow(sums, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect():
        got[r["c"], r["i"]] = r["v"]
    n = got[:, 0]
    if n.min() < 2:
        return Model(None, None, 0.0, float((n[1]) / n.sum()) if n.sum() else 0.5)
    means = [got[c, 1 : d + 1] / n[c] for c in (0, 1)]
    covs = [got[c, d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    factors = []
    for c in (0, 1):
        mixed = (1 - shrink) * covs[c] + shrink * pooled + ridge * np.diag(scale**2)
        factors.append(np.linalg.cholesky(mixed))
    return Model(means, factors, float(np.log(n[1] / n[0])))


def score(rows: DataFrame, model: Model, stats: str = "stats", out: str = "score") -> DataFrame:
    """``rows`` (with statistics) and their score; a score for every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 2 * 16 * 17 numbers

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            x = np.asarray(col.flatten()).reshape(-1, len(FEATURES))
            yield pa.array(shared.value.score(x))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn(out, F.arrow_udf(run, "double")(F.col(stats)))


def labelled(stats: DataFrame, labels: DataFrame, fold: int | None = 1) -> DataFrame:
    """Statistics with labels; rows with crc32(doc_id) mod 3 = ``fold`` are left out (None: no row is)."""
    y = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("label"))
    joined = stats.join(y, stats["doc_id"] == y["_id"], "inner")
    return joined if fold is None else joined.where(crc_mod("doc_id", 3) != fold)


def judge(docs: DataFrame, labels: DataFrame, fold: int | None = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; only statistics are kept and joined, not texts."""
    stats = cut(with_statistics(docs.select("doc_id", "text")).drop("text"))
    model = fit(labelled(stats, labels, fold))
    return score(stats, model).select(
        "doc_id", (crc_mod("doc_id", 3) == (1 if fold is None else fold)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, fold: int | None = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with the columns of ``docs``; no text is shuffled.

    Each text is read once for the fit and once, in one pass of statistics and score, for the decision. The statistics of
    the first pass are kept, so that no task runs two Python workers in a row.
    """
    stats = cut(with_statistics(docs.select("doc_id", "text")).drop("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled(stats, labels, fold)))

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            parts = [
                shared.value.score(np.array([statistics(t) for t in col.slice(k, 256).to_pylist()])) >= least for k in range(0, len(col), 256)
            ]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(run, "boolean")(F.col("text")))
