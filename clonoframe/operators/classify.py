"""Classifier heads on vectors, and scores' quality."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import apply_affine


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve from mid-ranks of distinct scores; null without both classes. Rows without a score don't count.

    Scores are counted first. Distinct scores are dealt into ranges between quantiles; the running sum goes over each range,
    from the sum of the ranges below it (one row a range on the driver).
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = rows.groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    cuts = sorted(set(rows.where(F.col(score).isNotNull()).approxQuantile(score, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    ranged = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(score))) if cuts else F.lit(0)
    per = per.where(F.col(score).isNotNull()).withColumn("_r", ranged)
    sums = {r["_r"]: r["n"] for r in per.groupBy("_r").agg(F.sum("n").alias("n")).collect()}
    before = F.element_at(F.array(*[F.lit(sum(v for q, v in sums.items() if q < r)).cast("long") for r in range(len(cuts) + 1)]), F.col("_r") + 1)
    inside = F.sum("n").over(Window.partitionBy("_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    below = before + F.coalesce(inside, F.lit(0))
    return per.withColumn("_u", F.col("p") * (below + F.col("n") / 2.0)).agg(
        F.expr("try_divide(sum(_u), cast(sum(p) as double) * sum(n))").alias("auc")
    )


def scaled_gamma(rows: DataFrame, vec: str = "vec") -> float:
    """1 / (width * variance of all entries): the usual width of a radial kernel; 1 where nothing varies."""
    x = rows.select(F.size(vec).alias("d"), F.explode(F.col(vec).cast("array<double>")).alias("x")).agg(F.max("d").alias("d"), F.var_pop("x").alias("v")).first()
    return 1 / (x["d"] * x["v"]) if x["v"] else 1.0


def radial_features(rows: DataFrame, gamma: float, n: int = 1024, seed: int = 0, vec: str = "vec") -> DataFrame:
    """``rows`` with ``vec`` mapped to ``n`` random Fourier features, whose products come near exp(-gamma * squared distance) (error about 1 / sqrt(n)).

    A linear head on them stands for a radial one without a kernel matrix, so training stays distributed. The map depends on the width, gamma, n
    and seed only: the same arguments serve training and prediction.
    """
    first = rows.select(F.size(vec).alias("d")).first()
    if first is None:
        return rows.withColumn(vec, F.col(vec).cast("array<double>"))
    rng = np.random.default_rng(seed)
    by, phase = rng.normal(scale=np.sqrt(2 * gamma), size=(first["d"], n)), rng.uniform(0, 2 * np.pi, n)
    turned = apply_affine(rows, np.zeros(first["d"]), by, phase, vec)
    return turned.withColumn(vec, F.transform(vec, lambda x: F.cos(x) * float(np.sqrt(2 / n))))


def train(rows: DataFrame, vec: str = "vec", label: str = "label", head: str = "svm", hidden: tuple = (256, 128), seed: int = 0, iterations: int = 100):
    """A fitted pipeline stage: linear SVM (regularised as C = 10) or multilayer perceptron."""
    df = rows.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    if head == "svm":
        return LinearSVC(regParam=0.1, maxIter=iterations).fit(df)
    if head == "mlp":
        width = len(df.first()["features"])
        return MultilayerPerceptronClassifier(layers=[width, *hidden, 2], seed=seed, maxIter=iterations).fit(df)
    raise ValueError(f"no head {head!r}")


def predict(model, rows: DataFrame, vec: str = "vec") -> DataFrame:
    """``rows`` with ``score``: the margin or the probability of class 1."""
    out = model.transform(rows.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))))
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", F.get(vector_to_array(raw), F.lit(1))).select(*rows.columns, "score")


def save_model(model, path: str) -> None:
    """The fitted head as a pipeline at ``path`` (any folder that Spark writes to); an older one there is replaced."""
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """What ``save_model`` wrote; ``predict`` takes it."""
    return PipelineModel.load(path)


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.corr(x, y).alias("pearson"))
