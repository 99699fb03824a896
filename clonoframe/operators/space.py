"""Building the reference space: k-means, functional clusters, cluster statistics, 2-D layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .encode import assign
from .metrics import principal_components


def kmeans(rows: DataFrame, k: int, vec: str = "vec", iterations: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame, dict]:
    """(assigned rows, centroids, statistics): distributed Lloyd; labels against the final centroids."""
    spark = rows.sparkSession
    model = KMeans(k=k, maxIter=iterations, tol=0.0, seed=seed, featuresCol="_f").fit(rows.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>"))))
    centroids = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, vec array<double>")
    assigned = assign(rows, centroids, vec)
    return assigned, centroids, cluster_stats(assigned, k).first().asDict()


def cluster_stats(assigned: DataFrame, k: int) -> DataFrame:
    """objective (mean squared distance) and imbalance (k * sum n_c^2 / N^2)."""
    per = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("s"))
    return per.agg((F.sum("s") / F.sum("n")).alias("objective"), (F.lit(float(k)) * F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("imbalance"))


def kmeans_range(rows: DataFrame, ks: list[int], **kw) -> list[tuple[DataFrame, DataFrame, dict]]:
    return [kmeans(rows, k, **kw) for k in ks]


def members(assigned: DataFrame, centroids: DataFrame, vec: str = "vec") -> DataFrame:
    """(cluster, vec, n): the rows of each cluster, one a row, with the cluster's size; a cluster without any has one zero vector and n = 0."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    known = centroids.join(sizes, "cluster", "left").select("cluster", centroids["vec"].alias("_c"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = known.join(assigned.select("cluster", F.col(vec).alias("_v")), "cluster", "left")
    return rows.select("cluster", F.coalesce("_v", F.transform("_c", lambda x: x * 0)).alias("vec"), "n")


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, restarts: int = 10, rounds: int = 25) -> np.ndarray:
    """k-means centroids with k-means++ starts; the best of some restarts."""
    best = None
    for _ in range(restarts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = np.min([((x - p) ** 2).sum(axis=1) for p in c], axis=0)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
            own = d.argmin(axis=1)
            c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
        cost = ((x - c[own]) ** 2).sum()
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def _affinity_products(centroids: DataFrame, x: np.ndarray, gamma: float):
    """The product of the affinity matrix exp(-gamma d^2) with a block of columns, by rows on the executors; the matrix never exists."""
    spark = centroids.sparkSession
    points = spark.sparkContext.broadcast((x, (x * x).sum(axis=1)))
    tasks = max(1, min(len(x) // 64, 4 * spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(x), 1, tasks)

    def times(v: np.ndarray) -> np.ndarray:
        columns = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, own = points.value
            for b in batches:
                at = b.column(0).to_numpy()
                for i in range(0, len(at), 256):
                    k = at[i : i + 256]
                    a = np.exp(-gamma * np.maximum(own[k, None] - 2 * p[k] @ p.T + own, 0))
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(a @ columns.value), pa.list_(pa.float64()))], names=["i", "v"])

        out = np.zeros(v.shape)
        got = rows.mapInArrow(run, "i long, v array<double>").toArrow()
        out[got.column("i").to_numpy()] = np.concatenate([blocks.matrix(c) for c in got.column("v").chunks]) if len(got) else 0
        columns.destroy()
        return out

    return times


def leading_vectors(times, scale: np.ndarray, k: int, seed: int = 0, extra: int = 8, rounds: int = 40, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues and vectors of ``diag(scale) A diag(scale)``: block Lanczos with full orthogonalisation, restarted from its best vectors, until their residuals are below ``tol``."""
    n, width = len(scale), min(len(scale), k + extra)
    rng = np.random.default_rng(seed)
    apply = lambda v: scale[:, None] * times(scale[:, None] * v)
    block, _ = np.linalg.qr(rng.normal(size=(n, width)))
    basis, images = block, apply(block)
    for _ in range(rounds):
        small = basis.T @ images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:width], mix[:, ::-1][:, :width]
        best, image = basis @ mix, images @ mix
        apart = image - best * values
        if np.linalg.norm(apart[:, :k], axis=0).max() < tol or basis.shape[1] >= n:
            break
        if basis.shape[1] > 6 * width:
            basis, images = best, image
        for _ in range(2):
            apart -= basis @ (basis.T @ apart)
        following, r = np.linalg.qr(apart)
        following = following[:, np.abs(np.diag(r)) > 1e-14]
        if not following.shape[1]:
            break
        basis, images = np.hstack([basis, following]), np.hstack([images, apply(following)])
    return values[:k], best[:, :k]


def spectral(centroids: DataFrame, k: int, gamma: float = 0.1, seed: int = 0, max_mb: int = 512) -> tuple[DataFrame, DataFrame]:
    """(mapping primary to func, functional centroids): spectral clustering of the centroids by their affinity exp(-gamma d^2).

    The affinity matrix is only multiplied with, on the executors. The centroids and the Lanczos vectors (rows x 7 (k + 8)) are held by the driver, and broadcast block by block, up to ``max_mb``;
    beyond, a ValueError: centroids are the result of a clustering and bounded by its k.
    """
    spark = centroids.sparkSession
    n, width = centroids.count(), len(centroids.select("vec").first()["vec"])
    if n * (width + 14 * (k + 8)) * 8 > max_mb << 20:
        raise ValueError(f"{n} centroids need more than {max_mb} MB; raise max_mb")
    got = sorted((r["cluster"], r["vec"]) for r in centroids.select("cluster", "vec").collect())
    x = np.array([g[1] for g in got], float)
    times = _affinity_products(centroids, x, gamma)
    s = 1 / np.sqrt(times(np.ones((n, 1)))[:, 0])
    _, vectors = leading_vectors(times, s, k, seed)
    e = vectors * s[:, None]
    c = lloyd(e, k, np.random.default_rng(seed))
    label = np.concatenate([((e[i : i + 4096, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, n, 4096)])
    mapping = spark.createDataFrame([(int(g[0]), int(y)) for g, y in zip(got, label, strict=True)], "primary int, func int")
    return mapping, functional_means(centroids, mapping)


def functional_means(centroids: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cluster, vec): mean of the member centroids of each functional cluster."""
    from .encode import centroid_mean

    return centroid_mean(centroids.join(mapping, centroids["cluster"] == mapping["primary"]), "func").select(F.col("func").alias("cluster"), "vec")


def layout(rows: DataFrame, metadata: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Two plot coordinates for each row (principal components), with metadata columns."""
    out, _ = principal_components(rows, 2, scale=False)
    flat = out.select(*[c for c in out.columns if c != "vec"], F.get("vec", F.lit(0)).alias("x"), F.coalesce(F.get("vec", F.lit(1)), F.lit(0.0)).alias("y"))
    return flat if metadata is None else flat.join(metadata, key, "left")
