"""Soft clustering with diversity over any number of rows and batches, and the linear correction that follows from it.

Rows keep only their vectors. A row's memberships follow from the centroids, and from the weights of its block and batch (clusters x batches): they are computed where they
are needed and never stored. An update is one aggregation: each block's summed memberships (clusters x batches), the weighted vectors of the clusters and the objective. From
them follow new centroids, and each block's new weights against what all other blocks hold. As all blocks change at once, weights only go part of the way
(geometrically) where the whole way would raise the objective, which therefore never rises within a round. All that meets on the driver is of the size clusters x (width +
blocks x batches).
The correction is solved for each cluster from the summed memberships and membership-weighted vectors of each batch. Corrected vectors are checkpointed between
rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..state import checkpointed
from . import blocks


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(length > 0, length, 1)


@dataclass
class Memberships:
    """What memberships follow from: unit centroids, and for each block its weights (clusters x batches)."""

    centroids: np.ndarray
    weights: np.ndarray  # block, cluster, batch
    sigma: float

    def of(self, z: np.ndarray, batch: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(memberships, distances), rows by clusters."""
        d = 2 * (1 - z @ self.centroids.T)
        r = np.exp(-(d - d.min(axis=1, keepdims=True)) / self.sigma) * self.weights[block, :, batch]
        return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300), d


def starting_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Distributed k-means of (vec); empty places stay away, so there may be fewer than k."""
    model = KMeans(k=k, maxIter=25, seed=seed, featuresCol="_f").fit(rows.select(array_to_vector("vec").alias("_f")))
    return np.array([c.tolist() for c in model.clusterCenters()])


def _sums(rows: DataFrame, f: Callable, length: int, parts: int) -> np.ndarray:
    """The sum over all rows of ``f(z, z0, batch, block)``."""

    def of_batch(b: pa.RecordBatch) -> np.ndarray:
        return f(blocks.matrix(b.column(0)), blocks.matrix(b.column(1)), *(b.column(i).to_numpy().astype(np.int64) for i in (2, 3)))

    return blocks.summed(rows.select("z", "vec", "batch", "block"), of_batch, length, parts)


def ridge(o: np.ndarray, s: np.ndarray, lam: float) -> np.ndarray:
    """(cluster, batch, width) offsets of each batch from summed memberships ``o`` (cluster x batch) and weighted vectors ``s`` (cluster x batch x width).

    The regression of the vectors on an intercept and batch indicators, batches penalised by ``lam``; the intercept isn't taken off.
    """
    out = np.zeros(s.shape)
    for c in range(len(o)):
        gram = np.zeros((o.shape[1] + 1,) * 2)
        gram[0, 0], gram[0, 1:], gram[1:, 0] = o[c].sum(), o[c], o[c]
        gram[1:, 1:] = np.diag(o[c] + lam)
        right = np.vstack([s[c].sum(axis=0), s[c]])
        out[c] = np.linalg.solve(gram + 1e-12 * np.eye(len(gram)), right)[1:]
    return out


def settled(values: list[float], window: int, eps: float, signed: bool) -> bool:
    """Whether the last ``window`` values fell by less than a share ``eps`` against the ``window`` that ended one earlier."""
    if len(values) <= window:
        return False
    now, before = sum(values[-window:]), sum(values[-window - 1 : -1])
    change = before - now
    return (change if signed else abs(change)) < eps * abs(before)


@dataclass
class SoftAligned:
    """``rows``: key, batch, vec, memberships; ``trace``: the objective at the start and after each outer round; ``inner``: at the start of each round and after each of its updates."""

    rows: DataFrame
    trace: list[float]
    inner: list[list[float]]


def soft_align(
    rows: DataFrame, clusters: int | None = None, sigma: float = 0.1, theta: float = 1.0, lam: float = 1.0, tau: float = 0.0, block: float = 0.05,
    outer: int = 10, inner: int = 20, eps_inner: float = 1e-5, eps_outer: float = 1e-4, seed: int = 0, cluster_fn: Callable | None = None,
) -> SoftAligned:
    """Corrects ``rows`` (key, batch string, vec): soft clusters that hold all batches in proportion, then each cluster's batch offsets taken off.

    ``block``: the share of rows that are a block, which doesn't count itself when it is updated; rows are dealt to blocks by a seeded hash of their key. ``cluster_fn(rows, k, seed)`` gives the starting centroids of (vec).
    """
    spark = rows.sparkSession
    sizes = sorted((r["batch"], r["n"]) for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in sizes)
    k = int(clusters or min(round(total / 30), 100))
    if k < 2:
        raise ValueError("too few rows for two clusters (45 at least); give the number of clusters")
    names, share = [b for b, _ in sizes], np.array([n / total for _, n in sizes])
    of_batch = F.create_map(*[F.lit(x) for i, b in enumerate(names) for x in (b, i)])
    th = np.full(len(names), theta) * (1 - np.exp(-((share * total / (k * tau)) ** 2)) if tau > 0 else 1.0)
    n_blocks = max(1, int(np.ceil(1 / block)))
    # As many parts as their size asks for: each update is a job over them.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 4096)))
    state = rows.select("key", of_batch[F.col("batch")].alias("batch"), F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n_blocks)).cast("int").alias("block"), F.col("vec").cast("array<double>").alias("vec"))
    state = checkpointed(state.repartition(parts, "key"))
    with_z = lambda df: df.withColumn("z", _unit_column("vec"))
    now = with_z(state).persist()
    try:
        y = unit(np.asarray((cluster_fn or starting_centroids)(now.select(F.col("z").alias("vec")), k, seed)))
        k, b, d = len(y), len(names), y.shape[1]
        model = Memberships(y, np.ones((n_blocks, k, b)), sigma)

        def by_batch(r: np.ndarray, batch: np.ndarray) -> np.ndarray:
            return np.stack([r[batch == i].sum(axis=0) for i in range(b)], axis=1)

        def sums(model: Memberships) -> tuple[np.ndarray, np.ndarray, float]:
            """(block x cluster x batch) memberships, (cluster x width) weighted vectors and the objective under a model; one job."""

            def f(z, _, batch, at):
                r, dist = model.of(z, batch, at)
                per = np.zeros((n_blocks, k, b))
                for n in np.unique(at):
                    per[n] = by_batch(r[at == n], batch[at == n])
                entropy = np.where(r > 0, r * np.log(np.where(r > 0, r, 1)), 0).sum()
                return np.concatenate([per.ravel(), (r.T @ z).ravel(), [(r * dist).sum() + sigma * entropy]])

            got = _sums(now, f, n_blocks * k * b + k * d + 1, parts)
            per = got[: n_blocks * k * b].reshape(n_blocks, k, b)
            o = per.sum(axis=0)
            expected = np.outer(o.sum(axis=1), share)
            return per, got[n_blocks * k * b : -1].reshape(k, d), float(got[-1] + sigma * (o * th * np.log((o + 1) / (expected + 1))).sum())

        trace, within = [], []
        for _ in range(outer):
            per, weighted_z, value = sums(model)
            trace = trace or [value]
            own, rate = [value], 1.0
            for it in range(inner):
                rest = np.maximum(per.sum(axis=0) - per, 0)  # what all other blocks hold
                rate = min(1.0, 2 * rate)
                wanted = th * np.log((rest.sum(axis=2, keepdims=True) * share + 1) / (rest + 1))
                while True:
                    moved_weights = np.exp((1 - rate) * np.log(model.weights) + rate * wanted)
                    tried = Memberships(unit(weighted_z), moved_weights, sigma)
                    got = sums(tried)
                    if got[2] <= own[-1] or rate < 0.05:
                        break
                    rate /= 2
                if got[2] > own[-1]:
                    break  # no step that is worth its name lowers the objective any more
                model, (per, weighted_z, value) = tried, got
                own.append(value)
                if it > 3 and settled(own, 3, eps_inner, signed=False):
                    break
            within.append(own)
            trace.append(own[-1])
            o = per.sum(axis=0)
            held = model

            def weighted(z, z0, batch, at, held=held):
                r, _d = held.of(z, batch, at)
                return np.stack([r[batch == i].T @ z0[batch == i] for i in range(b)], axis=1).ravel()

            offsets = ridge(o, _sums(now, weighted, k * b * d, parts).reshape(k, b, d), lam)
            fixed = spark.sparkContext.broadcast((held, offsets))

            def move(it: Iterator[pa.RecordBatch], fixed=fixed) -> Iterator[pa.RecordBatch]:
                held, offsets = fixed.value
                for rb in it:
                    z, z0 = blocks.matrix(rb.column(4)), blocks.matrix(rb.column(3))
                    batch, at = (rb.column(i).to_numpy().astype(np.int64) for i in (1, 2))
                    if not len(batch):
                        continue
                    r, _d = held.of(z, batch, at)
                    out = z0 - np.einsum("nk,knd->nd", r, offsets[:, batch])
                    yield pa.RecordBatch.from_arrays([*rb.columns[:4], pa.array(list(out), pa.list_(pa.float64())), pa.array(list(r), pa.list_(pa.float64()))], names=["key", "batch", "block", "vec", "out", "r"])

            kind = dict(state.select("key").dtypes)["key"]
            moved = checkpointed(now.select("key", "batch", "block", "vec", "z").mapInArrow(move, f"key {kind}, batch int, block int, vec array<double>, out array<double>, r array<double>"))
            following = moved.select("key", "batch", "block", "vec", _unit_column("out").alias("z")).persist()
            now.unpersist()
            now = following
            if len(trace) > 3 and settled(trace, 1, eps_outer, signed=True):
                break
    finally:
        now.unpersist()
    back = F.array(*[F.lit(x) for x in names])
    return SoftAligned(moved.select("key", F.get(back, F.col("batch")).alias("batch"), F.col("out").alias("vec"), F.col("r").alias("memberships")), trace, within)


def _unit_column(name: str):
    from ..functions import vectors as V

    return V.l2_normalize(F.col(name))
