"""A two-dimensional layout from the graph of near neighbours.

Each row's k nearest neighbours get weights that fall with the distance beyond the nearest one, at a rate that gives every row the same total; the two directions of a link are joined
as a fuzzy union. Positions start at the first two principal components and move in rounds: linked rows attract, seeded random rows repel. A round is one job:
every task moves its own rows against the positions of the round before, which are broadcast (two numbers a row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..state import checkpointed
from .metrics import principal_components
from .neighbors import knn

#: Most rows: their positions are broadcast in each round.
MOST = 4_000_000
#: Fixed values of the published method: the curve 1 / (1 + A d^(2 B)) for a least distance of 0.1.
A, B = 1.577, 0.895


def rates(distances: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sorted distances: the nearest positive one, and the scale at which exp(-(d - nearest) / scale) sums to log2 of their number."""
    goal = np.log2(distances.shape[1])
    nearest = np.where(distances > 0, distances, np.inf).min(axis=1)
    nearest = np.where(np.isfinite(nearest), nearest, 0)
    beyond = np.maximum(distances - nearest[:, None], 0)
    mean = np.maximum(distances.mean(axis=1), 1e-12)
    lo, hi = np.full(len(mean), -40.0), np.full(len(mean), 40.0)
    for _ in range(steps):
        mid = (lo + hi) / 2
        high = np.exp(-beyond / (mean * 2.0**mid)[:, None]).sum(axis=1) > goal
        lo, hi = np.where(high, lo, mid), np.where(high, mid, hi)
    return nearest, np.maximum(mean * 2.0**hi, 1e-3 * mean)


def fuzzy_graph(rows: DataFrame, k: int = 15) -> DataFrame:
    """(i, j, w): weights of the links of near rows (id, vec), both directions, each link once a direction."""
    edges = knn(rows, rows, k, exclude_self=True)
    per = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("dist", "j"))).alias("e"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for n in p["d"].map(len).unique():
                part = p[p["d"].map(len) == n]
                d = np.array(part["d"].tolist())
                nearest, scale = rates(d)
                w = np.exp(-np.maximum(d - nearest[:, None], 0) / scale[:, None])
                yield pd.DataFrame({"i": np.repeat(part["i"].to_numpy(), n), "j": np.concatenate(part["j"].to_numpy()), "w": w.ravel()})

    one = per.select("i", F.transform("e", lambda x: x["dist"]).alias("d"), F.transform("e", lambda x: x["j"]).alias("j")).mapInPandas(run, f"i {kind}, j {kind}, w double")
    link = one.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("s"), F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(F.lit(0.0)).alias("p"))
    w = (F.col("s") - F.col("p")).alias("w")
    return link.select(F.col("a").alias("i"), F.col("b").alias("j"), w).unionByName(link.select(F.col("b").alias("i"), F.col("a").alias("j"), w))


def moved(place: np.ndarray, own: np.ndarray, near: list[np.ndarray], weights: list[np.ndarray], rate: float, negatives: int, seed: int) -> np.ndarray:
    """New positions of the rows ``own``, each pulled by its neighbours and pushed by as many random rows for each unit of weight."""
    out = np.empty((len(own), 2))
    for k, (i, js, w) in enumerate(zip(own.tolist(), near, weights, strict=True)):
        gap = place[i] - place[js]
        d2 = (gap * gap).sum(axis=1)
        pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0) * w
        step = np.clip(pull[:, None] * gap, -4, 4).sum(axis=0)
        other = np.random.default_rng((seed, i)).integers(0, len(place), negatives * len(js))
        gap = place[i] - place[other]
        d2 = (gap * gap).sum(axis=1)
        push = np.where(other != i, 2 * B / ((0.001 + d2) * (1 + A * d2**B)), 0) * (w.sum() / len(js))
        out[k] = place[i] + rate * (step + np.clip(push[:, None] * gap, -4, 4).sum(axis=0)) / max(w.sum(), 1)
    return out


def neighbour_layout(rows: DataFrame, k: int = 15, rounds: int = 80, negatives: int = 5, seed: int = 0, most: int = MOST) -> DataFrame:
    """(id, x, y) of ``rows`` (id unique, vec). More than ``most`` rows are a ValueError; rows without neighbours (a table of one) stay where they start."""
    spark = rows.sparkSession
    rows = checkpointed(rows.select("id", F.col("vec").cast("array<double>").alias("vec")))
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows; positions of {most} at most are broadcast")
    kind = dict(rows.dtypes)["id"]
    if n < 3:
        flat = [(r["id"], float(at), 0.0) for at, r in enumerate(rows.orderBy("id").collect())]
        return spark.createDataFrame(flat, f"id {kind}, x double, y double")
    start, _ = principal_components(rows, 2, scale=False)
    first = start.select("id", F.get("vec", F.lit(0)).alias("x"), F.coalesce(F.get("vec", F.lit(1)), F.lit(0.0)).alias("y")).toPandas().sort_values("id", ignore_index=True)
    place = first[["x", "y"]].to_numpy()
    # Rounded, so that the order of sums, which depends on the partitions, doesn't matter.
    place = np.round((place - place.mean(axis=0)) * (10 / max(np.abs(place).max(), 1e-12)), 6)
    ids = spark.createDataFrame(pd.DataFrame({"id": first["id"], "at": np.arange(n)}), f"id {kind}, at long")
    graph = fuzzy_graph(rows, min(k, n - 1)).join(ids.select(F.col("id").alias("i"), F.col("at").alias("p")), "i").join(ids.select(F.col("id").alias("j"), F.col("at").alias("q")), "j")
    per = checkpointed(graph.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("q", "w"))).alias("e")).select("p", F.transform("e", lambda x: x["q"]).alias("q"), F.transform("e", lambda x: x["w"]).alias("w")))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 500)))
    per = per.repartition(parts, "p").persist()
    try:
        for turn in range(rounds):
            shared = spark.sparkContext.broadcast(place)

            def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    own = b.column(0).to_numpy()
                    lists = lambda c: [x.values.to_numpy() for x in c]
                    got = moved(shared.value, own, lists(b.column(1)), lists(b.column(2)), 1 - turn / rounds, negatives, seed * 1_000_003 + turn)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["p", "x", "y"])

            got = per.mapInArrow(run, "p long, x double, y double").toArrow()
            place = place.copy()
            place[got.column("p").to_numpy()] = np.stack([got.column("x").to_numpy(), got.column("y").to_numpy()], axis=1)
            shared.destroy()
    finally:
        per.unpersist()
    return spark.createDataFrame(pd.DataFrame({"id": first["id"], "x": place[:, 0], "y": place[:, 1]}), f"id {kind}, x double, y double")
