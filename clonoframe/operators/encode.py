"""Nearest-centroid assignment and the encoding of samples into cluster counts, sums and features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

#: Centroids are broadcast up to this size; larger sets go through blocks.
BROADCAST_BYTES = 64 << 20


def _bytes(centroids: DataFrame) -> int:
    return centroids.select((F.count(F.lit(1)) * F.max(F.size("vec")) * 8).alias("b")).first()["b"] or 0


def nearest_centroid(rows: DataFrame, centroids: DataFrame, vec: str = "vec", key: str | None = None) -> DataFrame:
    """``rows`` with ``cluster`` and ``d2`` of the nearest centroid (cluster, vec); ties go to the lowest cluster.

    The centroids' size is checked: up to BROADCAST_BYTES they are broadcast and rows aren't shuffled. Beyond, blocks of rows
    meet blocks of centroids by ``key``, a unique column of ``rows``, and the least of each row wins.
    """
    spark = rows.sparkSession
    if _bytes(centroids) <= BROADCAST_BYTES:
        got = sorted((r["cluster"], r["vec"]) for r in centroids.select("cluster", "vec").collect())
        shared = spark.sparkContext.broadcast((np.array([g[0] for g in got]), np.array([g[1] for g in got], float)))

        def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ids, c = shared.value
            own = (c * c).sum(axis=1)
            for col in it:
                x = blocks.matrix(col)
                if not len(x):
                    yield pa.array([], pa.struct([("cluster", pa.int32()), ("d2", pa.float64())]))
                    continue
                best = np.concatenate([(own - 2 * x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)])
                d = x - c[best]
                yield pa.StructArray.from_arrays([pa.array(ids[best].astype(np.int32)), pa.array((d * d).sum(axis=1))], ["cluster", "d2"])

        run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
        near = F.arrow_udf(run, "struct<cluster:int,d2:double>")
        return rows.withColumn("_near", near(F.col(vec).cast("array<double>"))).select(*rows.columns, "_near.cluster", "_near.d2")
    if key is None:
        raise ValueError("so many centroids need a unique key of the rows")

    kind = "long" if dict(rows.dtypes)[key] in ("bigint", "int") else "string"

    def least(ids, x, cs, c):
        cs = [int(i) for i in cs]
        own = (c * c).sum(axis=1)
        order = np.argsort(cs)
        best = order[(own[order] - 2 * x @ c[order].T).argmin(axis=1)]
        d = x - c[best]
        return [(i, int(cs[b]), float(v)) for i, b, v in zip(ids, best, (d * d).sum(axis=1), strict=True)]

    part = blocks.cells(
        rows.select(F.col(key).alias("id"), F.col(vec).alias("vec")), centroids.select(F.col("cluster").cast("long").alias("id"), "vec"),
        least, f"id {kind}, cluster int, d2 double", id_type=kind,
    )
    best = part.groupBy("id").agg(F.min(F.struct("d2", "cluster")).alias("m")).select(F.col("id").alias(key), F.col("m.cluster").alias("cluster"), F.col("m.d2").alias("d2"))
    return rows.join(best, key)


def assign(rows: DataFrame, centroids: DataFrame, vec: str = "vec") -> DataFrame:
    """``nearest_centroid`` for rows without a unique key, with any number of centroids.

    Where centroids are too many to broadcast, distinct vectors (by the SHA-256 of their entries as text, which is exact) meet the blocks of centroids,
    and rows get their cluster by that key. Streams need the broadcast and raise ValueError beyond it.
    """
    if _bytes(centroids) <= BROADCAST_BYTES:
        return nearest_centroid(rows, centroids, vec)
    if rows.isStreaming:
        raise ValueError("a stream takes centroids up to the size of a broadcast")
    exact = F.col(vec).cast("array<double>")
    keyed = rows.withColumn("_vk", F.sha2(F.array_join(F.transform(exact, lambda x: x.cast("string")), ",", "null"), 256))
    found = nearest_centroid(keyed.groupBy("_vk").agg(F.any_value(exact).alias("vec")), centroids, key="_vk")
    return keyed.join(found.select("_vk", "cluster", "d2"), "_vk").select(*rows.columns, "cluster", "d2")


def centroid_mean(rows: DataFrame, group: str = "label", vec: str = "vec") -> DataFrame:
    """(group, vec): mean vector of each group, summed by position."""
    long = rows.select(group, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    means = long.groupBy(group, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(group, F.transform("s", lambda s: s["m"]).alias("vec"))


def count_and_sum(assigned: DataFrame, by: tuple = ("sample",), freq: str = "freq", distinct: str | None = None) -> DataFrame:
    """by, cluster, diversity (rows, or distinct values of a column), abundance (sum; nulls and NaN skipped)."""
    f = F.nanvl(F.col(freq).cast("double"), F.lit(None).cast("double"))
    n = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    return assigned.groupBy(*by, "cluster").agg(n.alias("diversity"), F.coalesce(F.sum(f), F.lit(0.0)).alias("abundance"))


def encode_samples(clonotypes: DataFrame, centroids: DataFrame, vec: str = "vec", by: tuple = ("sample",), drop_failed: bool = True) -> DataFrame:
    """Scan, nearest centroid, count and sum: one shuffle, on sample and cluster (where centroids can be broadcast; see ``assign``)."""
    from .preprocess import drop_failures

    rows = drop_failures(clonotypes, "full_seq") if drop_failed and "full_seq" in clonotypes.columns else clonotypes
    return count_and_sum(assign(rows, centroids, vec), by)


def dense(encoded: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """(sample, diversity, abundance) with arrays of length k, 0-filled; samples without rows have zeros."""
    per = encoded.groupBy("sample").agg(
        F.map_from_entries(F.collect_list(F.struct("cluster", "diversity"))).alias("_d"), F.map_from_entries(F.collect_list(F.struct("cluster", "abundance"))).alias("_a")
    )
    fill = lambda m, kind: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0).cast(kind)))
    return samples.select("sample").distinct().join(per, "sample", "left").select("sample", fill("_d", "long").alias("diversity"), fill("_a", "double").alias("abundance"))


def functional_rollup(encoded: DataFrame, mapping: DataFrame, k: int, by: tuple = ("sample",)) -> DataFrame:
    """Sums over the functional cluster of each primary one; unmapped ones and functional ids not below ``k`` are dropped."""
    m = mapping.where(F.col("func") < k).select(F.col("primary").alias("cluster"), "func")
    return encoded.join(m, "cluster").groupBy(*by, F.col("func").alias("cluster")).agg(F.sum("diversity").alias("diversity"), F.sum("abundance").alias("abundance"))


def row_normalize(encoded: DataFrame, column: str, out: str, by: tuple = ("sample",), eps: float = 1e-9) -> DataFrame:
    """Share of a row's total: x / (sum + eps)."""
    return encoded.withColumn(out, F.col(column) / (F.sum(column).over(Window.partitionBy(*by)) + F.lit(eps)))


def count_to_frequency(encoded: DataFrame, column: str, out: str, by: tuple = ("sample",)) -> DataFrame:
    """x / sum; null for a zero row."""
    return encoded.withColumn(out, F.expr(f"try_divide(cast(`{column}` as double), sum(`{column}`) over (partition by {', '.join(f'`{b}`' for b in by)}))"))


def feature_matrix(dense_rows: DataFrame, mode: str = "concatenate", log: bool = True, eps: float = 1e-9) -> DataFrame:
    """(sample, vec) of dense rows: normalised abundance (log1p) and diversity, one after the other or one alone."""
    share = lambda c: F.transform(F.col(c), lambda x: x.cast("double") / (F.aggregate(F.col(c), F.lit(0.0), lambda a, y: a + y) + F.lit(eps)))
    abundance = lambda: F.transform(share("abundance"), lambda x: F.log1p(x)) if log else share("abundance")
    if mode == "concatenate":
        vec = F.concat(abundance(), share("diversity"))
    elif mode == "abundance":
        vec = abundance()
    elif mode == "diversity":
        vec = share("diversity")
    else:
        raise ValueError(f"no mode {mode!r}")
    return dense_rows.select("sample", vec.alias("vec"))


def functional_features(encoded: DataFrame, samples: DataFrame, mapping: DataFrame | None, width: int, k: int, mode: str = "concatenate", log: bool = True) -> DataFrame:
    """Encoded samples to features: rolled up unless they are k wide already, made dense, normalised."""
    rolled = encoded if width == k or mapping is None else functional_rollup(encoded, mapping, k)
    return feature_matrix(dense(rolled, samples, k), mode, log)
