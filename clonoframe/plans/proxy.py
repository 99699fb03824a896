"""The engine's tables, taken from the driver's tables: events are clonotypes, users are samples, embeddings are encoded sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.encode import centroid_mean, dense


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def clonotypes(spark: SparkSession, d: str) -> DataFrame:
    """sample, row_id, freq, v, vec_id, cdr3, full_seq of every event."""
    n = table(spark, d, "embeddings").count()
    e = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("sample"), e.alias("row_id"), F.col("value").alias("freq"), F.col("event_type").alias("v"), (e % F.lit(n)).alias("vec_id"),
        F.concat(F.when(e % 3 == 0, "C").otherwise("A"), F.repeat(F.lit("A"), (e % 15).cast("int")), F.when(e % 5 == 0, "*").otherwise(""), F.when(e % 2 == 0, "F").otherwise("W")).alias("cdr3"),
        F.when(e % 17 == 0, "Failure").otherwise(F.concat("event_type", F.lit("-"), (e % 50).cast("string"))).alias("full_seq"),
    )


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroid_mean(embeddings(spark, d)).select(F.col("label").alias("cluster"), "vec")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec): the sum of values of each event type, for each user."""
    ev = table(spark, d, "events")
    kinds = ev.select("event_type").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))
    k = kinds.count()
    enc = ev.join(kinds, "event_type").groupBy(F.col("user_id").alias("sample"), "cluster").agg(F.count(F.lit(1)).alias("diversity"), F.sum("value").alias("abundance"))
    return dense(enc, ev.select(F.col("user_id").alias("sample")), k).select(F.col("sample").alias("id"), F.col("abundance").alias("vec"))


def two_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = profiles(spark, d)
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


def vector_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = embeddings(spark, d).select(F.col("vec_id").alias("id"), "label", "vec")
    return e.where("label % 2 = 0").select("id", "vec"), e.where("label % 2 = 1").select("id", "vec")


EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CLON = (
    "clon AS (SELECT user_id AS sample, event_id AS row_id, value AS freq, event_type AS v, event_id % (SELECT count(*) FROM embeddings) AS vec_id, "
    "CASE WHEN event_id % 3 = 0 THEN 'C' ELSE 'A' END || repeat('A', CAST(event_id % 15 AS INTEGER)) || CASE WHEN event_id % 5 = 0 THEN '*' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'W' END AS cdr3, "
    "CASE WHEN event_id % 17 = 0 THEN 'Failure' ELSE event_type || '-' || CAST(event_id % 50 AS VARCHAR) END AS full_seq FROM events)"
)
CENT = (
    "cent AS (SELECT label AS cluster, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM "
    "(SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb) GROUP BY 1, 2) GROUP BY 1)"
)
NEAR = (
    "dist AS (SELECT vec_id, cluster, list_distance(v, c) AS d FROM emb, cent), "
    "near AS (SELECT vec_id, cluster, d * d AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM dist) WHERE r = 1)"
)
ENC = (
    f"{EMB}, {CLON}, {CENT}, {NEAR}, enc AS (SELECT sample, cluster, count(*) AS diversity, sum(freq) AS abundance "
    "FROM clon JOIN near USING (vec_id) WHERE full_seq <> 'Failure' GROUP BY 1, 2)"
)
DENSE = (
    f"{ENC}, grid AS (SELECT s.sample, k.cluster, coalesce(diversity, 0) AS diversity, coalesce(abundance, 0.0) AS abundance "
    "FROM (SELECT DISTINCT user_id AS sample FROM events) s CROSS JOIN (SELECT unnest(range(10)) AS cluster) k LEFT JOIN enc ON enc.sample = s.sample AND enc.cluster = k.cluster)"
)
PROF = (
    "prof AS (SELECT u.id, t.event_type AS pos, coalesce(sum(value), 0.0) AS x FROM (SELECT DISTINCT user_id AS id FROM events) u "
    "CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.id AND e.event_type = t.event_type GROUP BY 1, 2), "
    "pv AS (SELECT id, list(x ORDER BY pos) AS v FROM prof GROUP BY 1), a AS (SELECT * FROM pv WHERE id % 2 = 0), b AS (SELECT * FROM pv WHERE id % 2 = 1)"
)
PAIR_LONG = (
    f"{PROF}, nrm AS (SELECT id, pos, x, sum(x) OVER (PARTITION BY id) AS s FROM prof), "
    "pr AS (SELECT p.id AS i, q.id AS j, p.x / p.s AS p, q.x / q.s AS q, p.x / (p.s + 1e-9) AS pe, q.x / (q.s + 1e-9) AS qe "
    "FROM nrm p JOIN nrm q ON p.pos = q.pos WHERE p.id % 2 = 0 AND q.id % 2 = 1)"
)
VSIDES = f"{EMB}, a AS (SELECT vec_id AS id, v FROM emb WHERE label % 2 = 0), b AS (SELECT vec_id AS id, v FROM emb WHERE label % 2 = 1)"
