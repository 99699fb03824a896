"""URL filters: a blocked Bloom filter of listed keys in front of an exact hash join.

A listed key is a canonical host and path, ``host/path``; it fits its host and all subdomains if the URL's path starts
with its path. A URL's candidate keys are its host's suffixes after dots that are as long as some listed host, each with the beginnings of its path
that are as long as some listed path; so their number follows the list, not the URL. Candidates of distinct (host, path) go through the filter inside one Arrow-batched pass; the few possible hits are joined exactly with
the listed keys, which removes false positives, and the longest key gives the verdict (equal lengths: the longer
host). URLs that no key fits get the default verdict.

The filter is built from partitions' blocks, merged by block, and never exceeds ``max_filter_mb``: beyond that many keys it
only lets more false positives through to the join, and results stay the same. Spark broadcasts the listed keys only
under its own size threshold; else the join shuffles, and adaptive execution splits hot keys.

Rows meet the verdicts of their (host, path) at the end, so pages may have columns of any type.

Null URLs and URLs without ``://`` have an empty host and path and so fit no key. Repeated rows stay repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import build, maybe

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict): the contract's rules.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def parse_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path of each url."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def hash_keys(keys: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))


def build_filter(keys: DataFrame, n_keys: int, bits_per_key: int = 16, max_filter_mb: int = 64) -> np.ndarray:
    """The filter of a table with one string column ``key``; its size is bounded by ``max_filter_mb``."""
    return build(keys.select("key"), n_keys, lambda c: hash_keys(c.to_pylist()), bits_per_key, max_filter_mb)


def candidates(host: str, path: str, hosts: list[int], paths: list[int]) -> list[str]:
    """Keys that could fit: host suffixes at dots and beginnings of the path, each of a listed length."""
    n = len(host)
    tails = [host[n - k :] for k in hosts if 0 < k <= n and (k == n or host[n - k - 1] == ".")]
    heads = [path[:k] for k in paths if k <= len(path)] if tails else []
    return [t + "\0" + h for t in tails for h in heads]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_filter_mb: int = 64) -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict.

    ``rules``: host, path, verdict. A key listed with both verdicts blocks.
    Existing columns of those four names are replaced.
    """
    spark = pages.sparkSession
    keyed = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("__cf_v"))  # "block" > "allow"
        .select(
            F.concat("host", F.lit("\0"), "path").alias("__cf_key"), F.concat("host", "path").alias("__cf_rule"), "__cf_v",
            (F.length("host") + F.length("path")).alias("__cf_len"), F.length("host").alias("__cf_hlen"), F.length("path").alias("__cf_plen"),
        )
    )
    lengths = keyed.groupBy("__cf_hlen", "__cf_plen").count().collect()  # pairs of lengths that occur: their number is bounded by what hosts and paths may have
    hosts, paths = sorted({r["__cf_hlen"] for r in lengths}), sorted({r["__cf_plen"] for r in lengths})
    bloom = spark.sparkContext.broadcast(
        build_filter(keyed.select(F.col("__cf_key").alias("key")), sum(r["count"] for r in lengths), max_filter_mb=max_filter_mb)
    )

    def hits(hs: pa.Array, ps: pa.Array) -> pa.Array:
        each = [candidates(h, p, hosts, paths) for h, p in zip(hs.to_pylist(), ps.to_pylist(), strict=True)]
        flat = [k for x in each for k in x]
        keep = maybe(bloom.value, hash_keys(flat)) if flat else np.zeros(0, bool)
        ends = np.cumsum([len(x) for x in each], dtype=np.int64)
        held = np.concatenate([[0], np.cumsum(keep)])
        offsets = np.concatenate([[0], held[ends]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([k for k, y in zip(flat, keep, strict=True) if y], pa.string()))

    hits.__annotations__ = {"hs": pa.Array, "ps": pa.Array, "return": pa.Array}
    base = parse_urls(pages.drop("host", "path", "rule", "verdict"), url)
    own = base.columns
    found = base.select("host", "path").distinct().withColumn("__cf_key", F.explode(F.arrow_udf(hits, "array<string>")("host", "path")))
    best = found.join(keyed, "__cf_key").groupBy("host", "path").agg(
        F.max(F.struct("__cf_len", "__cf_hlen", "__cf_rule", "__cf_v")).alias("__cf_best")
    )
    verdicts = best.select(F.struct("host", "path").alias("__cf_on"), "__cf_best")
    same = (F.col("host") == F.col("__cf_on.host")) & (F.col("path") == F.col("__cf_on.path"))
    return base.join(verdicts, same, "left").select(
        *[F.col(f"`{c}`") for c in own], F.col("__cf_best.__cf_rule").alias("rule"), F.coalesce("__cf_best.__cf_v", F.lit(default)).alias("verdict")
    )


def op3(pages: DataFrame) -> DataFrame:
    """The contract's query: every page, by its url alone."""
    return judge(pages.select("page_id", "url"), rules_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rhost, rpath, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(v, length(rhost || rpath)) AS v
  FROM p JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
