"""Filters, top-k, sampling and set operations on clonotypes and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURE = "Failure"


def qc_filter(clonotypes: DataFrame, cdr3: str = "cdr3", least: int = 10) -> DataFrame:
    """CDR3 of at least ``least`` residues, from C to F, without stop codon."""
    c = F.col(cdr3)
    return clonotypes.where((F.length(c) >= least) & c.startswith("C") & c.endswith("F") & ~c.contains("*"))


def drop_failures(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose value isn't the failure mark; nulls stay."""
    return rows.where(~F.col(column).eqNullSafe(FAILURE))


def top_clones(clonotypes: DataFrame, n: int = 10_000, by: tuple = ("sample",), seq: str = "full_seq", freq: str = "freq", order: str = "row_id", drop_failed: bool = True) -> DataFrame:
    """The ``n`` most abundant rows of each sample; ties by row order; null and NaN frequencies last."""
    rows = drop_failures(clonotypes, seq) if drop_failed else clonotypes
    f = F.nanvl(F.col(freq).cast("double"), F.lit(None).cast("double"))
    w = Window.partitionBy(*by).orderBy(f.desc_nulls_last(), F.col(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def distinct_sequences(clonotypes: DataFrame, n: int = 10_000, **kw) -> DataFrame:
    """Union of the samples' top sequences without repeats."""
    seq = kw.get("seq", "full_seq")
    return top_clones(clonotypes, n, **kw).select(seq).distinct()


def failure_rate(rows: DataFrame, column: str = "full_seq") -> DataFrame:
    """Percentage of failed rows."""
    return rows.agg((F.lit(100.0) * F.avg(F.col(column).eqNullSafe(FAILURE).cast("double"))).alias("failure_pct"))


def split_by_label(encoded: DataFrame, names: dict[int, str] | None = None) -> dict[str, DataFrame]:
    """One table for each label, renamed dataset included; other labels are dropped."""
    names = names or {0: "_Normal", 1: "_Tumor"}
    return {s: encoded.where(F.col("label") == y).withColumn("dataset", F.concat("dataset", F.lit(s))) for y, s in names.items()}


def relabel(encoded: DataFrame, labels: DataFrame) -> DataFrame:
    """``encoded`` with the labels of (sample, label); samples that it lacks get null."""
    return encoded.drop("label").join(labels.select("sample", "label"), "sample", "left")


def merge_datasets(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def metadata_join(rows: DataFrame, metadata: DataFrame, key: str = "sample") -> DataFrame:
    """Inner join; of repeated metadata keys one row counts, the least by all its columns."""
    others = [c for c in metadata.columns if c != key]
    one = metadata.groupBy(key).agg(F.min(F.struct(*others)).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in others]) if others else metadata.distinct()
    return rows.join(one, key, "inner")


def common_features(tables: list[DataFrame]) -> list[str]:
    """Columns that all tables have, in numeric order of their trailing number, else of their name."""
    shared = set(tables[0].columns).intersection(*[t.columns for t in tables[1:]])
    import re

    return sorted(shared, key=lambda c: (re.sub(r"\d+$", "", c), int(m[0]) if (m := re.search(r"\d+$", c)) else -1))


def project_common(tables: list[DataFrame], keys: tuple = ("id",)) -> list[DataFrame]:
    """Each table cut to its ``keys`` and the features that all tables have, in one order (``common_features``)."""
    shared = [c for c in common_features(tables) if c not in keys]
    return [t.select(*keys, *shared) for t in tables]


def downsample(rows: DataFrame, n: int, key: str = "sample", seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a seeded MD5 of the key: the same ones at every run.

    Rows are counted by the first four digits; only the digits' group in which the n-th row lies is cut, the groups before it stay whole. Rows come in that order.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    per = {r["g"]: r["count"] for r in hashed.groupBy(F.substring("_h", 1, 4).alias("g")).count().collect()}  # at most 65,536 rows, and one of null keys
    left, edge = n, None
    for g in sorted(per, key=lambda g: g or "g"):
        if left < per[g]:
            edge = g
            break
        left -= per[g]
    if edge is None and sum(per.values()) <= n:
        return hashed.orderBy("_h", key).drop("_h")
    group = F.coalesce(F.substring("_h", 1, 4), F.lit("g"))  # null keys come last
    last = hashed.where(group == (edge or "g")).orderBy("_h", key).limit(left)
    return hashed.where(group < (edge or "g")).unionByName(last).orderBy("_h", key).drop("_h")


def datasets_by_size(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").count().orderBy(F.desc("count"), "dataset")


def label_of_last(pairs: DataFrame, key: str, label: str, position: str) -> DataFrame:
    """(key, label): of repeated keys the row with the greatest position counts."""
    return pairs.groupBy(key).agg(F.max_by(label, position).alias(label))
