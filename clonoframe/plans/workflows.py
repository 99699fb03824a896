"""The end-to-end flows, from files to tables: reconstruct sequences, build a space, encode datasets, compare them, correct them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import default_encoder, encode_column
from ..operators import correct, encode, metrics, preprocess, reconstruct, report, space
from ..sources import repertoire


@dataclass
class EncodeConfig:
    """Input folders and options of an encoding run; the folders are checked at once."""

    dataset: str
    neg_dir: str | None = None
    pos_dir: str | None = None
    unlabeled_dir: str | None = None
    drop_failures: bool = True
    top: int | None = None
    #: What is encoded: full_seq or cdr3.
    column: str = "full_seq"
    groups: list = field(init=False)

    def __post_init__(self):
        self.groups = repertoire.check_groups(self.neg_dir, self.pos_dir, self.unlabeled_dir)


def assert_finite(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """``rows``; a NaN or infinite entry of ``vec`` fails the job when it is read."""
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.when(bad, F.raise_error(F.lit(f"{vec} has entries that aren't finite")).cast("boolean")).otherwise(F.lit(True)))


def build_space(sequences: DataFrame, k: int, functional: int, encoder: Callable | None = None, gamma: float = 0.1, seed: int = 0, column: str = "full_seq") -> dict[str, DataFrame]:
    """assigned, centroids, mapping, functional of a table with a column ``sequence``. Sequences that can't be encoded (unknown residues, too long) don't count.

    ``column``: what the sequences are; it chooses the default encoder, as in ``encode_dataset``.
    """
    rows = assert_finite(encode_column(sequences.select("sequence"), "sequence", encoder or default_encoder(column)).where("vec is not null"))
    assigned, centroids, _ = space.kmeans(rows, k, seed=seed)
    mapping, means = space.spectral(centroids, functional, gamma, seed)
    return {"assigned": assigned, "centroids": centroids, "mapping": mapping, "functional": means}


def sequence_labels(sequences: DataFrame, k: int, encoder: Callable | None = None, seed: int = 0, column: str = "full_seq") -> tuple[DataFrame, DataFrame]:
    """(sequence, cluster) for each distinct sequence that can be encoded, and the centroids: encoded, then k-means."""
    known = encode_column(sequences.select("sequence").where("sequence is not null").distinct(), "sequence", encoder or default_encoder(column))
    rows = assert_finite(known.where("vec is not null"))
    assigned, centroids, _ = space.kmeans(rows, k, seed=seed)
    return assigned.select("sequence", "cluster"), centroids


def align_all(datasets: dict[str, DataFrame], **kw) -> dict[str, DataFrame]:
    """The panorama of any number of datasets' features by name (``correct.panorama``'s options)."""
    names = sorted(datasets)
    out, _ = correct.panorama([datasets[n] for n in names], **kw)
    return dict(zip(names, out, strict=True))


def reconstruct_files(spark: SparkSession, paths: str | list[str], v_fasta: str, j_fasta: str, out: str | None = None, columns: dict[str, str] | None = None, compat: bool = False, overwrite: bool = False) -> DataFrame:
    """Tables with V, J and CDR3 columns to tables with ``full_seq``: germline segments from FASTA files, all other columns kept, written as TSV if ``out`` is given.

    ``columns``: the names of v, j and cdr3 in the files.
    """
    names = {"v": "v", "j": "j", "cdr3": "cdr3"} | (columns or {})
    rows = repertoire.read_table(spark, paths)
    if missing := [c for c in names.values() if c not in rows.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    segments = repertoire.read_fasta(spark, v_fasta, "V").unionByName(repertoire.read_fasta(spark, j_fasta, "J"))
    got = reconstruct.full_sequences(rows, segments, names["v"], names["j"], names["cdr3"], compat)
    if out is None:
        return got
    repertoire.write_tsv(got, out, overwrite)
    return spark.read.csv(out, sep="\t", header=True)


def encode_dataset(spark: SparkSession, config: EncodeConfig, centroids: DataFrame, encoder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(encoded, samples): long-form counts and sums with labels, and every sample, also those without usable rows.

    Failed rows go before anything is encoded; sequences that can't be encoded (unknown residues, too long) don't count.
    """
    encoded, samples = [], []
    for folder, label in config.groups:
        paths = repertoire.list_files(spark, folder)
        rows = repertoire.read_repertoires(spark, paths, config.dataset)
        if config.top is not None:
            rows = preprocess.top_clones(rows, config.top, drop_failed=config.drop_failures)
        usable = preprocess.drop_failures(rows, "full_seq") if config.drop_failures else rows
        vectors = encode_column(usable, config.column, encoder or default_encoder(config.column)).where("vec is not null")
        encoded.append(encode.encode_samples(vectors, centroids, by=("dataset", "sample"), drop_failed=config.drop_failures).withColumn("label", F.lit(label).cast("int")))
        samples.append(repertoire.samples_of(spark, paths, label, config.dataset))
    return preprocess.merge_datasets(*encoded), preprocess.merge_datasets(*samples)


def dataset_features(encoded: DataFrame, samples: DataFrame, mapping: DataFrame | None, width: int, k: int, mode: str = "concatenate") -> DataFrame:
    """(id, vec) of one dataset's samples."""
    return encode.functional_features(encoded, samples, mapping, width, k, mode).select(F.col("sample").alias("id"), "vec")


def compare(features: dict[str, DataFrame], which: dict[str, Callable] = metrics.METRICS) -> DataFrame:
    """One row of metrics for every two datasets, in the order of their names."""
    tables = [report.metric_table(features[a], features[b], a, b, which) for a, b in combinations(sorted(features), 2)]
    return preprocess.merge_datasets(*tables)


def correct_and_compare(source: DataFrame, target: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """The comparison of all correction methods on two datasets' features."""
    return report.method_table(source, target, options)
