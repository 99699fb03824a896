"""Readers and writers of repertoire tables and of what goes with them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import sample_name

#: Names under which a column may come; the first that a header has counts.
ALIASES = {
    "cdr3": ("aminoAcid", "cdr3", "CDR3"),
    "v": ("vMaxResolved", "v", "V"),
    "j": ("jMaxResolved", "j", "J"),
    "freq": ("count (templates/reads)", "frequencyCount", "frequencyCount (%)", "freq"),
    "full_seq": ("full_seq",),
}


def list_files(spark: SparkSession, directory: str, suffix: str = ".tsv", recursive: bool = True) -> list[str]:
    """Paths under a directory that end in ``suffix``, sorted; [] where there is no such directory. Any file system that Spark reads."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found, files = [], fs.listFiles(root, recursive)
    while files.hasNext():
        p = files.next().getPath().toString()
        if p.endswith(suffix):
            found.append(p)
    return sorted(found)


def read_manifest(spark: SparkSession, manifests: str | list[str], n: int | None = None, seed: int = 0) -> DataFrame:
    """(path, sample) of the non-blank lines of manifest files; ``n``: a seeded random subset."""
    lines = spark.read.text(manifests).select(F.trim("value").alias("path")).where("path != ''")
    return sample_files(lines.select("path", sample_name(F.col("path"), "_filt_full.tsv").alias("sample")), n, seed)


def sample_files(paths: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """``n`` of the files, by a seeded hash of the path; all if None."""
    return paths if n is None else paths.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(n)


def read_directory(spark: SparkSession, directory: str, extension: str = ".tsv", suffix_length: int = 0, n: int | None = None, seed: int = 0) -> DataFrame:
    """(path, sample) of a flat directory; the sample is the name without its last ``suffix_length`` characters."""
    rows = [(p, p.rsplit("/", 1)[-1]) for p in list_files(spark, directory, extension, recursive=False)]
    out = spark.createDataFrame(rows, "path string, name string")
    return sample_files(out.select("path", F.substring("name", F.lit(1), F.length("name") - suffix_length).alias("sample")), n, seed)


def read_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A delimited file with a header, by its extension: .csv or .tsv; else ValueError."""
    first = path if isinstance(path, str) else path[0]
    for ext, sep in ((".csv", ","), (".tsv", "\t")):
        if first.endswith(ext):
            return spark.read.csv(path, sep=sep, header=True, mode="PERMISSIVE")
    raise ValueError(f"neither .csv nor .tsv: {first}")


def source_path() -> Column:
    """The path of a row's file as ``list_files`` has it: Spark's metadata escapes signs as URLs do."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _place(path: str | Column) -> str | Column:
    """A path without its file system, by which listed paths and rows' paths meet."""
    pattern = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    return re.sub(pattern, "", path) if isinstance(path, str) else F.regexp_replace(path, pattern, "")


def literal(path: str) -> str:
    """A path whose signs stand for themselves in Spark's readers, which take patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def headers_of(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """The header of each tab-separated file; one job over all files, which takes the first line of each file's first split. An empty file has the header ``('',)``."""
    if not paths:
        return {}
    lines = spark.read.text([literal(p) for p in paths]).where("_metadata.file_block_start = 0").select(source_path().alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    first = {_place(r["path"]): r["line"] for r in lines.groupBy("path").agg(F.min_by("value", "at").alias("line")).collect()}
    return {p: tuple(c.strip().strip('"') for c in first.get(_place(p), "").lstrip("\ufeff").split("\t")) for p in paths}


def read_repertoires(spark: SparkSession, paths: list[str], dataset: str = "", aliases: dict = ALIASES, with_path: bool = False) -> DataFrame:
    """The clonotypes of repertoire files, one sample a file, by header names.

    Files are read together by header; a file without a required column (full_seq, freq) gives no rows, and its sample survives
    through ``samples_of``. NaN frequencies become null. ``with_path``: a column with the file's path, too.
    """
    headers: dict[tuple, list[str]] = {}
    for p, columns in headers_of(spark, paths).items():
        headers.setdefault(columns, []).append(p)
    parts = []
    for columns, files in headers.items():
        pick = {k: next((c for c in names if c in columns), None) for k, names in aliases.items()}
        if pick["full_seq"] is None or pick["freq"] is None:
            continue
        df = spark.read.csv([literal(f) for f in files], sep="\t", header=True, mode="PERMISSIVE")
        parts.append(df.select(
            F.lit(dataset).alias("dataset"), sample_name(source_path()).alias("sample"),
            *[(F.col(f"`{pick[k]}`") if pick[k] else F.lit(None).cast("string")).alias(k) for k in ("cdr3", "v", "j")],
            F.expr(f"nanvl(try_cast(`{pick['freq']}` as double), null)").alias("freq"), F.col(f"`{pick['full_seq']}`").alias("full_seq"),
            *([source_path().alias("path")] if with_path else []),
        ))
    if not parts:
        from ..schemas import CLONOTYPES

        none = spark.createDataFrame([], CLONOTYPES)
        return none.withColumn("path", F.lit("")) if with_path else none
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Numbered over all header groups, so that no number repeats.
    return out.select("dataset", "sample", F.monotonically_increasing_id().alias("row_id"), "cdr3", "v", "j", "freq", "full_seq", *(["path"] if with_path else []))


def samples_of(spark: SparkSession, paths: list[str], label: int | None = None, dataset: str = "") -> DataFrame:
    """(dataset, sample, label) of the files, so that samples without usable rows survive."""
    rows = [(dataset, p.rsplit("/", 1)[-1], label) for p in paths]
    return spark.createDataFrame(rows, "dataset string, sample string, label int")


def check_groups(neg_dir: str | None, pos_dir: str | None, unlabeled_dir: str | None) -> list[tuple[str, int | None]]:
    """(directory, label) of an encoding run. Labelled and unlabelled input exclude each other; ValueError without any."""
    if unlabeled_dir and (neg_dir or pos_dir):
        raise ValueError("unlabelled input can't go with labelled input")
    given = [(d, y) for d, y in ((neg_dir, 0), (pos_dir, 1), (unlabeled_dir, None)) if d]
    if not given:
        raise ValueError("no input directory")
    return given


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(sequence) one a line, repeats kept."""
    return spark.read.text(path).select(F.col("value").alias("sequence"))


def read_labelled(spark: SparkSession, path: str, column: str = "full_seq", only_sequences: bool = False) -> DataFrame:
    """(sequence[, epitope, label]) of a labelled CSV."""
    df = spark.read.csv(path, header=True)
    seq = F.col(f"`{column}`").alias("sequence")
    return df.select(seq) if only_sequences else df.select(seq, F.col("Epitope").alias("epitope"), F.col("Label").cast("int").alias("label"))


def read_fasta(spark: SparkSession, path: str, kind: str = "V") -> DataFrame:
    """(kind, ord, id, gene, seq) of a FASTA file, in the file's order; the gene is the header's second field, or the id."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''")
    head = F.element_at(F.split("value", "\n"), 1)
    body = F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s", "")
    rid = F.element_at(F.split(F.trim(head), r"\s+"), 1)
    gene = F.coalesce(F.try_element_at(F.split(rid, r"\|"), F.lit(2)), rid)
    return raw.select(F.lit(kind).alias("kind"), F.monotonically_increasing_id().alias("ord"), rid.alias("id"), gene.alias("gene"), body.alias("seq"))


def read_factors(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """Residue factors from a CSV with one row a residue (a fixed, small number)."""
    rows = spark.read.csv(path, header=True).collect()
    return {r[0]: [float(x) for x in r[1:]] for r in rows}


def read_substitutions(text: str, identifier: str) -> str:
    """The lower triangle of one block of an AAindex2 file's text; ValueError if there is none."""
    for block in text.split("//"):
        lines = block.strip().splitlines()
        if any(x.split() == ["H", identifier] for x in lines):
            at = next(i for i, x in enumerate(lines) if x.startswith("M rows"))
            return "\n".join(lines[at + 1 :])
    raise ValueError(f"no block {identifier}")


def require_model(spark: SparkSession, path: str, files: tuple[str, ...]) -> None:
    """FileNotFoundError unless a model's folder has all its files; nothing is downloaded."""
    have = {p.rsplit("/", 1)[-1] for p in list_files(spark, path, "", recursive=False)}
    if missing := [f for f in files if f not in have]:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")


def write_tsv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep="\t", header=True)


def write_encoded(encoded: DataFrame, path: str, overwrite: bool = False) -> None:
    """Encoded samples by dataset and label; an existing folder is an error unless ``overwrite``."""
    encoded.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("dataset").parquet(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """All parts and datasets under a folder, merged by name; their order doesn't matter."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def describe_encoded(encoded: DataFrame) -> DataFrame:
    """Samples, labels and clusters of each dataset."""
    return encoded.groupBy("dataset").agg(
        F.countDistinct("sample").alias("samples"), F.countDistinct("label").alias("labels"), F.countDistinct("cluster").alias("clusters")
    )


def write_scores(df: DataFrame, path: str, score: str = "score", label: str = "label") -> None:
    df.select(score, label).write.mode("errorifexists").csv(path)


def write_embeddings(rows: DataFrame, path: str, key: str = "sample", overwrite: bool = False) -> None:
    """Vectors of sequences, one folder a file (``key``). ``overwrite`` replaces the folders of the given files only; without it an existing path is an error."""
    writer = rows.write.partitionBy(key)
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)


def read_embeddings(spark: SparkSession, path: str, key: str = "sample", files: list[str] | None = None) -> DataFrame:
    """What ``write_embeddings`` wrote; of some ``files``, only their folders are read."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn(key, F.col(key).cast("string"))
    return rows if files is None else rows.where(F.col(key).isin(files))
