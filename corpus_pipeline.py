"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality: rejected documents go. 2. near-duplicates: one document of each group stays. 3. secrets are
masked in the texts. 4. sources are mixed to their target weights: rows repeat or go. 5. texts become token ids, which are decoded
again and compared with the text.
Every stage works on all that the stage before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoframe.llm import bpe, minhash, mixing, quality, secret_scan
from clonoframe.llm.common import ensure_checkpoint_dir
from clonoframe.llm.queries import RANKS


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold=None)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secret_scan.redact(docs))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding them gives the text back."""
    slim = docs.select("doc_id", "lang", "source", "n_chars", "text")
    both = bpe.round_trip(slim, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=False)
    return both.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", stage_quality),
    ("MinHash near-dedup", stage_near_duplicates),
    ("secret scans", stage_secrets),
    ("mixing sources to target weights", stage_mix),
    ("byte-level BPE encoding and decoding", stage_encode),
]

#: No SQL expresses the classifier's sums, the signatures or the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The files between them lie in the shared checkpoint folder; a stage's files go when the next one has written its own, the last ones stay."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
