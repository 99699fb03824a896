"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, crosstok, ctw, merkle, minhash, mixing, mpeg, quality, secret_scan, suffix, topk, urlfilter

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(_table(spark, sf_dir, "documents"), words=3, similarity=0.85)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op3(_table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(_table(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_columns(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def decoded_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: decoding gives every text back."""
    return op4_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: the edited texts."""
    return op7_merkle_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the payload that is read back."""
    return op10_mpeg_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


_DECODED = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"
_EDITED = """
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '') DESC) AS r FROM documents)
SELECT a.doc_id, length(a.t) AS n_chars, sha256(left(a.t, length(a.t) - length(a.t) // 3) || left(b.t, length(a.t) // 3)) AS edited_sha256
FROM o a JOIN o b ON b.r = CASE WHEN a.r = (SELECT max(r) FROM o) THEN 1 ELSE a.r + 1 END"""
_PAYLOAD = r"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, greatest(576, (n + 575) // 576 * 576) AS m FROM s)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(encode(t) || repeat('\xFF'::BLOB, m - n)) AS payload_sha256 FROM p"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_secret_scan, op2_minhash_dedup, op3_url_filter, op4_byte_bpe, op5_ctw_score, op6_pivotal_mix, op7_merkle_fingerprint, op8_quality_qda, op9_suffix_dedup, op10_mpeg_audio,
        op11_collocations, op12_cross_tokenizer, op13_threshold_topk, decoded_digests, edited_digests, payload_digests,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_dedup": minhash.ORACLE, "op3_url_filter": urlfilter.ORACLE, "op11_collocations": collocations.ORACLE, "op13_threshold_topk": topk.ORACLE,
        "decoded_digests": _DECODED, "edited_digests": _EDITED, "payload_digests": _PAYLOAD,
    }
