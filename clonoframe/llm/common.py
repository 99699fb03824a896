"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of the rows that one Arrow batch of ours holds on its way out.
OUT_ROWS = 512


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names. Where none is set, a local master (tests) gets one of its own; a cluster gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"/tmp/clonoframe-checkpoint-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(
    df: DataFrame,
    columns: list[str],
    row: Callable[..., tuple],
    schema: str,
    setup: Callable[[], tuple] | None = None,
) -> DataFrame:
    """Apply ``row(*values, *setup())`` to every row in Arrow batches.

    Only ``columns`` leave the JVM. Results are emitted in batches of at most OUT_ROWS rows,
    so memory follows one incoming Arrow batch, not a partition.
    """
    out_schema = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = setup() if setup else ()
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                got = [row(*v, *extra) for v in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                cols = list(zip(*got, strict=True)) if got else [[] for _ in out_schema]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema
                )

    return df.select(*columns).mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or it with underscores in front until no column has that name (in any case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


#: Words as the contracts define them: runs of bytes other than space and 0x09-0x0D.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n tasks a number that ``repartition(n, column)`` deals to it; where none is found, any number."""
    rows = spark.range(24 * n).select(F.col("id").cast("int").alias("i")).withColumn("p", F.pmod(F.hash("i"), F.lit(n)))
    found = {r["p"]: r["i"] for r in rows.groupBy("p").agg(F.min("i").alias("i")).collect()}
    return [found.get(p, p) for p in range(n)]
