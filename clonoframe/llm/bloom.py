"""Blocked Bloom filters of 64-bit keys, built on the executors and broadcast; their size is bounded by a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix

BLOCK_WORDS = 8  # of 64 bits: 512-bit blocks, one cache line
BITS_SET = 6


def block_bits(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash its block and its mask of BLOCK_WORDS words."""
    block = (mix(hashes) >> np.uint64(16)) % np.uint64(n_blocks)
    mask = np.zeros((len(hashes), BLOCK_WORDS), np.uint64)
    h = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))
    for k in range(BITS_SET):
        bit = (h >> np.uint64(9 * k)) & np.uint64(511)
        mask[np.arange(len(hashes)), (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block.astype(np.int64), mask


def build(keys: DataFrame, n_keys: int, hashed, bits_per_key: int = 16, max_filter_mb: int = 64) -> np.ndarray:
    """The filter of a table's first column, hashed by ``hashed(pa.Array)``: (blocks, words).

    Blocks are merged on the executors; at most ``max_filter_mb`` come to the driver, however many keys there are.
    """
    n_blocks = int(max(1, min(n_keys * bits_per_key // 512 + 1, max_filter_mb * 2**20 // 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, mask = block_bits(hashed(batch.column(0)), n_blocks)
            cols = [pa.array(block)] + [pa.array(mask[:, w].view(np.int64)) for w in range(BLOCK_WORDS)]
            yield pa.RecordBatch.from_arrays(cols, names=["block"] + [f"w{w}" for w in range(BLOCK_WORDS)])

    rows = (
        keys.mapInArrow(run, "block long, " + ", ".join(f"w{w} long" for w in range(BLOCK_WORDS)))
        .groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(BLOCK_WORDS)])
    )
    out = np.zeros((n_blocks, BLOCK_WORDS), np.uint64)
    got = rows.toArrow()  # at most n_blocks rows, a bounded number
    if got.num_rows:
        at = got.column("block").to_numpy()
        for w in range(BLOCK_WORDS):
            out[at, w] = got.column(f"w{w}").to_numpy().view(np.uint64)
    return out


def maybe(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    block, mask = block_bits(hashes, len(bloom))
    return ((bloom[block] & mask) == mask).all(axis=1)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def filter_of(keys: DataFrame, max_filter_mb: int = 64) -> Broadcast:
    """The broadcast filter of a table of one long column without nulls."""
    return keys.sparkSession.sparkContext.broadcast(build(keys, keys.count(), _numbers, max_filter_mb=max_filter_mb))


def passes(bloom: Broadcast, key: Column) -> Column:
    """Whether a long (not null) may be among the filter's keys; only the keys go to Python."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            yield pa.array(maybe(bloom.value, _numbers(col)))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(key)
