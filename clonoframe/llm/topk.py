"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt to blocks of about ``BLOCK``, whatever their ids are. A block sorts each dimension once. For a query its lists are read from the end that
the sign of the query's component favours, a depth at a time; rows seen for the first time are scored whole, and the block stops when the
bound of all unseen rows (the query times the values at the present depth) is below the kth score. Each query first takes a
kth score from one block (about ``BLOCK`` rows, broadcast), so that other blocks stop sooner and return only rows that can still count.
Every block meets every query; queries are streamed, so a task holds one block.

Components are floor(scale * x) as whole numbers. Scores are exact: in 53 bits where these hold them, in Python's integers beyond; a score outside of 64 bits
counts as the nearest 64-bit number. Vectors that are null, or hold null, NaN or infinite components, take no part; vectors of different widths don't meet. A
row is not matched with rows of its own id. Ties go to smaller ids, null ids last. Every row that is a query counts as one, repeated
ids too. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pa_schema

#: Rows of a block.
BLOCK = 2048
#: Depth of the first step into the lists; each further step doubles it.
FIRST = 32

OUT = "q long, query_id long, vec_id long, score long"


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(x * scale)


def fit(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type in which every inner product is exact."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2.0**53:
        return x, q
    as_int = np.frompyfunc(int, 1, 1)
    return as_int(x).astype(object), as_int(q).astype(object)


def _held(score) -> int:
    """A score, or the nearest number of 64 bits."""
    return min(max(int(np.ceil(score)) if isinstance(score, float) else int(score), -(2**63)), 2**63 - 1)


class Lists:
    """A block's rows with one sorted list a dimension."""

    def __init__(self, ids: list, rows: np.ndarray):
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in self.order]
        self.own: dict = {}
        for at, i in enumerate(self.ids):
            self.own.setdefault(i, []).append(at)
        self.rows = rows[self.order]
        self.up = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.up, axis=0)

    def search(self, rows: np.ndarray, q: np.ndarray, own, k: int, least) -> list[tuple[int, int]]:
        """(score, place) of the best k rows of at least ``least`` (None: any), by score and place, without rows of the id ``own``.

        ``rows`` are the block's in the type that ``fit`` chose. Rows lie in the order of ties.
        """
        n = len(rows)
        seen = np.zeros(n, bool)
        if own is not None:
            seen[self.own.get(own, [])] = True
        plus, minus = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        best: list[tuple[int, int]] = []
        before, depth = 0, min(FIRST, n)
        while True:
            fresh = np.zeros(n, bool)
            fresh[self.up[n - depth : n - before, plus].ravel()] = True
            fresh[self.up[before:depth, minus].ravel()] = True
            if depth == n:
                fresh[:] = True  # all lists are at their ends, as is a query of zeros
            at = np.flatnonzero(fresh & ~seen)
            seen[at] = True
            score = rows[at] @ q
            if least is not None:
                at, score = at[score >= least], score[score >= least]
            if len(at) > k and score.dtype != object:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                at, score = at[score >= edge], score[score >= edge]
            best = sorted([*best, *((_held(s), int(a)) for s, a in zip(score, at, strict=True))], key=lambda e: (-e[0], e[1]))[:k]
            if depth == n:
                return best
            bound = (self.values[n - depth, plus] * q[plus]).sum() + (self.values[depth - 1, minus] * q[minus]).sum()
            if (len(best) == k and best[-1][0] > _held(bound)) or (least is not None and least > bound):
                return best
            before, depth = depth, min(2 * depth, n)


def kth(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[float | None]:
    """For each query the kth score within some rows, or None where there are fewer; scores that 53 bits can't hold give None."""
    if not len(rows) or rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) >= 2.0**53:
        return [None] * len(q)
    out = []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ rows.T
        s[own[i : i + 256, None] == ids] = -np.inf
        edge = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) >= k else np.full(len(s), -np.inf)
        out += [None if e == -np.inf else float(e) for e in edge]
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=float).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def search(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows; all where there are fewer."""
    spark = rows.sparkSession
    v = F.transform(F.col(f"`{vec}`"), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_q")).where(F.col("vec").isNotNull() & good)
    # A row's own number keeps repeated ids apart and deals them evenly.
    slim = slim.select("id", "vec", "is_q", F.size("vec").alias("width"), F.monotonically_increasing_id().alias("at"))
    n_blocks = max(1, -(-slim.count() // block))
    slim = slim.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(n_blocks)).cast("int"))
    seed: dict[int, tuple] = {}
    for r in slim.where("block = 0").select("id", "vec", "width").collect():
        seed.setdefault(r["width"], []).append((r["id"], r["vec"]))
    seed = {w: (np.array([np.nan if i is None else i for i, _ in s]), whole(np.array([x for _, x in s], float).reshape(len(s), w), scale)) for w, s in seed.items()}
    shared = spark.sparkContext.broadcast(seed)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, ids = b.column(3).to_numpy(zero_copy_only=False), np.array([np.nan if i is None else i for i in b.column(0).to_pylist()], float)
            least: list = [None] * b.num_rows
            for w in np.unique(width):
                if w in shared.value:
                    mine = np.flatnonzero(width == w)
                    q = whole(_matrix(b.column(1).take(pa.array(mine))), scale)
                    for i, e in zip(mine, kth(shared.value[w][1], shared.value[w][0], q, ids[mine], k), strict=True):
                        least[i] = e
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(least, pa.float64())], names=["id", "vec", "width", "at", "least"])

    asked = slim.where("is_q").mapInArrow(start, "id long, vec array<double>, width int, at long, least double")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "width", F.lit(1).alias("tag"), "at", "id", "vec", "least")
    held = slim.select("block", "width", F.lit(0).alias("tag"), "at", "id", "vec", F.lit(None).cast("double").alias("least"))
    dealt = held.unionByName(asked).repartition(n_blocks, "block", "width").sortWithinPartitions("block", "width", "tag")
    schema = pa_schema(spark, OUT)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, lists = None, [], [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if b.num_rows else []
            for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if tuple(key[:2, s]) != now:
                    now, ids, parts, lists = tuple(key[:2, s]), [], [], None
                cut = b.slice(s, e - s)
                x = whole(_matrix(cut.column(5)).reshape(e - s, int(key[1, s])), scale)
                if not key[2, s]:
                    ids += cut.column(4).to_pylist()
                    parts.append(x)
                    continue
                if not parts:
                    continue  # no row of this width in the block
                lists = lists or Lists(ids, np.concatenate(parts))
                own_rows, x = fit(lists.rows, x)
                out = [[], [], [], []]
                for q, at, own, least in zip(x, cut.column(3).to_pylist(), cut.column(4).to_pylist(), cut.column(6).to_pylist(), strict=True):
                    for score, place in lists.search(own_rows, q, own, k, least):
                        for col, value in zip(out, (at, own, lists.ids[place], score), strict=True):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return dealt.mapInArrow(meet, OUT).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id
), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10"""
