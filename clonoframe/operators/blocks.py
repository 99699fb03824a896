"""Blocked all-pairs computation: what needs every pair of rows of two tables, without a row for a pair.

``cells``: rows are packed into blocks of ``BLOCK`` vectors; every (left block, right block) cell meets in one task, which holds the two blocks
and returns what it has reduced. Each block is copied once for every block of the other side, so the shuffle
grows with n * m / BLOCK vectors, and no side is broadcast.

``swept``: a task holds one large left block (at most ``HOLD`` rows) and what it has reduced so far, while the right rows pass by in small steps. There are as many left blocks as
keep the cores busy, or as memory asks for, so the shuffle is some 24 copies of the right side until the left one passes 24 * HOLD rows, and a left row gives its result once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=float)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def cells(
    left: DataFrame, right: DataFrame, reduce: Callable, ddl: str, id_type: str = "string", block: int = BLOCK, sizes: tuple[int, int] | None = None, groups: list[tuple[int, int, int]] | None = None,
) -> DataFrame:
    """Rows that ``reduce(left_ids, left_matrix, right_ids, right_matrix)`` yields as tuples of ``ddl``, for every cell.

    ``left`` and ``right``: id, vec. Ids are strings or longs (``id_type``). ``sizes``: the sides' numbers of rows, where they are known; else both are counted.
    ``groups``: (group, left rows, right rows); then both sides have a column ``grp`` and only rows of one group meet.
    """
    spark = left.sparkSession
    if groups is None:
        groups = [(0, *(sizes or (left.count(), right.count())))]
        left, right = (df.withColumn("grp", F.lit(0)) for df in (left, right))
    n_blocks = [(g, max(1, -(-n // block)), max(1, -(-m // block))) for g, n, m in groups]
    table = spark.createDataFrame(n_blocks, "grp int, nx int, ny int")

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        own, other = ("nx", "ny") if is_left else ("ny", "nx")
        if len(n_blocks) == 1:
            counted = df.where(F.col("grp") == n_blocks[0][0]).select("*", F.lit(n_blocks[0][1]).alias("nx"), F.lit(n_blocks[0][2]).alias("ny"))
        else:
            counted = df.join(table, "grp")
        b = F.pmod(F.xxhash64("id"), F.col(own).cast("long"))
        spread = counted.select("grp", F.col("id").cast(id_type).alias("id"), "vec", b.alias("b"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("o"))
        x, y = (F.col("b"), F.col("o").cast("long")) if is_left else (F.col("o").cast("long"), F.col("b"))
        return spread.select("grp", x.alias("x"), y.alias("y"), F.lit(0 if is_left else 1).alias("side"), "id", "vec")

    both = side(left, True).unionByName(side(right, False))
    tasks = min(sum(n * m for _, n, m in n_blocks), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    dealt = both.repartition(max(1, tasks), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "side", "id")
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])

        def close():
            if held[0] and held[2]:
                rows = list(reduce(held[0], np.concatenate(held[1]), held[2], np.concatenate(held[3])))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            # Rows come sorted by cell and side; each run of equal keys is taken as one slice of the batch's matrix.
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if batch.num_rows else []
            for p, q in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                *cell, s = keys[:, p].tolist()
                if cell != now:
                    yield from close()
                    now, held = cell, ([], [], [], [])
                held[2 * s].extend(batch.column(4).slice(p, q - p).to_pylist())
                held[2 * s + 1].append(matrix(batch.column(5).slice(p, q - p)))
        yield from close()

    return dealt.mapInArrow(run, ddl)


#: Most rows of a left block of a sweep, and most bytes of their vectors; right rows that meet it at once; cells for each core, so that none idles long.
HOLD, HOLD_BYTES, STEP, WAVES = 32_768, 32 << 20, 2048, 2
#: Numbers of a strip (left rows by right rows) of a sweep's step.
STRIP = 1 << 19

Fold = Callable[[list, np.ndarray], tuple[Callable[[list, np.ndarray, int], None], Callable[[], Iterator[tuple]]]]


def grid(spark, n: int, m: int, width: int, square: bool = False) -> tuple[int, int]:
    """(left blocks, right parts) of a sweep over n and m vectors; ``square``: the numbers for which the fewest vectors are copied, so that a left row may meet several right parts."""
    tasks = WAVES * spark.sparkContext.defaultParallelism
    held = max(BLOCK, min(HOLD, HOLD_BYTES // (8 * max(1, width))))
    wanted = max(1, round((tasks * n / max(1, m)) ** 0.5)) if square else tasks
    nx = max(1, -(-n // held), min(tasks, wanted, -(-n // BLOCK)))
    return nx, max(1, min(-(-tasks // nx), -(-m // BLOCK)))


def strips(rows: int, columns: int) -> Iterator[slice]:
    """Slices of left rows that meet ``columns`` right rows in about STRIP numbers."""
    step = max(1, STRIP // max(1, columns))
    for i in range(0, rows, step):
        yield slice(i, min(rows, i + step))


class Room:
    """Memory for the matrices of a task's strips, taken once and used again: fresh memory would cost as much as the sums."""

    def __init__(self):
        self._held: dict = {}

    def get(self, rows: int, columns: int, name: str = "", kind: type = float) -> np.ndarray:
        n = rows * columns
        if len(self._held.get(name, ())) < n:
            self._held[name] = np.empty(n, kind)
        return self._held[name][:n].reshape(rows, columns)

    def product(self, left: np.ndarray, right: np.ndarray, name: str = "") -> np.ndarray:
        return np.matmul(left, right, out=self.get(len(left), right.shape[1], name))


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix's true places; where they are few, some ten times as fast as ``np.nonzero``."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def swept(
    left: DataFrame, right: DataFrame, fold: Fold, ddl: str, id_type: str = "string", sizes: tuple[int, int] | None = None, square: bool = False, whole: bool = False, half: bool = False,
) -> tuple[DataFrame, bool]:
    """Rows of ``ddl`` from ``fold`` for each cell of ``grid``, and whether each left block has met all right rows in one cell.

    ``left`` and ``right``: id, vec; ids are strings or longs (``id_type``). ``right`` may have a column ``tag`` (int); a step then holds rows of one tag only. ``fold(ids, x)`` is called with a left block
    and gives (add, done): ``add(ids, y, tag)`` takes the next right rows, ``done()`` yields tuples of columns. Cells without rows of either side give nothing. Where the second value is false,
    a left row gives one result for each right part. ``square`` is for folds with small results a left row or block: the shuffle is some 10 copies of a side then.
    ``whole``: the second value is always true. ``half``: both sides are the same rows and the fold is a sum over pairs that doesn't change when a pair turns around: two blocks meet once,
    and a step's tag says how often it counts (2, or 1 where a block meets itself).
    """
    spark = left.sparkSession
    n, m = sizes or (left.count(), right.count())
    first = left.select(F.size("vec").alias("n")).first()
    nx, ny = grid(spark, n, m, first["n"] if first else 1, square)
    ny = 1 if whole else ny
    if half:
        nx = ny = max(nx, ny) if nx * ny == 1 else max(nx, min(-(-n // BLOCK), round((2 * WAVES * spark.sparkContext.defaultParallelism) ** 0.5)))
    at = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def side(df: DataFrame, k: int, x, y):
        tag = F.col("tag").cast("int") if k and "tag" in df.columns else F.lit(0)
        placed = df.select(F.col("id").cast(id_type).alias("id"), F.col("vec").cast("array<double>").alias("vec"), tag.alias("tag"), x.alias("x"))
        return placed.withColumn("y", y).select((F.col("x") * ny + F.col("y") if not k else F.col("y") * ny + F.col("x")).alias("cell"), F.lit(k).alias("side"), "tag", "id", "vec")

    if half:
        x, y = F.col("x"), F.col("y")
        own = left.select(F.col("id").cast(id_type).alias("id"), F.col("vec").cast("array<double>").alias("vec"), at(nx).alias("own"))
        # Cells of a triangle: x up to y.
        cell = (F.floor(y * (y + 1) / 2).cast("int") + x).alias("cell")
        lefts = own.withColumnRenamed("own", "x").withColumn("y", F.explode(F.sequence(x, F.lit(nx - 1)))).select(cell, F.lit(0).alias("side"), F.lit(0).alias("tag"), "id", "vec")
        rights = own.withColumnRenamed("own", "y").withColumn("x", F.explode(F.sequence(F.lit(0), y))).select(cell, F.lit(1).alias("side"), F.when(x == y, 1).otherwise(2).alias("tag"), "id", "vec")
        both = lefts.unionByName(rights)
    else:
        both = side(left, 0, at(nx), every(ny)).unionByName(side(right, 1, at(ny), every(nx)))
    tasks = min(nx * (nx + 1) // 2 if half else nx * ny, 4 * max(WAVES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = both.repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "side", "tag", "id")
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, fed = None, [], [], None

        def close() -> Iterator[pa.RecordBatch]:
            for columns in fed[1]() if fed else ():
                # Lists of vectors are wide; each batch stays small.
                for i in range(0, len(columns[0]), 2048):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 2048], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if batch.num_rows else []
            for p, q in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                cell, s, tag = keys[:, p].tolist()
                if cell != now:
                    yield from close()
                    now, ids, held, fed = cell, [], [], None
                for i in range(p, q, STEP) if s else [p]:
                    size = min(STEP, q - i) if s else q - p
                    own, vectors = batch.column(3).slice(i, size), matrix(batch.column(4).slice(i, size))
                    if not s:
                        ids.extend(own.to_pylist())
                        held.append(vectors)
                    elif ids:
                        if fed is None:
                            fed, held = fold(ids, np.concatenate(held)), []
                        fed[0](own.to_pylist(), vectors, tag)
        yield from close()

    return dealt.mapInArrow(run, ddl), ny == 1


#: Numbers of all tasks' partial sums that one task adds up; beyond, Spark adds them by position.
DIRECT = 1 << 21


def summed(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], length: int, parts: int) -> np.ndarray:
    """The sum over all rows of ``f(batch)``, a flat array of ``length``; each of the ``parts`` tasks gives one partial sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = f(b)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            for v in b.column(0):
                total = total + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    partial = rows.mapInArrow(run, "v array<double>")
    if parts * length <= DIRECT:
        # One task adds the partial sums up, so that the driver gets one of them, whatever the number of parts.
        got = (partial.repartition(1).mapInArrow(added, "v array<double>") if parts > 1 else partial).toArrow()
        return np.asarray(got.column("v").combine_chunks().flatten(), float).reshape(-1, length).sum(axis=0) if len(got) else np.zeros(length)
    out = np.zeros(length)
    for r in partial.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out
