"""Full-length sequences from CDR3 and gene names."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import rename_gene
from .preprocess import FAILURE

LEAST = 50


def clean_gene(name, kind: str):
    """A name in the segments' style: one zero after the dash dropped (V), colons as dashes (J); unresolved gives null."""
    c = F.when(name.isNull() | (name == "unresolved"), F.lit(None)).otherwise(name)
    return rename_gene(c) if kind == "V" else rename_gene(F.regexp_replace(c, ":", "-"))


class IdSubstrings:
    """All substrings of a catalogue's ids at once: its sorted suffixes, and over each run of them the record that comes last."""

    def __init__(self, records: list[tuple[int, str, str]]):
        """``records``: (order, id, sequence)."""
        self.seqs = [r[2] for r in sorted(records)]
        found = sorted((name[k:], at) for at, (_, name, _) in enumerate(sorted(records)) for k in range(len(name) + 1))
        self.suffixes = [f[0] for f in found]
        last = np.array([f[1] for f in found], np.int64)
        # last[k][i]: the latest record of 2**k suffixes from i on.
        self.last = [last]
        while (1 << len(self.last)) <= len(last):
            half = 1 << (len(self.last) - 1)
            self.last.append(np.maximum(self.last[-1][:-half], self.last[-1][half:]))

    def latest(self, part: str) -> int:
        """The place of the last record whose id contains ``part``; -1 if none does."""
        lo, hi = bisect_left(self.suffixes, part), bisect_left(self.suffixes, part + "\U0010ffff")
        if lo == hi:
            return -1
        k = (hi - lo).bit_length() - 1
        return int(max(self.last[k][lo], self.last[k][hi - (1 << k)]))


#: Catalogues whose ids and sequences have more characters than this are joined instead of broadcast.
CATALOGUE = 32 << 20


def _compatible(named: DataFrame, own: DataFrame, kind: str) -> DataFrame:
    """(name, seq): the last record whose id contains the name ``g``, or, for V names with a dash, its family."""
    size = own.agg(F.coalesce(F.sum(F.length("id") * F.length("id") + F.length("seq")), F.lit(0)).alias("n")).first()["n"]
    if size > CATALOGUE:
        fits = F.col("id").contains(F.col("g"))
        if kind == "V":
            fits = fits | (F.col("g").contains("-") & F.col("id").contains(F.element_at(F.split("g", "-"), 1)))
        return named.join(own, fits).groupBy("name").agg(F.max_by("seq", "ord").alias("seq"))
    shared = named.sparkSession.sparkContext.broadcast(IdSubstrings([(r["ord"], r["id"], r["seq"]) for r in own.select("ord", "id", "seq").collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = [[], []]
            for name, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [g, g.split("-")[0]] if kind == "V" and "-" in g else [g]
                if (at := max(known.latest(p) for p in parts)) >= 0:
                    out[0].append(name)
                    out[1].append(known.seqs[at])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["name", "seq"])

    return named.select("name", "g").mapInArrow(run, "name string, seq string")


def resolve_genes(names: DataFrame, segments: DataFrame, kind: str, compat: bool = False) -> DataFrame:
    """(name, seq) for distinct names. Default: allele 01 of the exact gene, else of the family. ``compat``: the last record whose id contains the name, or, for V
    names with a dash, the family.

    Names are few next to rows: each is resolved once. Exact lookups are equi-joins on gene and family; compat looks names up among the sorted suffixes of the catalogue's
    ids, which are broadcast after a size check.
    """
    own = segments.where(F.col("kind") == kind)
    named = names.select("name").distinct().withColumn("g", clean_gene(F.col("name"), kind)).where("g is not null")
    if compat:
        return _compatible(named, own, kind)
    gene = F.element_at(F.split("gene", r"\*"), 1)
    catalogue = own.select("ord", "seq", gene.alias("key"), F.when(F.col("gene").endswith("*01"), 0).otherwise(1).alias("other"))
    families = catalogue.withColumn("key", F.element_at(F.split("key", "-"), 1))
    keys = named.select("name", F.col("g").alias("key"), F.lit(0).alias("step")).unionByName(named.select("name", F.element_at(F.split("g", "-"), 1).alias("key"), F.lit(1).alias("step")))
    hits = keys.where("step = 0").join(catalogue, "key").unionByName(keys.where("step = 1").join(families, "key"))
    return hits.groupBy("name").agg(F.min_by("seq", F.struct("step", "other", "ord")).alias("seq"))


#: Cells of the tables of one batch of alignments.
TABLE_CELLS = 400_000


def _codes(rows: list[str], size: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Code points of strings as a matrix, with ``fill`` beyond each string's end."""
    if not width:
        return np.zeros((len(rows), 0), np.int32)
    out = np.array(rows, f"<U{width}").view("<i4").reshape(len(rows), width)
    return np.where(np.arange(width) < size[:, None], out, fill)


def align_all(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A global alignment of each pair with the most equal residues; gaps and unequal pairs cost nothing and unequal pairs aren't formed.

    Of the best alignments it takes the one whose pairs come earliest in the first string, then in the second; between pairs the first string's residues stand first.
    All tables of a batch are filled a row at a time: the row below, its diagonal where residues are equal, and a running maximum from the right. Pairs of like lengths
    share a batch, so padding is short and memory is bounded.
    """
    out: list[tuple[str, str]] = [("", "")] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        end, n, m = at, 0, 0
        while end < len(order):
            x, y = (len(s) for s in pairs[order[end]])
            if end > at and (max(n, x) + 1) * (max(m, y) + 1) * (end - at + 1) > TABLE_CELLS:
                break
            n, m, end = max(n, x), max(m, y), end + 1
        part = [pairs[k] for k in order[at:end]]
        for k, rows in zip(order[at:end], _aligned(part, n, m), strict=True):
            out[k] = rows
        at = end
    return out


def _aligned(pairs: list[tuple[str, str]], n: int, m: int) -> list[tuple[str, str]]:
    size = np.array([[len(s) for s in p] for p in pairs]).reshape(-1, 2)
    a, b = _codes([p[0] for p in pairs], size[:, 0], n, -1), _codes([p[1] for p in pairs], size[:, 1], m, -2)
    best = np.zeros((n + 1, len(pairs), m + 1), np.int16 if min(n, m) < 2**15 else np.int32)
    for i in range(n - 1, -1, -1):
        row = best[i + 1].copy()
        np.maximum(row[:, :-1], np.where(a[:, i, None] == b, best[i + 1][:, 1:] + 1, 0), out=row[:, :-1])
        best[i] = np.maximum.accumulate(row[:, ::-1], axis=1)[:, ::-1]
    # Each step takes a residue of both (2), of the second (1) or of the first string (0); -1 beyond the end.
    steps = np.full((len(pairs), n + m), -1, np.int8)
    i, j, all_ = np.zeros(len(pairs), int), np.zeros(len(pairs), int), np.arange(len(pairs))
    for k in range(n + m):
        go = all_[(i < size[:, 0]) & (j < size[:, 1])]
        if not len(go):
            break
        p, q = i[go], j[go]
        here = best[p, go, q]
        both = (a[go, p] == b[go, q]) & (here == best[p + 1, go, q + 1] + 1)
        second = ~both & (best[p, go, q + 1] == here)
        steps[go, k] = np.where(both, 2, np.where(second, 1, 0))
        i[go] += both | ~second
        j[go] += both | second
    # One string is used up; what is left of the other faces gaps.
    walked = (steps >= 0).sum(axis=1)
    length = walked + (size[:, 0] - i) + (size[:, 1] - j)
    at = np.arange(n + m)
    rest = (at >= walked[:, None]) & (at < length[:, None])
    steps = np.where(rest, np.where(i < size[:, 0], 0, 1)[:, None], steps).astype(np.int8)
    return list(zip(*(_row_text(codes, steps, gap, length) for codes, gap in ((a, 1), (b, 0))), strict=True))


def _row_text(codes: np.ndarray, steps: np.ndarray, gap: int, length: np.ndarray) -> list[str]:
    """One side's rows: its residues in order, and dashes at the steps of kind ``gap``."""
    if not steps.shape[1]:
        return [""] * len(steps)
    taken = (steps >= 0) & (steps != gap)
    place = np.maximum(np.cumsum(taken, axis=1) - 1, 0)
    out = np.full(steps.shape, ord("-"), "<i4")
    if codes.shape[1]:
        out = np.where(taken, np.take_along_axis(codes, place, axis=1), out).astype("<i4")
    text, width = out.tobytes().decode("utf-32-le"), steps.shape[1]
    return [text[k * width : k * width + n] for k, n in enumerate(length.tolist())]


def align(a: str, b: str) -> tuple[str, str]:
    """``align_all`` of one pair."""
    return align_all([(a, b)])[0]


def alignments(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, a_row, b_row, equal): the aligned rows of each distinct pair of strings, and how many residues are equal. Pairs with a null string have no row."""
    ddl = "a string, b string, a_row string, b_row string, equal int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows = align_all(given)
            equal = [sum(p == q and p != "-" for p, q in zip(*r, strict=True)) for r in rows]
            columns = [[g[0] for g in given], [g[1] for g in given], [r[0] for r in rows], [r[1] for r in rows]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(equal, pa.int32())], names=["a", "b", "a_row", "b_row", "equal"])

    distinct = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    return distinct.mapInArrow(run, ddl)


def alignment_steps(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, step, a_at, b_at): the trace of each distinct pair as rows; ``a_at`` and ``b_at`` are places in the strings from 0, null at a gap."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = alignments(pairs, a, b).select("a", "b", F.posexplode(F.arrays_zip(letters("a_row").alias("x"), letters("b_row").alias("y"))).alias("step", "s"), "a_row", "b_row")
    place = lambda c, row: F.when(F.col(f"s.{c}") != "-", F.length(F.regexp_replace(F.substring(row, F.lit(1), F.col("step")), "-", "")))
    return rows.select("a", "b", "step", place("x", "a_row").alias("a_at"), place("y", "b_row").alias("b_at"))


def assemble_all(triples: list[tuple[str, str, str]]) -> list[str]:
    """Of each (V, J, CDR3): V without its last five residues, at most two of those before the CDR3, the CDR3, and what of J follows it."""
    cores = []
    for (v, _, cdr3), (row, _) in zip(triples, align_all([(c, v[-5:]) for v, _, c in triples]), strict=True):
        lead = len(row) - len(row.lstrip("-"))
        cores.append(v[-5:][: min(lead, 2)] + cdr3 if v else cdr3)
    out = []
    for (v, j, _), core, (row, other) in zip(triples, cores, align_all([(c, j) for (_, j, _), c in zip(triples, cores, strict=True)]), strict=True):
        rest = len(row) - len(row.rstrip("-")) if j else 0
        out.append(v[:-5] + core + (other[len(other) - rest :] if rest else ""))
    return out


def assemble(v: str, j: str, cdr3: str) -> str:
    """``assemble_all`` of one."""
    return assemble_all([(v, j, cdr3)])[0]


def full_sequences(rows: DataFrame, segments: DataFrame, v: str = "v", j: str = "j", cdr3: str = "cdr3", compat: bool = False) -> DataFrame:
    """``rows`` with ``full_seq``: the assembled sequence if V was found and it is longer than 50 residues, else the failure mark.

    Each distinct name is resolved once; the resolved names are joined back (Spark broadcasts them under its own threshold).
    """
    vs = resolve_genes(rows.select(F.col(v).alias("name")), segments, "V", compat).select(F.col("name").alias("_vn"), F.col("seq").alias("_v"))
    js = resolve_genes(rows.select(F.col(j).alias("name")), segments, "J", compat).select(F.col("name").alias("_jn"), F.col("seq").alias("_j"))

    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        rows = list(zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True))
        distinct = list({(v, j or "", x or "") for v, j, x in rows if v})
        made = dict(zip(distinct, (s if len(s) > LEAST else FAILURE for s in assemble_all(distinct)), strict=True))
        return pa.array([made.get((v, j or "", x or ""), FAILURE) for v, j, x in rows], pa.string())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "c": pa.Array, "return": pa.Array}
    joined = rows.join(vs, F.col(v) == F.col("_vn"), "left").join(js, F.col(j) == F.col("_jn"), "left")
    return joined.withColumn("full_seq", F.arrow_udf(run, "string")("_v", "_j", F.col(cdr3))).drop("_v", "_j", "_vn", "_jn")
