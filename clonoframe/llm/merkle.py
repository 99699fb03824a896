"""Document fingerprints: a Merkle tree over sections, paragraphs and short leaves.

A section ends after blank lines, a paragraph at a line's end, and a leaf where a hash of the last four
characters, whatever they are, falls into a fixed share, after LEAST characters at least and MOST at most:
leaf borders depend on nearby text only, so an
edit moves few of them. All pieces keep their separators; together they are the text. A leaf's hash
covers its text, an inner hash its children's hashes, each with its level's prefix. Equal roots mean equal texts;
where roots differ, following differing branches finds the edits (``edits``).

A fingerprint is the root's hash and the tree in short: each leaf's length, 24 bits of its hash, and whether it ends a paragraph or a section. Likeness and edits of two
documents are found from their fingerprints alone.

Likeness of two trees is Dice's coefficient of their leaves, each with its length: 1 for equal
texts, also for two empty ones; 0 where no leaf is shared. Equal branches at both ends are passed over, the leaves between them are compared as
bags. Null texts count as empty.

The edit of the query takes the next document in descending doc_id (null ids last, equal ids by text, descending too;
after the last comes the first; a table of one row is its own next).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_partitions, pa_schema, slots

#: Characters of a leaf, and the share of borders among all places (the mean is near LEAST + 1 / share).
LEAST, MOST, _SHARE = 8, 64, 1 / 12
_MUL, _BELOW = np.uint32(0x9E3779B1), np.uint32(2**32 * _SHARE)
_BLANK = re.compile(r"\n(?:[ \t]*\n)+")
#: Characters of a text that ranges of one id are cut by; sampled rows of such ids that place these cuts (results don't depend on them).
HEAD, SAMPLE = 32, 20_000
_hash = partial(hashlib.blake2b, digest_size=16)


@dataclass
class Tree:
    root: str
    sections: list  # (hash, start, end, [(hash, start, end, [(hash, start, end)])])
    leaves: Counter
    n_chars: int


def _cut(text: str, start: int, end: int, at: re.Pattern) -> list[tuple[int, int]]:
    out, p = [], start
    for m in at.finditer(text, start, end):
        out.append((p, m.end()))
        p = m.end()
    if p < end:
        out.append((p, end))
    return out


_LINE = re.compile(r"\n")


def _borders(text: str) -> list[int]:
    """Places where a leaf may end: those whose last four characters have a hash in the fixed share."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 4:
        return []
    h = c[:-3] * _MUL
    for k in (1, 2, 3):
        h += c[k : len(c) - 3 + k]
        h *= _MUL
    return (np.flatnonzero(h < _BELOW) + 4).tolist()


def tree(text: str | None, known: dict[str, bytes] | None = None) -> Tree:
    """The Merkle tree of a whole text. ``known`` may hold leaf hashes of a related text; it gets this text's."""
    text = text or ""
    known = {} if known is None else known
    sections, leaves = [], Counter()
    top, borders, at = _hash(b"\x03"), _borders(text), 0
    borders.append(len(text) + LEAST + MOST)
    for a, b in _cut(text, 0, len(text), _BLANK):
        paragraphs, mid = [], _hash(b"\x02")
        for c, d in _cut(text, a, b, _LINE):
            low, p, own = _hash(b"\x01"), c, []
            pieces = []
            while p < d:
                while borders[at] < p + LEAST:
                    at += 1
                q = min(d, p + MOST, borders[at])
                piece = text[p:q]
                pieces.append(piece)
                h = known.get(piece)
                if h is None:
                    h = known[piece] = _hash(b"\x00" + piece.encode("utf-8", "surrogatepass")).digest()
                low.update(h)
                own.append((h, p, q))
                p = q
            leaves.update(pieces)
            h = low.digest()
            mid.update(h)
            paragraphs.append((h, c, d, own))
        h = mid.digest()
        top.update(h)
        sections.append((h, a, b, paragraphs))
    return Tree(top.hexdigest(), sections, leaves, len(text))


def fingerprint(t: Tree) -> str:
    """Root, ``-`` and, for each leaf, 24 bits of its hash and a byte (length - 1, 64: a paragraph ends, 128: a section ends) in base 64; no leaves for an empty text."""
    out = bytearray()
    for _, _, _, paragraphs in t.sections:
        for _, _, _, leaves in paragraphs:
            for h, p, q in leaves:
                out += h[:3]
                out.append(q - p - 1)
            out[-1] |= 64
        out[-1] |= 128
    return f"{t.root}-{base64.b64encode(out).decode()}"


def _leaves(short: str) -> np.ndarray:
    """A fingerprint's leaves: 24 bits of hash, then a byte of length and marks."""
    return np.frombuffer(base64.b64decode(short.split("-", 1)[1]), ">u4")


def read(short: str) -> Tree:
    """The tree of a fingerprint; leaves are known by their short hashes, inner nodes by their children's."""
    sections, paragraphs, leaves, bag, at, n = [], [], [], Counter(), 0, 0
    for word in _leaves(short).tolist():
        key, size = (word >> 8, (word & 63) + 1), (word & 63) + 1
        leaves.append((key, at, at + size))
        bag[key] += 1
        at += size
        if word & 64:
            paragraphs.append((tuple(x[0] for x in leaves), n, at, leaves))
            n, leaves = at, []
        if word & 128:
            sections.append((tuple(x[0] for x in paragraphs), paragraphs[0][1], at, paragraphs))
            paragraphs = []
    return Tree(short.split("-", 1)[0], sections, bag, at)


def likeness_of(a: str, b: str) -> float:
    """``likeness`` of two documents from their fingerprints."""
    if a.split("-", 1)[0] == b.split("-", 1)[0]:
        return 1.0
    x, y = _leaves(a), _leaves(b)
    total = int((x & 63).sum() + len(x) + (y & 63).sum() + len(y))
    x, y = x & 0xFFFFFF3F, y & 0xFFFFFF3F
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    i = n if same.all() else int(same.argmin())
    same = x[len(x) - (n - i) :][::-1] == y[len(y) - (n - i) :][::-1]
    j = n - i if same.all() else int(same.argmin())
    shared = int((x[:i] & 63).sum() + i + (x[len(x) - j :] & 63).sum() + j)
    (u, k), (v, m) = (np.unique(s[i : len(s) - j], return_counts=True) for s in (x, y))
    both, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    shared += int((np.minimum(k[p], m[q]) * ((both & 63) + 1)).sum())
    return 2 * shared / total


def likeness(a: Tree, b: Tree) -> float:
    """Dice's coefficient of the leaves, weighted by their lengths."""
    return likeness_of(fingerprint(a), fingerprint(b))


def edits(a: Tree, b: Tree) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Ranges of a's and b's texts under the differing branches, found from the roots down."""
    if a.root == b.root:
        return []

    def walk(x, y, ends):
        i, n = 0, min(len(x), len(y))
        while i < n and x[i][0] == y[i][0]:
            i += 1
        j = 0
        while j < n - i and x[-1 - j][0] == y[-1 - j][0]:
            j += 1
        p, q = x[i : len(x) - j], y[i : len(y) - j]
        if len(p) == len(q) and p and len(p[0]) > 3:
            return [r for u, v in zip(p, q, strict=True) if u[0] != v[0] for r in walk(u[3], v[3], (u[1], v[1]))]
        at = (x[i][1] if i < len(x) else x[-1][2] if x else ends[0], y[i][1] if i < len(y) else y[-1][2] if y else ends[1])
        return [((at[0], p[-1][2] if p else at[0]), (at[1], q[-1][2] if q else at[1]))]

    return walk(a.sections, b.sections, (0, 0))


def edited_text(text: str, following: str) -> str:
    """``text`` whose last third gives way to the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and the likeness to both and to the next document.

    Texts are shuffled once, into ranges of doc_id whose bounds are quantiles of the column; ids that fill several ranges, and null ids, are cut again by the first HEAD characters of their
    texts (rows that are alike in both stay together). Besides its
    own rows each range gets a copy of the next range's first rows, so that every row meets its successor in
    its own task; a task holds two texts and trees at a time. ``edits``: the ranges of the text and of the edited one (start:end>start:end,
    code points) under the differing branches of the two trees, comma-joined.
    """
    spark = docs.sparkSession
    n = input_partitions(spark)
    ids = docs.select("doc_id")
    cuts = ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    times = Counter(int(c) for c in cuts or [])
    rows, nulls = ids.agg(F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), F.lit(1)))).first()
    # Ids that fill several ranges, and null ids (key null), are cut again by the beginnings of their texts.
    hot: dict[int | None, int] = {v: k - 1 for v, k in times.items() if k > 1}
    if n > 1 and (k := round(n * nulls / max(rows, 1))) > 1:
        hot[None] = k - 1
    head = F.substring(F.coalesce("text", F.lit("")), 1, HEAD) if hot else F.lit("")
    within: dict[int | None, list[str]] = {}
    if hot:
        own = F.col("doc_id").isin([v for v in hot if v is not None]) | (F.col("doc_id").isNull() if None in hot else F.lit(False))
        found = docs.where(own).select("doc_id", head.alias("h"))
        for v, group in _by_id(found.sample(min(1.0, SAMPLE / rows), 3).limit(2 * SAMPLE).collect()).items():
            group = sorted(group, reverse=True)
            within[v] = sorted({group[i * len(group) // (hot[v] + 1)] for i in range(1, hot[v] + 1)}, reverse=True)

    def at(c: Column, h: Column) -> Column:
        """Range 0 holds the largest ids; null ids are the last."""
        beyond = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(times)]), lambda b: b > c)) if times else F.lit(0)
        out = F.when(c.isNull(), F.lit(len(times))).otherwise(beyond)
        for v, heads in within.items():
            later = F.size(F.filter(F.array(*[F.lit(t) for t in heads]), lambda t: t > h))
            out = out + (F.when(c.isNull(), later).otherwise(F.lit(0)) if v is None else F.when(c.isNull() | (c < v), F.lit(len(heads))).when(c == v, later).otherwise(F.lit(0)))
        return out

    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), head.alias("_head")).withColumn("_range", at(F.col("doc_id"), F.col("_head")))
    # One row for each range; the bounds' number is fixed, so this is small whatever the input. Null ids come after all others in this order, too.
    firsts = {
        r["_range"]: r["first"]
        for r in docs.select("doc_id", head.alias("_head")).withColumn("_range", at(F.col("doc_id"), F.col("_head"))).groupBy("_range").agg(F.max(F.struct("doc_id", "_head")).alias("first")).collect()
    }
    if not firsts:
        return spark.createDataFrame([], _OUT)
    there = sorted(firsts)
    before = {r: there[i - 1] for i, r in enumerate(there)}  # the first range follows the last
    gets = [(r, *firsts[r], before[r]) for r in there]
    # The array of targets: the row's own range and, for the first rows of a range, the range before.
    first_of = F.create_map(*[x for r, i, h, _ in gets for x in (F.lit(r), F.struct(F.lit(i).cast("long").alias("i"), F.lit(h).alias("h")))])
    first = first_of[F.col("_range")]
    first_here = F.col("doc_id").eqNullSafe(first["i"]) & (F.col("_head") == first["h"])
    to = F.create_map(*[F.lit(x) for r, _, _, b in gets for x in (r, b)])
    spread = ranged.select(
        "doc_id", "text", F.explode(
            F.when(first_here, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")), F.struct(to[F.col("_range")].alias("r"), F.lit(1).alias("copy"))))
            .otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))))
        ).alias("_to"),
    ).select(F.col("_to.r").alias("_r"), F.col("_to.copy").alias("_copy"), "doc_id", "text")
    # One range a task: each range is dealt by a number whose hash is its own task.
    numbers = slots(spark, len(there))
    slot = F.create_map(*[F.lit(x) for r, s in zip(there, numbers, strict=True) for x in (r, s)])
    dealt = spread.repartition(len(there), slot[F.col("_r")]).sortWithinPartitions(
        F.col("_r"), F.col("_copy"), F.col("doc_id").desc_nulls_last(), F.col("text").desc()
    )
    schema = pa_schema(spark, _OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, tree, fingerprint, leaf hashes) that waits for its successor
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                r, copy, doc_id, text = (c[k].as_py() for c in batch.columns)
                if copy and (held is None or held[0] != r):
                    continue  # only the first copied row follows a range
                hashes: dict[str, bytes] = {}
                t = tree(text, hashes)
                short = fingerprint(t)
                if held is not None and held[0] == r:
                    rows.append(_result(held, text, short))
                    size += 1
                held = None if copy else (r, doc_id, text, t, short, hashes)
                if size >= 512:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return dealt.mapInArrow(run, _OUT)


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_sections long, n_leaves long, edits string"
)


def _by_id(rows: list) -> dict[int | None, list[str]]:
    out: dict[int | None, list[str]] = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r["h"])
    return out


def _result(held: tuple, following: str, after: str) -> tuple:
    _, doc_id, text, own, short, hashes = held
    edited = edited_text(text, following)
    e = own if edited == text else tree(edited, hashes)
    changed = fingerprint(e)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), short, changed,
        likeness_of(short, changed), likeness_of(short, after), len(own.sections), sum(own.leaves.values()),
        ",".join(f"{a}:{b}>{c}:{d}" for (a, b), (c, d) in edits(own, e)),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
