"""Suffix-array dedup: remove every byte covered by a 200-byte string that starts more than once.

Suffix order is made by the linear grouping construction (``suffix_array``): suffixes start grouped by
their first symbol; groups are processed in descending order; each suffix of a group points to the nearest suffix to its
left in a lower group (its previous smaller one), and those targets leave their groups for new ones just above, by how many
suffixes of the processed group point to them. At the end, groups hold equal Lyndon prefixes, and one
ascending pass along the pointers emits the order of every group. Nothing is renamed and no step recurses.

Over a corpus, 200-byte strings are dealt by content, so that equal ones always meet:

1. The anchor of a 200-byte string is its K-byte string with the least hash (leftmost at ties). A scan counts anchors; those
   that occur twice or more go into a Bloom filter of bounded size (false positives cost work, not results).
2. A second scan emits, for each occurrence of a possibly repeated anchor, the segment: the union of the 200-byte strings with that
   anchor. Equal segments are combined, with all their places, before they are shuffled by anchor.
3. Segments of one anchor that are equal are repeated as a whole. For the others the common anchor becomes one symbol, contexts
   are cut to what they share with any other segment, and the suffix array of their concatenation puts equal
   strings side by side.
4. Covered ranges go back to the texts by a 128-bit hash of the text (equal texts have equal results), and each text is cut once.

Null texts count as empty; texts under 200 bytes lose nothing. Matches don't cross documents; rows that repeat a document count as
further occurrences. A task holds the distinct segments of one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import filter_of, maybe
from .common import cut, input_partitions, pa_schema
from .shingles import _B, _powers, mix

LENGTH = 200
K = 64
#: About how much the scan holds of segments to combine equal ones before they are shuffled.
COMBINE_BYTES = 64 << 20


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of a list of integers, by the linear grouping construction."""
    n = len(symbols)
    if not n:
        return []
    alphabet = sorted(set(symbols))
    number = {c: g for g, c in enumerate(alphabet)}
    group = [number[c] for c in symbols]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    top = len(alphabet) - 1
    below = list(range(-1, top))  # the next lower group
    above = list(range(1, top + 2))
    above[top] = -1
    prev = [-1] * (n + 1)
    done = [False] * (n + 1)
    g = top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        points: dict[int, int] = {}
        most = 1
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            done[i] = True
            if j >= 0:
                if j in points:
                    k = points[j] + 1
                    points[j] = k
                    if k > most:
                        most = k
                else:
                    points[j] = 1
        members[g] = own
        # Targets with more pointers go further up; those with equally many, of one group, form one new group.
        levels = (list(points),) if most == 1 else [[j for j, k in points.items() if k == c] for c in sorted(set(points.values()), reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:
                old = group[j]
                new = moved.get(old)
                if new is None:
                    moved[old] = new = len(members)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                group[j] = new
                members[new].append(j)
        g = below[g]
    # Ascending pass: groups' places first, then every suffix puts its left neighbour, and that one's pointers, in place.
    place = [0] * len(members)
    g = 0  # the lowest group is the first symbol's own remainder or stands below all others
    while below[g] >= 0:
        g = below[g]
    at = 1
    while g >= 0:
        place[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    out = [-1] * (n + 1)
    out[0] = n
    placed = [False] * n
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            placed[j] = True
            j = prev[j]
    return out[1:]


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-byte string, in order."""
    n = len(data)
    up, down = _powers(1 << max(16, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's bytes: anchor hashes, their places, and the first and last start of the strings of ``length`` with that anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data, k)
    w = length - k + 1
    m = len(h) - w + 1  # number of windows
    # Minima over windows of w: suffix minima of blocks of w and prefix minima of the next ones. The low bits hold the place, so ties go left.
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    keyed = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = keyed
    blocks = padded.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(left[:m], right[w - 1 : w - 1 + m])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [m]]) - 1
    return h[place[first]], place[first], first, last


def _text_key(raw: bytes) -> bytes:
    """The first 128 bits of the text's SHA-256."""
    return hashlib.sha256(raw).digest()[:16]


def _shared(strings: list[bytes]) -> list[int]:
    """For each string how long a prefix it shares with any other one."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for a, b in zip(order, order[1:], strict=False):
        x, y = strings[a], strings[b]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            c = n
        else:
            lo, hi = 0, n
            while hi - lo > 1:
                mid = (lo + hi) >> 1
                if x[:mid] == y[:mid]:
                    lo = mid
                else:
                    hi = mid
            c = lo
        out[a] = max(out[a], c)
        out[b] = max(out[b], c)
    return out


def repeated_starts(segments: list[tuple[bytes, int]], length: int = LENGTH, k: int = K) -> list[list[int]]:
    """For distinct segments of one anchor (bytes, anchor's place): starts of the strings of ``length`` that another segment has too."""
    out: list[list[int]] = [[] for _ in segments]
    lefts = _shared([s[:p][::-1] for s, p in segments])
    rights = _shared([s[p + k :] for s, p in segments])
    text: list[int] = []
    owner: list[tuple[int, int] | None] = []  # (segment, start) of symbols from which a whole string fits
    width = length - k + 1
    for i, (s, p) in enumerate(segments):
        a, b = lefts[i], rights[i]
        if a + b + k < length:
            continue
        text += s[p - a : p]
        text.append(256)
        text += s[p + k : p + k + b]
        text.append(-1)
        fits = a + b + 2 - width  # how many starts leave room; each such string holds the anchor's symbol
        starts = min(a + 1, fits)
        owner += [(i, p - a + x) for x in range(starts)] + [None] * (a + b + 2 - starts)
    if not text:
        return out
    before = None
    joined = "".join([chr(c + 1) for c in text])
    for at in suffix_array(text):
        if (own := owner[at]) is None:
            continue
        here = joined[at : at + width]
        if before is not None and here == before[0]:
            if before[2]:
                out[before[1][0]].append(before[1][1])
            out[own[0]].append(own[1])
            before = (here, own, False)
        else:
            before = (here, own, True)
    return out


def group_ranges(rows: list[tuple[bytes, int, int, list]], length: int = LENGTH, k: int = K) -> list[tuple]:
    """Covered ranges of the segments of one anchor: (location, start, end), relative to the segments.

    ``rows``: bytes, anchor's place, number of occurrences, their distinct locations.
    """
    seen: dict[tuple[bytes, int], list] = {}
    for seg, p, n, where in rows:
        own = seen.setdefault((seg, p), [0, set()])
        own[0] += n
        own[1].update(where)
    out = [(w, 0, len(s)) for (s, _), (n, ws) in seen.items() if n > 1 for w in ws]
    single = [n == 1 for n, _ in seen.values()]
    if len(seen) > 1 and any(single):
        for (_, ws), starts, alone in zip(seen.values(), repeated_starts(list(seen), length, k), single, strict=True):
            if starts and alone:
                (where,) = ws
                out += [(where, a, b) for a, b in merge([(x, x + length) for x in starts])]
    return out


def _repeated_filter(docs: DataFrame, max_filter_mb: int = 64) -> Broadcast:
    """A Bloom filter of the anchors that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))[0] for t in batch.column(0).to_pylist() if t and len(t) * 4 >= LENGTH]
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    twice = cut(
        docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    )
    return filter_of(twice, max_filter_mb)


def covered(docs: DataFrame) -> DataFrame:
    """Covered ranges: k (the text's key), a, b (bytes); ranges may overlap and repeat."""
    spark = docs.sparkSession
    bloom = _repeated_filter(docs)
    seg_ddl = "h long, seg binary, p int, n long, ks array<binary>, ats array<long>"
    seg_schema = pa_schema(spark, seg_ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal segments are combined here as far as memory allows, so that copies and periodic texts give few rows.
        held: dict[tuple, list] = {}
        size = 0

        def flush():
            rows = []
            for (h, seg, p), (n, ws) in held.items():
                rows.append((h, seg, p, n, [w[0] for w in ws], [w[1] for w in ws]))
                if len(rows) == 4096:
                    yield _batch(rows, seg_schema)
                    rows = []
            if rows:
                yield _batch(rows, seg_schema)
            held.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t or len(t) * 4 < LENGTH:
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                h, place, first, last = anchors(np.frombuffer(raw, np.uint8))
                if not len(h):
                    continue
                hit = np.flatnonzero(maybe(bloom.value, h))
                if not len(hit):
                    continue
                key = _text_key(raw)
                for x, q, a, b in zip(h[hit].view(np.int64).tolist(), place[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                    name = (x, raw[a : b + LENGTH], q - a)
                    own = held.get(name)
                    if own is None:
                        held[name] = own = [0, set()]
                        size += b + LENGTH - a + 300
                    own[0] += 1
                    before = len(own[1])
                    own[1].add((key, a))
                    size += 100 * (len(own[1]) - before)
                if size > COMBINE_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    segments = docs.select("text").mapInArrow(emit, seg_ddl)
    dealt = segments.repartition(input_partitions(spark), "h").sortWithinPartitions("h")
    ddl = "k binary, a long, b long"
    schema = pa_schema(spark, ddl)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for h, seg, p, n, ks, ats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != now:
                    out += group_ranges(held)
                    now, held = h, []
                held.append((seg, p, n, list(zip(ks, ats, strict=True))))
            if len(out) > 4096:
                yield _batch([(w[0], w[1] + a, w[1] + b) for w, a, b in out], schema)
                out = []
        out += group_ranges(held)
        if out:
            yield _batch([(w[0], w[1] + a, w[1] + b) for w, a, b in out], schema)

    return dealt.mapInArrow(settle, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_text(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside ``ranges``, and the maximal removed runs."""
    runs = merge(ranges)
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out), runs


def with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__cf_ranges`` of the covered byte ranges of its text (null: none); every row stays."""
    ranges = covered(docs).groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("__cf_ranges"))
    key = F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), 1, 32))
    return docs.withColumn("__cf_k", key).join(ranges.withColumnRenamed("k", "__cf_k"), "__cf_k", "left").drop("__cf_k")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = pa_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            a, b = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                own = slice(ends[i], ends[i + 1])
                kept, runs = cut_text(raw, list(zip(a[own].tolist(), b[own].tolist(), strict=True)))
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            if rows:
                yield _batch(rows, schema)

    return with_ranges(docs.select("doc_id", "text")).select("doc_id", "text", "__cf_ranges").mapInArrow(run, ddl)
