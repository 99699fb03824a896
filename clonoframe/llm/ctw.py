"""LM scoring by context-tree weighting.

Every byte is eight binary decisions, each made at one of 255 nodes (its leading bits). Every node has a context tree of its own
over the preceding bytes, of depth ``DEPTH``: a context's estimate is Krichevsky and Trofimov's, and its weighted probability is
half its own estimate and half the product of its children's. Scoring uses the tree as trained: at each context, from the deepest
up, the prediction mixes the context's estimate and the deeper prediction by the posterior weights that training gave them.
A text is scored as its bytes (A-Z in lower case) and one end mark; contexts before its start are zero bytes.

What is gathered: for each group of documents the distinct (DEPTH+1)-byte strings with their counts in training documents, and
the distinct words likewise, as packed sorted arrays dealt into shards by the two nearest context bytes (words: by hash). A shard
merges all groups' arrays by a tree, so its tables are whole from depth 2 down; depths 0 and 1 have at most 65,536 entries and
are finished on the driver. The shards then send each group the log-probabilities of its own strings, and texts meet them by group.
No table of the corpus's strings is broadcast or collected, and everything gathered grows with the input.

Words are keyed by 64-bit hashes. Null texts count as empty: one end mark, one end token. A corpus without training documents scores with
all estimates at one half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, input_partitions, pa_schema, slots
from .shingles import lower_bytes, mix, word_hashes

DEPTH = 7
#: Text of one group, in bytes.
GROUP = 32 << 20
#: Inputs of a node when tables are merged.
FAN = 64
#: Groups that one copy of a table answers.
ANSWERED = 256
#: Entries of a table that are weighed at once.
PIECE = 1 << 18
#: Bytes of texts that are looked up at once.
LOOKUP = 1 << 20
END = np.uint64(1)  # key of the end token
_LN10 = np.log(10.0)


# --- packed arrays ---------------------------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """A sorted uint64 array, or one of counts or probabilities, compressed."""
    raw = np.diff(a, prepend=a.dtype.type(0)).tobytes() if a.dtype == np.uint64 else a.tobytes()
    # Byte planes compress better than whole numbers.
    planes = np.frombuffer(raw, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(b: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], size, "zstd", asbytes=True), np.uint8)
    out = np.frombuffer(planes.reshape(width, -1).T.tobytes(), kind)
    return np.cumsum(out, dtype=np.uint64) if kind is np.uint64 else out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


# --- the model -------------------------------------------------------------------------------------------------------


def strings(raw: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte and the end mark: the preceding bytes, nearest first, then the byte, as one number."""
    a = np.frombuffer(bytes(depth) + raw + b"\xff", np.uint8).astype(np.uint64)
    n = len(raw) + 1
    key = np.zeros(n, np.uint64)
    for j in range(1, depth + 1):
        key = key << np.uint64(8) | a[depth - j : depth - j + n]
    return key << np.uint64(8) | a[depth:]


def _gammaln(x: np.ndarray) -> np.ndarray:
    """log-gamma for x >= 0.5: Stirling's series after shifting x above 8."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] -= np.log(x[low])
        x = x + low
    z = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x


_G_HALF = float(_gammaln(np.array([0.5]))[0])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of Krichevsky and Trofimov's estimate of a sequence with these counts."""
    return _gammaln(n0 + 0.5) + _gammaln(n1 + 0.5) - 2 * _G_HALF - _gammaln(n0 + n1 + 1.0)


_SMALL = 4096
_LG_HALF = _gammaln(np.arange(_SMALL) + 0.5)
_LG_ONE = _gammaln(np.arange(_SMALL) + 1.0)


def _table_log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """``log_kt``, with small counts looked up."""
    total = n0 + n1
    out = _LG_HALF[np.minimum(n0, _SMALL - 1)] + _LG_HALF[np.minimum(n1, _SMALL - 1)] - 2 * _G_HALF - _LG_ONE[np.minimum(total, _SMALL - 1)]
    large = np.flatnonzero(total >= _SMALL)
    out[large] = log_kt(n0[large], n1[large])
    return out


def _starts(a: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], a[1:] != a[:-1]])


def contexts(keys: np.ndarray, counts: np.ndarray, depth: int, lowest: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For the depths ``lowest`` to ``depth``: distinct (context, byte) keys, their counts, and the place of each key of the next depth."""
    out = {depth: (keys, counts, None)}
    for d in range(depth - 1, lowest - 1, -1):
        k, c, _ = out[d + 1]
        short = (k >> np.uint64(16)) << np.uint64(8) | k & np.uint64(255)
        order = np.argsort(short, kind="stable")
        ranked = short[order]
        new = _starts(ranked)
        place = np.empty(len(k), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        first = np.flatnonzero(new)
        out[d] = (ranked[first], np.add.reduceat(c[order], first), place)
    return out


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int, lowest: int, want: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each bit: the nodes of depth ``lowest``, their log weighted probabilities, and (if wanted) the probability of the bit of
    each entry, mixed from ``depth`` up to ``lowest``. One bit's nodes are held at a time."""
    tables = contexts(keys, counts, depth, lowest)
    for i in range(8):
        made: dict[int, tuple] = {}
        below = None  # log products of the children, by the nodes of the depth at hand
        for d in range(depth, lowest - 1, -1):
            k, c, _ = tables[d]
            node = k >> np.uint64(8 - i)
            new = _starts(node)
            first, own = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
            bit = (k >> np.uint64(7 - i)).astype(np.uint8) & np.uint8(1)
            n = np.add.reduceat(c, first)
            n1 = np.add.reduceat(np.where(bit == 1, c, 0), first)
            kt = _table_log_kt(n - n1, n1)
            w, weight = None, kt
            if d < depth:
                up, there = made[d + 1][:2], tables[d][2]
                # The first entry of a deeper node leads to its parent.
                below = np.bincount(own[there[up[0]]], weights=up[1], minlength=len(first))
                w, weight = 1 / (1 + np.exp(np.clip(below - kt, -700, 700))), np.logaddexp(kt, below) - np.log(2)
            made[d] = (first, weight, own, n, n1, w, bit)
        p = None
        if want:
            steps = {depth: np.arange(len(keys), dtype=np.int32)}
            for d in range(depth - 1, lowest - 1, -1):
                steps[d] = tables[d][2][steps[d + 1]]
            for d in range(depth, lowest - 1, -1):
                _, _, own, n, n1, w, bit = made[d]
                at = own[steps[d]]
                ones = n1[at]
                kt = (np.where(bit[steps[d]] == 1, ones, n[at] - ones) + 0.5) / (n[at] + 1.0)
                p = kt if d == depth else w[at] * kt + (1 - w[at]) * p
        first, weight = made[lowest][:2]
        yield (tables[lowest][0] >> np.uint64(8 - i))[first], weight, p


def pieces(keys: np.ndarray, depth: int) -> Iterator[slice]:
    """Slices of a table that hold whole pairs of nearest bytes, of about PIECE entries; a larger pair is a slice of its own."""
    pair = keys >> np.uint64(8 * (depth - 1))
    ends = np.append(np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(keys)) if len(keys) else []
    start = last = 0
    for end in ends:
        if end - start > PIECE and last > start:
            yield slice(start, last)
            start = last
        last = end
    if last > start:
        yield slice(start, last)


class Top:
    """Depths 0 and 1, finished from the sums over shards: byte counts by nearest byte, and log products of depth 2."""

    def __init__(self, counts: np.ndarray, below: np.ndarray):
        # counts: 256 x 256; below: 256 x 256, by leading-bits number 1..255
        n0, n1 = np.zeros((256, 256)), np.zeros((256, 256))
        for i in range(8):
            for bit, to in ((0, n0), (1, n1)):
                for lead in range(1 << i):
                    start = ((lead << 1) | bit) << (7 - i)
                    to[:, (1 << i) | lead] = counts[:, start : start + (1 << (7 - i))].sum(axis=1)
        kt1 = log_kt(n0, n1)
        weighted = np.logaddexp(kt1, below) - np.log(2)
        m0, m1 = n0.sum(axis=0), n1.sum(axis=0)
        kt0, under = log_kt(m0, m1), weighted.sum(axis=0)
        self.w1 = 1 / (1 + np.exp(np.clip(below - kt1, -700, 700)))
        self.w0 = 1 / (1 + np.exp(np.clip(under - kt0, -700, 700)))
        self.p1 = (n1 + 0.5) / (n0 + n1 + 1)
        self.p0 = (m1 + 0.5) / (m0 + m1 + 1)

    def finish(self, keys: np.ndarray, bits: Iterable[np.ndarray], depth: int) -> np.ndarray:
        """log10 of the probability of each entry's byte, from the predictions of depth 2, bit by bit."""
        near = (keys >> np.uint64(8 * depth)).astype(np.int64)
        byte = (keys & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(keys))
        for i, p in enumerate(bits):
            lead = (1 << i) | byte >> (8 - i)
            bit = byte >> (7 - i) & 1
            a = self.p1[near, lead]
            b = self.p0[lead]
            w1, w0 = self.w1[near, lead], self.w0[lead]
            q = w1 * np.where(bit == 1, a, 1 - a) + (1 - w1) * p
            out += np.log(w0 * np.where(bit == 1, b, 1 - b) + (1 - w0) * q)
        return out / _LN10


# --- over a corpus ---------------------------------------------------------------------------------------------------

_BLOBS = "gid long, shard int, words boolean, keys binary, counts binary"


def _shard(keys: np.ndarray, words: bool, shards: int, depth: int) -> np.ndarray:
    return (mix(keys if words else keys >> np.uint64(8 * (depth - 1))) >> np.uint64(20)) % np.uint64(shards)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches as Python values, a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True)


def _gather(docs: DataFrame, shards: int, depth: int) -> DataFrame:
    """Packed distinct strings and words of each group of documents, by shard, with training counts."""
    schema = pa_schema(docs.sparkSession, _BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, waiting, fresh, size = None, {}, {True: [], False: []}, 0, 0

        def settle():
            nonlocal fresh
            for kind in (True, False):
                keys, counts = [], []
                for train in (True, False):
                    own = [k for k, t in waiting[kind] if t is train]
                    if own:
                        u, c = np.unique(np.concatenate(own), return_counts=True)
                        keys.append(u)
                        counts.append(c if train else np.zeros(len(u), np.int64))
                waiting[kind] = []
                k, c = summed(keys, counts)
                to = _shard(k, kind, shards, depth)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(shards + 1, dtype=np.uint64))
                for s in np.flatnonzero(np.diff(ends)).tolist():
                    at = order[ends[s] : ends[s + 1]]
                    parts.setdefault((kind, s), []).append((k[at], c[at]))
                fresh += len(k)
            if fresh >= 4 * LOOKUP:
                compact()

        def compact():
            nonlocal fresh
            for at, held in parts.items():
                if len(held) > 1:
                    parts[at] = [summed([k for k, _ in held], [c for _, c in held])]
            fresh = 0

        def close():
            settle()
            compact()
            rows = [(now, s, kind, pack(k), pack(c)) for (kind, s), ((k, c),) in parts.items()]
            parts.clear()
            yield _batch(rows, schema)

        for gid, train, text in _rows(batches):
            if gid != now:
                if now is not None:
                    yield from close()
                now, size = gid, 0
            raw = lower_bytes(text)
            waiting[False].append((strings(raw, depth), train))
            waiting[True].append((np.append(word_hashes(raw), END), train))
            size += len(raw)
            if size >= LOOKUP:
                settle()
                size = 0
        if now is not None:
            yield from close()

    return docs.select("gid", "train", "text").mapInArrow(run, _BLOBS)


def _merged(blobs: DataFrame, groups: int, n: int) -> DataFrame:
    """shard, words, keys, counts: one row for each table, merged over the groups by a tree of FAN inputs a node.

    A node holds at most FAN packed arrays, each no larger than the table that it is part of; a table's size is the number of its distinct strings.
    """
    ddl = "gid long, shard int, words boolean, keys binary, counts binary"
    schema = pa_schema(blobs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            keys, counts = summed([k for k, _ in held], [c for _, c in held])
            return _batch([(*now, pack(keys), pack(counts.astype(np.int64)))], schema)

        for gid, shard, kind, keys, counts in _rows(batches):
            if (gid, shard, kind) != now:
                if held:
                    yield close()
                now, held = (gid, shard, kind), []
            held.append((unpack(keys, np.uint64), unpack(counts, np.int64)))
            if len(held) >= 8:
                held = [summed([k for k, _ in held], [c for _, c in held])]
        if held:
            yield close()

    while True:
        up = blobs.withColumn("gid", F.floor(F.col("gid") / FAN)).repartition(n, "gid", "shard", "words").sortWithinPartitions("gid", "shard", "words")
        blobs, groups = up.mapInArrow(run, ddl), -(-groups // FAN)
        if groups <= 1:
            return blobs.select("shard", "words", "keys", "counts")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def score(docs: DataFrame, depth: int = DEPTH, folds: int = 7, held_fold: int = 2, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs``."""
    spark = docs.sparkSession
    n = input_partitions(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(total // group) + 1
    dealt = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", folds) != held_fold).alias("train"))
        .withColumn("gid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    )
    # Groups are dealt to tasks in turn, by numbers whose hashes are their own tasks.
    task = F.element_at(F.array(*[F.lit(x) for x in slots(spark, n)]), (F.pmod("gid", F.lit(n)) + 1).cast("int"))
    blobs = cut(_gather(dealt.repartition(n, task).sortWithinPartitions("gid"), n, depth))
    merged = cut(_merged(blobs, groups, n))

    # First pass over the tables: sums for depths 0 and 1, and the words' totals. At most 2 * 65,536 + 2 keys.
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, below, words = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros(2)
        for batch in batches:
            for kind, packed, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, c = unpack(packed, np.uint64), unpack(numbers, np.int64)
                if kind:
                    words += (c.sum(), (c > 0).sum())
                    continue
                np.add.at(counts, ((keys >> np.uint64(8 * depth)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)), c)
                for part in pieces(keys, depth):
                    for i, (node, weight, _) in enumerate(weigh(keys[part], c[part], depth, 2, False)):
                        np.add.at(below, ((node >> np.uint64(8 + i)).astype(np.int64), (1 << i) | (node & np.uint64((1 << i) - 1)).astype(np.int64)), weight)
        flat = np.concatenate([counts.ravel(), below.ravel(), words])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["i", "v"])

    got = merged.select("words", "keys", "counts").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(2 * 65536 + 2)
    if got.num_rows:
        flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
    top = spark.sparkContext.broadcast(Top(flat[:65536].reshape(256, 256), flat[65536 : 2 * 65536].reshape(256, 256)))
    train_tokens, vocabulary = int(flat[-2]), int(flat[-1])

    # Second pass: each group gets the values of its own strings and words. A table goes to every batch of ANSWERED groups; a task
    # holds one table and one group's array at a time.
    value_ddl = "shard int, words boolean, keys binary, answers binary"
    value_schema = pa_schema(spark, value_ddl)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kind, packed, numbers in _rows(batches):
            keys, c = unpack(packed, np.uint64), unpack(numbers, np.int64)
            if kind:
                value = c.astype(np.float64)
            else:
                value = np.empty(len(keys), np.float16)
                for part in pieces(keys, depth):
                    value[part] = top.value.finish(keys[part], (p for _, _, p in weigh(keys[part], c[part], depth, 2, True)), depth)
            yield _batch([(shard, kind, packed, pack(value))], value_schema)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = value = None
        for gid, kind, packed, table in _rows(batches):
            if gid is None:
                keys, value = unpack(packed, np.uint64), unpack(table, np.float64 if kind else np.float16)
            else:
                yield _batch([(gid, None, None, None, kind, packed, pack(value[np.searchsorted(keys, unpack(packed, np.uint64))]))], answer_schema)

    answer_ddl = "gid long, doc_id long, train boolean, text string, words boolean, keys binary, answers binary"
    answer_schema = pa_schema(spark, answer_ddl)
    tables = merged.mapInArrow(values, value_ddl).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit((groups - 1) // ANSWERED)))).withColumn("gid", F.lit(None).cast("long"))
    asked = blobs.select("gid", "shard", "words", "keys", F.lit(None).cast("binary").alias("answers"), F.floor(F.col("gid") / ANSWERED).cast("int").alias("b"))
    met = tables.select(asked.columns).unionByName(asked).repartition(n, "shard", "words", "b").sortWithinPartitions("shard", "words", "b", F.col("gid").asc_nulls_first())
    told = met.select("gid", "words", "keys", "answers").mapInArrow(answers, answer_ddl)
    none = F.lit(None)
    texts = dealt.select("gid", "doc_id", "train", "text", none.cast("boolean").alias("words"), none.cast("binary").alias("keys"), none.cast("binary").alias("answers"))
    met = told.unionByName(texts).repartition(n, task).sortWithinPartitions("gid", F.col("words").asc_nulls_last())
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    schema = pa_schema(spark, ddl)
    norm = float(np.log10(train_tokens + vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, ready, waiting, size = None, {True: [], False: []}, {}, [], 0

        def look(kind: bool, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of the arrays, sorted by key, and the values there."""
            known, value = ready[kind]
            k = np.concatenate(keys)
            order = np.argsort(k)
            return np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in keys])[order], value[np.searchsorted(known, k[order])]

        def close() -> pa.RecordBatch:
            of, c = look(True, [np.append(word_hashes(raw), END) for _, _, raw in waiting])
            tokens = np.bincount(of, minlength=len(waiting))
            known = np.bincount(of[c > 0], minlength=len(waiting))
            base = np.bincount(of, weights=np.log10(c + 1), minlength=len(waiting)) - tokens * norm
            of, v = look(False, [strings(raw, depth) for _, _, raw in waiting])
            s = np.bincount(of, weights=v, minlength=len(waiting))
            bits = -s / np.log10(2) / np.array([len(raw) + 1 for _, _, raw in waiting])
            columns = [[x for x, _, _ in waiting], [not t for _, t, _ in waiting], tokens, known, np.full(len(waiting), train_tokens), base, s, bits]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for gid, doc_id, train, text, kind, keys, value in _rows(batches):
            if gid != now:
                if waiting:
                    yield close()
                now, tables, ready, waiting, size = gid, {True: [], False: []}, {}, [], 0
            if keys is not None:
                tables[kind].append((unpack(keys, np.uint64), unpack(value, np.float64 if kind else np.float16)))
                continue
            if not ready:
                for k in (True, False):
                    a, v = np.concatenate([x for x, _ in tables[k]]), np.concatenate([y for _, y in tables[k]])
                    del tables[k]
                    order = np.argsort(a)
                    a = a[order]
                    ready[k] = (a, v[order])
                    del a, v, order
            raw = lower_bytes(text)
            waiting.append((doc_id, train, raw))
            size += len(raw)
            if size >= LOOKUP:
                yield close()
                waiting, size = [], 0
        if waiting:
            yield close()

    return met.mapInArrow(run, ddl)
