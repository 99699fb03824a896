"""Alignment of two tokenizers' tokens: a dangling-suffix transducer over token bytes.

Tokens of both sides are read in turn; the state is which side leads and by which unmatched bytes (the residual). The lagging side gives the next token: it shortens the
residual, or passes it and leads from there. Transitions are memoised by state and token. An empty residual closes a group.
Every token that is read against a residual overlaps the token that the residual belongs to, which gives the links.

Texts are cut before spaces that follow another sign than white space, where the spaces are not at the end of the text. Side A's pattern has no match over such
a place, and no piece of side B has a space after another sign (checked when the model is loaded), so both sides' tokens end there and
the segments' tokens in a row are the text's. Each distinct segment of a block is encoded once, and all of them are aligned together, one token of each at a time.

A block is some megabytes of texts in one task. Blocks, with each text's distinct linked id pairs, are written once. An id pair's count sums the blocks' own counts;
texts then meet slices of the counts of bounded size, so no table is broadcast and no text's pairs become rows.

Null and empty texts, and texts whose tokens don't join to the text again, have no tokens: zeros and an empty digest. Repeated rows and ids count each. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pa_schema

#: Characters of text of a block; id pairs of a slice; bytes of packed pairs that meet a slice in a task.
BLOCK, SLICE, MEET = 16 << 20, 2 << 20, 32 << 20
#: Multiplier of A's ids in a pair's key.
BASE = 1 << 20

_CUT = re.compile(r"(?<=\S)(?= +[^ ])")


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable signs of Latin-1 stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Aligns many token rows at once by memoised transitions. ``a`` and ``b``: bytes of each side's tokens, by id.

    A state is which side leads and its residual; state 0 has none. Transitions are kept as sorted keys (state, token) and their next states; -1 where the bytes differ.
    """

    def __init__(self, a, b, limit: int = 1_000_000):
        self.bytes = (a, b)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number = {(0, b""): 0}
        self.states = [(0, b"")]
        self.leads = np.zeros(1024, np.int8)
        self.keys, self.next = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.recent: dict[int, int] = {}
        self.starts = np.full(BASE, -1, np.int64)

    def state(self, lead: int, rest: bytes) -> int:
        if not rest:
            return 0
        n = self.number.setdefault((lead, rest), len(self.states))
        if n == len(self.states):
            self.states.append((lead, rest))
            if n == len(self.leads):
                self.leads = np.concatenate([self.leads, np.zeros(n, np.int8)])
            self.leads[n] = lead
        return n

    def step(self, key: int) -> int:
        """The state after the lagging side has given a token."""
        if key not in self.recent:
            lead, rest = self.states[key // BASE]
            got = self.bytes[1 - lead][key % BASE]
            if rest.startswith(got):
                self.recent[key] = self.state(lead, rest[len(got) :])
            else:
                self.recent[key] = self.state(1 - lead, got[len(rest) :]) if got.startswith(rest) else -1
        return self.recent[key]

    def begin(self, tokens: np.ndarray) -> np.ndarray:
        """States in which side A leads by a whole token."""
        for t in np.unique(tokens[self.starts[tokens] < 0]).tolist():
            self.starts[t] = self.state(0, self.bytes[0][t])
        return self.starts[tokens]

    def follow(self, keys: np.ndarray) -> np.ndarray:
        if len(self.recent) > 4096:
            more = np.array(list(self.recent.items()), np.int64)
            every = np.concatenate([self.keys, more[:, 0]])
            order = np.argsort(every, kind="stable")
            self.keys, self.next, self.recent = every[order], np.concatenate([self.next, more[:, 1]])[order], {}
        out = np.full(len(keys), -2, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.next[at], -2)
        unknown = np.flatnonzero(out == -2)
        if len(unknown):
            new, which = np.unique(keys[unknown], return_inverse=True)
            out[unknown] = np.array([self.step(k) for k in new.tolist()], np.int64)[which]
        return out

    def align(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows ``a[a_at[r]:a_at[r + 1]]`` and ``b`` likewise: whether a row's bytes agree, (row, end in a, end in b) of each group, and (row, A id, B id) of each link, by row."""
        if len(self.keys) + len(self.recent) > self.limit or len(self.states) > self.limit:
            self.clear()
        tokens, ends, at = (a, b), (a_at[1:], b_at[1:]), [a_at[:-1].copy(), b_at[:-1].copy()]
        n = len(a_at) - 1
        state, last, good = np.zeros(n, np.int64), np.zeros((2, n), np.int64), np.ones(n, bool)
        groups, links = [np.zeros((3, 0), np.int64)], [np.zeros((3, 0), np.int64)]
        active = np.arange(n)
        while len(active) > FEW:
            fresh = active[state[active] == 0]
            ended = fresh[at[0][fresh] == ends[0][fresh]]
            good[ended] = at[1][ended] == ends[1][ended]
            fresh = fresh[at[0][fresh] < ends[0][fresh]]
            last[0][fresh] = a[at[0][fresh]]
            state[fresh] = self.begin(last[0][fresh])
            at[0][fresh] += 1
            active = active[state[active] > 0]
            lag = 1 - self.leads[state[active]]
            stays = np.ones(len(active), bool)
            for side in (0, 1):
                own = active[lag == side]
                left = at[side][own] < ends[side][own]
                good[own[~left]] = False
                stays[lag == side] = left
                own = own[left]
                last[side][own] = tokens[side][at[side][own]]
                at[side][own] += 1
            active, lag = active[stays], lag[stays]
            links.append(np.stack([active, last[0][active], last[1][active]]))
            state[active] = self.follow(state[active] * BASE + np.where(lag == 0, last[0][active], last[1][active]))
            closed = active[state[active] == 0]
            groups.append(np.stack([closed, at[0][closed], at[1][closed]]))
            good[active[state[active] < 0]] = False
            active = active[state[active] >= 0]
        for r in active.tolist():
            # The few longest rows go on one by one.
            now, i, j, own, out = int(state[r]), int(at[0][r]), int(at[1][r]), [], []
            x, y = (int(v[r]) for v in last)
            while now >= 0:
                if now == 0:
                    if i == a_at[r + 1]:
                        break
                    x, i = int(a[i]), i + 1
                    now = int(self.begin(np.array([x]))[0])
                    continue
                if self.leads[now]:
                    if i == a_at[r + 1]:
                        now = -1
                        break
                    x, i = int(a[i]), i + 1
                else:
                    if j == b_at[r + 1]:
                        now = -1
                        break
                    y, j = int(b[j]), j + 1
                out.append((r, x, y))
                now = self.step(now * BASE + (x if self.leads[now] else y))
                if now == 0:
                    own.append((r, i, j))
            good[r] = now == 0 and j == b_at[r + 1]
            groups.append(np.array(own, np.int64).reshape(-1, 3).T)
            links.append(np.array(out, np.int64).reshape(-1, 3).T)

        def by_row(parts: list[np.ndarray]) -> np.ndarray:
            whole = np.concatenate(parts, axis=1)
            whole = whole[:, good[whole[0]]]
            return whole[:, np.argsort(whole[0], kind="stable")]

        return good, by_row(groups), by_row(links)


#: Rows left at which they go on one by one.
FEW = 16


def written(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of groups as text, one after another, and where each row's text begins: decimal ids, ``,`` between a side's ids, ``|`` between sides and ``;`` after each group."""
    n = len(a_at) - 1
    # Tokens in the order of the text: by group, A's before B's.
    row, a_end, b_end = groups
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    a_from, b_from = (np.where(first, at[row], np.concatenate([[0], end[:-1]]) if len(end) else end) for at, end in ((a_at, a_end), (b_at, b_end)))
    n_a, n_b = a_end - a_from, b_end - b_from
    size = np.stack([n_a, n_b], axis=1).ravel()
    source = np.stack([a_from, b_from + len(a)], axis=1).ravel()
    start = np.cumsum(size) - size
    place = np.repeat(source - start, size) + np.arange(size.sum())
    ids = np.concatenate([a, b])[place]
    sign = np.full(len(ids), ord(","), np.uint8)
    ends = np.cumsum(size) - 1
    sign[ends[0::2]], sign[ends[1::2]] = ord("|"), ord(";")
    digits = 1 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000) + (ids >= 100_000) + (ids >= 1_000_000)
    end = np.cumsum(digits + 1)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = sign
    rest, at = ids.copy(), end - 2
    for k in range(int(digits.max(initial=0))):
        here = digits > k
        out[at[here] - k] = 48 + rest[here] % 10
        rest //= 10
    tokens = np.bincount(row, n_a + n_b, n).astype(np.int64)
    return out, np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(tokens)])]


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.fromiter((t for r in rows for t in r), np.int64, int(at[-1])), at


class Pair:
    """Two tokenizers with their tokens' bytes, and the transducer between them."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        with open(a_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        sign = byte_of_sign()
        a_bytes = {i: bytes(sign[c] for c in t) for t, i in vocabulary.items() if all(c in sign for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        hexed = re.compile("<0x([0-9A-F]{2})>")
        b_bytes = [bytes([int(m[1], 16)]) if (m := hexed.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.transducer = Transducer(a_bytes, b_bytes)
        self.a_lengths = np.zeros(max(a_bytes) + 1, np.int64)
        for i, t in a_bytes.items():
            self.a_lengths[i] = len(t)

    def segments(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both sides' ids of segments, each with its ends. Side B puts a space in front itself."""
        a, b = [], []
        for i in range(0, len(wanted), 4096):
            part = wanted[i : i + 4096]
            a.append(_ragged([e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]))
            b.append(_ragged(self.b.encode([s[1:] for s in part], num_threads=1)))
        return *_joined(a), *_joined(b)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    before = np.cumsum([0, *(len(p) for p, _ in parts)])
    return np.concatenate([p for p, _ in parts]), np.concatenate([[0], *(at[1:] + n for (_, at), n in zip(parts, before, strict=False))])


@lru_cache(maxsize=2)
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


def block_rows(both: Pair, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """For each text (n_a, n_b, n_groups, n_links, digest); then each text's number of distinct pairs, and their keys (sorted within a text) and numbers of links, text by text."""
    number: dict[str, int] = {}
    split = [np.array([number.setdefault(s, len(number)) for s in both.segments(t)], np.int32) if t else None for t in texts]
    wanted = list(number)
    number.clear()
    a, a_at, b, b_at = both.encode(wanted)
    good, groups, links = both.transducer.align(a, a_at, b, b_at)
    # Side B's bytes are those of side A, as they align; side A's are the segment's, if they are as many: it never changes a byte, it could only leave some out.
    length = np.fromiter((len(s.encode("utf-8", "surrogatepass")) for s in wanted), np.int64, len(wanted))
    good &= np.add.reduceat(np.append(both.a_lengths[a], 0), a_at[:-1]) == length if len(wanted) else good
    n = len(wanted)
    raw, raw_at = written(a, a_at, b, b_at, groups)
    raw = raw.tobytes()
    count = np.stack([np.diff(a_at), np.diff(b_at), np.bincount(groups[0], minlength=n)], axis=1)
    # A segment's distinct pairs and how often each is linked.
    key = links[1] * BASE + links[2]
    order = np.lexsort((key, links[0]))
    seg, key = links[0][order], key[order]
    start = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    times_in = np.diff(np.append(start, len(key)))
    seg, key = seg[start], key[start]
    n_keys = np.bincount(seg, minlength=n)
    first = np.cumsum(n_keys) - n_keys
    rows, sizes, keys, counts = [], [], [], []
    for own in split:
        if own is None or not good[own].all():
            rows.append((0, 0, 0, 0, ""))
            sizes.append(0)
            continue
        digest = hashlib.sha256()
        for i in range(0, len(own), 65536):
            part = own[i : i + 65536]
            text = b"".join([raw[p:q] for p, q in zip(raw_at[part].tolist(), raw_at[part + 1].tolist(), strict=True)])
            digest.update(text if i + 65536 < len(own) else text[:-1])
        used, times = np.unique(own, return_counts=True)
        m = n_keys[used]
        at = np.repeat(first[used] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        k, v = key[at], times_in[at] * np.repeat(times, m)
        order = np.argsort(k)
        k, v = k[order], v[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        k, v = k[start], np.add.reduceat(v, start) if len(start) else v
        n_a, n_b, n_groups = (times @ count[used]).tolist()
        rows.append((n_a, n_b, n_groups, int(v.sum()), digest.hexdigest()))
        sizes.append(len(k))
        keys.append(k)
        counts.append(v)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return rows, np.array(sizes, np.int64), join(keys), join(counts)


def _pack(sizes: np.ndarray, keys: np.ndarray, links: np.ndarray) -> bytes:
    """Sizes, keys as steps within a text, and links, packed."""
    steps = np.diff(keys, prepend=0)
    start = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[start] = keys[start]
    high, low = (steps >> 20).astype("<u2"), (steps & (BASE - 1)).astype("<u4")
    # Few steps need all bits: bytes of one kind lie together.
    raw = b"".join([sizes.astype("<u4").tobytes(), high.tobytes(), np.ascontiguousarray(low.view(np.uint8).reshape(-1, 4).T[:3]).tobytes(), links.astype("<u4").tobytes()])
    return np.array([len(sizes), len(keys)], "<u8").tobytes() + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each entry, key, links)."""
    m, n = np.frombuffer(blob, "<u8", 2).tolist()
    raw = zstandard.ZstdDecompressor().decompress(blob[16:])
    sizes = np.frombuffer(raw, "<u4", m).astype(np.int64)
    high = np.frombuffer(raw, "<u2", n, 4 * m).astype(np.int64)
    low = np.frombuffer(raw, np.uint8, 3 * n, 4 * m + 2 * n).reshape(3, n).astype(np.int64)
    total = np.cumsum((high << 20) + low[0] + (low[1] << 8) + (low[2] << 16))
    start = (np.cumsum(sizes) - sizes)[sizes > 0]
    before = np.where(start > 0, total[start - 1], 0)
    keys = total - np.repeat(before, sizes[sizes > 0])
    return np.repeat(np.arange(m), sizes), keys, np.frombuffer(raw, "<u4", n, 4 * m + 5 * n).astype(np.int64)


BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary"


def _blocks(docs: DataFrame, a_file: str, b_file: str, size: int) -> DataFrame:
    schema = pa_schema(docs.sparkSession, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_file, b_file)
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            rows, *entries = block_rows(both, texts)
            values = number, ids, *(list(c) for c in zip(*rows, strict=True)), _pack(*entries)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    held += len(text or "") + 64
                    if held >= size:
                        yield from close()
                        number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def _counts(blocks: DataFrame) -> DataFrame:
    """(key, n, best): how many texts hold a pair, and whether no other pair of its A id is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                keys, n = np.unique(_unpack(blob.as_py())[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    per = blocks.select("pairs").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("key", 20)))
    return per.select("key", "n", (F.col("n") == most).alias("best"))


def _answers(blocks: DataFrame, counts: DataFrame, slice_: int, meet: int) -> DataFrame:
    """(block, at, n_best, count_sum) of each text with links: blocks meet slices of the counts in cells."""
    spark = blocks.sparkSession
    n_slices = max(1, -(-counts.count() // slice_))
    n_bytes = blocks.agg(F.coalesce(F.sum(F.octet_length("pairs")), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_groups = max(1, -(-n_bytes // (meet * n_slices)), -(-tasks // n_slices))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).to_numpy() % n_slices
            for s in np.unique(of):
                part = b.filter(pa.array(of == s))
                raw = b"".join(part.column(c).cast(t).to_numpy(zero_copy_only=False).astype(d).tobytes() for c, t, d in ((0, pa.int64(), "<i8"), (1, pa.int64(), "<i8"), (2, pa.int8(), "i1")))
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([zstandard.compress(raw, 3)])], names=["s", "n", "blob"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, keys, links = _unpack(blob.as_py())
                size = np.frombuffer(blob.as_py(), "<u8", 1).tolist()[0]
                for s in range(n_slices):
                    mine = keys % n_slices == s
                    if mine.any():
                        sizes = np.bincount(at[mine], minlength=size)
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block]), pa.array([_pack(sizes, keys[mine], links[mine])])], names=["s", "n", "blob"])

    table = counts.mapInArrow(slices, "s int, n long, blob binary").select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("g"), F.lit(0).alias("tag"), "n", "blob")
    asked = blocks.select("block", "pairs").mapInArrow(parts, "s int, n long, blob binary").select("s", F.pmod(F.shiftright("n", 32) + F.col("n"), F.lit(n_groups)).alias("g"), F.lit(1).alias("tag"), "n", "blob")
    dealt = table.unionByName(asked).repartition(n_slices * n_groups, "s", "g").sortWithinPartitions("s", "g", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            for s, g, tag, n, blob in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4), strict=True):
                if (s, g) != now:
                    now, held, ready = (s, g), [], None
                if tag == 0:
                    raw = zstandard.decompress(blob.as_py())
                    held.append((np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "i1", n, 16 * n)))
                    continue
                if ready is None:
                    key, count, best = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(key)
                    ready, held = (key[order], count[order], best[order].astype(np.int64)), []
                at, keys, links = _unpack(blob.as_py())
                place = np.searchsorted(ready[0], keys)
                texts, which = np.unique(at, return_inverse=True)
                best, total = np.zeros((2, len(texts)), np.int64)
                np.add.at(best, which, links * ready[2][place])
                np.add.at(total, which, links * ready[1][place])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(texts), n), texts, best, total)], names=["block", "at", "n_best", "count_sum"])

    return dealt.mapInArrow(run, "block long, at long, n_best long, count_sum long")


def align(docs: DataFrame, a_file: str, b_file: str, block: int = BLOCK, slice_: int = SLICE, meet: int = MEET) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text."""
    blocks = cut(_blocks(docs, a_file, b_file, block))
    counts = cut(_counts(blocks))
    got = _answers(blocks, counts, slice_, meet).groupBy("block", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = blocks.select("block", F.posexplode(F.arrays_zip(*names)).alias("at", "row")).select("block", F.col("at").cast("long").alias("at"), "row.*")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(got, ["block", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
