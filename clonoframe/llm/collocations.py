"""Phrase collocations: count tries of depth 3 per shard, serialised sorted, merged by prefix range.

A shard is some 8 MB of texts of one language. Each word position gives the string of at most three words from there to the end of its piece; the sorted distinct strings
with their counts are the shard's trie: the count of a phrase is the sum over the strings that start with it. Tries are written
sorted, in chunks of bounded size, level by level (words, children, counts). Cut points of about equal weight are taken from strings at even gaps from a random place of each chunk
(shards are alike, so their chunks begin at about the same strings, whatever their number); chunks are split there and each range merges its sorted runs. Ranges may end inside a word's or a word pair's children, so no word is too
frequent for a task; the few phrases that such an end divides are summed afterwards. In a merged range the walk from the root
to a phrase gives the counts of its left parts. Right parts are suffix links: the phrase without its first word is looked up among the frequent
phrases (a part is at least as frequent as the whole), and the link of a triple goes on to the link of its pair.

Phrases are compared as bytes, never as hashes; products are decimals of 38 digits. Null or empty texts and texts without words give nothing; null languages are ``und``.
Repeated rows count each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pa_schema

#: Bytes of text of a shard; entries of a chunk; entries, before they are merged, that a range should have; most cut points' candidates that reach the driver.
SHARD, CHUNK, RANGE, SAMPLE = 8 << 20, 1 << 16, 1 << 19, 50_000
#: Strings of a whole chunk that may be cut points.
MARKS = 8
#: Salts of the first of two rankings.
SALTS = 256

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2
_END = re.compile(rb"[.,;:!?\n-\r]")

Run = tuple[pa.Array, np.ndarray, np.ndarray]  # words (binary) in order; (entries, 3) places in them from 1, 0: none; counts


def _sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and each word's place among them."""
    d = words.dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return d.dictionary.take(pa.array(order)), place[d.indices.to_numpy()]


def _summed(w: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``w`` in order, and their summed counts (None: 1 each)."""
    if not len(w):
        return w, np.zeros(0, np.int64)
    bits = int(w.max()).bit_length()
    key = w[:, 0].astype(np.int64)
    if 3 * bits <= 63:
        key = ((key << bits | w[:, 1]) << bits) | w[:, 2]
    else:
        _, pair = np.unique((key << 32) | w[:, 1], return_inverse=True)
        key = (pair << 32) | w[:, 2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key))) if counts is None else np.add.reduceat(counts[order], first)
    return w[order[first]], n.astype(np.int64)


def trie(raw: bytes) -> Run:
    """The sorted run of a lower-cased text, or of texts joined by line ends."""
    data = np.frombuffer(raw, np.uint8)
    kind = _CLASS[data]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return pa.array([], pa.binary()), np.zeros((0, 3), np.int32), np.zeros(0, np.int64)
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    known, ids = _sorted_words(words)
    del data, kind, inside, edge, start, end, words
    w = np.zeros((len(ids), 3), np.int32)
    w[:, 0] = ids + 1
    for k in (1, 2):
        if len(ids) > k:
            w[:-k, k] = np.where(piece[k:] == piece[:-k], ids[k:] + 1, 0)
    w, n = _summed(w, None)
    return known, w, n


def _levels(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new first word, and where a new pair of first words begins."""
    one = np.concatenate([[True], w[1:, 0] != w[:-1, 0]])
    return np.flatnonzero(one), np.flatnonzero(one | np.concatenate([[True], w[1:, 1] != w[:-1, 1]]))


def pack(run: Run) -> bytes:
    """A run level by level: first words with their numbers of pairs, second words with their numbers of triples, third words, counts."""
    words, w, n = run
    used = np.unique(w)
    used = used[used > 0]
    w = np.searchsorted(used, w) + (w > 0)
    one, two = _levels(w)
    own = words.take(pa.array(used - 1))
    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int32)
    raw = own.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if len(own) else b""
    arrays = [
        np.diff(ends), np.diff(w[one, 0], prepend=0), np.diff(np.append(np.searchsorted(two, one), len(two))), w[two, 1], np.diff(np.append(two, len(w))), w[:, 2], n,
    ]
    small = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in arrays]
    head = np.array([[len(a), a.itemsize] for a in small], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in small) + raw)


def unpack(blob: bytes) -> Run:
    data = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(data, "<u8", 14).reshape(7, 2)
    at, arrays = 112, []
    for size, width in head.tolist():
        arrays.append(np.frombuffer(data, f"<u{width}", size, at).astype(np.int64))
        at += size * width
    lengths, first, pairs, second, triples, third, n = arrays
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[at:])])
    w = np.stack([np.repeat(np.repeat(np.cumsum(first), pairs), triples), np.repeat(second, triples), third], axis=1).astype(np.int32)
    return words, w, n


def entry(run: Run, i: int) -> tuple[bytes, ...]:
    """The words of an entry, without the missing ones."""
    return tuple(run[0][k - 1].as_py() for k in run[1][i].tolist() if k)


def split(run: Run, cuts: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Run]]:
    """(number, part) of the parts of a run between cut points; an entry at a cut point belongs to the part after it."""
    words, w, n = run
    lo, hi = 0, len(n)
    if not hi:
        return
    # Only cut points within the run matter; a part's number counts all cut points up to it.
    here = bisect_left(cuts, entry(run, 0))
    while here < len(cuts) and cuts[here] <= entry(run, 0):
        here += 1
    for k in range(here, len(cuts)):
        a, b = lo, hi
        while a < b:  # the first entry that isn't below the cut point
            mid = (a + b) // 2
            a, b = (mid + 1, b) if entry(run, mid) < cuts[k] else (a, mid)
        if a > lo:
            yield k, (words, w[lo:a], n[lo:a])
        lo = a
        if lo == hi:
            return
    yield len(cuts), (words, w[lo:hi], n[lo:hi])


def merge(runs: list[Run]) -> Run:
    """One run of several. The sort is a merge of sorted runs."""
    words, place = _sorted_words(pa.concat_arrays([r[0] for r in runs]))
    at, parts = 0, []
    for r in runs:
        to = np.concatenate([np.zeros(1, np.int32), place[at : at + len(r[0])] + 1])
        parts.append(to[r[1]])
        at += len(r[0])
    w, n = _summed(np.concatenate(parts), np.concatenate([r[2] for r in runs]))
    return words, w, n


def _place(words: pa.Array, word: bytes) -> int:
    """A word's place from 1; 0 if it isn't there."""
    at = bisect_left(range(len(words)), word, key=lambda i: words[i].as_py())
    return at + 1 if at < len(words) and words[at].as_py() == word else 0


NODES = "lang string, w1 string, w2 string, w3 string, f long, l1 long, l2 long, open boolean"


def nodes(run: Run, least: int, ends: list[tuple[bytes, ...]]) -> list[pa.Array]:
    """Columns (w1, w2, w3, f, l1, l2, open) of the phrases of a merged range that occur ``least`` times. ``ends`` are the range's cut points: phrases that start one may go on in another
    range; they are open, whatever their count, and are no left part yet."""
    words, w, n = run
    one, two = _levels(w)
    f1, f2 = np.add.reduceat(n, one), np.add.reduceat(n, two)
    of2 = np.searchsorted(two, np.arange(len(n)), side="right") - 1
    of1 = np.searchsorted(one, two, side="right") - 1
    open1, open2 = np.zeros(len(one), bool), np.zeros(len(two), bool)
    for e in ends:
        if e and (p := _place(words, e[0])):
            open1 |= w[one, 0] == p
            if len(e) > 1 and (q := _place(words, e[1])):
                open2 |= (w[two, 0] == p) & (w[two, 1] == q)
    a = np.flatnonzero(open1 | (f1 >= least))
    b = np.flatnonzero((w[two, 1] > 0) & (open2 | (f2 >= least)))
    c = np.flatnonzero((w[:, 2] > 0) & (n >= least))
    places = np.zeros((len(a) + len(b) + len(c), 3), np.int32)
    places[: len(a), 0] = w[one[a], 0]
    places[len(a) : len(a) + len(b), :2] = w[two[b], :2]
    places[len(a) + len(b) :] = w[c]
    f = np.concatenate([f1[a], f2[b], n[c]])
    no = np.zeros(len(a), np.int64)
    up1 = np.concatenate([no, np.where(open1[of1[b]], 0, f1[of1[b]]), np.where(open1[of1[of2[c]]], 0, f1[of1[of2[c]]])])
    up2 = np.concatenate([no, np.zeros(len(b), np.int64), np.where(open2[of2[c]], 0, f2[of2[c]])])
    texts = [words.take(pa.array(np.maximum(p - 1, 0), mask=p == 0)).cast(pa.string()) for p in places.T]
    return [*texts, pa.array(f), pa.array(up1, mask=up1 == 0), pa.array(up2, mask=up2 == 0), pa.array(np.concatenate([open1[a], open2[b], np.zeros(len(c), bool)]))]


def _pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A text cut at ends of pieces into parts of about ``size`` bytes."""
    at = 0
    while len(raw) - at > size and (m := _END.search(raw, at + size)):
        yield raw[at : m.end()]
        at = m.end()
    yield raw[at:]


def _tries(docs: DataFrame, shard: int, chunk: int) -> DataFrame:
    """(lang, marks, entries, total, blob): the chunks of all shards' tries."""
    ddl = "lang string, marks array<array<binary>>, entries long, total long, blob binary"
    schema = pa_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                whole = trie(b"\n".join(held.pop(lang)))
                for a in range(0, len(whole[2]), chunk):
                    part = whole[0], whole[1][a : a + chunk], whole[2][a : a + chunk]
                    blob = pack(part)
                    gap = max(1, chunk // MARKS)
                    marks = [list(entry(part, i)) for i in range(zlib.crc32(blob) % gap, len(part[2]), gap)]
                    row = lang, marks, len(part[2]), int(part[2].sum()), blob
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    for raw in _pieces((text or "").encode("utf-8", "surrogatepass").lower(), shard):
                        held.setdefault(lang, []).append(raw)
                        size += len(raw)
                        if size >= shard:
                            yield from flush()
                            size = 0
        yield from flush()

    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text").mapInArrow(run, ddl)


def cut_points(tries: DataFrame, per_range: int) -> tuple[int, dict[str, list[tuple[bytes, ...]]]]:
    """The number of ranges, and each language's cut points between them."""
    total, marks = tries.agg(F.sum("entries"), F.sum(F.size("marks"))).first()
    n_ranges = max(1, -(-(total or 0) // per_range))
    points: dict[str, list[tuple[bytes, ...]]] = {}
    if n_ranges > 1 and marks:
        # The sample only balances ranges; results don't depend on it.
        drawn = tries.select("lang", F.explode("marks").alias("mark")).sample(min(1.0, SAMPLE / marks), 7).collect()
        drawn = sorted((r["lang"].encode(), tuple(map(bytes, r["mark"]))) for r in drawn)
        for k in sorted({i * len(drawn) // n_ranges for i in range(1, n_ranges)}):
            if drawn and (not (own := points.setdefault(drawn[k][0].decode(), [])) or own[-1] != drawn[k][1]):
                own.append(drawn[k][1])
    return n_ranges, points


def frequent(docs: DataFrame, least: int, shard: int = SHARD, chunk: int = CHUNK, per_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f, l1, l2) of all phrases of 1 to 3 words that occur ``least`` times (missing words and left parts null), and (lang, n): all words."""
    spark = docs.sparkSession
    tries = cut(_tries(docs, shard, chunk))
    n_ranges, points = cut_points(tries, per_range)
    shared = spark.sparkContext.broadcast(points)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang = batch.column(0)[k].as_py()
                got = [(lang, i, pack(r)) for i, r in split(unpack(batch.column(1)[k].as_py()), shared.value.get(lang, []))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names=["lang", "part", "blob"])

    schema = pa_schema(spark, NODES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if runs:
                cuts = shared.value.get(now[0], [])
                out = nodes(merge(runs), least, cuts[max(0, now[1] - 1) : now[1] + 1])
                runs.clear()
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(out[0]), pa.string()), *out], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if key != now:
                    yield from close()
                    now, runs = key, []
                runs.append(unpack(batch.column(2)[k].as_py()))
        yield from close()

    n_tasks = min(n_ranges, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tries.select("lang", "blob").mapInArrow(deal, "lang string, part long, blob binary").repartition(n_tasks, "lang", "part")
    found = cut(dealt.sortWithinPartitions("lang", "part").mapInArrow(join, NODES))
    words = tries.groupBy("lang").agg(F.sum("total").alias("n"))
    keys = ["lang", "w1", "w2", "w3"]
    divided = found.where("open").groupBy(*keys).agg(F.sum("f").alias("f"), F.max("l1").alias("l1"))
    whole = found.where("not open").select(*keys, "f", "l1", "l2").unionByName(divided.where(F.col("f") >= least).select(*keys, "f", "l1", F.lit(None).cast("long").alias("l2")))
    one = divided.where("w2 is null").select("lang", "w1", F.col("f").alias("o1"))
    two = divided.where("w2 is not null").select("lang", "w1", "w2", F.col("f").alias("o2"))
    full = whole.join(one, ["lang", "w1"], "left").join(two, ["lang", "w1", "w2"], "left")
    l1 = F.when(F.col("w2").isNotNull(), F.coalesce("l1", "o1")).alias("l1")
    return full.select(*keys, "f", l1, F.when(F.col("w3").isNotNull(), F.coalesce("l2", "o2")).alias("l2")), words


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 or 3 words by floor(10**6 a a / (l r)) of their lowest-scoring cut.

    A phrase needs ``least`` occurrences; it goes where a longer phrase that contains it has ``covered`` percent of its occurrences or more.
    """
    full, words = frequent(docs, least, **sizes)
    full = cut(full)
    one = full.where("w2 is null").select("lang", F.col("w1").alias("w2"), F.col("f").alias("r"))
    two = full.where("w2 is not null and w3 is null").join(one, ["lang", "w2"]).select("lang", "w1", "w2", F.col("f").alias("a"), F.col("l1").alias("l"), "r")
    link = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    three = full.where("w3 is not null").join(link, ["lang", "w2", "w3"])
    s1, s2 = _score(F.col("f"), F.col("l1"), F.col("r1")), _score(F.col("f"), F.col("l2"), F.col("r2"))
    three = three.withColumn("s1", s1).withColumn("s2", s2).select(
        "lang", "w1", "w2", "w3", F.col("f").alias("a"), F.when(F.col("s2") < F.col("s1"), F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(F.col("s2") < F.col("s1"), F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    inner = three.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = inner.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("longer"))
    kept = two.join(longer, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rows = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    rows = rows.unionByName(three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's phrases are ranked in salted parts first, so that one task ranks SALTS * top rows at most.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, d, w[i:i + d - 1] AS g FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM s WHERE len(w) > 0), (VALUES (1), (2), (3)) AS t(d) WHERE i + d - 1 <= len(w)
), f AS MATERIALIZED (SELECT lang, d, array_to_string(g, ' ') AS phrase, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE d = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE f >= 10),
sides AS MATERIALIZED (
  SELECT lang, phrase, g, f AS a, k, array_to_string(g[1:k], ' ') AS lp, array_to_string(g[k + 1:], ' ') AS rp FROM (SELECT *, unnest(generate_series(1, d - 1)) AS k FROM c WHERE d >= 2)
), cuts AS (
  SELECT s.lang, s.phrase, s.g, s.a, s.k, l.f AS l, r.f AS r, (1000000::HUGEINT * s.a * s.a) // (l.f * r.f) AS score
  FROM sides s JOIN c l ON l.lang = s.lang AND l.phrase = s.lp JOIN c r ON r.lang = s.lang AND r.phrase = s.rp
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner2 AS (
  SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, array_to_string(g[k:k + 1], ' ') AS phrase, f FROM c, (VALUES (1), (2)) AS t(k) WHERE d = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner2 i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
