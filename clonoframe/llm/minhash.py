"""MinHash near-duplicates: circulant MinHash, banding, exact Jaccard verification.

1. A document's set of word shingles (64-bit hashes) is deduplicated. The first permutation scatters the
   hashes over a circle of 2**20 places; the second, shifted by one place for each coordinate, finds for coordinate k
   the place with the least second-permutation value at the places shifted by k. So the values of one shingle for all
   coordinates are one contiguous piece of the second permutation. The coordinate's value is the least hash at that place, so that
   it names one shingle however large the set is.
2. Rows with equal sets form a class, named by a 128-bit hash of the set; it goes on with its least (doc_id, text hash) and one signature.
3. Bands of the signature are hashed to buckets. Buckets with the same members count once. In each bucket signatures (a byte
   a coordinate) are compared: classes whose sizes and signatures (within ``SIGMAS`` standard deviations) allow a link. The components
   of these possible links are the candidate groups; classes that are alone take no further part.
4. Texts of candidates only, found by a Bloom filter of bounded size in front of an exact join, are shuffled to work units by group,
   and sets are compared exactly in one task: pairs that may be links and aren't connected yet.
5. Components of the verified links give each document's component id.

Buckets and groups that are too large for one task are cut into blocks (``sweep``). First each block is compared in itself and with a hub of
its group. Then what isn't in the group's largest part, the outliers, is compared with all blocks. So every possible
link between different parts is looked at, no pair is emitted but links, and copies of a hub cost one comparison each.

Null or empty texts, and texts without words, have an empty set and are linked with nothing; nor are rows with null ids. Rows that repeat
an id with different texts are compared each by its own text; the component is named by the least id in it. ``n_shingles`` counts distinct 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import filter_of, passes
from .common import cut, input_partitions, pa_schema
from .graph import components
from .shingles import lower_bytes, mix, overlap, shingle_set

PLACES = 20  # bits of the circle
COORDINATES = 160
SIGMAS = 5.5
#: Shingles of a block of a large group, and members of a block of a large bucket, so that a task's memory is bounded.
BLOCK = 400_000
MEMBERS = 4096


@lru_cache(maxsize=1)
def _second() -> tuple[np.ndarray, np.ndarray]:
    """The second permutation, continued past its end, as overlapping pieces of COORDINATES values; and its inverse."""
    p = np.random.default_rng(20).permutation(1 << PLACES).astype(np.uint32)
    inverse = np.empty_like(p)
    inverse[p] = np.arange(len(p), dtype=np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[:COORDINATES]]), COORDINATES), inverse


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least second-permutation value of each coordinate, for a set of shingle hashes (not empty)."""
    pieces, out = _second()[0], None
    places = (hashes >> np.uint64(64 - PLACES)).astype(np.int64)
    for i in range(0, len(places), 2048):
        least = pieces[places[i : i + 2048]].min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def named(hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each coordinate the least hash at its place, mixed: which shingle gave the coordinate. ``hashes`` are sorted."""
    place = (_second()[1][least].astype(np.int64) - np.arange(COORDINATES)) % (1 << PLACES)
    return mix(hashes[np.searchsorted(hashes, place.astype(np.uint64) << np.uint64(64 - PLACES))])


def rows_per_band(similarity: float, miss: float = 1e-8) -> int:
    """The most rows a band may have so that a pair at the threshold shares no band with probability ``miss`` at most."""
    fit = [r for r in range(1, 17) if (1 - similarity**r) ** (COORDINATES // r) <= miss]
    return max(fit, default=1)


def band_hashes(sig: np.ndarray, rows: int) -> list[int]:
    n = len(sig) // rows
    return [
        int.from_bytes(hashlib.blake2b(k.to_bytes(2, "little") + sig[k * rows : (k + 1) * rows].tobytes(), digest_size=8).digest(), "little", signed=True)
        for k in range(n)
    ]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def set_name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, node (the set's name; null for the empty set), sig (bytes), bands of every row."""
    rows = rows_per_band(similarity)
    ddl = "doc_id long, th long, n_shingles long, node binary, sig binary, bands array<long>"
    schema = pa_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, n, nodes, sigs, bands = batch.slice(start, 512), [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingle_set(lower_bytes(text), words)
                    n.append(len(s))
                    sig = named(s, signature(s)) if len(s) else None
                    nodes.append(None if sig is None else set_name(s))
                    sigs.append(None if sig is None else sig.astype(np.uint8).tobytes())
                    bands.append([] if sig is None else band_hashes(sig, rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()), part.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text").mapInArrow(run, ddl)


def _percent(similarity: float) -> int:
    return round(similarity * 100)


class Parts:
    """Disjoint parts of a unit's members; members of one known component start in one part."""

    def __init__(self, known: list):
        first: dict = {}
        self.up = [first.setdefault(p, i) for i, p in enumerate(known)]

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def may_link(sizes: np.ndarray, sigs: np.ndarray, i: int, to: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the members ``to`` may be linked with member i by size and signature, and how alike they look."""
    n, o = sizes[i], sizes[to]
    percent = round(similarity * 100)
    to = to[100 * np.minimum(n, o) >= percent * np.maximum(n, o)]
    if not len(to):
        return to, np.zeros(0)
    alike = (sigs[to] == sigs[i]).mean(axis=1)
    fits = alike >= similarity - SIGMAS * np.sqrt(similarity * (1 - similarity) / COORDINATES)
    return to[fits], alike[fits]


def near(sizes: np.ndarray, sigs: np.ndarray, outlier: np.ndarray, known: list, similarity: float, confirm=None) -> list[tuple[int, int]]:
    """Links that connect the members of one unit: pairs with an outlier, not connected yet, that may be links and that ``confirm`` holds."""
    parts, links = Parts(known), []
    m = len(sizes)
    label = parts.labels()
    for i in range(m - 1):
        rest = np.arange(i + 1, m)
        rest = rest[label[rest] != label[i]]
        if not outlier[i]:
            rest = rest[outlier[rest]]
        if not len(rest):
            continue
        to, alike = may_link(sizes, sigs, i, rest, similarity)
        new = False
        for j in to[np.argsort(-alike, kind="stable")].tolist():
            if parts.find(i) != parts.find(j) and (confirm is None or confirm(i, j)):
                new = parts.join(i, j)
                links.append((i, j))
        if new:
            label = parts.labels()
    return links


_LINKS = "a binary, b binary"


def _by_unit(units: DataFrame, columns: list[str], meet) -> DataFrame:
    """Links (a, b) that ``meet(rows)`` finds in each unit's distinct members; ``rows``: node, _part, _outlier, then ``columns``."""
    schema = pa_schema(units.sparkSession, _LINKS)
    names = ["_unit", "node", "_part", "_outlier", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, {}, []

        def close():
            return meet(list(held.values())) if len(held) > 1 else []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for unit, *row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if unit != now:
                        found += close()
                        now, held = unit, {}
                    if row[0] not in held:
                        held[row[0]] = row
            if found:
                yield emit()
                found = []
        found += close()
        if found:
            yield emit()

    n = input_partitions(units.sparkSession)
    return units.select(*names).repartition(n, "_unit").sortWithinPartitions("_unit", "node").mapInArrow(run, _LINKS)


def _meet_signatures(similarity: float):
    def meet(rows: list) -> list[tuple[bytes, bytes]]:
        nodes, parts, outlier, n, sigs = zip(*rows, strict=True)
        got = near(np.array(n), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(rows), -1), np.array(outlier), parts, similarity)
        return [(nodes[i], nodes[j]) for i, j in got]

    return meet


def _meet_texts(words: int, similarity: float):
    percent = round(similarity * 100)

    def meet(rows: list) -> list[tuple[bytes, bytes]]:
        # The exact join is by doc_id and a 64-bit hash of the text; a text with another set isn't the one that is meant.
        rows = [(node, part, outlier, s) for node, part, outlier, text in rows if set_name(s := shingle_set(lower_bytes(text), words)) == node]
        if len(rows) < 2:
            return []
        nodes, parts, outlier, sets = zip(*rows, strict=True)
        sizes = np.array([len(s) for s in sets])
        sigs = np.stack([named(s, signature(s)).astype(np.uint8) for s in sets])

        def confirm(i: int, j: int) -> bool:
            both = overlap(sets[i], sets[j])
            return 100 * both >= percent * int(sizes[i] + sizes[j] - both)

        return [(nodes[i], nodes[j]) for i, j in near(sizes, sigs, np.array(outlier), parts, similarity, confirm)]

    return meet


def sweep(members: DataFrame, capacity: int, meet) -> DataFrame:
    """Links (a, b) that connect whatever in each group can be linked. ``members``: grp, node, w (weight), rank (the hub has the most).

    ``meet(units)`` gives the links of units (_unit, node, _part, _outlier). Groups beyond ``capacity`` are met block by block.
    """
    sizes = members.groupBy("grp").agg((F.floor(F.sum("w") / capacity) + 1).alias("blocks"), F.max(F.struct("rank", "node")).alias("_h")).select(
        "grp", "blocks", F.col("_h.node").alias("hub")
    )
    placed = cut(members.join(sizes, "grp").select("node", "grp", "blocks", "hub", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")))
    first = placed.select(
        "node", "grp",
        F.explode(F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("block"),
    ).select("node", F.struct("grp", "block", F.col("block").alias("other")).alias("_unit"), F.col("node").alias("_part"), F.lit(True).alias("_outlier"))
    got = cut(meet(first))
    many = placed.where("blocks > 1")
    if many.isEmpty():
        return got
    parts = components(got)
    in_part = cut(
        many.join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "grp", "blocks", "block", F.coalesce("component", "node").alias("part"))
    )
    counts = in_part.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("grp").agg(F.max(F.struct("k", "part")).alias("m")).select("grp", F.col("m.part").alias("main"))
    mark = in_part.join(main, "grp").withColumn("outlier", F.col("part") != F.col("main"))
    # Outlier blocks: again of bounded size. Each outlier block meets each block of its group once.
    per = mark.groupBy("grp").agg(F.count(F.when(F.col("outlier"), 1)).alias("o"), F.count(F.lit(1)).alias("all"), F.first("blocks").alias("_b")).where("o > 0").select(
        "grp", F.ceil(F.col("o") * F.col("_b") / F.col("all")).cast("int").alias("outer")
    )
    joined = mark.join(per, "grp").withColumn("ob", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("outer")))
    # All members go to the units (own block, every outlier block); outliers also to (every block, own outlier block).
    inner = joined.select("node", "grp", "part", "outlier", F.col("block").cast("long").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer").cast("long") - 1)).alias("y"))
    across = joined.where("outlier").select("node", "grp", "part", "outlier", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("x"), F.col("ob").cast("long").alias("y"))
    second = inner.unionByName(across).distinct().select("node", F.struct("grp", F.col("x").alias("block"), F.col("y").alias("other")).alias("_unit"), F.col("part").alias("_part"), F.col("outlier").alias("_outlier"))
    return got.union(cut(meet(second)))


def _possible(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) whose components hold all pairs that share a bucket and may be linked by size and signature."""
    # Dealt once by band, read by the aggregation and by the join. A hot bucket is one of the bands of its members only.
    spread = classes.select(F.xxhash64("node").alias("k"), F.explode("bands").alias("band")).repartition(input_partitions(classes.sparkSession), "band")
    # A bucket is named by its members, so that bands with the same members count once.
    buckets = (
        spread.groupBy("band").agg(F.min("k").alias("m"), F.count(F.lit(1)).alias("c"), F.sum(F.col("k").cast("decimal(38,0)")).alias("x"))
        .where("c > 1").select("band", F.xxhash64("m", "c", "x").alias("grp"))
    )
    inside = spread.join(buckets, "band").select("grp", "k").distinct()
    members = inside.join(classes.select(F.xxhash64("node").alias("k"), "node"), "k").select("grp", "node", F.lit(1).alias("w"), F.lit(0).alias("rank"))
    looks = classes.select("node", "n", "sig")
    return sweep(members, MEMBERS, lambda units: _by_unit(units.join(looks, "node"), ["n", "sig"], _meet_signatures(similarity)))


def _classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, th, n_shingles, node), and for each class its component: node, cid, cth (the component's least doc_id and text hash)."""
    table = cut(signed(docs, words, similarity))
    own = table.where("node is not null and doc_id is not null")
    classes = cut(
        own.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    maybe = cut(_possible(classes, similarity))
    groups = cut(components(maybe))
    ranks = maybe.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("rank"))
    members = (
        classes.select("node", F.col("n").alias("w"), "rep").join(groups, "node").join(ranks, "node", "left")
        .select(F.col("component").alias("grp"), "node", "w", F.coalesce("rank", F.lit(0)).alias("rank"), "rep")
    )
    members = cut(members)
    where = members.select("node", F.col("rep.doc_id").alias("_i"), F.col("rep.th").alias("_t"))
    bloom = filter_of(where.select(F.xxhash64("_i", "_t").alias("h")))

    def texts(nodes: DataFrame) -> DataFrame:
        found = docs.select("doc_id", "text", text_hash(F.col("text")).alias("th")).where(passes(bloom, F.xxhash64("doc_id", "th")))
        return nodes.join(where, "node").join(found, (F.col("_i") == F.col("doc_id")) & (F.col("_t") == F.col("th")))

    links = sweep(members.select("grp", "node", "w", "rank"), BLOCK, lambda units: _by_unit(texts(units), ["text"], _meet_texts(words, similarity)))
    parts = cut(components(links))
    linked_classes = members.select("node", "rep").join(parts, "node")
    least = linked_classes.groupBy("component").agg(F.min("rep").alias("c"))
    moved = linked_classes.join(least, "component").select("node", "c")
    all_classes = classes.select("node", "rep").join(moved, "node", "left").select("node", F.coalesce("c", "rep").alias("c"))
    return table.select("doc_id", "th", "n_shingles", "node"), all_classes.select("node", F.col("c.doc_id").alias("cid"), F.col("c.th").alias("cth"))


def linked(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    table, classes = _classes(docs, words, similarity)
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id"))
    return table.join(classes, "node", "left").select("doc_id", "n_shingles", cid.alias("component_id"), cid.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with its columns.

    Of each group the row with the least doc_id (equal ids: the least text hash) stays; rows that repeat both id and text count
    as one. Rows without doc_id all stay. Only rows that may go are shuffled: a Bloom filter of their keys lets the others pass.
    """
    cols = docs.columns
    table, classes = _classes(docs, words, similarity)
    own = table.where("doc_id is not null").groupBy("doc_id", "th").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("k"))
    stays = F.col("cid").isNull() | ((F.col("cid") == F.col("doc_id")) & (F.col("cth") == F.col("th")))
    suspects = cut(own.join(classes, "node", "left").select("doc_id", "th", stays.alias("stays"), "k").where("k > 1 or not stays"))
    bloom = filter_of(suspects.select(F.xxhash64("doc_id", "th").alias("h")))
    rows = docs.select(F.struct(*cols).alias("row")).withColumn("th", text_hash(F.col("row.text")))
    doubt = F.col("row.doc_id").isNotNull() & passes(bloom, F.xxhash64("row.doc_id", "th"))
    marked = suspects.select(F.struct("doc_id", "th", "stays").alias("s"))
    met = rows.where(doubt).join(marked, (F.col("row.doc_id") == F.col("s.doc_id")) & (F.col("th") == F.col("s.th")), "left").where("s is null or s.stays")
    nth = F.row_number().over(Window.partitionBy("s.doc_id", "s.th").orderBy("th"))
    once = met.where("s is null").select("row").union(met.where("s is not null").withColumn("nth", nth).where("nth = 1").select("row"))
    return rows.where(~doubt).select("row").union(once).select(*[F.col(f"row.`{c}`").alias(c) for c in cols])


#: op2's whole result in SQL: every pair that shares a shingle is counted, components come by recursion. For small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
