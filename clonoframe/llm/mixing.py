"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

A document of source s is worth ``target(s) / size(s)`` copies: the whole part for sure, the fraction by rounding. Rounding
takes two partners and moves mass, in words, from one to the other until one of the two has a whole
number; which way is drawn so that every expectation stays, and words are kept exactly by each step.

1. The ``CHUNK`` largest documents of a source are settled one after another, the largest first; each one's partner is the pool of all smaller
   documents of the source, which have one rate in common. So a long document's fraction is made up for by many short ones, not left
   to the end.
2. The other documents are dealt into chunks of at most ``CHUNK`` by (source, hash of the row); in a chunk each document's partner is the pool
   of the smaller ones of the chunk. What is left of a chunk is one document, as a rule among its smallest.
3. These residuals are dealt into chunks again and rounded pair by pair, and so on: a reduction tree whose depth is the
   logarithm of the largest source's documents. A hot source has proportionally more buckets.

A source's total misses its target by less than the one document that is left at the end and drawn alone. A pool's rate stays between 0 and ``most``, rounded up.
Draws are hashes of the seed, the level and the documents, so reruns agree. Only ids, sources and sizes are shuffled.

Null texts have size 0; documents of size 0 and sources without words take nothing. Null sources form one source, the
last. Rows that agree in doc_id, source and size are interchangeable: copies go to them in the order of their texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, input_partitions

CHUNK = 256
#: Sources whose targets are broadcast; beyond that many they are joined by a shuffle, which adaptive execution splits at hot sources.
BROADCAST_SOURCES = 100_000
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
MOST = 3.0


def size_of(text: Column) -> Column:
    """Number of words: runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, source_docs, target: words for each source; one row a source.

    Sources by code point, null last, weigh ``weights`` in turn, and share ``share`` of all sizes; a target above ``most``
    times its source's size stops there and the excess is shared again by weight. That ends at target =
    min(most * size, level * weight) for one level, which rises from sum to sum until no more source stops.
    """
    spark = sized.sparkSession
    n = input_partitions(spark)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    # One row a source from here on. Ranks: by ranges of sources, each range counted; a range's offset is the count of those before it.
    per = cut(per.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["count"] for r in per.groupBy("_p").count().collect()}  # one row a range
    if not counts:
        return per.select("source", "source_size", "source_docs", F.lit(0.0).alias("target"))
    offsets = F.array(*[F.lit(sum(k for q, k in counts.items() if q < p)) for p in range(max(counts) + 1)])
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((inside + F.element_at(offsets, F.col("_p") + 1)) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    per = cut(per.withColumn("_w", w).withColumn("_cap", cap))
    total, free = per.agg(F.sum("source_size"), F.sum("_w")).first()
    total = float(total) * share
    level, before = total / free, None
    while level != before:
        before = level
        stops = F.col("_cap") <= F.col("_w") * F.lit(level)
        held, free = per.agg(F.sum(F.when(stops, F.col("_cap"))), F.sum(F.when(~stops, F.col("_w")))).first()
        if not free:
            break
        level = max(level, (total - (held or 0.0)) / free)
    return per.select("source", "source_size", "source_docs", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def _draw(seed: int, level: int, a: Column, b: Column) -> Column:
    """A number in [0, 1) from the seed, the level and two documents."""
    h = F.xxhash64(F.lit(seed), F.lit(level), a, b)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Pivotal rounding of an array of (doc_id, size, whole, x): the decided ones and what is left of the last."""
    kind = "struct<doc_id:bigint,size:bigint,whole:bigint,x:double>"
    none = F.lit(None).cast(kind)

    def put(item: Column, x: Column) -> Column:
        return F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["whole"].alias("whole"), x.alias("x"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["held"]
        sa, sb = a["size"].cast("double"), b["size"].cast("double")
        up = F.least((1 - a["x"]) * sa, b["x"] * sb)  # words that can go from b to a
        down = F.least(a["x"] * sa, (1 - b["x"]) * sb)  # and from a to b
        toward_a = _draw(seed, level, F.struct(a["doc_id"], a["size"]), F.struct(b["doc_id"], b["size"])) < down / (up + down)
        a_whole = F.when(toward_a, (1 - a["x"]) * sa <= b["x"] * sb).otherwise(a["x"] * sa <= (1 - b["x"]) * sb)
        xa = F.when(toward_a, F.when(a_whole, F.lit(1.0)).otherwise(a["x"] + up / sa)).otherwise(F.when(a_whole, F.lit(0.0)).otherwise(a["x"] - down / sa))
        xb = F.when(toward_a, F.when(a_whole, b["x"] - up / sb).otherwise(F.lit(0.0))).otherwise(F.when(a_whole, b["x"] + down / sb).otherwise(F.lit(1.0)))
        done, rest = F.when(a_whole, put(a, xa)).otherwise(put(b, xb)), F.when(a_whole, put(b, xb)).otherwise(put(a, xa))
        open_ = (rest["x"] > 0) & (rest["x"] < 1)  # both can become whole at once
        return F.when(a.isNull(), F.struct(b.alias("held"), acc["done"].alias("done"))).otherwise(
            F.struct(F.when(open_, rest).otherwise(none).alias("held"), F.concat(acc["done"], F.when(open_, F.array(done)).otherwise(F.array(done, rest))).alias("done"))
        )

    start = F.struct(none.alias("held"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, start, step)


def _settle(items: Column, rate: Column, pool: Column, most: int, seed: int, level: int) -> Column:
    """Pivotal rounding of an array of (doc_id, size), large ones first, each against the pool of those after it and of ``pool`` more words.

    All have ``rate`` copies in common. Gives done (doc_id, size, whole, x = 0), held (the one that is left, or null) and the pool's rate at the end.
    """
    kind = "struct<doc_id:bigint,size:bigint,whole:bigint,x:double>"
    none = F.lit(None).cast(kind)

    def put(item: Column, copies: Column, x: Column) -> Column:
        return F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), copies.cast("long").alias("whole"), x.cast("double").alias("x"))

    def step(acc: Column, item: Column) -> Column:
        r, size = acc["rate"], item["size"].cast("double")
        rest = acc["rest"] - size
        low = F.floor(r + F.lit(1e-9))
        x = F.greatest(r - low, F.lit(0.0))
        whole = x <= 1e-9
        up, down = F.least((1 - x) * size, r * rest), F.least(x * size, (F.lit(most) - r) * rest)
        is_up = _draw(seed, level, item["doc_id"], item["size"]) < down / (up + down)
        moved = F.when(is_up, up).otherwise(-down)
        full = F.when(is_up, (1 - x) * size <= r * rest).otherwise(x * size <= (F.lit(most) - r) * rest)
        alone = (rest <= 0) | (up + down <= 0)
        # The document is settled, or the pool is used up and the document is what is left.
        settled = put(item, low + F.when(is_up, 1).otherwise(0), F.lit(0.0))
        left = put(item, low, F.when(alone, x).otherwise(F.least(F.greatest(x + moved / size, F.lit(0.0)), F.lit(1.0))))
        after = F.when(whole | alone, r).otherwise(F.least(F.greatest(r - moved / rest, F.lit(0.0)), F.lit(most)))
        stays = whole | (~alone & full)
        return F.struct(
            after.alias("rate"), rest.alias("rest"),
            F.when(stays, acc["held"]).otherwise(left).alias("held"),
            F.when(stays, F.concat(acc["done"], F.array(F.when(whole, put(item, low, F.lit(0.0))).otherwise(settled)))).otherwise(acc["done"]).alias("done"),
        )

    words = F.aggregate(items, pool.cast("double"), lambda acc, i: acc + i["size"])
    start = F.struct(rate.cast("double").alias("rate"), words.alias("rest"), none.alias("held"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, start, step)


def copies(sized: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``sized`` (doc_id, source, size)."""
    goal = cut(targets(sized, weights, most, share))
    top = math.ceil(most)  # copies that a document may get
    biggest, sources = goal.agg(F.max("source_docs"), F.count(F.lit(1))).first()
    biggest = biggest or 0
    side = F.broadcast if sources <= BROADCAST_SOURCES else lambda df: df
    keep = ["doc_id", "source", "size", "source_size", "target"]
    key = F.struct("size", F.xxhash64(F.lit(seed + 1), "doc_id", "size").alias("h"))
    # The largest documents of each source and, if there are more, the key of the next one; a task keeps few rows of a source before the shuffle.
    rank = F.row_number().over(Window.partitionBy("source").orderBy(key.desc()))
    tops = sized.where("size > 0").withColumn("_k", rank).where(F.col("_k") <= CHUNK + 1).groupBy("source").agg(
        F.max(F.when(F.col("_k") == CHUNK + 1, key)).alias("_next"), F.collect_list(F.struct(key.alias("key"), "doc_id", "size")).alias("_all")
    )
    large = F.array_sort(F.filter("_all", lambda i: F.col("_next").isNull() | (i["key"] > F.col("_next"))), lambda a, b: F.when(a["key"] > b["key"], -1).when(a["key"] < b["key"], 1).otherwise(0))
    named = side(goal.select(F.col("source").alias("_s"), "source_size", "source_docs", "target"))
    first = cut(
        tops.select("source", "_next", F.transform(large, lambda i: F.struct(i["doc_id"].alias("doc_id"), i["size"].alias("size"))).alias("_items"))
        .join(named, F.col("source").eqNullSafe(F.col("_s")), "inner")
        .withColumn("_rest", F.col("source_size") - F.aggregate("_items", F.lit(0).cast("long"), lambda acc, i: acc + i["size"]))
        .withColumn("_got", _settle(F.col("_items"), F.col("target") / F.col("source_size"), F.col("_rest"), top, seed, -1))
        .select("source", "source_size", "target", "source_docs", "_next", "_got")
    )

    def of(rows: DataFrame, part: str, *more: str) -> DataFrame:
        """One row for each document in ``part``."""
        each = rows.select("source", "source_size", "target", *more, F.col(part).alias("_d"))
        return each.select(F.col("_d.doc_id").alias("doc_id"), "source", F.col("_d.size").alias("size"), "source_size", "target", *more, F.col("_d.whole").alias("whole"), F.col("_d.x").alias("x"))

    def done(rows: DataFrame) -> DataFrame:
        settled = of(rows.withColumn("_e", F.explode("_got.done")), "_e")
        return settled.select(*keep, (F.col("whole") + F.round("x").cast("long")).alias("copies"))

    def held(rows: DataFrame) -> DataFrame:
        return of(rows.where("_got.held is not null").withColumn("_e", F.col("_got.held")), "_e", "source_docs")

    # The others have the rate that is left. Sources and sizes without words take nothing.
    rates = first.select(F.col("source").alias("_s"), "_next", F.col("_got.rate").alias("_rate"))
    nothing = sized.where("size = 0").join(named, F.col("source").eqNullSafe(F.col("_s")), "left").select(*keep, F.lit(0).cast("long").alias("copies"))
    small = (
        sized.where("size > 0").join(side(rates.where("_next is not null")), F.col("source").eqNullSafe(F.col("_s")), "inner").where(key <= F.col("_next")).drop("_s")
        .join(named, F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    )
    levels, n = 0, biggest
    while n > 1 or levels == 0:
        levels, n = levels + 1, -(-n // (CHUNK // 2))
    parts, left = [nothing, done(first)], None
    for level in range(levels):
        last = level == levels - 1
        buckets = F.lit(1) if last and level else F.greatest(F.lit(1), F.ceil(F.col("source_docs") / float(CHUNK * (CHUNK // 2) ** level)).cast("long"))
        dealt = (small if level == 0 else left).withColumn("_h", F.xxhash64(F.lit(seed + 1), F.lit(level), "doc_id", "size")).withColumn("_b", F.pmod("_h", buckets))
        # At the last level each source has few residuals; before that, repeated rows that meet in a bucket are cut into chunks.
        by = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", *([] if level == 0 else ["x"]))
        chunk = F.lit(0) if last and level else F.floor((F.row_number().over(by) - 1) / CHUNK)
        item = [(-F.col("size")).alias("_s"), "_h", "doc_id", "size", *([] if level == 0 else ["whole", "x"])]
        if level == 0:
            how = _settle(F.transform("_items", lambda i: F.struct(i["doc_id"].alias("doc_id"), i["size"].alias("size"))), F.col("_rate"), F.lit(0), top, seed, level)
        else:
            how = _fold(F.transform("_items", lambda i: F.struct(i["doc_id"].alias("doc_id"), i["size"].alias("size"), i["whole"].alias("whole"), i["x"].alias("x"))), seed, level)
        first_of = [F.first(c).alias(c) for c in ("source_size", "target", "source_docs", *(["_rate"] if level == 0 else []))]
        folded = cut(
            dealt.withColumn("_chunk", chunk).groupBy("source", "_b", "_chunk").agg(*first_of, F.array_sort(F.collect_list(F.struct(*item))).alias("_items"))
            .withColumn("_got", how).select("source", "source_size", "target", "source_docs", "_got")
        )
        parts.append(done(folded))
        left = held(folded).unionByName(held(first)) if level == 0 else held(folded)
    # At most one document of a source is left: it is drawn alone.
    alone = _draw(seed, levels, F.col("doc_id"), F.col("size")) < F.col("x")
    parts.append(left.select(*keep, (F.col("whole") + alone.cast("long")).alias("copies")))
    out = parts[0].select(*keep, "copies")
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep, F.col("copies").cast("long").alias("copies")))
    return out


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The contract's query: doc_id, size, source_size, target, taken (copies times size)."""
    sized = cut(sizes(docs))
    return copies(sized, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (0 times: gone); all its columns, nothing else.

    Needs columns doc_id, source and text.
    """
    cols = docs.columns
    size, n = free_name("size", cols), free_name("n", cols)
    decided = copies(cut(sizes(docs)), seed, weights, most, share).where("copies > 0")
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies"))
    got = decided.withColumn("n", F.row_number().over(same)).select(
        F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "n").alias("got"), "copies"
    )
    mine = Window.partitionBy("doc_id", "source", size).orderBy("text")
    numbered = docs.withColumn(size, size_of(F.col("text"))).withColumn(n, F.row_number().over(mine)).select(F.struct(*cols, size, n).alias("row"))
    on = (
        F.col("row.doc_id").eqNullSafe(F.col("got.i")) & F.col("row.source").eqNullSafe(F.col("got.s"))
        & (F.col(f"row.{size}") == F.col("got.z")) & (F.col(f"row.{n}") == F.col("got.n"))
    )
    repeated = numbered.join(got, on, "inner").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"row.`{c}`").alias(c) for c in cols])
