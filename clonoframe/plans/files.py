"""Queries that write the driver's tables as the engine's files, into the shared checkpoint folder, and read them again; and queries on columns that other flows use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..functions import vectors as V
from ..operators import correct, metrics, preprocess
from ..sources import repertoire
from ..state import checkpoint_folder
from . import proxy as P
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type || '-' || (event_id % 50) AS full_seq, count(*) AS n, round(sum(value), 4) AS freq FROM events GROUP BY 1")
def repertoire_files(spark, d):
    """TSV sink, listing, headers in one job and the scan by header: half of the files have their columns in another order and under another name."""
    e = F.col("event_id")
    rows = P.table(spark, d, "events").select(F.concat("event_type", F.lit("-"), (e % 50).cast("string")).alias("full_seq"), F.col("value").alias("frequencyCount"), F.col("event_type").alias("aminoAcid"), e)
    folder = _folder(spark, "repertoires with spaces")
    repertoire.write_tsv(rows.where(e % 2 == 0).drop("event_id"), f"{folder}/one")
    repertoire.write_tsv(rows.where(e % 2 == 1).select(F.col("frequencyCount").alias("count (templates/reads)"), "full_seq"), f"{folder}/two")
    got = repertoire.read_repertoires(spark, repertoire.list_files(spark, folder, ".csv"), "d")
    return got.groupBy("full_seq").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("freq"), 4).alias("freq"))


@query("SELECT event_type AS dataset, count(DISTINCT user_id) AS samples, count(DISTINCT user_id % 2) AS labels, count(DISTINCT event_id % 10) AS clusters FROM events GROUP BY 1")
def encoded_files(spark, d):
    """Encoded datasets in parts, one without labels; all parts are merged by name and described."""
    ev = P.table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("sample"), (F.col("user_id") % 2).alias("label"), (F.col("event_id") % 10).alias("cluster"), "event_id")
    folder = _folder(spark, "encoded")
    repertoire.write_encoded(ev.where("event_id % 3 = 0").drop("event_id"), f"{folder}/a")
    repertoire.write_encoded(ev.where("event_id % 3 > 0").select("cluster", "sample", "dataset", "label"), f"{folder}/b")
    parts = [repertoire.read_encoded(spark, f"{folder}/{k}") for k in "ab"]
    return repertoire.describe_encoded(preprocess.merge_datasets(*parts))


@query("SELECT CAST(label AS VARCHAR) AS sample, count(*) AS n, round(sum(embedding[1]), 4) AS first FROM embeddings WHERE label < 3 GROUP BY 1")
def embedding_files(spark, d):
    folder = _folder(spark, "embeddings")
    repertoire.write_embeddings(P.embeddings(spark, d).select(F.col("label").cast("string").alias("sample"), "vec_id", "vec"), folder)
    got = repertoire.read_embeddings(spark, folder, files=["0", "1", "2"])
    return got.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("vec", F.lit(0))), 4).alias("first"))


@query("SELECT 'V' AS kind, 'X' || p_partkey || '|' || p_brand || '*01|f' AS id, p_brand || '*01' AS gene, replace(p_type, ' ', '') AS seq FROM part")
def fasta_files(spark, d):
    """Records of several lines, one file."""
    p = P.table(spark, d, "part")
    record = F.concat(F.lit(">X"), "p_partkey", F.lit("|"), "p_brand", F.lit("*01|f rest of the line\n"), F.regexp_replace("p_type", " ", "\n"))
    folder = _folder(spark, "fasta")
    p.select(record).coalesce(1).write.text(folder)
    return repertoire.read_fasta(spark, folder).select("kind", "id", "gene", "seq")


@query("SELECT p_brand AS sequence, p_mfgr AS epitope, label, count(*) AS n FROM (SELECT p_brand, p_type AS p_mfgr, CAST(p_partkey % 2 AS INTEGER) AS label FROM part) GROUP BY 1, 2, 3")
def labelled_files(spark, d):
    """The labelled CSV, and scores without a header."""
    p = P.table(spark, d, "part").select(F.col("p_brand").alias("full_seq"), F.col("p_type").alias("Epitope"), (F.col("p_partkey") % 2).alias("Label"))
    folder = _folder(spark, "labelled")
    p.write.csv(folder, header=True)
    got = repertoire.read_labelled(spark, folder)
    return got.groupBy("sequence", "epitope", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(p_retailprice, 2) AS score, CAST(p_partkey % 2 AS INTEGER) AS label, count(*) AS n FROM part GROUP BY 1, 2")
def score_files(spark, d):
    p = P.table(spark, d, "part").select(F.round("p_retailprice", 2).alias("score"), (F.col("p_partkey") % 2).cast("int").alias("label"))
    folder = _folder(spark, "scores")
    repertoire.write_scores(p, folder)
    return spark.read.schema("score double, label int").csv(folder).groupBy("score", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 's' || event_id ELSE 't' || event_id || '.tsv' END AS sample FROM events WHERE event_id % 3 > 0")
def manifest_files(spark, d):
    """Paths of a manifest with blank lines; the suffix goes where a name has it."""
    e = F.col("event_id")
    line = F.when(e % 3 == 0, F.lit("  ")).when(e % 2 == 0, F.concat(F.lit(" /data/a b/s"), e, F.lit("_filt_full.tsv"))).otherwise(F.concat(F.lit("t"), e, F.lit(".tsv ")))
    folder = _folder(spark, "manifest")
    P.table(spark, d, "events").select(line).write.text(folder)
    return repertoire.read_manifest(spark, folder).select("sample")


@query("SELECT p_type AS sequence, count(*) AS n FROM part GROUP BY 1")
def sequence_files(spark, d):
    folder = _folder(spark, "lines")
    P.table(spark, d, "part").select("p_type").write.text(folder)
    return repertoire.read_sequences(spark, folder).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "WITH t AS (SELECT p_partkey, list_concat(list_concat([1], list_transform(list_filter(string_split(upper(p_brand), ''), lambda c: c <> ''), lambda c: CASE WHEN instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) > 0 THEN instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) + 3 ELSE 3 END)), [2]) AS ids FROM part) "
    "SELECT p_partkey, array_to_string(list_concat(ids, list_transform(range(greatest(12 - len(ids), 0)), lambda i: 0)), ',') AS ids, len(ids) AS tokens FROM t"
)
def tokens(spark, d):
    """Special tokens, unknown signs and padding."""
    vocabulary = {"<cls>": 1, "<sep>": 2, "<unk>": 3} | {c: k + 4 for k, c in enumerate(_LETTERS)}
    ids = strings.token_ids(F.upper("p_brand"), vocabulary)
    return P.table(spark, d, "part").select(
        "p_partkey", F.array_join(F.transform(strings.pad_tokens(ids, 12), lambda x: x.cast("string")), ",").alias("ids"), V.total(F.transform(strings.token_mask(ids, 12), lambda x: x.cast("double"))).cast("long").alias("tokens")
    )


@query(
    "WITH t AS (SELECT vec_id, (p - 1) // 8 AS t, (p - 1) % 8 AS pos, x FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)) "
    "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS x FROM t WHERE t <= vec_id % 8 GROUP BY 1, 2"
)
def masked_pooling(spark, d):
    """Means of the first tokens of each row, the others masked."""
    e = P.embeddings(spark, d)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("vec"), t * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: t <= F.col("vec_id") % 8)
    return e.select("vec_id", F.posexplode(V.masked_mean(rows, mask)).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


@query("WITH f AS (SELECT CAST(pos - 1 AS INTEGER) AS feature, avg(x) AS mean, var_pop(x) AS var FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1) SELECT feature, round(mean, 6) AS mean, round(var, 6) AS var FROM f")
def feature_moments(spark, d):
    return correct.feature_stats(P.embeddings(spark, d)).select("feature", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("SELECT bool_and(abs(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) - 1) < 1e-4) AS unit FROM embeddings")
def unit_rows(spark, d):
    return correct.unit_rows(P.embeddings(spark, d), 1e-4)


@query("SELECT l_orderkey, l_linenumber, round(exp(-l_quantity * l_discount / 450), 9) AS weight FROM lineitem")
def link_weights(spark, d):
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.edge_weight(F.col("l_quantity"), F.col("l_discount")), 9).alias("weight"))


_SPREAD = (
    f"WITH {P.PROF}, d AS (SELECT 'intra_a' AS k, list_distance(x.v, y.v) AS d FROM a x, a y WHERE x.id <> y.id UNION ALL SELECT 'intra_b', list_distance(x.v, y.v) FROM b x, b y WHERE x.id <> y.id "
    "UNION ALL SELECT 'inter', list_distance(a.v, b.v) FROM a, b) SELECT k, round(sqrt(var_pop(d)) / avg(d), 5) AS cv FROM d GROUP BY 1"
)


@query(_SPREAD)
def scatter_spread(spark, d):
    """Coefficients of variation of the distances within and between two datasets."""
    got = metrics.scatter_summary(*P.two_sides(spark, d))
    return got.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"{k}_cv").alias("cv")) for k in ("intra_a", "intra_b", "inter")])).alias("s")).select("s.k", F.round("s.cv", 5).alias("cv"))


@query(
    "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT id AS i, (id * 7) % (SELECT count(*) FROM e) AS j, (id % 5) / 4.0 AS w FROM e WHERE id % 3 > 0), "
    "t AS (SELECT i AS id, p AS pos, sum(w * x) AS x FROM (SELECT i, w, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM l JOIN e ON e.id = l.j) GROUP BY 1, 2), "
    "g AS (SELECT id, unnest(range(1, len(v) + 1)) AS pos FROM e) SELECT g.id, CAST(g.pos - 1 AS INTEGER) AS pos, round(coalesce(x, 0), 6) AS x FROM g LEFT JOIN t ON t.id = g.id AND t.pos = g.pos"
)
def gathered_vectors(spark, d):
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("id"), "vec")
    n = e.count()
    i = F.col("id")
    links = e.where(i % 3 > 0).select(i.alias("i"), (i * 7 % n).alias("j"), ((i % 5) / F.lit(4.0)).alias("w"))
    return correct.gathered(links, e).select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


@query(
    "WITH e AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY 1), "
    "z AS (SELECT id, pos, (x - m) / s AS z FROM e JOIN m USING (pos)) SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(z / sqrt(sum(z * z) OVER (PARTITION BY id)), 6) AS x FROM z"
)
def rescaled_rows(spark, d):
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("id"), "vec")
    return correct.rescaled(e).select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))
