"""All queries on the engine's own operators, and their SQL. Numbers are rounded, so that the last bits of sums don't matter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoders, strings
from ..functions import vectors as V
from ..operators import classify, correct, encode, graph_layout, kernel_svm, metrics, neighbors, networks, preprocess, reconstruct, report, soft, space
from . import proxy as P

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    rows = P.clonotypes(spark, d).join(P.embeddings(spark, d).select("vec_id", "vec"), "vec_id")
    return encode.encode_samples(rows, P.centroids(spark, d))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "events").select(F.col("user_id").alias("sample")).distinct()


def _long(df: DataFrame, key: str, vec: str = "vec", digits: int = 6) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("pos", "x")).select(key, "pos", F.round("x", digits).alias("x"))


# --- encoding --------------------------------------------------------------------------------------------------------


@query(f"WITH {P.ENC} SELECT sample, cluster, diversity, round(abundance, 4) AS abundance, round(ln(1 + abundance / (sum(abundance) OVER (PARTITION BY sample) + 1e-9)), 6) AS log_share FROM enc")
def encode_repertoires(spark, d):
    enc = encode.row_normalize(_encoded(spark, d), "abundance", "_s")
    return enc.select("sample", "cluster", "diversity", F.round("abundance", 4).alias("abundance"), F.round(F.log1p("_s"), 6).alias("log_share"))


@query(f"WITH {P.DENSE} SELECT sample, string_agg(CAST(diversity AS VARCHAR), ',' ORDER BY cluster) AS diversity, round(sum(abundance), 4) AS total FROM grid GROUP BY 1")
def encode_dense(spark, d):
    got = encode.dense(_encoded(spark, d), _samples(spark, d), 10)
    return got.select("sample", F.array_join(F.transform("diversity", lambda x: x.cast("string")), ",").alias("diversity"), F.round(V.total(F.col("abundance")), 4).alias("total"))


@query(f"WITH {P.EMB}, {P.CENT}, {P.NEAR} SELECT vec_id, cluster, round(d2, 6) AS d2 FROM near")
def nearest_centroid(spark, d):
    return encode.nearest_centroid(P.embeddings(spark, d), P.centroids(spark, d)).select("vec_id", "cluster", F.round("d2", 6).alias("d2"))


@query(f"WITH {P.EMB}, {P.CENT} SELECT cluster, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, round(unnest(c), 6) AS x FROM cent")
def centroid_mean(spark, d):
    return _long(P.centroids(spark, d), "cluster")


_ROLL = f"{P.ENC}, roll AS (SELECT sample, cluster % 4 AS cluster, sum(diversity) AS diversity, sum(abundance) AS abundance FROM enc WHERE cluster % 4 < 3 GROUP BY 1, 2)"


def _mapping(spark):
    return spark.range(10).select(F.col("id").cast("int").alias("primary"), (F.col("id") % 4).cast("int").alias("func"))


@query(f"WITH {_ROLL} SELECT sample, cluster, CAST(diversity AS BIGINT) AS diversity, round(abundance, 4) AS abundance FROM roll")
def functional_rollup(spark, d):
    return encode.functional_rollup(_encoded(spark, d), _mapping(spark), 3).select("sample", "cluster", "diversity", F.round("abundance", 4).alias("abundance"))


_GRID3 = (
    f"WITH {_ROLL}, g AS (SELECT s.sample, k.pos, coalesce(diversity, 0) AS dv, coalesce(abundance, 0.0) AS ab FROM (SELECT DISTINCT user_id AS sample FROM events) s "
    "CROSS JOIN (SELECT CAST(unnest(range(3)) AS INTEGER) AS pos) k LEFT JOIN roll ON roll.sample = s.sample AND roll.cluster = k.pos), "
    "n AS (SELECT sample, pos, ln(1 + ab / (sum(ab) OVER (PARTITION BY sample) + 1e-9)) AS a, dv / (sum(dv) OVER (PARTITION BY sample) + 1e-9) AS v FROM g) "
)


def _features(spark, d, mode):
    return _long(encode.functional_features(_encoded(spark, d), _samples(spark, d), _mapping(spark), 10, 3, mode), "sample")


@query(_GRID3 + "SELECT sample, pos, round(a, 6) AS x FROM n UNION ALL SELECT sample, pos + 3, round(v, 6) FROM n")
def feature_matrix_concatenate(spark, d):
    return _features(spark, d, "concatenate")


@query(_GRID3 + "SELECT sample, pos, round(a, 6) AS x FROM n")
def feature_matrix_abundance(spark, d):
    return _features(spark, d, "abundance")


@query(_GRID3 + "SELECT sample, pos, round(v, 6) AS x FROM n")
def feature_matrix_diversity(spark, d):
    return _features(spark, d, "diversity")


@query(f"WITH {P.ENC} SELECT sample, cluster, round(abundance / (sum(abundance) OVER (PARTITION BY sample) + 1e-9), 6) AS share FROM enc")
def row_normalize(spark, d):
    return encode.row_normalize(_encoded(spark, d), "abundance", "share").select("sample", "cluster", F.round("share", 6).alias("share"))


@query(f"WITH {P.ENC} SELECT sample, cluster, round(CAST(diversity AS DOUBLE) / sum(diversity) OVER (PARTITION BY sample), 6) AS share FROM enc")
def count_to_frequency(spark, d):
    return encode.count_to_frequency(_encoded(spark, d), "diversity", "share").select("sample", "cluster", F.round("share", 6).alias("share"))


@query("SELECT user_id AS sample, event_id % 10 AS cluster, count(DISTINCT event_type) AS diversity FROM events GROUP BY user_id, event_id % 10")
def distinct_diversity(spark, d):
    rows = P.clonotypes(spark, d).withColumn("cluster", F.col("row_id") % 10)
    return encode.count_and_sum(rows, distinct="v").select("sample", "cluster", "diversity")


# --- preprocessing ---------------------------------------------------------------------------------------------------


@query(f"WITH {P.CLON} SELECT row_id, cdr3 FROM clon WHERE length(cdr3) >= 10 AND cdr3 LIKE 'C%F' AND NOT contains(cdr3, '*')")
def qc_filter(spark, d):
    return preprocess.qc_filter(P.clonotypes(spark, d)).select("row_id", "cdr3")


_TOP = f"{P.CLON}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY freq DESC, row_id) AS r FROM clon WHERE full_seq <> 'Failure') WHERE r <= 5)"


@query(f"WITH {_TOP} SELECT sample, row_id, full_seq, freq FROM top")
def top_clones(spark, d):
    return preprocess.top_clones(P.clonotypes(spark, d), 5).select("sample", "row_id", "full_seq", "freq")


@query(f"WITH {_TOP} SELECT DISTINCT full_seq FROM top")
def merged_distinct_seqs(spark, d):
    return preprocess.distinct_sequences(P.clonotypes(spark, d), 5)


@query(f"WITH {P.CLON} SELECT row_id FROM clon WHERE full_seq <> 'Failure'")
def drop_failures(spark, d):
    return preprocess.drop_failures(P.clonotypes(spark, d), "full_seq").select("row_id")


@query(f"WITH {P.CLON} SELECT round(100.0 * avg(CASE WHEN full_seq = 'Failure' THEN 1.0 ELSE 0.0 END), 6) AS failure_pct FROM clon")
def failure_rate(spark, d):
    return preprocess.failure_rate(P.clonotypes(spark, d)).select(F.round("failure_pct", 6).alias("failure_pct"))


def _labelled(spark, d):
    lab = P.table(spark, d, "labels").select(F.col("doc_id").alias("sample"), F.col("quality").alias("label"))
    return preprocess.relabel(_encoded(spark, d), lab).withColumn("dataset", F.lit("all"))


_LAB = f"{P.ENC}, lab AS (SELECT enc.*, quality AS label FROM enc LEFT JOIN labels ON doc_id = sample)"


@query(f"WITH {_LAB} SELECT CASE label WHEN 0 THEN 'all_Normal' ELSE 'all_Tumor' END AS dataset, count(*) AS n, CAST(sum(diversity) AS BIGINT) AS rows FROM lab WHERE label IN (0, 1) GROUP BY 1")
def split_by_label(spark, d):
    parts = preprocess.split_by_label(_labelled(spark, d))
    return preprocess.merge_datasets(*parts.values()).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("diversity").alias("rows"))


@query(f"WITH {_LAB} SELECT sample, cluster, label FROM lab")
def relabel(spark, d):
    return _labelled(spark, d).select("sample", "cluster", "label")


@query("SELECT event_type AS dataset, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE user_id % 2 = 0) GROUP BY 1")
def merge_datasets(spark, d):
    ev = P.table(spark, d, "events").select(F.col("event_type").alias("dataset"), "user_id")
    return preprocess.merge_datasets(ev, ev.where("user_id % 2 = 0")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dataset, count(*) AS n FROM (SELECT event_type AS dataset FROM events UNION ALL SELECT 'all' FROM events) GROUP BY 1")
def merge_whole(spark, d):
    ev = P.table(spark, d, "events").select(F.col("event_type").alias("dataset"), "user_id")
    return preprocess.merge_datasets(ev, ev.select("user_id", F.lit("all").alias("dataset"))).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def metadata_join(spark, d):
    c = P.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return preprocess.metadata_join(c, P.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name"), "key").select("c_custkey", "n_name")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def label_of_last(spark, d):
    return preprocess.label_of_last(P.table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT c_custkey FROM customer ORDER BY md5('0:' || c_custkey), c_custkey LIMIT 100")
def downsample(spark, d):
    return preprocess.downsample(P.table(spark, d, "customer").select("c_custkey"), 100, "c_custkey")


@query("SELECT event_type AS dataset, count(*) AS count FROM events GROUP BY 1")
def datasets_by_size(spark, d):
    return preprocess.datasets_by_size(P.table(spark, d, "events").select(F.col("event_type").alias("dataset")))


@query("SELECT 'x' AS dataset, count(DISTINCT user_id) AS samples, count(DISTINCT user_id % 2) AS labels, count(DISTINCT event_type) AS clusters FROM events")
def describe_encoded(spark, d):
    from ..sources.repertoire import describe_encoded as describe

    return describe(P.table(spark, d, "events").select(F.lit("x").alias("dataset"), F.col("user_id").alias("sample"), (F.col("user_id") % 2).alias("label"), F.col("event_type").alias("cluster")))


# --- strings and vectors ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN length(p_type) <= 30 THEN left(p_type, CAST(floor((length(p_type) + 1) / 2) AS BIGINT)) || repeat('-', 30 - length(p_type)) || substr(p_type, CAST(floor((length(p_type) + 1) / 2) AS BIGINT) + 1) END AS padded FROM part")
def gap_pad(spark, d):
    return P.table(spark, d, "part").select("p_partkey", strings.pad_gap(F.col("p_type"), 30).alias("padded"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_brand), ''), lambda c: CAST(instr('ARNDCEQGHILKMFPSTWYV-', c) - 1 AS VARCHAR)), ',') AS numbers FROM part")
def aa_encode(spark, d):
    return P.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(strings.residue_numbers(F.upper("p_brand")), lambda x: x.cast("string")), ",").alias("numbers"))


@query("SELECT event_id, 'TRBV' || CAST(event_id % 30 AS VARCHAR) || '-' || CAST(event_id % 7 AS VARCHAR) AS gene FROM events")
def gene_rename(spark, d):
    e = F.col("event_id")
    minor = F.when(e % 7 == 0, F.lit("-0")).otherwise(F.concat(F.lit("-0"), (e % 7).cast("string")))
    major = F.when(e % 30 == 0, F.lit("0")).otherwise(F.lpad((e % 30).cast("string"), 2, "0"))
    return P.table(spark, d, "events").select("event_id", strings.rename_gene(F.concat(F.lit("TCRBV"), major, minor)).alias("gene"))


@query(f"WITH {P.EMB} SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS dot, round(list_distance(a.v, b.v) * list_distance(a.v, b.v), 6) AS d2, round(list_cosine_distance(a.v, b.v), 6) AS cosine FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1")
def vector_functions(spark, d):
    e = P.embeddings(spark, d)
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("w"))
    return e.join(n, "vec_id").select("vec_id", *[F.round(f(F.col("vec"), F.col("w")), 6).alias(k) for k, f in (("dot", V.dot), ("d2", V.squared_distance), ("cosine", V.cosine_distance))])


def _eigen_sql(name: str, source: str, n: int, squarings: int = 24) -> str:
    """Table ``{name}`` (vs): the first ``n`` eigenvectors of the symmetric matrix ``m`` of ``source``, by repeated squaring and deflation; largest entries are positive."""
    square = "list_transform(s, lambda r: list_transform(s, lambda q: list_inner_product(r, q) / list_inner_product(flatten(s), flatten(s))))"
    top = "list_transform(s, lambda r, i: r[i])"
    return (
        f"{name}_w(c, t, m, s, vs) AS (SELECT 0, 0, m, m, CAST([] AS DOUBLE[][]) FROM {source} UNION ALL SELECT CASE WHEN t < {squarings} THEN c ELSE c + 1 END, CASE WHEN t < {squarings} THEN t + 1 ELSE 0 END, "
        f"CASE WHEN t < {squarings} THEN m ELSE less END, CASE WHEN t < {squarings} THEN {square} ELSE less END, CASE WHEN t < {squarings} THEN vs ELSE list_append(vs, v) END "
        "FROM (SELECT *, list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - lam * v[i] * v[j])) AS less FROM (SELECT *, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS lam FROM "
        "(SELECT c, t, m, s, vs, list_transform(col, lambda x: x / sqrt(list_inner_product(col, col)) * sign(col[list_position(list_transform(col, lambda y: abs(y)), list_max(list_transform(col, lambda y: abs(y))))])) AS v FROM "
        f"(SELECT *, s[list_position({top}, list_max({top}))] AS col FROM {name}_w WHERE c < {n}))))), {name} AS (SELECT vs FROM {name}_w WHERE c = {n})"
    )


def _cov_sql(long: str) -> str:
    return f"SELECT list(r ORDER BY p) AS m FROM (SELECT p, list(c ORDER BY q) AS r FROM (SELECT a.pos AS p, b.pos AS q, covar_pop(a.x, b.x) AS c FROM {long} a JOIN {long} b ON a.id = b.id GROUP BY 1, 2) GROUP BY 1)"


# --- metrics ---------------------------------------------------------------------------------------------------------

_XLN = "CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0 END"
_JS = f"0.5 * {_XLN.format('p')} + 0.5 * {_XLN.format('q')} - CASE WHEN p + q > 0 THEN (p + q) / 2 * ln((p + q) / 2) ELSE 0 END"


@query(f"WITH {P.PAIR_LONG} SELECT round(avg(d), 6) AS jsd FROM (SELECT i, j, greatest(sum({_JS}), 0) AS d FROM pr GROUP BY 1, 2)")
def jsd(spark, d):
    return metrics.jsd(*P.two_sides(spark, d)).select(F.round("jsd", 6).alias("jsd"))


@query(f"WITH {P.PAIR_LONG} SELECT round(avg(d), 6) AS jsd FROM (SELECT i, j, greatest(sum({_JS}), 0) AS d FROM pr WHERE j = i + 1 GROUP BY 1, 2)")
def jsd_pairwise(spark, d):
    a, b = P.two_sides(spark, d)
    return a.join(b.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w")), "id").agg(F.round(F.avg(V.jensen_shannon(F.col("vec"), F.col("w"))), 6).alias("jsd"))


@query(
    f"WITH {P.PAIR_LONG} SELECT i AS id, round(greatest(sum({_JS}), 0), 6) AS jsd, round(-sum(pe * ln(qe + 1e-9)), 6) AS cross_entropy FROM pr WHERE j = i + 1 GROUP BY 1"
)
def paired_metrics(spark, d):
    a, b = P.two_sides(spark, d)
    b = b.select((F.col("id") - 1).alias("id"), "vec")
    both = metrics.paired(a, b, "JSD").select("id", F.round("distance", 6).alias("jsd"))
    return both.join(metrics.paired(a, b, V.cross_entropy).select("id", F.round("distance", 6).alias("cross_entropy")), "id")


@query(f"WITH {P.PAIR_LONG} SELECT round(avg(d), 6) AS cross_entropy FROM (SELECT i, j, (-sum(pe * ln(qe + 1e-9)) - sum(qe * ln(pe + 1e-9))) / 2 AS d FROM pr GROUP BY 1, 2)")
def cross_entropy(spark, d):
    return metrics.cross_entropy(*P.two_sides(spark, d)).select(F.round("cross_entropy", 6).alias("cross_entropy"))


@query(f"WITH {P.PAIR_LONG} SELECT round(avg(d), 6) AS cross_entropy FROM (SELECT i, j, -sum(pe * ln(qe + 1e-9)) AS d FROM pr GROUP BY 1, 2)")
def cross_entropy_one_way(spark, d):
    return metrics.cross_entropy(*P.two_sides(spark, d), symmetric=False).select(F.round("cross_entropy", 6).alias("cross_entropy"))


@query(f"WITH {P.PROF} SELECT round(avg(list_cosine_distance(a.v, b.v)), 6) AS cosine_distance FROM a, b")
def cosine_distance(spark, d):
    return metrics.cosine_distance(*P.two_sides(spark, d)).select(F.round("cosine_distance", 6).alias("cosine_distance"))


_K = "sum(exp(-g * pow(list_distance(x.v, y.v), 2)))"


@query(
    f"WITH {P.PROF}, sg AS (SELECT 1 / (2 * pow(median(list_distance(a.v, b.v)), 2) + 1e-9) AS g FROM a, b), na AS (SELECT count(*) AS m FROM a), nb AS (SELECT count(*) AS n FROM b), "
    f"kaa AS (SELECT {_K} AS s FROM a x, a y, sg), kbb AS (SELECT {_K} AS s FROM b x, b y, sg), kab AS (SELECT {_K} AS s FROM a x, b y, sg) "
    "SELECT round(greatest((kaa.s - m) / (m * (m - 1) + 1e-9) + (kbb.s - n) / (n * (n - 1) + 1e-9) - 2 * kab.s / (m * n), 0), 6) AS mmd FROM kaa, kbb, kab, na, nb"
)
def mmd(spark, d):
    return metrics.mmd(*P.two_sides(spark, d)).select(F.round("mmd", 6).alias("mmd"))


@query(f"WITH {P.PROF} SELECT round((SELECT avg(list_distance(x.v, y.v)) FROM a x, a y WHERE x.id <> y.id), 6) AS intra_a, round((SELECT avg(list_distance(x.v, y.v)) FROM b x, b y WHERE x.id <> y.id), 6) AS intra_b, round((SELECT avg(list_distance(x.v, y.v)) FROM a x, b y), 6) AS inter")
def scatter_summary(spark, d):
    return metrics.scatter_summary(*P.two_sides(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("intra_a", "intra_b", "inter")])


def _knn_sql(left: str, right: str, k: int, where: str = "TRUE") -> str:
    return f"SELECT i, j, r, d FROM (SELECT x.id AS i, y.id AS j, list_distance(x.v, y.v) AS d, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, y.v), y.id) AS r FROM {left} x, {right} y WHERE {where}) WHERE r <= {k}"


@query(f"WITH {P.VSIDES} SELECT i, j, CAST(r AS INTEGER) AS rank, round(d, 6) AS dist FROM ({_knn_sql('a', 'b', 5)})")
def knn_edges(spark, d):
    a, b = P.vector_sides(spark, d)
    return neighbors.knn(a, b, 5).select("i", "j", F.col("rank").cast("int").alias("rank"), F.round("dist", 6).alias("dist"))


@query(f"WITH {P.VSIDES} SELECT i, j, CAST(r AS INTEGER) AS rank, round(d, 6) AS dist FROM ({_knn_sql('a', 'b', 5)})")
def knn_pruned(spark, d):
    """The same edges from cells around pivots."""
    return neighbors.knn(*P.vector_sides(spark, d), 5, prune=True).select("i", "j", "rank", F.round("dist", 6).alias("dist"))


@query(f"WITH {P.VSIDES}, ab AS ({_knn_sql('a', 'b', 15)}), ba AS ({_knn_sql('b', 'a', 15)}) SELECT ab.i, ab.j FROM ab JOIN ba ON ab.i = ba.j AND ab.j = ba.i")
def mutual_nn(spark, d):
    a, b = P.vector_sides(spark, d)
    return neighbors.mutual_nn(a, b, 15, 15)


@query(
    f"WITH {P.VSIDES}, u AS (SELECT id, v, 0 AS s FROM a UNION ALL SELECT id, v, 1 FROM b), e AS ({_knn_sql('u', 'u', 15, 'x.id <> y.id')}), "
    "c AS (SELECT s, count(*) AS n FROM u GROUP BY 1), w AS (SELECT e.i, x.s, sum(CASE WHEN x.s = y.s THEN 1 ELSE 0 END) AS same FROM e JOIN u x ON x.id = e.i JOIN u y ON y.id = e.j GROUP BY 1, 2) "
    "SELECT round(avg(CASE WHEN same > 15.0 * n / (SELECT count(*) FROM u) THEN 1.0 ELSE 0.0 END), 6) AS kbet FROM w JOIN c USING (s)"
)
def kbet_nopca(spark, d):
    return metrics.kbet(*P.vector_sides(spark, d), pca=False).select(F.round("kbet", 6).alias("kbet"))


@query(
    f"WITH RECURSIVE {P.EMB}, fl AS (SELECT vec_id AS id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb), "
    f"z AS (SELECT id, pos, (x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos) AS x FROM fl), cv AS ({_cov_sql('z')}), {_eigen_sql('pc', 'cv', 10)}, "
    "zv AS (SELECT id, list(x ORDER BY pos) AS v FROM z GROUP BY 1), u AS (SELECT zv.id, label % 2 AS s, list_transform(vs, lambda w: list_inner_product(w, zv.v)) AS v FROM zv JOIN emb ON vec_id = zv.id, pc), "
    f"e AS ({_knn_sql('u', 'u', 15, 'x.id <> y.id')}), c AS (SELECT s, count(*) AS n FROM u GROUP BY 1), "
    "w AS (SELECT e.i, x.s, sum(CASE WHEN x.s = y.s THEN 1 ELSE 0 END) AS same FROM e JOIN u x ON x.id = e.i JOIN u y ON y.id = e.j GROUP BY 1, 2) "
    "SELECT round(avg(CASE WHEN same > 15.0 * n / (SELECT count(*) FROM u) THEN 1.0 ELSE 0.0 END), 6) AS kbet FROM w JOIN c USING (s)"
)
def kbet(spark, d):
    return metrics.kbet(*P.vector_sides(spark, d)).select(F.round("kbet", 6).alias("kbet"))


@query(
    f"WITH {P.PROF}, z AS (SELECT id, pos, (x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos) AS x FROM prof), "
    f"u AS (SELECT id, id % 2 AS s, list(x ORDER BY pos) AS v FROM z GROUP BY id), e AS ({_knn_sql('u', 'u', 5, 'x.id <> y.id')}), "
    "c AS (SELECT s, count(*) AS n FROM u GROUP BY 1), w AS (SELECT e.i, x.s, sum(CASE WHEN x.s = y.s THEN 1 ELSE 0 END) AS same FROM e JOIN u x ON x.id = e.i JOIN u y ON y.id = e.j GROUP BY 1, 2) "
    "SELECT round(avg(CASE WHEN same > 5.0 * n / (SELECT count(*) FROM u) THEN 1.0 ELSE 0.0 END), 6) AS kbet FROM w JOIN c USING (s)"
)
def kbet_profiles(spark, d):
    """All components are kept (there are fewer than 10 features), so neighbours are those of the z-scores, which SQL can find."""
    return metrics.kbet(*P.two_sides(spark, d), k=5).select(F.round("kbet", 6).alias("kbet"))


def _entropy_sql(beta: str) -> str:
    total = f"list_sum(list_transform(d, lambda x: exp(-x * {beta})))"
    return f"CASE WHEN {total} > 0 THEN ln({total}) + {beta} * list_sum(list_transform(d, lambda x: x * exp(-x * {beta}))) / {total} ELSE 0 END"


@query(
    f"WITH RECURSIVE {P.VSIDES}, least_side AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('0:' || id), id) AS r FROM (SELECT id, v, '0' AS s FROM a UNION ALL SELECT id, v, '1' FROM b)), "
    f"u AS (SELECT s || '|' || id AS id, v, s FROM r, least_side WHERE r <= n), e AS ({_knn_sql('u', 'u', 90, 'x.id <> y.id')}), "
    "g AS (SELECT i, list(d ORDER BY r) AS d, list(left(j, 1) ORDER BY r) AS f FROM e GROUP BY 1), "
    f"w(i, d, f, beta, lo, hi, t, h) AS (SELECT i, d, f, CAST(1 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0, {_entropy_sql('1.0')} FROM g UNION ALL "
    f"SELECT i, d, f, nb, nlo, nhi, t + 1, {_entropy_sql('nb')} FROM (SELECT i, d, f, t, CASE WHEN h > ln(30) THEN coalesce((beta + hi) / 2, beta * 2) ELSE coalesce((beta + lo) / 2, beta / 2) END AS nb, "
    "CASE WHEN h > ln(30) THEN beta ELSE lo END AS nlo, CASE WHEN h > ln(30) THEN hi ELSE beta END AS nhi FROM w WHERE abs(h - ln(30)) >= 1e-5 AND t < 49)), "
    "fin AS (SELECT i, any_value(d) AS d, any_value(f) AS f, max_by(beta, t) AS beta FROM w GROUP BY 1), "
    "long AS (SELECT i, unnest(list_transform(d, lambda x: exp(-x * beta))) AS p, unnest(f) AS f FROM fin), "
    "ix AS (SELECT i, 1 / (pow(sum(CASE WHEN f = '0' THEN p ELSE 0 END) / sum(p), 2) + pow(sum(CASE WHEN f = '1' THEN p ELSE 0 END) / sum(p), 2) + 1e-9) AS x FROM long GROUP BY 1) "
    "SELECT CASE WHEN (SELECT n FROM least_side) <= 90 THEN 1.0 ELSE round(least(greatest(2 - median(x), 0), 1), 6) END AS ilisi FROM ix"
)
def ilisi(spark, d):
    return metrics.ilisi(*P.vector_sides(spark, d)).select(F.round("ilisi", 6).alias("ilisi"))


# --- correction ------------------------------------------------------------------------------------------------------

_HVG = (
    f"{P.EMB}, f AS (SELECT CAST(pos - 1 AS INTEGER) AS feature, avg(x) AS mean, var_pop(x) AS var FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb) GROUP BY 1), "
    "ends AS (SELECT min(mean) AS lo, max(mean) AS hi FROM f WHERE var > 0), "
    "bn AS (SELECT f.*, greatest(0, len(list_filter(range(21), lambda i: CASE WHEN i = 20 THEN hi ELSE lo + i * (hi - lo) / 20 END < mean)) - 1) AS bin FROM f, ends WHERE var > 0), "
    "z AS (SELECT feature, coalesce((var - avg(var) OVER (PARTITION BY bin)) / (stddev_samp(var) OVER (PARTITION BY bin) + 1e-6), 0) AS dispersion FROM bn)"
)


@query(f"WITH {_HVG} SELECT feature, round(dispersion, 5) AS dispersion FROM z ORDER BY z.dispersion DESC, feature LIMIT 20")
def hvg(spark, d):
    return correct.highly_variable(P.embeddings(spark, d), 20).select("feature", F.round("dispersion", 5).alias("dispersion"))


_UNIT = (
    f"{P.EMB}, nm AS (SELECT vec_id AS id, label, v, sqrt(list_inner_product(v, v)) AS n FROM emb), un AS (SELECT id, label, list_transform(v, lambda x: x / n) AS v FROM nm), "
    "a AS (SELECT id, v FROM un WHERE label % 2 = 0), b AS (SELECT id, v FROM un WHERE label % 2 = 1)"
)


def _cos_sql(left: str, right: str, k: int) -> str:
    return f"SELECT i, j FROM (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id ORDER BY 1 - list_inner_product(x.v, y.v), y.id) AS r FROM {left} x, {right} y) WHERE r <= {k}"


@query(
    f"WITH {_UNIT}, ab AS ({_cos_sql('a', 'b', 5)}), ba AS ({_cos_sql('b', 'a', 5)}), pr AS (SELECT ab.i, ab.j FROM ab JOIN ba ON ab.i = ba.j AND ab.j = ba.i), "
    "fl AS (SELECT id, v, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), "
    "st AS (SELECT i AS me, j AS you FROM pr UNION ALL SELECT j, i FROM pr), mv AS (SELECT me, m.pos, sum(y.x - m.x) AS s FROM st JOIN fl m ON m.id = st.me JOIN fl y ON y.id = st.you AND y.pos = m.pos GROUP BY 1, 2) "
    "SELECT fl.id, CAST(fl.pos - 1 AS INTEGER) AS pos, round(fl.x + 0.1 * coalesce(s, 0), 5) AS x FROM fl LEFT JOIN mv ON me = fl.id AND mv.pos = fl.pos"
)
def scanorama(spark, d):
    got = correct.scanorama(*P.vector_sides(spark, d), k=5)
    return _long(got.source.unionByName(got.target), "id", digits=5)


@query(
    f"WITH {P.EMB}, nm AS (SELECT vec_id AS id, label % 3 AS g, v, sqrt(list_inner_product(v, v)) AS n FROM emb), un AS (SELECT id, g, list_transform(v, lambda x: x / n) AS v FROM nm), "
    "nn AS (SELECT i, j FROM (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id, y.g ORDER BY 1 - list_inner_product(x.v, y.v), y.id) AS r FROM un x JOIN un y ON x.g <> y.g) WHERE r <= 5), "
    "pr AS (SELECT p.i, p.j FROM nn p JOIN nn q ON p.i = q.j AND p.j = q.i), fl AS (SELECT id, g, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM un), "
    "mv AS (SELECT i, m.pos, sum(y.x - m.x) AS s FROM pr JOIN fl m ON m.id = i JOIN fl y ON y.id = j AND y.pos = m.pos GROUP BY 1, 2) "
    "SELECT g AS dataset, fl.id, CAST(fl.pos - 1 AS INTEGER) AS pos, round(fl.x + 0.1 * coalesce(s, 0), 5) AS x FROM fl LEFT JOIN mv ON i = fl.id AND mv.pos = fl.pos"
)
def panorama(spark, d):
    e = P.embeddings(spark, d).select((F.col("label") % 3).alias("dataset"), F.col("vec_id").alias("id"), "vec")
    got, _ = correct.panorama([e.where(F.col("dataset") == g).select("id", "vec") for g in range(3)], k=5)
    kind = e.schema["dataset"].dataType
    parts = [g.select(F.lit(n).cast(kind).alias("dataset"), "id", F.posexplode("vec").alias("pos", "x")) for n, g in enumerate(got)]
    return preprocess.merge_datasets(*parts).select("dataset", "id", "pos", F.round("x", 5).alias("x"))


@query(
    f"WITH {_UNIT}, ab AS ({_knn_sql('a', 'b', 15)}), ba AS ({_knn_sql('b', 'a', 15)}), pr AS (SELECT ab.i, ab.j FROM ab JOIN ba ON ab.i = ba.j AND ab.j = ba.i), "
    "fa AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a), fb AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b), "
    "mc AS (SELECT j, fa.pos, avg(fa.x - fb.x) AS c FROM pr JOIN fa ON fa.id = i JOIN fb ON fb.id = j AND fb.pos = fa.pos GROUP BY 1, 2), "
    "w AS (SELECT t.id, m.id AS j, exp(-(1 - list_inner_product(t.v, m.v))) AS w FROM b t, b m WHERE m.id IN (SELECT j FROM pr)) "
    "SELECT w.id, CAST(mc.pos - 1 AS INTEGER) AS pos, round(sum(w * c) / sum(w), 5) AS x FROM w JOIN mc USING (j) GROUP BY 1, 2"
)
def mnn_correction(spark, d):
    a, b = (correct.cosine_rows(x) for x in P.vector_sides(spark, d))
    return _long(correct.mnn_vectors(a, b, 15), "id", "corr", digits=5)


def _means(got: correct.Corrected) -> DataFrame:
    return _long(got.source.unionByName(got.target), "id", digits=5)


@query(
    f"WITH {_HVG}, hv AS (SELECT list(feature ORDER BY feature) AS fs FROM (SELECT feature FROM z ORDER BY dispersion DESC, feature LIMIT 50)), "
    "sub AS (SELECT vec_id AS id, label, list_transform(fs, lambda i: v[i + 1]) AS v FROM emb, hv), un AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM sub), "
    "a AS (SELECT id, v FROM un WHERE label % 2 = 0), b AS (SELECT id, v FROM un WHERE label % 2 = 1), "
    f"ab AS ({_knn_sql('a', 'b', 15)}), ba AS ({_knn_sql('b', 'a', 15)}), pr AS (SELECT ab.i, ab.j FROM ab JOIN ba ON ab.i = ba.j AND ab.j = ba.i), "
    "fa AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a), fb AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b), "
    "mc AS (SELECT j, fa.pos, avg(fa.x - fb.x) AS c FROM pr JOIN fa ON fa.id = i JOIN fb ON fb.id = j AND fb.pos = fa.pos GROUP BY 1, 2), "
    "w AS (SELECT t.id, m.id AS j, exp(-(1 - list_inner_product(t.v, m.v))) AS w FROM b t, b m WHERE m.id IN (SELECT j FROM pr)), "
    "cr AS (SELECT w.id, mc.pos, sum(w * c) / sum(w) AS c FROM w JOIN mc USING (j) GROUP BY 1, 2), cl AS (SELECT id, list(c ORDER BY pos) AS c FROM cr GROUP BY 1), "
    "gv AS (SELECT b.id, v, c, sqrt(list_inner_product(c, c)) AS len, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS g FROM b JOIN cl USING (id)), "
    "ray AS (SELECT *, list_inner_product(v, g) AS p FROM gv), "
    "near AS (SELECT ray.id, m.side, m.id AS other, list_inner_product(m.v, g) AS q, ray.p, pow(list_distance(m.v, ray.v), 2) AS d2 FROM ray, (SELECT 0 AS side, id, v FROM a UNION ALL SELECT 1, id, v FROM b) m), "
    "wt AS (SELECT *, exp(-(d2 - pow(q - p, 2))) AS w FROM near), rk AS (SELECT id, sum(CASE WHEN q <= p OR other = id THEN w ELSE 0 END) / sum(w) AS rank FROM wt WHERE side = 1 GROUP BY 1), "
    "cum AS (SELECT id, q, sum(w) OVER (PARTITION BY id ORDER BY q, other ROWS UNBOUNDED PRECEDING) AS s, sum(w) OVER (PARTITION BY id) AS total FROM wt WHERE side = 0), "
    "hit AS (SELECT id, coalesce(min(CASE WHEN s > rank * total THEN q END), max(q)) AS q FROM cum JOIN rk USING (id) GROUP BY 1), sc AS (SELECT ray.*, greatest((hit.q - p) / len, 1) AS scale FROM ray JOIN hit USING (id)), "
    "part AS (SELECT id, unnest(fs) AS feature, unnest(v) AS x FROM a, hv UNION ALL SELECT id, unnest(fs), unnest(list_transform(list_zip(v, c), lambda t: t[1] + scale * t[2])) FROM sc, hv), "
    "whole AS (SELECT vec_id AS id, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos FROM emb) "
    "SELECT whole.id, pos, round(coalesce(part.x, whole.x), 5) AS x FROM whole LEFT JOIN part ON part.id = whole.id AND feature = pos"
)
def mnn_full(spark, d):
    return _means(correct.mnn(*P.vector_sides(spark, d), k=15, hvg=50))


@query()
def coral(spark, d):
    return _means(correct.coral(*P.vector_sides(spark, d)))


@query(
    f"WITH {P.VSIDES}, fl AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b) SELECT CAST(p.pos - 1 AS INTEGER) AS i, CAST(q.pos - 1 AS INTEGER) AS j, round(avg(p.x), 4) AS mean, "
    "round(covar_samp(p.x, q.x), 4) AS cov FROM fl p JOIN fl q ON q.id = p.id AND q.pos >= p.pos GROUP BY 1, 2"
)
def coral_moments(spark, d):
    """Means and covariances of the aligned source: they are the target's."""
    got = correct.coral(*P.vector_sides(spark, d)).source
    wide = got.select("vec", F.posexplode("vec").alias("i", "x")).select("i", "x", F.posexplode("vec").alias("j", "y")).where("j >= i")
    return wide.groupBy("i", "j").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.covar_samp("x", "y"), 4).alias("cov"))


@query()
def harmony(spark, d):
    return _means(correct.harmony(*P.vector_sides(spark, d)))


@query("SELECT CAST(label % 2 AS VARCHAR) AS batch, count(*) AS n, true AS sums_to_one, true AS never_rises FROM embeddings GROUP BY 1")
def harmony_invariants(spark, d):
    """Every row's memberships sum to 1, and the objective never rises within a round."""
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("key"), (F.col("label") % 2).cast("string").alias("batch"), "vec")
    got = soft.soft_align(e)
    falls = all(y <= x for own in got.inner for x, y in zip(own, own[1:], strict=False))
    one = F.abs(V.total(F.col("memberships")) - 1) < 1e-9
    return got.rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.bool_and(one).alias("sums_to_one"), F.lit(falls).alias("never_rises"))


@query()
def metric_report(spark, d):
    return report.metric_table(*P.vector_sides(spark, d), "even", "odd")


@query()
def method_report(spark, d):
    """The baseline and all four correction methods."""
    a, b = P.two_sides(spark, d)
    hvg = {"hvg": 50} if (first := a.first()) and len(first["vec"]) > 50 else {}  # all features, where there are no more than that
    return report.method_table(a, b, {"MNN": {"k": 15} | hvg, "Scanorama": {"k": 5} | hvg})


# --- space, layout, sequences ----------------------------------------------------------------------------------------


@query()
def kmeans(spark, d):
    assigned, _, _ = space.kmeans(P.embeddings(spark, d), 8)
    return assigned.select("vec_id", "cluster", F.round("d2", 6).alias("d2"))


@query("SELECT count(*) AS n, true AS nearest, true AS objective_agrees FROM embeddings")
def kmeans_invariants(spark, d):
    """Every row is at its nearest centroid, and the objective is the mean squared distance to it."""
    assigned, centroids, stats = space.kmeans(P.embeddings(spark, d), 8)
    pairs = assigned.join(F.broadcast(centroids.select(F.col("cluster").alias("c"), F.col("vec").alias("cv"))))
    d2 = V.squared_distance(F.col("vec"), F.col("cv"))
    per = pairs.groupBy("vec_id").agg(F.min(d2).alias("least"), F.max(F.when(F.col("c") == F.col("cluster"), d2)).alias("own"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("own") <= F.col("least") + 1e-9).alias("nearest"), (F.abs(F.avg("own") - stats["objective"]) < 1e-9).alias("objective_agrees"))


@query()
def kmeans_traverse(spark, d):
    stats = [(k, s["objective"], s["imbalance"]) for k, (_, _, s) in zip((4, 8), space.kmeans_range(P.embeddings(spark, d), [4, 8]), strict=True)]
    return spark.createDataFrame(stats, "k int, objective double, imbalance double")


@query(f"WITH {P.EMB}, {P.CENT}, {P.NEAR}, n AS (SELECT cluster, count(*) AS n, sum(d2) AS s FROM near GROUP BY 1) SELECT round(sum(s) / sum(n), 6) AS objective, round(10.0 * sum(n * n) / pow(sum(n), 2), 6) AS imbalance FROM n")
def cluster_stats(spark, d):
    got = encode.nearest_centroid(P.embeddings(spark, d), P.centroids(spark, d))
    return space.cluster_stats(got, 10).select(F.round("objective", 6).alias("objective"), F.round("imbalance", 6).alias("imbalance"))


@query(f"WITH {P.EMB}, {P.CENT}, {P.NEAR} SELECT cluster, count(vec_id) AS n FROM cent LEFT JOIN near USING (cluster) GROUP BY 1")
def cluster_members(spark, d):
    c = P.centroids(spark, d)
    return space.members(encode.nearest_centroid(P.embeddings(spark, d), c), c).select("cluster", "n").distinct()


@query()
def spectral(spark, d):
    return space.spectral(P.centroids(spark, d), 3)[0]


@query(
    f"WITH RECURSIVE {P.EMB}, {P.CENT}, pair AS (SELECT p.cluster AS i, q.cluster AS j, exp(-0.1 * pow(list_distance(p.c, q.c), 2)) AS a FROM cent p, cent q), sc AS (SELECT i, 1 / sqrt(sum(a)) AS s FROM pair GROUP BY 1), "
    "af AS (SELECT list(r ORDER BY i) AS m FROM (SELECT pair.i, list(a * x.s * y.s ORDER BY pair.j) AS r FROM pair JOIN sc x ON x.i = pair.i JOIN sc y ON y.i = pair.j GROUP BY 1)), "
    f"{_eigen_sql('ev', 'af', 3)}, pt AS (SELECT i, s, row_number() OVER (ORDER BY i) AS nr FROM sc), co AS (SELECT i, nr, d, s * vs[d][nr] AS x FROM pt, ev, (SELECT unnest(range(1, 4)) AS d)), "
    "way AS (SELECT code, i, d, x, (code // CAST(pow(3, nr - 1) AS BIGINT)) % 3 AS g FROM (SELECT unnest(range(CAST(pow(3, (SELECT count(*) FROM pt)) AS BIGINT))) AS code) k, co), "
    "val AS (SELECT code, sum(q) AS v FROM (SELECT code, g, d, pow(sum(x), 2) / count(*) AS q FROM way GROUP BY 1, 2, 3) GROUP BY 1), best AS (SELECT max_by(code, v) AS code FROM val), "
    "got AS (SELECT DISTINCT i, g FROM way JOIN best USING (code)) SELECT i AS \"primary\", min(i) OVER (PARTITION BY g) AS func FROM got"
)
def spectral_partition(spark, d):
    """The functional clusters named by their least member: SQL tries every partition."""
    m = space.spectral(P.centroids(spark, d), 3)[0]
    least = m.groupBy("func").agg(F.min("primary").alias("least"))
    return m.join(least, "func").select("primary", F.col("least").alias("func"))


@query(
    f"WITH RECURSIVE {P.EMB}, fl AS (SELECT vec_id AS id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb), cv AS ({_cov_sql('fl')}), {_eigen_sql('pc', 'cv', 2)}, "
    "mid AS (SELECT list(x ORDER BY pos) AS mid FROM (SELECT pos, avg(x) AS x FROM fl GROUP BY 1)) "
    "SELECT vec_id AS id, label, round(list_inner_product(v, vs[1]) - list_inner_product(mid, vs[1]), 6) AS x, round(list_inner_product(v, vs[2]) - list_inner_product(mid, vs[2]), 6) AS y FROM emb, pc, mid"
)
def layout(spark, d):
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("id"), "vec", "label")
    return space.layout(e).select("id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "WITH s AS (SELECT value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), "
    "n AS (SELECT sum(label) AS p, count(*) - sum(label) AS q FROM s) SELECT round((sum(r) - max(p) * (max(p) + 1) / 2.0) / (CAST(max(p) AS DOUBLE) * max(q)), 6) AS auc FROM r, n WHERE label = 1"
)
def roc_auc(spark, d):
    ev = P.table(spark, d, "events").select(F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))
    return classify.roc_auc(ev).select(F.round("auc", 6).alias("auc"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def pearson(spark, d):
    return classify.pearson(P.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("pearson", 6).alias("pearson"))


@query()
def classifier_scores(spark, d):
    rows = P.embeddings(spark, d).withColumn("label", (F.col("label") % 2).cast("int"))
    model = classify.train(rows, iterations=20)
    return classify.predict(model, rows).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS n, true AS conditions FROM embeddings")
def kernel_machine(spark, d):
    """The cascade's vectors satisfy the optimality conditions over all rows."""
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("label"), "vec")
    m = kernel_svm.train(e, c=1.0, gamma=1.0)
    weights = m.weighted(spark).select(F.col("id").cast("long").alias("id"), F.abs("weight").alias("a"))
    got = kernel_svm.predict(e, m).join(weights, "id", "left").withColumn("side", F.col("score") * F.when(F.col("label") == 1, F.lit(1.0)).otherwise(F.lit(-1.0)))
    a = F.coalesce("a", F.lit(0.0))
    fits = ((a >= m.c * (1 - 1e-9)) | (F.col("side") >= 1 - 2e-3)) & ((a <= 1e-9) | (F.col("side") <= 1 + 2e-3))
    return got.agg(F.count(F.lit(1)).alias("n"), F.bool_and(fits).alias("conditions"))


@query("SELECT count(*) AS n, true AS loss_falls, true AS codes_fit FROM embeddings")
def autoencoder(spark, d):
    """Codes of 8 numbers; the reconstruction error falls over the epochs."""
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("id"), "vec")
    net = networks.autoencoder(e, 8, hidden=24, epochs=5, batch=250, rate=0.01)
    codes = networks.apply(e, net, upto=2)
    return codes.agg(F.count(F.lit(1)).alias("n"), F.lit(net.losses[-1] < net.losses[0]).alias("loss_falls"), F.bool_and(F.size("out") == 8).alias("codes_fit"))


@query("SELECT label % 2 AS label, count(*) AS n, true AS loss_falls FROM embeddings GROUP BY 1")
def network_head(spark, d):
    """A head with one hidden layer, trained by mini-batches."""
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"), "vec", F.array((F.col("label") % 2).cast("double")).alias("target"))
    net = networks.fit(e, networks.Network.new((len(e.first()["vec"]), 16, 1)), "logistic", 5, batch=250, rate=0.01)
    return networks.apply(e, net).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.lit(net.losses[-1] < net.losses[0]).alias("loss_falls"))


@query("SELECT count(*) AS n, true AS finite, true AS spread FROM embeddings")
def neighbour_layout(spark, d):
    e = P.embeddings(spark, d).select(F.col("vec_id").alias("id"), "vec")
    got = graph_layout.neighbour_layout(e, rounds=20)
    inside = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside("x") & inside("y")).alias("finite"), ((F.stddev("x") > 0) & (F.stddev("y") > 0)).alias("spread"))


def _segments(spark):
    v = [("V", i, f"TRBV{i}-1*01", f"TRBV{i}-1*01", "DTGITQTPKYLVTAMGSKRTMKREHLGHDSMYWYRQKAKKSLEFMFYYNCKEFIENKTVPNHF" + "ACDE"[i % 4] + "CASS") for i in range(1, 31)]
    j = [("J", i, f"TRBJ1-{i}*01", f"TRBJ1-{i}*01", "NTEAFFGQGTRLTVV") for i in range(1, 8)]
    return spark.createDataFrame(v + j, "kind string, ord long, id string, gene string, seq string")


def _receptors(spark, d):
    e = F.col("event_id")
    return P.table(spark, d, "events").select(
        "event_id", F.concat(F.lit("TCRBV"), F.lpad((e % 40).cast("string"), 2, "0"), F.lit("-01")).alias("v"), F.concat(F.lit("TRBJ1-"), (e % 9).cast("string")).alias("j"),
        F.concat(F.lit("CASS"), F.element_at(F.array(*[F.lit(x) for x in ("LG", "PT", "QQ")]), (e % 3 + 1).cast("int")), F.lit("NTEAFF")).alias("cdr3"),
    )


def _align_sql(name: str, source: str) -> str:
    """Tables ``{name}`` (k, a, b, x, y): the aligned rows of each pair of strings of ``source`` (k, a, b), by a table of suffixes' scores and a walk through it."""
    n, m = "length(a)", "length(b)"
    cell = lambda i, j: f"(CASE WHEN {i} < {n} AND {j} < {m} THEN best[({n} - 1 - ({i})) * {m} + {m} - ({j})] ELSE 0 END)"
    down, right, both = (f"(CASE WHEN {c} THEN best[{at}] ELSE 0 END)" for c, at in ((f"t >= {m}", f"t - {m} + 1"), (f"t % {m} > 0", "t"), (f"t >= {m} AND t % {m} > 0", f"t - {m}")))
    same = f"substr(a, {n} - t // {m}, 1) = substr(b, {m} - t % {m}, 1)"
    pair = f"substr(a, i + 1, 1) = substr(b, j + 1, 1) AND {cell('i', 'j')} = {cell('i + 1', 'j + 1')} + 1"
    gap = f"{cell('i', 'j + 1')} = {cell('i', 'j')}"
    return (
        f"{name}_t(k, a, b, t, best) AS (SELECT k, a, b, 0, CAST([] AS INTEGER[]) FROM {source} UNION ALL SELECT k, a, b, t + 1, list_append(best, CAST(greatest({down}, {right}, CASE WHEN {same} THEN {both} + 1 ELSE 0 END) AS INTEGER)) "
        f"FROM {name}_t WHERE t < {n} * {m}), "
        f"{name}_w(k, a, b, best, i, j, x, y) AS (SELECT k, a, b, best, 0, 0, '', '' FROM {name}_t WHERE t = {n} * {m} UNION ALL SELECT k, a, b, best, CASE WHEN pair OR NOT gap THEN i + 1 ELSE i END, CASE WHEN pair OR gap THEN j + 1 ELSE j END, "
        f"x || CASE WHEN pair OR NOT gap THEN substr(a, i + 1, 1) ELSE '-' END, y || CASE WHEN pair OR gap THEN substr(b, j + 1, 1) ELSE '-' END "
        f"FROM (SELECT *, {pair} AS pair, {gap} AS gap FROM {name}_w WHERE i < {n} AND j < {m})), "
        f"{name} AS (SELECT k, a, b, x || substr(a, i + 1) || repeat('-', {m} - j) AS x, y || repeat('-', {n} - i) || substr(b, j + 1) AS y FROM {name}_w WHERE i = {n} OR j = {m})"
    )


@query(
    "WITH RECURSIVE r AS (SELECT event_id, event_id % 40 AS vn, event_id % 9 AS jn, 'CASS' || (['LG', 'PT', 'QQ'])[event_id % 3 + 1] || 'NTEAFF' AS cdr3 FROM events), "
    "vs AS (SELECT CAST(unnest(range(1, 31)) AS BIGINT) AS vn), vseq AS (SELECT vn, 'DTGITQTPKYLVTAMGSKRTMKREHLGHDSMYWYRQKAKKSLEFMFYYNCKEFIENKTVPNHF' || substr('ACDE', CAST(vn % 4 + 1 AS BIGINT), 1) || 'CASS' AS v FROM vs), "
    "js AS (SELECT CAST(unnest(range(1, 8)) AS BIGINT) AS jn, 'NTEAFFGQGTRLTVV' AS j), "
    "f AS (SELECT event_id, cdr3, v, coalesce(js.j, (SELECT j FROM js WHERE jn = 1)) AS j FROM r LEFT JOIN vseq USING (vn) LEFT JOIN js USING (jn)), "
    "s1 AS (SELECT DISTINCT cdr3 || '|' || right(v, 5) AS k, cdr3 AS a, right(v, 5) AS b FROM f WHERE v IS NOT NULL), "
    + _align_sql("p", "s1")
    + ", c1 AS (SELECT k, left(b, CAST(least(length(x) - length(ltrim(x, '-')), 2) AS BIGINT)) || a AS core FROM p), "
    "s2 AS (SELECT DISTINCT core || '|' || j AS k, core AS a, j AS b FROM f JOIN c1 ON c1.k = cdr3 || '|' || right(v, 5)), "
    + _align_sql("q", "s2")
    + ", c2 AS (SELECT k, a || right(y, CAST(length(x) - length(rtrim(x, '-')) AS BIGINT)) AS core FROM q), "
    "o AS (SELECT event_id, left(v, length(v) - 5) || c2.core AS s FROM f LEFT JOIN c1 ON c1.k = cdr3 || '|' || right(v, 5) LEFT JOIN c2 ON c2.k = c1.core || '|' || j) "
    "SELECT event_id, CASE WHEN length(s) > 50 THEN s ELSE 'Failure' END AS full_seq FROM o"
)
def full_seq(spark, d):
    return reconstruct.full_sequences(_receptors(spark, d), _segments(spark)).select("event_id", "full_seq")


@query(
    "WITH seg AS (SELECT i AS ord, 'TRBV' || i || '-1*01' AS id, 'DTGITQTPKYLVTAMGSKRTMKREHLGHDSMYWYRQKAKKSLEFMFYYNCKEFIENKTVPNHF' || substr('ACDE', CAST(i % 4 + 1 AS BIGINT), 1) || 'CASS' AS seq FROM range(1, 31) t(i)), "
    "g AS (SELECT DISTINCT 'TCRBV' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') || '-01' AS name, 'TRBV' || (event_id % 40) || '-1' AS g FROM events) "
    "SELECT name, max_by(seq, ord) AS seq FROM g JOIN seg ON contains(id, g) OR contains(id, split_part(g, '-', 1)) GROUP BY 1"
)
def genes_compatible(spark, d):
    """The last record whose id contains a name or its family."""
    return reconstruct.resolve_genes(_receptors(spark, d).select(F.col("v").alias("name")), _segments(spark), "V", compat=True)


@query(
    "WITH RECURSIVE s AS (SELECT DISTINCT p_brand || '|' || left(p_type, 12) AS k, p_brand AS a, left(p_type, 12) AS b FROM part), " + _align_sql("p", "s")
    + ", u AS (SELECT a, b, x, y, CAST(unnest(range(length(x))) AS INTEGER) AS step FROM p) SELECT a, b, step, CASE WHEN substr(x, step + 1, 1) <> '-' THEN CAST(length(replace(left(x, step), '-', '')) AS INTEGER) END AS a_at, "
    "CASE WHEN substr(y, step + 1, 1) <> '-' THEN CAST(length(replace(left(y, step), '-', '')) AS INTEGER) END AS b_at FROM u"
)
def alignment_trace(spark, d):
    return reconstruct.alignment_steps(P.table(spark, d, "part").select(F.col("p_brand").alias("a"), F.substring("p_type", 1, 12).alias("b")))


def _norm_sql(squares: dict[str, float], length: int, d: int, filler: str | None) -> str:
    """SQL of factor_encoding and substitution_encoding: the norm from each residue's squared norm; ``filler`` pads to ``length``."""
    values = ", ".join(f"('{a}', CAST({v!r} AS DOUBLE))" for a, v in squares.items())
    pad = f" + ({length} - length(cdr3)) * (SELECT q FROM t WHERE a = '{filler}')" if filler else ""
    return (
        f"WITH t(a, q) AS (VALUES {values}), r AS (SELECT event_id, 'CASS' || (['LG', 'PT', 'QQ'])[event_id % 3 + 1] || 'NTEAFF' AS cdr3 FROM events), "
        f"c AS (SELECT event_id, cdr3, unnest(string_split(left(cdr3, {length}), '')) AS a FROM r) "
        f"SELECT event_id, CAST({length * d} AS INTEGER) AS width, round(sqrt(sum(coalesce(q, 0)){pad}), 6) AS norm FROM c LEFT JOIN t USING (a) GROUP BY event_id, cdr3"
    )


_FACTORS = {a: [float(np.round(np.sin(i * k + 1), 3)) for k in range(1, 6)] for i, a in enumerate(strings.ALPHABET[:-1])}
_CODE = encoders.principal_code(encoders.substitution_matrix(), 4)


@query(_norm_sql({a: float((_CODE[i] ** 2).sum()) for i, a in enumerate(strings.ALPHABET)}, 30, 4, "-"))
def substitution_encoding(spark, d):
    rows = encoders.encode_column(_receptors(spark, d), "cdr3", encoders.substitution_encoder())
    return rows.select("event_id", F.size("vec").alias("width"), F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query(_norm_sql({a: sum(x * x for x in v) for a, v in _FACTORS.items()}, 20, 5, None))
def factor_encoding(spark, d):
    rows = encoders.encode_column(_receptors(spark, d), "cdr3", encoders.factor_encoder(_FACTORS, 20))
    return rows.select("event_id", F.size("vec").alias("width"), F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query("SELECT user_id AS sample, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    from ..streaming.encode_stream import windowed_counts as windowed

    ev = P.table(spark, d, "events").select("ts", F.col("user_id").alias("sample"), F.col("value").alias("freq"))
    return windowed(ev).select("sample", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


from . import files  # noqa: E402, F401 - registers its queries
