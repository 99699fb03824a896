"""Analytic cases, edge cases and independent NumPy versions of the engine's operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoframe.functions import encoders, strings
from clonoframe.functions import vectors as V
from clonoframe.operators import blocks, classify, correct, encode, graph_layout, kernel_svm, metrics, neighbors, networks, preprocess, reconstruct, soft, space
from clonoframe.plans import workflows
from clonoframe.sources import repertoire
from clonoframe.state import checkpointed
from clonoframe.streaming import encode_stream


def side(spark, rows, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<double>")


def value(df):
    return df.first()[0]


def test_pair_metrics(spark):
    a, b = side(spark, [[1, 0]]), side(spark, [[0, 1]], 10)
    assert value(metrics.jsd(a, b)) == pytest.approx(math.log(2))
    assert value(metrics.jsd(a, a)) == pytest.approx(0)
    assert value(metrics.cross_entropy(a, b)) == pytest.approx(-math.log(1e-9), abs=1e-5)
    assert value(metrics.cosine_distance(a, b)) == pytest.approx(1)
    assert value(metrics.cosine_distance(a, side(spark, [[2, 0]]))) == pytest.approx(0)
    assert value(metrics.cosine_distance(a, side(spark, [[-1, 0]]))) == pytest.approx(2)
    zero = side(spark, [[0, 0]])
    assert value(metrics.jsd(a, zero)) is None and value(metrics.cosine_distance(a, zero)) is None
    x, y = side(spark, [[0], [0]]), side(spark, [[1], [1]], 10)
    assert value(metrics.mmd(x, y)) == pytest.approx(2 - 2 * math.exp(-0.5), abs=1e-6)
    assert value(metrics.mmd(side(spark, [[0]]), y)) == 0
    assert value(metrics.ilisi(x, y)) == 1.0


def test_median_distance(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(37, 3))
    want = np.median(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)))
    assert metrics.median_distance(side(spark, x), side(spark, y), bins=8) == pytest.approx(want)


def test_kbet(spark):
    rng = np.random.default_rng(1)
    a, b = side(spark, rng.normal(size=(30, 4))), side(spark, rng.normal(size=(30, 4)) + 100, 100)
    assert value(metrics.kbet(a, b)) == 1.0
    assert value(metrics.kbet(side(spark, rng.normal(size=(20, 1))), side(spark, rng.normal(size=(20, 1)), 50))) == 1.0
    with pytest.raises(ValueError):
        metrics.kbet(side(spark, [[1, 2]]), side(spark, [[1, 3]], 5))


def test_ilisi_mixed_and_apart(spark):
    rng = np.random.default_rng(2)
    a = side(spark, rng.normal(size=(110, 3)))
    assert value(metrics.ilisi(a, side(spark, rng.normal(size=(130, 3)), 1000))) < 0.3
    assert value(metrics.ilisi(a, side(spark, rng.normal(size=(110, 3)) + 1000, 1000))) > 0.95


def test_knn_and_blocks(spark, monkeypatch):
    from clonoframe.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 256)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, size=(50, 3)), rng.integers(0, 3, size=(60, 3))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(50) for j in sorted(range(60), key=lambda j: (d[i, j], j))[:4]}
    assert {(r.i, r.j) for r in neighbors.knn(side(spark, x), side(spark, y), 4).collect()} == want
    cells = blocks.cells(side(spark, x), side(spark, y), lambda i, a, j, b: [(len(i) * len(j),)], "n long", id_type="long", block=7)
    assert cells.agg(F.sum("n")).first()[0] == 3000


def test_nearest_centroid_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = side(spark, rng.normal(size=(40, 5)))
    c = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(9, 5)))], "cluster int, vec array<double>")
    one = {r.id: r.cluster for r in encode.nearest_centroid(rows, c).collect()}
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 10)
    assert {r.id: r.cluster for r in encode.nearest_centroid(rows, c, key="id").collect()} == one
    with pytest.raises(ValueError):
        encode.nearest_centroid(rows, c)
    tie = spark.createDataFrame([(4, [1.0]), (2, [1.0])], "cluster int, vec array<double>")
    monkeypatch.undo()
    assert encode.nearest_centroid(side(spark, [[0]]), tie).first()["cluster"] == 2


def test_features(spark):
    d = spark.createDataFrame([("s", [1, 1], [3.0, 1.0]), ("z", [0, 0], [0.0, 0.0])], "sample string, diversity array<long>, abundance array<double>")
    got = {r.sample: r.vec for r in encode.feature_matrix(d).collect()}
    assert got["s"] == pytest.approx([math.log(1.75), math.log(1.25), 0.5, 0.5], abs=1e-6) and got["z"] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        encode.feature_matrix(d, "both")
    enc = spark.createDataFrame([("s", i, n, float(n)) for i, n in enumerate((1, 2, 4))], "sample string, cluster int, diversity long, abundance double")
    m = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "primary int, func int")
    assert {(r.cluster, r.diversity) for r in encode.functional_rollup(enc, m, 2).collect()} == {(0, 5), (1, 2)}
    dense = encode.dense(enc, spark.createDataFrame([("s",), ("none",)], "sample string"), 4)
    assert {r.sample: r.diversity for r in dense.collect()} == {"s": [1, 2, 4, 0], "none": [0, 0, 0, 0]}


def test_preprocess(spark):
    rows = spark.createDataFrame([("s", 0, "Failure", 9.0), ("s", 1, "a", 5.0), ("s", 2, "b", 5.0), ("s", 3, None, float("nan")), ("s", 4, "d", None)], "sample string, row_id long, full_seq string, freq double")
    assert [r.row_id for r in preprocess.top_clones(rows, 1).collect()] == [1]
    assert preprocess.top_clones(rows, 9).count() == 4
    assert value(preprocess.failure_rate(rows)) == pytest.approx(20)
    a, b = (spark.createDataFrame([tuple(range(n))], ", ".join(f"feature_{i} int" for i in range(n))) for n in (12, 13))
    assert preprocess.common_features([a, b]) == [f"feature_{i}" for i in range(12)]
    assert preprocess.downsample(rows, 2, "row_id", 3).collect() == preprocess.downsample(rows.repartition(3), 2, "row_id", 3).collect()


def test_strings(spark):
    df = spark.createDataFrame([("TCRBV05-01",), ("TCRBJ02-03",), ("TRBV5-1",), (None,)], "s string")
    assert [r[0] for r in df.select(strings.rename_gene(F.col("s"))).collect()] == ["TRBV5-1", "TRBJ2-3", "TRBV5-1", None]
    one = spark.createDataFrame([("ABC",), ("ABCDEFG",), ("",)], "s string")
    assert [r[0] for r in one.select(strings.pad_gap(F.col("s"), 6)).collect()] == ["AB---C", None, "------"]
    assert one.select(strings.residue_numbers(F.col("s"))).first()[0] == [0, -1, 4]


def test_encoders(spark):
    assert encoders.gap_padded("ABC", 6) == "AB---C"
    m = encoders.substitution_matrix()
    assert m.shape == (21, 21) and np.allclose(m, m.T) and m.max() == 1 and m[20, 20] == m.diagonal()[:20].min()
    assert encoders.substitution_encoder(15, 8)(["CASSF"]).shape == (1, 120)
    bad = encoders.substitution_encoder(3)(["CASSF", "CXS", "CAS"])
    assert np.isnan(bad[:2]).all() and not np.isnan(bad[2]).any()
    rows = encoders.encode_column(spark.createDataFrame([("CAS",), (None,), ("CASSF",), ("C*S",), ("",)], "s string"), "s", encoders.substitution_encoder(3))
    assert [r.vec is None for r in rows.collect()] == [False, True, True, True, False]
    f = encoders.factor_encoder({"A": [1.0, 2.0]}, 3)
    assert f(["AXAA", "A"]).tolist() == [[1, 2, 0, 0, 1, 2], [1, 2, 0, 0, 0, 0]]
    assert encoders.mean_pooled(np.array([[[1.0], [3.0], [9.0]]]), np.array([[1, 1, 0]])).tolist() == [[2.0]]


def test_reconstruct(spark):
    seg = spark.createDataFrame(
        [("V", 0, "x|TRBV10-1*02", "TRBV10-1*02", "M" * 60 + "LCASS"), ("V", 1, "x|TRBV10-1*01", "TRBV10-1*01", "K" * 60 + "LCASS"), ("V", 2, "x|TRBV10-3*04", "TRBV10-3*04", "Q" * 60 + "LCASS"),
         ("J", 0, "x|TRBJ1-1*01", "TRBJ1-1*01", "NTEAFFGQGTRLTVV")], "kind string, ord long, id string, gene string, seq string")
    rows = spark.createDataFrame([("TCRBV10-01", "TRBJ1-1", "CASSPNTEAFF"), ("TRBV10-9", None, "CASSP"), (None, "TRBJ1-1", "CASSP"), ("unresolved", "x", "C"), ("TRBV99", "x", "C")], "v string, j string, cdr3 string")
    got = [r.full_seq for r in reconstruct.full_sequences(rows, seg).orderBy(F.col("v").isNull(), "v").collect()]
    assert sorted(set(got)) == sorted({"K" * 60 + "LCASSPNTEAFFGQGTRLTVV", "K" * 60 + "LCASSP", "Failure"})
    compat = reconstruct.resolve_genes(spark.createDataFrame([("TRBV10-1",)], "name string"), seg, "V", compat=True)
    assert compat.first()["seq"].startswith("Q")


def test_coral(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 3, rng.normal(size=(150, 4)) @ rng.normal(size=(4, 4)) - 1
    got = np.array([r.vec for r in correct.coral(side(spark, x), side(spark, y)).source.orderBy("id").collect()])
    assert np.allclose(got.mean(axis=0), y.mean(axis=0)) and np.allclose(np.cov(got.T), np.cov(y.T), atol=1e-4)
    with pytest.raises(ValueError):
        correct.coral(side(spark, [[1, 2]]), side(spark, [[1]]))


def test_scanorama_pair(spark):
    a, b = np.array([1.0, 0.0]), np.array([0.6, 0.8])
    got = correct.scanorama(side(spark, [a]), side(spark, [b], 5), k=1)
    assert got.source.first()["vec"] == pytest.approx(list(a + 0.1 * (b - a))) and got.target.first()["vec"] == pytest.approx(list(b + 0.1 * (a - b)))


def plain_variance_scale(ref: np.ndarray, new: np.ndarray, corr: np.ndarray, rows: list[int], sigma: float) -> np.ndarray:
    """Scales (at least 1) of the corrections of some rows of ``new``: the reference's quantile at the row's weighted rank along the correction."""
    out = np.ones(len(rows))
    for k, i in enumerate(rows):
        length = np.linalg.norm(corr[i])
        if length == 0:
            continue
        g = corr[i] / length

        def along(m, g=g, x=new[i]):
            p = m @ g
            rest = (m - x) - np.outer((m - x) @ g, g)
            return p, np.exp(-(rest**2).sum(axis=1) / sigma)

        p, w = along(new)
        own = p[i]  # the same product, so that the row counts itself
        rank = w[p <= own].sum() / w.sum()
        q, v = along(ref)
        order = np.argsort(q, kind="stable")
        reach = np.cumsum(v[order]) > rank * v.sum()
        at = order[int(reach.argmax())] if reach.any() else order[-1]
        out[k] = max((q[at] - own) / length, 1.0)
    return out


def test_mnn_numpy(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(25, 6)), rng.normal(size=(20, 6)) + 0.5
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = unit(x), unit(y)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    k = 4
    near_b = [set(np.argsort(d[i])[:k]) for i in range(25)]
    near_a = [set(np.argsort(d[:, j])[:k]) for j in range(20)]
    pairs = [(i, j) for i in range(25) for j in range(20) if j in near_b[i] and i in near_a[j]]
    mean = {j: np.mean([a[i] - b[j] for i, jj in pairs if jj == j], axis=0) for j in {j for _, j in pairs}}
    w = np.exp(-(1 - b @ b[list(mean)].T))
    want = (w / w.sum(axis=1, keepdims=True)) @ np.array(list(mean.values()))
    got = np.array([r.corr for r in correct.mnn_vectors(side(spark, a), side(spark, b), k).orderBy("id").collect()])
    assert np.allclose(got, want)
    full = correct.mnn(side(spark, x), side(spark, y, 100), k=k)
    scale = plain_variance_scale(a, b, want, list(range(20)), 1.0)
    assert np.allclose(np.array([r.vec for r in full.target.orderBy("id").collect()]), b + want * scale[:, None]) and (scale >= 1).all()
    assert np.allclose(np.array([r.vec for r in full.source.orderBy("id").collect()]), a)
    assert plain_variance_scale(a, b, np.zeros_like(want), [0], 1.0)[0] == 1
    svd = correct.mnn(side(spark, x), side(spark, y, 100), k=k, hvg=4, svd_dim=1, variance=False)
    assert len(svd.features) == 4 and np.allclose(np.delete(np.array(svd.target.orderBy("id").first()["vec"]), svd.features), np.delete(y[0], svd.features))
    many = correct.mnn_many([side(spark, x), side(spark, y, 100)], k=k, variance=False)
    assert len(many) == 2 and many[1].count() == 20


def soft_rows(spark, x, batch):
    return spark.createDataFrame([(i, str(b), v.tolist()) for i, (v, b) in enumerate(zip(x, batch, strict=True))], "key long, batch string, vec array<double>")


def plain_soft(x, batch, block, centroids, sigma, theta, lam, outer, inner):
    """Soft clustering and correction of whole matrices, with the same blocks and steps."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    phi, share = np.eye(batch.max() + 1)[batch], np.bincount(batch) / len(batch)
    z, y = unit(x), unit(centroids)
    weights = np.ones((block.max() + 1, len(y), phi.shape[1]))

    def look(z, y, weights):
        d = 2 * (1 - z @ y.T)
        r = np.exp(-(d - d.min(axis=1, keepdims=True)) / sigma) * weights[block, :, batch]
        r /= r.sum(axis=1, keepdims=True)
        o = r.T @ phi
        e = np.outer(o.sum(axis=1), share)
        return r, (r * d).sum() + sigma * (r * np.log(r)).sum() + sigma * (o * theta * np.log((o + 1) / (e + 1))).sum()

    trace = []
    for _ in range(outer):
        r, value = look(z, y, weights)
        own, rate = [value], 1.0
        for _ in range(inner):
            rate = min(1.0, 2 * rate)
            wanted = np.array([((np.outer((o := r[block != n].T @ phi[block != n]).sum(axis=1), share) + 1) / (o + 1)) ** theta for n in range(len(weights))])
            following = unit(r.T @ z)
            while True:
                w = weights ** (1 - rate) * wanted**rate
                new, value = look(z, following, w)
                if value <= own[-1] or rate < 0.05:
                    break
                rate /= 2
            if value > own[-1]:
                break
            y, weights, r = following, w, new
            own.append(value)
        trace.append(own)
        out = x.copy()
        one = np.hstack([np.ones((len(x), 1)), phi])
        for k in range(len(y)):
            by = one * r[:, k : k + 1]
            b = np.linalg.solve(by.T @ one + np.diag([0.0] + [lam] * phi.shape[1]) + 1e-12 * np.eye(one.shape[1]), by.T @ x)
            out -= by[:, 1:] @ b[1:]
        z = unit(out)
    return out, r, trace


def test_soft_clustering_equals_whole_matrices(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 4)) + c for c in ([4, 0, 0, 0], [0, 4, 0, 0], [4, 1, 0, 0], [0, 4, 2, 0])])
    batch = np.repeat([0, 0, 1, 2], 40)
    rows = soft_rows(spark, x, batch)
    n = 10
    block = np.array([r[0] for r in rows.orderBy("key").select(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(n))).collect()])
    start = rng.normal(size=(3, 4))
    got = soft.soft_align(rows, clusters=3, block=1 / n, sigma=0.3, theta=1.5, outer=3, inner=4, eps_outer=-1.0, eps_inner=-1.0, seed=5, cluster_fn=lambda *_: start)
    out, r, trace = plain_soft(x, batch, block, start, 0.3, 1.5, 1.0, 3, 4)
    table = got.rows.orderBy("key").collect()
    assert np.allclose([t.vec for t in table], out) and np.allclose([t.memberships for t in table], r)
    assert [len(i) for i in got.inner] == [len(i) for i in trace] and np.allclose(np.concatenate(got.inner), np.concatenate(trace))
    assert all(b <= a for own in got.inner for a, b in zip(own, own[1:], strict=False))
    assert [t.batch for t in table] == [str(b) for b in batch]
    direct, blocks.DIRECT = blocks.DIRECT, 0  # the sums that Spark adds by position
    try:
        again = soft.soft_align(rows, clusters=3, block=1 / n, sigma=0.3, theta=1.5, outer=1, inner=2, seed=5, cluster_fn=lambda *_: start)
    finally:
        blocks.DIRECT = direct
    assert np.allclose(again.trace[0], trace[0][0])


def test_harmony_mixes(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(60, 5)) + 2, rng.normal(size=(60, 5)) + 3])
    got = correct.harmony(side(spark, x[:60]), side(spark, x[60:]), clusters=3)
    out = np.array([r.vec for t in (got.source, got.target) for r in t.orderBy("id").collect()])
    gap = lambda m: np.linalg.norm(m[:60].mean(axis=0) - m[60:].mean(axis=0))
    assert out.shape == x.shape and gap(out) < 0.7 * gap(x)
    with pytest.raises(ValueError):
        correct.harmony(side(spark, x[:20]), side(spark, x[60:80]))


def test_hvg(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 30)) * rng.uniform(0.1, 3, 30) + rng.uniform(0, 5, 30)
    x[:, 3] = 1
    mean, var = x.mean(axis=0), x.var(axis=0)
    keep = var > 0
    edges = np.linspace(mean[keep].min(), mean[keep].max(), 21)
    bins = np.maximum(0, np.searchsorted(edges, mean, side="left") - 1)
    z = np.zeros(30)
    for b in set(bins[keep]):
        at = keep & (bins == b)
        if at.sum() > 1:
            z[at] = (var[at] - var[at].mean()) / (var[at].std(ddof=1) + 1e-6)
    want = sorted(np.flatnonzero(keep), key=lambda i: (-z[i], i))[:10]
    assert [r.feature for r in correct.highly_variable(side(spark, x), 10).collect()] == want
    with pytest.raises(ValueError):
        correct.highly_variable(side(spark, x), 31)


def test_space(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(20, 2)) + c for c in ([0, 0], [20, 0], [0, 20])])
    assigned, centroids, stats = space.kmeans(side(spark, x), 3)
    assert sorted(r["count"] for r in assigned.groupBy("cluster").count().collect()) == [20, 20, 20] and stats["imbalance"] == pytest.approx(1)
    mapping, means = space.spectral(centroids, 2, gamma=0.001)
    assert mapping.count() == 3 and means.count() == 2
    flat = space.layout(side(spark, x))
    assert set(flat.columns) == {"id", "x", "y"}
    far = spark.createDataFrame([(0, [0.0, 0.0]), (1, [999.0, 999.0])], "cluster int, vec array<double>")
    rows = space.members(encode.nearest_centroid(side(spark, x), far), far)
    assert {(r.cluster, r.n): r["count"] for r in rows.groupBy("cluster", "n").count().collect()} == {(0, 60): 60, (1, 0): 1}
    assert rows.where("n = 0").first()["vec"] == [0, 0]


def test_classify(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "score double, label int")
    pos, neg = [0.35, 0.8, 0.4], [0.1, 0.4]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert value(classify.roc_auc(rows)) == pytest.approx(want)
    assert value(classify.roc_auc(rows.where("label = 1"))) is None
    train = spark.createDataFrame([([float(i), 1.0], int(i > 5)) for i in range(12)], "vec array<double>, label int")
    for head in ("svm", "mlp"):
        got = classify.predict(classify.train(train, head=head, hidden=(4,), iterations=50), train)
        assert value(classify.roc_auc(got)) > 0.9


def test_sources(spark, tmp_path):
    d = tmp_path / "rep"
    (d / "sub").mkdir(parents=True)
    (d / "a.tsv").write_text("full_seq\tcount (templates/reads)\nAAA\t2\nBBB\tnan\n")
    (d / "sub" / "b.tsv").write_text("aminoAcid\tvMaxResolved\tjMaxResolved\tfrequencyCount\tfull_seq\nCAF\tV\tJ\t0.5\tCCC\n")
    (d / "bad.tsv").write_text("x\ty\n1\t2\n")
    paths = repertoire.list_files(spark, str(d))
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["a.tsv", "bad.tsv", "b.tsv"]
    assert repertoire.list_files(spark, str(tmp_path / "none")) == []
    got = {r.full_seq: (r["sample"], r.freq) for r in repertoire.read_repertoires(spark, paths).collect()}
    assert got == {"AAA": ("a.tsv", 2.0), "BBB": ("a.tsv", None), "CCC": ("b.tsv", 0.5)}
    assert repertoire.samples_of(spark, paths, 1).count() == 3
    m = tmp_path / "m.txt"
    m.write_text("/x/s1_filt_full.tsv\n\n/x/s2.tsv\n")
    assert {r["sample"] for r in repertoire.read_manifest(spark, str(m)).collect()} == {"s1", "s2.tsv"}
    assert repertoire.read_directory(spark, str(d), suffix_length=4, n=1).count() == 1
    fa = tmp_path / "v.fasta"
    fa.write_text(">L1|TRBV1*01|Homo sapiens|P|\nDTG\nITQ\n>L2|TRBV2*01|x\nEPE\n")
    assert [(r.gene, r.seq) for r in repertoire.read_fasta(spark, str(fa)).orderBy("ord").collect()] == [("TRBV1*01", "DTGITQ"), ("TRBV2*01", "EPE")]
    with pytest.raises(ValueError):
        repertoire.read_table(spark, "x.txt")
    for bad in ((None, None, None), ("a", None, "c")):
        with pytest.raises(ValueError):
            repertoire.check_groups(*bad)
    assert repertoire.check_groups("n", "p", None) == [("n", 0), ("p", 1)]
    enc = spark.createDataFrame([("d", "s", 1, 0, 2, 1.0)], "dataset string, sample string, label int, cluster int, diversity long, abundance double")
    out = str(tmp_path / "enc")
    repertoire.write_encoded(enc, out)
    with pytest.raises(Exception, match="exist"):
        repertoire.write_encoded(enc, out)
    assert repertoire.read_encoded(spark, out).count() == 1
    with pytest.raises(FileNotFoundError):
        repertoire.require_model(spark, str(d), ("model.bin",))
    assert repertoire.read_substitutions("H A\nM rows = A\n1\n//\nH B\nM rows = A, cols = A\n2\n3 4\n//", "B") == "2\n3 4"


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = spark.createDataFrame([(f"s{i % 3}", float(i), [float(v) for v in rng.normal(size=2)]) for i in range(60)], "sample string, freq double, vec array<double>")
    c = spark.createDataFrame([(0, [-1.0, 0.0]), (1, [1.0, 0.0])], "cluster int, vec array<double>")
    src = str(tmp_path / "in")
    rows.repartition(6).write.parquet(src)
    stream = encode_stream.stream_clonotypes(spark, src, rows.schema.simpleString()[7:-1].replace(":", " "), 2)
    q = encode_stream.encode_stream(stream, c).writeStream.format("memory").queryName("enc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["sample"], r.cluster, r.diversity, round(r.abundance, 6)) for r in df.collect())
    assert key(spark.table("enc")) == key(encode.encode_samples(rows, c))
    parts, check = str(tmp_path / "parts"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        encode_stream.run_to_parts(stream, parts, check, c).awaitTermination()
    assert spark.read.parquet(parts).count() == 60


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.l2_normalize(F.col("a")).alias("n"), V.cosine_distance(F.col("a"), F.col("b")).alias("c"), V.standardize(F.col("b")).alias("s")).first()
    assert r.n == pytest.approx([0.6, 0.8]) and r.c is None and r.s == [0, 0]


def test_workflows(spark, tmp_path):
    from clonoframe.plans import workflows as W

    rng = np.random.default_rng(11)
    seqs = ["CASS" + "".join(rng.choice(list("ACDEFGHIKL"), 6)) + "F" for _ in range(40)]
    built = W.build_space(spark.createDataFrame([(s,) for s in seqs], "sequence string"), 4, 2)
    assert built["mapping"].count() == 4 and built["functional"].count() == 2
    features = {}
    for d in ("one", "two"):
        folder = tmp_path / d
        folder.mkdir()
        for i in range(3):
            pick = rng.choice(seqs, 10)
            (folder / f"s{i}.tsv").write_text("full_seq\tfrequencyCount\n" + "".join(f"{s}\t{k + 1}\n" for k, s in enumerate(pick)) + "Failure\t9\n")
        (folder / "zero.tsv").write_text("other\n1\n")
        enc, samples = W.encode_dataset(spark, W.EncodeConfig(d, neg_dir=str(folder)), built["centroids"])
        assert samples.count() == 4 and enc.agg(F.sum("diversity")).first()[0] == 30
        features[d] = W.dataset_features(enc, samples, built["mapping"], 4, 2)
        assert features[d].count() == 4
    table = W.compare(features, {"CrossEntropy": metrics.cross_entropy, "CosineDistance": metrics.cosine_distance})
    row = table.first()
    assert (row.Dataset1, row.Dataset2, row.n_samples_1) == ("one", "two", 4) and row.CosineDistance != row.CosineDistance
    with pytest.raises(ValueError):
        W.EncodeConfig("x")
    with pytest.raises(Exception, match="finite"):
        W.assert_finite(side(spark, [[float("nan")]])).collect()


def test_method_report_has_all_methods(spark):
    from clonoframe.plans import registry

    got = {r.Method: r for r in registry.queries()["method_report"](spark, "/root/testdata/sf0.01").collect()}
    assert list(got) == ["Baseline", "CORAL", "Harmony", "MNN", "Scanorama"]
    assert all(math.isfinite(r.JSD) and math.isfinite(r.JSD_improvement) for r in got.values())


def test_method_table_computes_sides_once(spark):
    from clonoframe.operators import report

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rng = np.random.default_rng(1)
    a, b = (side(spark, np.abs(rng.normal(size=(20, 3)))).mapInArrow(counted, "id long, vec array<double>") for _ in range(2))
    got = report.method_table(a, b, methods={"Same": lambda x, y: correct.Corrected(x, y), "Bad": None}).collect()
    assert [r.Method for r in got] == ["Baseline", "Same", "Bad"] and got[1].JSD_improvement == 0 and math.isnan(got[2].JSD)
    # Each side is read for its checkpoint only, not again for each method and metric.
    assert 40 <= read.value <= 80


def test_blocks_of_one_side_meet_once(spark):
    rows = side(spark, np.random.default_rng(13).normal(size=(3000, 2)))

    def fold(_, x):
        met = np.zeros(3)

        def add(__, y, times):
            met[:] += len(x) * len(y), len(x) * len(y) * times, float((x @ y.T).sum()) * times

        return add, lambda: [(met[:1], met[1:2], met[2:])]

    got = blocks.swept(rows, rows, fold, "pairs double, counted double, s double", id_type="long", sizes=(3000, 3000), square=True, half=True)[0].agg(F.sum("pairs"), F.sum("counted"), F.sum("s")).first()
    total = np.array([r.vec for r in rows.collect()]).sum(axis=0)
    assert got[1] == 3000**2 and got[0] < 0.75 * 3000**2 and got[2] == pytest.approx(total @ total)


def test_median_of_many_equal_and_far_distances(spark, monkeypatch):
    rng = np.random.default_rng(14)
    exactly = lambda x, y: float(np.median(np.sqrt(((x[:, None] - y) ** 2).sum(axis=2))))
    pairs = [
        (rng.integers(0, 3, size=(60, 2)).astype(float), rng.integers(0, 3, size=(50, 2)).astype(float)),
        (rng.normal(size=(60, 3)) + 1e6, rng.normal(size=(51, 3)) + 1e6),
        (rng.normal(size=(60, 3)) * 1e-9, np.vstack([rng.normal(size=(50, 3)) * 1e-9, [[1e3, 0, 0]]])),
    ]
    for few in (1, 100, metrics.FEW):
        monkeypatch.setattr(metrics, "FEW", few)
        for x, y in pairs:
            assert metrics.median_distance(side(spark, x), side(spark, y), bins=16) == pytest.approx(exactly(x, y), rel=1e-12)


def test_row_values_are_computed_once(spark):
    # A lambda that holds an aggregate of its row would compute it for each entry: seconds instead of milliseconds on wide vectors.
    import time

    wide = side(spark, np.ones((40, 4000)))
    for f in (V.l2_normalize, V.shares, V.standardize):
        start = time.perf_counter()
        assert wide.select(F.sum(F.size(f(F.col("vec"))))).first()[0] == 160_000
        assert time.perf_counter() - start < 5, f


def test_adjust_variance_by_few_sweeps(spark, monkeypatch):
    rng = np.random.default_rng(12)
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    # Many equal rows, zero rows and places on the bins' very edges, beside rows in general position.
    ref = unit(np.vstack([rng.integers(-1, 2, size=(300, 3)), rng.normal(size=(300, 3)), np.zeros((2, 3))]).astype(float))
    new = unit(np.vstack([rng.integers(-1, 2, size=(120, 3)), rng.normal(size=(80, 3)) + 0.3]).astype(float))
    corr = np.vstack([np.eye(3)[rng.integers(0, 3, 100)] * 0.25, rng.normal(size=(98, 3)) * 0.1, np.zeros((2, 3))])
    want = []
    for x, c in zip(new, corr, strict=True):
        length = np.linalg.norm(c)
        g = c / length if length else c
        weigh = lambda m, x=x, g=g: (p := (g * m).sum(axis=1), np.exp(-np.maximum(((m - x) ** 2).sum(axis=1) - (p - (g * x).sum()) ** 2, 0)))
        p, w = weigh(new)
        rank = (w * (p <= (g * x).sum())).sum() / w.sum()
        q, v = weigh(ref)
        order = np.argsort(q, kind="stable")
        over = np.flatnonzero(np.cumsum(v[order]) > rank * v.sum() * (1 + 1e-12))
        hit = q[order[over[0]]] if len(over) else q.max()
        want.append(c * max(1.0, (hit - (g * x).sum()) / length) if length else c)
    calls, swept = [], blocks.swept
    monkeypatch.setattr(blocks, "swept", lambda *a, **kw: calls.append(1) or swept(*a, **kw))
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(corr)], "id long, corr array<double>")
    got = {r.id: r.corr for r in correct.adjust_variance(side(spark, ref), side(spark, new), rows).collect()}
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-9)
    # Ranks and first bins share a sweep; a bin of 1/128 of the places is narrowed by 64.
    assert len(calls) <= 4


def test_metric_table_tells_failures_from_results(spark):
    from clonoframe.operators import report

    a, b = side(spark, [[1, 2], [2, 1]]), side(spark, [[0, 0], [1, 1]], 10)
    row = report.metric_table(a, b, "a", "b", {"kBET": metrics.kbet, "Cosine": metrics.cosine_distance, "Entropy": metrics.cross_entropy}).first()
    assert math.isnan(row.kBET) and math.isnan(row.Cosine) and math.isfinite(row.Entropy)
    assert "kBET: more neighbours than rows" in row.errors and "Cosine: undefined" in row.errors and "Entropy" not in row.errors
    assert report.metric_table(a, b, "a", "b", {"Entropy": metrics.cross_entropy}).first().errors is None
    with pytest.raises(ZeroDivisionError):
        report.metric_table(a, b, "a", "b", {"Broken": lambda x, y: 1 / 0})
    with pytest.raises(Exception, match="lost"):
        report.metric_table(a, b, "a", "b", {"Broken": lambda x, y: x.select(F.raise_error(F.lit("lost")))})


def test_method_table_tells_failures_from_results(spark):
    from clonoframe.operators import report

    rng = np.random.default_rng(2)
    a, b = (side(spark, np.abs(rng.normal(size=(20, 3))) + 0.1, at) for at in (0, 100))

    def picky(x, y):
        raise ValueError("too few rows")

    def broken(x, y):
        return correct.Corrected(x.select("id", F.raise_error(F.lit("lost")).cast("array<double>").alias("vec")), y)

    got = {r.Method: r for r in report.method_table(a, b, methods={"Same": lambda x, y: correct.Corrected(x, y), "Picky": picky, "None": None}).collect()}
    assert got["Baseline"].errors is None and got["Same"].errors is None
    assert got["Picky"].errors == "Picky: too few rows" and math.isnan(got["Picky"].JSD) and "not there" in got["None"].errors
    few = {r.Method: r for r in report.method_table(a.limit(3), b.limit(3), methods={"Same": lambda x, y: correct.Corrected(x, y)}).collect()}
    assert math.isfinite(few["Same"].JSD) and few["Same"].errors == few["Baseline"].errors == "kBET: more neighbours than rows"
    for method, error in ((lambda x, y: 1 / 0, "zero"), (broken, "lost")):
        with pytest.raises(Exception, match=error):
            report.method_table(a, b, methods={"Broken": method})


def test_jsd_does_not_depend_on_the_order_of_tasks(spark):
    rng = np.random.default_rng(3)
    a, b = (checkpointed(side(spark, np.exp(rng.normal(size=(200, 3)) * 4), at).repartition(8, "id")) for at in (0, 1000))
    # The same partial sums under other names of their partitions come from the shuffle in another order.
    reordered = lambda df: [spark.createDataFrame(df.rdd.mapPartitionsWithIndex(lambda i, it, k=k: it if i % 8 == k else iter(())), df.schema) for k in (3, 0, 6, 1, 7, 2, 5, 4)]
    parts = reordered(a)
    other = parts[0]
    for p in parts[1:]:
        other = other.unionByName(p)
    assert value(metrics.jsd(a, b)) == value(metrics.jsd(other, b))


def test_neighbours_folded_where_they_are(spark):
    from clonoframe.operators import blocks, neighbors

    x = np.random.default_rng(4).normal(size=(600, 3))
    rows = side(spark, x)
    got = neighbors.knn_folded(rows, rows, 4, lambda ids, near, dist: (ids, near[:, -1], dist[:, -1]), "i long, j long, d double", exclude_self=True).collect()
    want = {r.i: (r.j, r.dist) for r in neighbors.knn(rows, rows, 4, exclude_self=True).where("rank = 4").collect()}
    assert {r.i: (r.j, r.d) for r in got} == want and len(got) == 600
    few = neighbors.knn_folded(rows.limit(3), rows.limit(3), 9, lambda ids, near, _: (ids, np.full(len(ids), near.shape[1])), "i long, n long", exclude_self=True).collect()
    assert [r.n for r in few] == [2, 2, 2]
    # Copies of both sides: right rows by left blocks, left rows by right parts.
    (nx, ny), (sx, sy) = (blocks.grid(spark, 40_000, 40_000, 8, square=s) for s in (False, True))
    assert sx * sy >= nx * ny and sx + sy < nx + ny


def test_jsd_forms_no_pairs(spark, monkeypatch):
    from clonoframe.operators import blocks, metrics

    rng = np.random.default_rng(5)
    # Shares over many octaves, zeros, equal rows and rows of one feature.
    x, y = (np.exp(rng.normal(scale=6, size=(n, 7))) * (rng.random((n, 7)) < 0.7) + np.eye(7)[rng.integers(0, 7, n)] * 1e-3 for n in (90, 70))
    x[:5], y[:5], x[5] = y[:5], y[:5], np.eye(7)[2]
    p, q = (m / m.sum(axis=1, keepdims=True) for m in (x, y))
    ent = lambda m: np.where(m > 0, m * np.log(np.where(m > 0, m, 1)), 0).sum(axis=-1)
    want = (0.5 * ent(p)[:, None] + 0.5 * ent(q) - ent((p[:, None] + q) / 2)).mean()
    monkeypatch.setattr(blocks, "swept", None)
    monkeypatch.setattr(blocks, "cells", None)
    assert abs(metrics.jsd(side(spark, x), side(spark, y)).first()[0] - want) < 1e-13
    assert metrics.jsd(side(spark, x[:1]), side(spark, x[:1])).first()[0] < 1e-14
    assert metrics.jsd(side(spark, x), side(spark, y).limit(0)).first()[0] is None


def test_median_of_tied_distances(spark):
    from clonoframe.operators import metrics

    # 1,210,000 distances: all 1 but one row's; the median's bin holds one value that occurs over a million times.
    a = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(1100)], "id long, vec array<double>")
    b = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1099)] + [(1099, [3.0, 4.0])], "id long, vec array<double>")
    assert metrics.median_distance(a, b) == 1.0
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=(6, 3))
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>") for m in (x, y)]
    want = np.median(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)))
    assert abs(metrics.median_distance(*frames) - want) < 1e-12


def test_harmony_ends_by_its_rules(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(40, 4)) + [3, 0, 0, 0], rng.normal(size=(40, 4)) + [0, 3, 0, 0]])
    rows = soft_rows(spark, x, np.repeat([0, 1], 40))
    restarts = lambda rows, k, seed: space.lloyd(np.array([r.vec for r in rows.orderBy("vec").collect()]), k, np.random.default_rng(seed))
    got = soft.soft_align(rows, clusters=4, eps_outer=10.0, cluster_fn=restarts)
    assert len(got.trace) == 4  # the outer rule needs four values, however small the change
    full = soft.soft_align(rows, clusters=4, eps_outer=-10.0, outer=5, cluster_fn=restarts)
    assert len(full.trace) == 6 and np.allclose(full.trace[:4], got.trace)
    # The two batches' means move towards each other.
    out = np.array([r.vec for r in got.rows.orderBy("key").collect()])
    gap = lambda m: np.linalg.norm(m[:40].mean(axis=0) - m[40:].mean(axis=0))
    assert gap(out) < 0.5 * gap(x)


def test_readers_and_writers(spark, tmp_path):
    one, two = tmp_path / "a.tsv", tmp_path / "b.tsv"
    one.write_text("full_seq\tfrequencyCount\tv\nAAA\t2\tx\nCCC\tNaN\ty\n")
    two.write_text("frequencyCount\tother\tfull_seq\n5\tq\tGGG\n")
    (tmp_path / "c.tsv").write_text("nothing\there\n1\t2\n")
    paths = repertoire.list_files(spark, str(tmp_path))
    assert [set(h) for h in repertoire.headers_of(spark, paths).values()][2] == {"nothing", "here"}
    got = repertoire.read_repertoires(spark, paths).collect()
    assert sorted((r.sample, r.full_seq, r.freq, r.v) for r in got if r.freq is not None) == [("a.tsv", "AAA", 2.0, "x"), ("b.tsv", "GGG", 5.0, None)]
    assert len(got) == 3 and len({r.row_id for r in got}) == 3
    (tmp_path / "s.txt").write_text("CASS\nCAW\nCASS\n")
    assert sorted(r.sequence for r in repertoire.read_sequences(spark, str(tmp_path / "s.txt")).collect()) == ["CASS", "CASS", "CAW"]


def test_downsample_and_auc_are_exact(spark):
    import hashlib

    keys = list(range(3000))
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (0, 1, 700, 3000, 5000):
        got = sorted(r.k for r in preprocess.downsample(rows, n, "k", 3).collect())
        assert got == sorted(sorted(keys, key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())[:n])
    rng = np.random.default_rng(1)
    pairs = [(float(s), int(y)) for s, y in zip(rng.integers(0, 40, 500), rng.integers(0, 2, 500), strict=True)]
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert abs(classify.roc_auc(spark.createDataFrame(pairs, "score double, label int")).first()[0] - want) < 1e-12
    assert classify.roc_auc(spark.createDataFrame([(1.0, 1)], "score double, label int")).first()[0] is None


def test_panorama_of_three(spark):
    """Against a plain loop over all pairs of datasets; ids repeat between them."""
    rng = np.random.default_rng(11)
    xs = [rng.normal(size=(n, 5)) for n in (14, 9, 11)]
    us = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in xs]
    want, k = [u.copy() for u in us], 4
    for i in range(3):
        for j in range(3):
            if i != j:
                cos = us[i] @ us[j].T
                for a in range(len(us[i])):
                    for b in range(len(us[j])):
                        if b in np.argsort(-cos[a])[:k] and a in np.argsort(-cos[:, b])[:k]:
                            want[i][a] += 0.1 * (us[j][b] - us[i][a])
    got, features = correct.panorama([side(spark, x) for x in xs], k=k)
    assert features is None
    for g, w in zip(got, want, strict=True):
        assert np.allclose(np.array([r.vec for r in g.orderBy("id").collect()]), w)
    alone, _ = correct.panorama([side(spark, xs[0])])
    assert np.allclose(np.array([r.vec for r in alone[0].orderBy("id").collect()]), us[0])
    named = workflows.align_all({"b": side(spark, xs[1]), "a": side(spark, xs[0])}, k=k, hvg=3)
    assert list(named) == ["a", "b"] and named["b"].count() == 9


def test_variance_ranks_where_means_cannot_be_binned(spark):
    flat = correct.highly_variable(side(spark, [[1.0, 2.0, 3.0]] * 3), 2).collect()
    assert [(r.feature, r.dispersion) for r in flat] == [(0, 0.0), (1, 0.0)]
    odd = correct.highly_variable(side(spark, [[1.0, 0.0, float("inf")], [2.0, 9.0, 1.0]]), 3).collect()
    assert [r.feature for r in odd] == [1, 0, 2]


def test_unit_rows_common_features_and_weights(spark):
    assert correct.unit_rows(side(spark, [[0.6, 0.8], [1.0, 0.0]])).first()["unit"] and not correct.unit_rows(side(spark, [[1.0, 1.0]])).first()["unit"]
    assert correct.unit_rows(side(spark, [[1.0, 1.0]]).limit(0)).first()["unit"]
    a, b = spark.createDataFrame([(1, 2, 3, 4)], "id int, f10 int, f2 int, x int"), spark.createDataFrame([(5, 6, 7)], "f2 int, id int, f10 int")
    got = preprocess.project_common([a, b])
    assert got[0].columns == got[1].columns == ["id", "f2", "f10"] and tuple(got[1].first()) == (6, 5, 7)
    w = spark.range(1).select(V.edge_weight(F.lit(3.0), F.lit(4.0), 2.0).alias("w")).first()["w"]
    assert w == pytest.approx(np.exp(-12 / 8))


def test_tokens(spark):
    vocab = {"<pad>": 0, "<cls>": 1, "<sep>": 2, "<unk>": 3, "A": 4, "C": 5}
    t = spark.createDataFrame([("ACX",), ("",), (None,)], "s string").select(strings.token_ids(F.col("s"), vocab).alias("t"))
    assert [r.t for r in t.collect()] == [[1, 4, 5, 3, 2], [1, 2], [1, 2]]
    padded = t.select(strings.pad_tokens(F.col("t"), 4).alias("p"), strings.token_mask(F.col("t"), 4).alias("m")).collect()
    assert [(r.p, r.m) for r in padded] == [([1, 4, 5, 3, 2], [1] * 5), ([1, 2, 0, 0], [1, 1, 0, 0]), ([1, 2, 0, 0], [1, 1, 0, 0])]


def test_saved_heads_score_alike(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3) + 2 * (i % 2)], i % 2) for i in range(40)], "id int, vec array<double>, label int")
    model = classify.train(rows, iterations=10)
    classify.save_model(model, str(tmp_path / "head"))
    score = lambda m: [r.score for r in classify.predict(m, rows).orderBy("id").collect()]
    assert score(classify.load_model(str(tmp_path / "head"))) == pytest.approx(score(model))


def test_sequence_labels(spark):
    seqs = spark.createDataFrame([("CASSF",), ("CASSF",), ("CWWWWWF",), (None,)], "sequence string")
    labels, centroids = workflows.sequence_labels(seqs, 2)
    got = {r.sequence: r.cluster for r in labels.collect()}
    assert set(got) == {"CASSF", "CWWWWWF"} and len(set(got.values())) == 2 and centroids.count() == 2


def test_many_centroids_need_no_key(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(30, 4))
    rows = spark.createDataFrame([(f"s{i % 3}", float(i), [float(v) for v in x[i // 2]]) for i in range(60)], "sample string, freq double, vec array<double>")
    c = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(12, 4)))], "cluster int, vec array<double>")
    read = lambda: sorted(tuple(r) for r in encode.encode_samples(rows, c).collect())
    small = read()
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 10)
    assert read() == small and sum(r[2] for r in small) == 60
    tie = spark.createDataFrame([(10, [1.0]), (9, [1.0])], "cluster int, vec array<double>")
    assert encode.assign(side(spark, [[0], [0]]), tie).select("id", "cluster").orderBy("id").collect() == [(0, 9), (1, 9)]


def test_radial_head_parts_rings(spark):
    rng = np.random.default_rng(14)
    angle, label = rng.uniform(0, 2 * np.pi, 120), np.arange(120) % 2
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (1 + 2 * label)[:, None]
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(120)], "id int, vec array<double>, label int")
    gamma = classify.scaled_gamma(rows)
    assert gamma == pytest.approx(1 / (2 * x.var()))
    mapped = classify.radial_features(rows, gamma, n=2000)
    z = np.array([r.vec for r in mapped.orderBy("id").collect()])
    assert np.abs(z @ z.T - np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))).max() < 0.15
    few = classify.radial_features(rows, gamma, n=64)
    auc = lambda r: value(classify.roc_auc(classify.predict(classify.train(r, iterations=20), r)))
    assert auc(few) > 0.99 > 0.9 > auc(rows)
    assert classify.radial_features(rows.limit(0), gamma).count() == 0


def test_spectral_by_products_equals_dense(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cluster int, vec array<double>")
    a = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    times = space._affinity_products(frame, x, 0.1)
    v = rng.normal(size=(300, 3))
    assert np.allclose(times(v), a @ v)
    s = 1 / np.sqrt(a.sum(axis=1))
    want = np.linalg.eigvalsh(a * np.outer(s, s))[::-1][:6]
    values, vectors = space.leading_vectors(lambda m: a @ m, s, 6)
    assert np.allclose(values, want) and np.allclose((a * np.outer(s, s)) @ vectors, vectors * values, atol=1e-7)
    # Four far groups of unequal size are found, whatever the number of centroids.
    y = np.vstack([rng.normal(size=(n, 3)) * 0.3 + c for n, c in ((200, [0, 0, 0]), (90, [9, 0, 0]), (50, [0, 9, 0]), (20, [0, 0, 9]))])
    mapping, _ = space.spectral(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "cluster int, vec array<double>"), 4)
    got = [r.func for r in mapping.orderBy("primary").collect()]
    assert [len(set(got[p:q])) for p, q in ((0, 200), (200, 290), (290, 340), (340, 360))] == [1] * 4 and len(set(got)) == 4
    with pytest.raises(ValueError, match="MB"):
        space.spectral(frame, 4, max_mb=0)


def test_pruned_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 8)) * 6
    a, b = (np.vstack([c + rng.normal(size=(40, 8)) * 0.2 for c in centres]) for _ in range(2))
    a[7], b[5], b[6] = 0, 0, b[7]
    left, right = side(spark, a), side(spark, b)
    for metric in ("euclidean", "cosine"):
        cells = neighbors.metric_cells(left, right, 5, metric, pivots=25)
        assert cells.share < 0.2, (metric, cells.share)
        edges = [sorted(map(tuple, neighbors.knn(left, right, 5, metric, prune=p).collect())) for p in (True, False)]
        assert edges[0] == edges[1]
    edges = [sorted(map(tuple, neighbors.knn(left, left, 3, exclude_self=True, prune=p).collect())) for p in (True, False)]
    assert edges[0] == edges[1] and not any(i == j for i, j, *_ in edges[0])
    few = neighbors.knn(left.limit(3), right.limit(4), 9, prune=True)
    assert few.count() == 12
    assert neighbors.knn(left.limit(0), right, 3, prune=True).count() == 0 and neighbors.knn(left, right.limit(0), 3, prune=True).count() == 0


def plain_inverse_simpson(d, first, perplexity):
    entropy = lambda b: np.log((p := np.exp(-d * b)).sum()) + b * (d * p).sum() / p.sum()
    lo, hi = 1e-12, 1e12
    for _ in range(300):
        mid = np.sqrt(lo * hi)
        lo, hi = (mid, hi) if entropy(mid) > np.log(perplexity) else (lo, mid)
    p = np.exp(-d * lo) / np.exp(-d * lo).sum()
    return 1 / (p[first].sum() ** 2 + p[~first].sum() ** 2 + 1e-9)


def test_inverse_simpson_of_many_rows():
    rng = np.random.default_rng(1)
    d = np.sort(rng.gamma(2, size=(40, 90)) * 10.0 ** rng.integers(-2, 3, size=(40, 1)), axis=1)
    first = rng.random((40, 90)) < 0.4
    want = [plain_inverse_simpson(x, f, 30) for x, f in zip(d, first, strict=True)]
    assert np.allclose(metrics.inverse_simpson(d, first, 30), want, atol=1e-3)
    one = metrics.inverse_simpson(d[:1], first[:1], 30)
    assert one[0] == metrics.inverse_simpson(d, first, 30)[0]
    assert np.allclose(metrics.inverse_simpson(np.zeros((1, 90)), first[:1], 30), 1 / (first[0].mean() ** 2 + (1 - first[0].mean()) ** 2))


def plain_align(a: str, b: str) -> tuple[str, str]:
    """A global alignment with the most equal pairs; gaps and unequal pairs cost nothing and unequal pairs aren't formed.

    Of the best alignments it takes the one whose pairs come earliest in ``a``, then in ``b``; between pairs a's residues stand first.
    """
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] and best[i + 1][j + 1] + 1 >= max(best[i + 1][j], best[i][j + 1]) else max(best[i + 1][j], best[i][j + 1])
    x, y, i, j = [], [], 0, 0
    while i < n and j < m:
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            x.append(a[i])
            y.append(b[j])
            i, j = i + 1, j + 1
        elif best[i][j + 1] == best[i][j]:
            x.append("-")
            y.append(b[j])
            j += 1
        else:
            x.append(a[i])
            y.append("-")
            i += 1
    return "".join(x) + a[i:] + "-" * (m - j), "".join(y) + "-" * (n - i) + b[j:]


def test_alignments_of_a_batch(spark):
    import time

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ACDEF-é") for _ in range(rng.randint(0, n)))
    pairs = [(word(12), word(9)) for _ in range(300)] + [("", ""), ("A", ""), ("", "C"), ("A" * 40, "A" * 30)]
    assert reconstruct.align_all(pairs) == [plain_align(a, b) for a, b in pairs]
    cells, reconstruct.TABLE_CELLS = reconstruct.TABLE_CELLS, 500
    try:
        assert reconstruct.align_all(pairs) == [plain_align(a, b) for a, b in pairs]
    finally:
        reconstruct.TABLE_CELLS = cells
    long = [("".join(rng.choice("ACDEFGHIKL") for _ in range(18)), "".join(rng.choice("ACDEFGHIKL") for _ in range(20))) for _ in range(3000)]
    t = time.perf_counter()
    many = reconstruct.align_all(long)
    fast = time.perf_counter() - t
    t = time.perf_counter()
    assert many[:300] == [plain_align(a, b) for a, b in long[:300]]
    assert fast < 10 * (time.perf_counter() - t) / 2  # as a rule ten times as fast; this leaves room for a busy machine
    frame = spark.createDataFrame([("CASS", "ASF"), ("CASS", "ASF"), ("A", None)], "a string, b string")
    assert [tuple(r) for r in reconstruct.alignments(frame).collect()] == [("CASS", "ASF", *plain_align("CASS", "ASF"), 2)]
    steps = [tuple(r)[2:] for r in reconstruct.alignment_steps(frame).orderBy("step").collect()]
    x, y = plain_align("CASS", "ASF")
    assert steps == [(k, None if p == "-" else len(x[:k].replace("-", "")), None if q == "-" else len(y[:k].replace("-", ""))) for k, (p, q) in enumerate(zip(x, y, strict=True))]


def test_compatible_genes(spark):
    rng = random.Random(6)
    records = [("V", i, f"X{i}|TRBV{rng.randint(1, 30)}{rng.choice(['', '-1', '-2'])}*0{rng.randint(1, 3)}|f", "", f"S{i}") for i in range(80)]
    segments = spark.createDataFrame(records, "kind string, ord long, id string, gene string, seq string")
    names = ["TCRBV05-01", "TRBV1", "TRBV1-1", "TRBV99", "TRBV3-2", "unresolved", None, "TRBV"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.seq for r in reconstruct.resolve_genes(frame, segments, "V", compat=True).collect()}
    limit, reconstruct.CATALOGUE = reconstruct.CATALOGUE, 0
    try:
        joined = {r.name: r.seq for r in reconstruct.resolve_genes(frame, segments, "V", compat=True).collect()}
    finally:
        reconstruct.CATALOGUE = limit
    assert got == joined and got["TRBV"] == "S79" and "TRBV99" not in got
    known = reconstruct.IdSubstrings([(3, "abcab", "x"), (1, "bca", "y"), (2, "zz", "z")])
    for part in ("", "a", "b", "ca", "zz", "zzz", "abcab", "q"):
        have = [k for k, name in enumerate(["bca", "zz", "abcab"]) if part in name]
        assert known.latest(part) == (have[-1] if have else -1)


def test_names_of_files(spark, tmp_path):
    names = ["a b.tsv", "a%20b.tsv", "x+y.tsv", "p#1.tsv", "Große Probe é.tsv", "100%.tsv", "q=1&r.tsv", "w[1]{2}.tsv"]
    for k, n in enumerate(names):
        (tmp_path / n).write_text(f"full_seq\tfrequencyCount\nSEQ{k}\t{k + 1}\n")
    paths = repertoire.list_files(spark, str(tmp_path))
    assert sorted(p.rsplit("/", 1)[-1] for p in paths) == sorted(names)
    rows = repertoire.read_repertoires(spark, paths, "d").collect()
    assert {(r["sample"], r.full_seq) for r in rows} == {(n, f"SEQ{k}") for k, n in enumerate(names)}
    assert {r["sample"] for r in repertoire.samples_of(spark, paths, 1, "d").collect()} == set(names)


def test_default_encoding_of_full_sequences(spark, tmp_path):
    from clonoframe.plans import workflows as W

    rng = np.random.default_rng(8)
    long = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n)) for n in (110, 112, 118, 125)]
    (tmp_path / "s one.tsv").write_text("full_seq\tfrequencyCount\n" + "".join(f"{s}\t1\n" for s in [*long, long[0][:50] + "X" + long[0][50:], "A" * 200, "Failure"]))
    built = W.build_space(spark.createDataFrame([(s,) for s in long], "sequence string"), 2, 2)
    enc, samples = W.encode_dataset(spark, W.EncodeConfig("d", unlabeled_dir=str(tmp_path)), built["centroids"])
    assert enc.agg(F.sum("diversity")).first()[0] == 4 and [r["sample"] for r in samples.collect()] == ["s one.tsv"]
    dense = encode.dense(enc, samples, 2).first()
    assert sum(dense.diversity) == 4


def test_stream_of_files(spark, tmp_path):
    from clonoframe.plans import workflows as W

    inbox, out, state = (str(tmp_path / n) for n in ("in box", "out", "state"))
    (tmp_path / "in box").mkdir()
    put = lambda name, text: (tmp_path / "in box" / name).write_text(text)
    put("a 1.tsv", "full_seq\tfrequencyCount\nCASS\t2\nCASS\t3\nFailure\t9\nC*S\t1\n")
    put("b.tsv", "other\tcount (templates/reads)\tfull_seq\nq\t5\tCAWW\n")
    put("c.tsv", "nothing\n1\n")
    vectors = lambda rows: encoders.encode_column(rows, "full_seq", encoders.substitution_encoder(8))
    known = encoders.encode_column(spark.createDataFrame([(0, "CASS"), (1, "CAWW")], "cluster int, s string"), "s", encoders.substitution_encoder(8)).select("cluster", "vec")
    run = lambda: encode_stream.encode_files(spark, inbox, out, state, known, vectors, "d", files_per_batch=1)
    read = lambda: sorted((r["sample"], r.cluster, r.diversity, r.abundance) for r in spark.read.parquet(out).collect())
    run()
    first = [("a 1.tsv", 0, 2, 5.0), ("b.tsv", 1, 1, 5.0)]
    assert read() == first
    put("d.tsv", "full_seq\tfreq\nCASS\t1\n")
    run()
    assert read() == [*first, ("d.tsv", 0, 1, 1.0)]
    # All batches again, as after a loss of the checkpoint: each file's rows stay once.
    encode_stream.encode_files(spark, inbox, out, str(tmp_path / "other"), known, vectors, "d")
    assert read() == [*first, ("d.tsv", 0, 1, 1.0)]
    assert W.repertoire.read_repertoires(spark, [], with_path=True).columns[-1] == "path"


def test_embedding_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a b.tsv", "CASS", [1.0, 2.0]), ("a b.tsv", "CASS", [1.0, 2.0]), ("01", "CAW", [0.5])], "sample string, sequence string, vec array<double>")
    path = str(tmp_path / "e")
    repertoire.write_embeddings(rows, path)
    back = repertoire.read_embeddings(spark, path)
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="exist"):
        repertoire.write_embeddings(rows, path)
    repertoire.write_embeddings(rows.where("sample = '01'").withColumn("sequence", F.lit("new")), path, overwrite=True)
    assert repertoire.read_embeddings(spark, path, files=["01"]).first()["sequence"] == "new" and repertoire.read_embeddings(spark, path).count() == 3


def test_reconstruct_files(spark, tmp_path):
    from clonoframe.plans import workflows as W

    v, j = "D" * 60 + "YLCASS", "NTEAFFGQGTRLTVV"
    (tmp_path / "v.fasta").write_text(f">X1|TRBV5-1*01|Homo sapiens\n{v[:30]}\n{v[30:]}\n")
    (tmp_path / "j.fasta").write_text(f">Y1|TRBJ1-1*01|Homo sapiens\n{j}\n")
    (tmp_path / "r.tsv").write_text("vGene\tj\tcdr3\tn\nTCRBV05-01\tTCRBJ01-01\tCASSLGNTEAFF\t3\nunresolved\tTCRBJ01-01\tCASSF\t1\n")
    got = W.reconstruct_files(spark, str(tmp_path / "r.tsv"), str(tmp_path / "v.fasta"), str(tmp_path / "j.fasta"), str(tmp_path / "out"), {"v": "vGene"})
    rows = {r.n: r.full_seq for r in got.collect()}
    assert rows == {"3": reconstruct.assemble(v, j, "CASSLGNTEAFF"), "1": "Failure"} and rows["3"].endswith("GQGTRLTVV")
    with pytest.raises(ValueError, match="no column"):
        W.reconstruct_files(spark, str(tmp_path / "r.tsv"), str(tmp_path / "v.fasta"), str(tmp_path / "j.fasta"))


def test_scatter_by_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(20, 3)) + 1
    d = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    got = metrics.scatter_summary(side(spark, x), side(spark, y)).first()
    for name, m in (("intra_a", d(x, x)[~np.eye(30, dtype=bool)]), ("intra_b", d(y, y)[~np.eye(20, dtype=bool)]), ("inter", d(x, y).ravel())):
        assert got[name] == pytest.approx(m.mean()) and got[f"{name}_var"] == pytest.approx(m.var()) and got[f"{name}_cv"] == pytest.approx(m.std() / m.mean())


def test_networks(spark, tmp_path):
    rng = np.random.default_rng(4)
    net = networks.Network.new((3, 4, 2), 1)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 2))
    got = networks.loss_and_gradient(net, x, y, "squared")
    for k in range(0, len(net.parameters), 5):
        ends = []
        for step in (1e-5, -1e-5):
            moved = networks.Network(net.widths, net.parameters.copy())
            moved.parameters[k] += step
            ends.append(networks.squared(moved.forward(x)[-1], y)[0])
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(got[k], abs=1e-5)
    x = rng.normal(size=(90, 3))
    label = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), [float(t)]) for i, (v, t) in enumerate(zip(x, label, strict=True))], "id long, vec array<double>, target array<double>").repartition(3)
    start = networks.Network.new((3, 8, 1), 2)
    fitted = networks.fit(rows, start, "logistic", 4, batch=30, rate=0.05, seed=7)
    # The same batches on whole matrices.
    plain, adam, losses = networks.Network(start.widths, start.parameters.copy()), networks.Adam(np.zeros(41), np.zeros(41)), []
    for epoch in range(4):
        of = np.array([r[0] for r in rows.orderBy("id").select(F.pmod(F.xxhash64(F.lit(7), F.lit(epoch), "id"), F.lit(3))).collect()])
        total = 0.0
        for k in range(3):
            g = networks.loss_and_gradient(plain, x[of == k], label[of == k][:, None], "logistic")
            total += g[-2]
            plain.parameters = adam.move(plain.parameters, g[:-2] / g[-1], 0.05 * (1 + np.cos(np.pi * (epoch * 3 + k) / 12)) / 2)
        losses.append(total / 90)
    assert np.allclose(fitted.losses, losses) and np.allclose(fitted.parameters, plain.parameters) and losses[-1] < losses[0]
    # A run that ends early goes on where it was.
    folder = str(tmp_path / "net")
    store, seen = networks._store, []

    def stop(*args):
        store(*args)
        seen.append(args[2])
        if args[2] == 1:
            raise RuntimeError("lost")

    networks._store = stop
    try:
        with pytest.raises(RuntimeError):
            networks.fit(rows, start, "logistic", 4, batch=30, rate=0.05, seed=7, folder=folder)
    finally:
        networks._store = store
    again = networks.fit(rows, start, "logistic", 4, batch=30, rate=0.05, seed=7, folder=folder)
    assert seen == [0, 1] and np.allclose(again.losses, losses) and np.allclose(again.parameters, plain.parameters)
    with pytest.raises(ValueError):
        networks.fit(rows, start, "logistic", 5, batch=30, rate=0.05, seed=7, folder=folder)
    out = networks.apply(rows.unionByName(spark.createDataFrame([(99, None, None)], rows.schema)), fitted)
    assert out.where("id = 99").first()["out"] is None and out.where("id < 90").first()["out"] is not None


def test_autoencoder_beats_principal_components(spark):
    rng = np.random.default_rng(5)
    t = rng.uniform(-2, 2, size=(400, 1))
    x = np.hstack([t, np.sin(2 * t), t**2 / 2]) + rng.normal(scale=0.02, size=(400, 3))
    x -= x.mean(axis=0)
    _, s, _ = np.linalg.svd(x)
    linear = (s[1:] ** 2).sum() / 2 / len(x)
    net = networks.autoencoder(side(spark, x), 1, hidden=16, epochs=120, batch=200, rate=0.03)
    assert net.losses[-1] < 0.6 * linear
    assert len(networks.apply(side(spark, x), net, upto=2).first()["out"]) == 1


def test_kernel_machine_equals_one_solver(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 2))
    label = ((x**2).sum(axis=1) + rng.normal(scale=0.3, size=240) > 1.4).astype(int)
    y = np.where(label == 1, 1.0, -1.0)
    alpha, offset = kernel_svm.solve(x, y, 2.0, 0.8, tol=1e-6)
    want = kernel_svm.kernel(x, x, 0.8) @ (alpha * y) + offset
    # The solver's own conditions.
    assert abs((alpha * y).sum()) < 1e-9 and (y * want)[alpha < 1e-9].min() > 1 - 1e-4 and (y * want)[alpha > 2 - 1e-9].max() < 1 + 1e-4
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, label, strict=True))], "id long, vec array<double>, label int").repartition(3)
    machine = kernel_svm.train(rows, 2.0, 0.8, part=50, tol=1e-6)
    got = {r.id: r.score for r in kernel_svm.predict(rows, machine).collect()}
    assert max(abs(got[i] - want[i]) for i in range(240)) < 1e-3 and len(machine.vectors) < 240
    with pytest.raises(ValueError, match="support"):
        kernel_svm.train(rows, 2.0, 0.8, part=50, most=3)
    one = kernel_svm.train(rows.where("label = 1"), 2.0, 0.8)
    assert all(r.score > 0 for r in kernel_svm.predict(rows, one).collect())


def test_kernel_machine_of_many_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, label = rng.normal(size=(500, 3)), rng.integers(0, 2, 500)
    y = np.where(label == 1, 1.0, -1.0)
    alpha, offset = kernel_svm.solve(x, y, 1.0, 1.0, tol=1e-6)
    want = kernel_svm.kernel(x, x, 1.0) @ (alpha * y) + offset
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, label, strict=True))], "id long, vec array<double>, label int").repartition(3)
    # Most rows are support vectors, many times as many as a working set or a part has rows.
    monkeypatch.setattr(kernel_svm, "HELD", 48)
    monkeypatch.setattr(kernel_svm, "PART", 40)
    machine = kernel_svm.train(rows, 1.0, 1.0, part=40, tol=1e-6)
    got = {r.id: r.score for r in kernel_svm.predict(rows, machine).collect()}
    assert machine.size > 300 and not len(machine.vectors)
    assert max(abs(got[i] - want[i]) for i in range(500)) < 1e-3
    weights = {int(r.id): r.weight for r in machine.weighted(spark).collect()}
    assert len(weights) == machine.size and max(abs(weights.get(i, 0.0) - alpha[i] * y[i]) for i in range(500)) < 1e-3


def test_kernel_machine_takes_few_turns(spark, monkeypatch):
    rng = np.random.default_rng(15)
    x, label = rng.normal(size=(600, 6)), rng.integers(0, 2, 600)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(label == 1, 1.0, -1.0)
    alpha, offset = kernel_svm.solve(x, y, 1.0, 1.0, tol=1e-6)
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, label, strict=True))], "id long, vec array<double>, label int").repartition(3)
    monkeypatch.setattr(kernel_svm, "HELD", 64)
    monkeypatch.setattr(kernel_svm, "PART", 60)
    machine = kernel_svm.train(rows, 1.0, 1.0, part=60)
    weights = {int(r.id): r.weight for r in machine.weighted(spark).collect()}
    got = kernel_svm.kernel(x, x, 1.0) @ np.array([weights.get(i, 0.0) for i in range(600)]) + machine.offset
    assert machine.size > 300 and abs(sum(weights.values())) < 1e-9 and max(abs(w) for w in weights.values()) <= 1
    assert np.abs(got - kernel_svm.kernel(x, x, 1.0) @ (alpha * y) - offset).max() < 1e-2
    # From zero and with sets of HELD rows it took 33.
    assert machine.rounds < 20, machine.rounds


def trustworthiness(x, y, k=10):
    """The share of near rows of a layout that are near in the input, by ranks."""
    n = len(x)
    order = lambda m: np.argsort(((m[:, None] - m[None]) ** 2).sum(axis=2) + np.diag([np.inf] * n), axis=1)
    rank = np.empty((n, n), int)
    np.put_along_axis(rank, order(x), np.arange(n)[None].repeat(n, axis=0), axis=1)
    near = np.take_along_axis(rank, order(y)[:, :k], axis=1)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(near - k + 1, 0).sum()


def test_neighbour_layout(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(30, 10)) * 0.4 + c for c in np.eye(10)[:7] * 4])
    got = graph_layout.neighbour_layout(side(spark, x), k=10, rounds=60)
    place = lambda df: np.array([[r.x, r.y] for r in df.orderBy("id").collect()])
    y = place(got)
    assert trustworthiness(x, y) > trustworthiness(x, place(space.layout(side(spark, x)))) + 0.03
    assert np.array_equal(y, place(graph_layout.neighbour_layout(side(spark, x).repartition(5), k=10, rounds=60)))
    d = np.sort(rng.gamma(2, size=(20, 15)), axis=1)
    nearest, scale = graph_layout.rates(d)
    assert np.allclose(np.exp(-(d - nearest[:, None]) / scale[:, None]).sum(axis=1), np.log2(15), atol=1e-6)
    assert graph_layout.neighbour_layout(side(spark, x[:1])).count() == 1
    with pytest.raises(ValueError):
        graph_layout.neighbour_layout(side(spark, x), most=3)


def test_late_rows_are_dropped(spark, tmp_path):
    import time

    source, out = tmp_path / "in", str(tmp_path / "out")
    batches = [["2020-01-01 10:05", "2020-01-01 12:30"], ["2020-01-01 12:26"], ["2020-01-01 10:10", "2020-01-01 12:25"], ["2020-01-01 15:00"], ["2020-01-01 15:01"]]
    for k, times in enumerate(batches):
        spark.createDataFrame([(t, "s", 1.0) for t in times], "t string, sample string, freq double").select(F.to_timestamp("t").alias("ts"), "sample", "freq").coalesce(1).write.parquet(str(source / f"b{k}"))
        time.sleep(0.05)
    rows = spark.readStream.schema("ts timestamp, sample string, freq double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    counts = encode_stream.windowed_counts(rows).select(F.col("window.start").alias("start"), "sample", "n", "total")
    query = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {str(r.start)[11:16]: r.n for r in spark.read.parquet(out).collect()}
    # 10:10 came two batches after 12:30: its window had been closed. 12:25 came in time.
    assert got == {"10:00": 1, "12:00": 3}


def test_entry_points(spark, tmp_path):
    from clonoframe.__main__ import main

    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 60)) for _ in range(40)]
    (tmp_path / "db.txt").write_text("\n".join(seqs))
    at = lambda n: str(tmp_path / n)
    main(["space", at("db.txt"), "--clusters", "4", "--functional", "2", "--out", at("space")], spark)
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
        for k in range(2):
            (tmp_path / d / f"s{k}.tsv").write_text("full_seq\tfreq\n" + "".join(f"{s}\t{i + 1}\n" for i, s in enumerate(rng.choice(seqs, 8))))
        main(["encode", d, "--space", at("space"), "--unlabeled-dir", at(d), "--out", at(f"enc_{d}")], spark)
    with pytest.raises(Exception, match="exist"):
        main(["encode", "one", "--space", at("space"), "--unlabeled-dir", at("one"), "--out", at("enc_one")], spark)
    with pytest.raises(ValueError):
        main(["encode", "one", "--space", at("space"), "--out", at("none")], spark)
    main(["compare", at("enc_one"), at("enc_two"), "--space", at("space"), "--out", at("table")], spark)
    row = spark.read.csv(at("table"), sep="\t", header=True).first()
    assert (row.Dataset1, row.Dataset2, row.n_samples_1) == ("one", "two", "2") and 0 <= float(row.JSD) <= np.log(2)
    main(["correct", at("enc_one"), at("enc_two"), "--space", at("space"), "--out", at("methods")], spark)
    assert [r.Method for r in spark.read.csv(at("methods"), sep="\t", header=True).collect()][0] == "Baseline"


def test_sweeps_keep_the_nearest(spark, monkeypatch):
    """Several left blocks and right parts, equal rows, text ids, groups that are skipped: always the edges of brute force; copies of a side follow the cores, not its blocks."""
    from clonoframe.operators import blocks

    nx, ny = blocks.grid(spark, 600_000, 600_000, 64)
    assert nx + ny <= 40, (nx, ny)  # 2,344 copies by blocks of 256
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "STEP", 8)
    monkeypatch.setattr(blocks, "STRIP", 64)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, size=(90, 3)).astype(float)
    frame = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = sorted((f"r{i}", f"r{j}", n + 1) for i in range(90) for n, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (d[i, j], f"r{j}"))[:7]))
    for hold, waves in ((32, 2), (1000, 2), (1000, 0)):
        monkeypatch.setattr(blocks, "HOLD", hold)
        monkeypatch.setattr(blocks, "WAVES", waves or 1)
        for prune in (False, True):
            got = neighbors.knn(frame, frame, 7, exclude_self=True, prune=prune).collect()
            assert sorted((r.i, r.j, r.rank) for r in got) == want, (hold, waves, prune)
            assert all(abs(r.dist - d[int(r.i[1:]), int(r.j[1:])]) < 1e-12 for r in got)
    one = neighbors.knn(frame.limit(3), frame, 7).collect()  # one left block, right parts
    assert len(one) == 21 and {r.rank for r in one} == set(range(1, 8))


def test_metrics_and_correction_by_many_blocks(spark, monkeypatch):
    """Left blocks and right parts of a few rows give what one block gives."""
    from clonoframe.operators import blocks

    rng = np.random.default_rng(8)
    x, y = np.abs(rng.normal(size=(45, 3))) + 0.1, np.abs(rng.normal(size=(38, 3))) + 0.2
    y[5] = y[6] = x[3]
    a, b = side(spark, x), side(spark, y, 1000)

    def all_values():
        spread = metrics.scatter_summary(a, b).first()
        moved = {r.id: r.vec for r in correct.mnn(a, b, k=4).target.collect()}
        return [value(metrics.mmd(a, b)), value(metrics.jsd(a, b)), metrics.median_distance(a, b, bins=5), *spread], np.array([moved[k] for k in sorted(moved)])

    whole = all_values()
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert abs(whole[0][2] - np.median(d)) < 1e-12
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "STEP", 4)
    monkeypatch.setattr(blocks, "STRIP", 32)
    monkeypatch.setattr(blocks, "WAVES", 3)
    assert min(blocks.grid(spark, 45, 38, 3)) > 1  # blocks and parts
    parts = all_values()
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
