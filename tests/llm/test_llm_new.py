"""Collocations, cross-tokenizer alignment and threshold search against plain versions; long white space."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clonoframe.llm import bpe, collocations, crosstok, quality, suffix, topk, urlfilter
from clonoframe.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["rank", "phrase", "a", "l", "r", "n", "score", "w1", "f", "first", "blob", "block", "at", "pairs", "n_a", "key", "is_q", "width", "tag", "vec", "id"]


def with_clashes(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


# --- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN)


def test_white_space_rule_equals_the_pattern(enc):
    rng = random.Random(3)
    for _ in range(300):
        signs = ["a", "word ", " ", "\n", "  \t", "　\xa0", "!", "12", "é", "\x1c", "\x85"]
        t = "".join(rng.choice(signs) * rng.choice([1, 1, 2, 9]) for _ in range(rng.randint(1, 60)))
        assert bpe.ids_of(t, enc, piece=5, run=3).tolist() == enc.encode(t, disallowed_special=()), repr(t)


@pytest.mark.parametrize("sign", [" ", "\n", "\t", "　"])
def test_millions_of_white_space(enc, sign):
    run = sign * 2_000_000
    whole = enc._encode_single_piece(run)
    less = enc._encode_single_piece(run[:-1])
    small = lambda t: enc.encode(t, disallowed_special=())
    assert bpe.ids_of(run, enc).tolist() == whole
    assert bpe.ids_of("a" + run, enc).tolist() == small("a") + whole
    assert bpe.ids_of(run + "b", enc).tolist() == less + small(sign + "b")
    assert bpe.ids_of("a" + run + "b c", enc).tolist() == small("a") + less + small(sign + "b c")


def test_long_white_space_as_jobs(spark):
    texts = ["a" + " " * 1_200_000 + "b", "\n" * 1_200_000, "plain"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in bpe.digests(docs, public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert all(r.round_trip for r in corpus_pipeline.stage_encode(spark, docs, "").select("round_trip").collect())


# --- 11 --------------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top, covered=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for d in (1, 2, 3):
                f[lang].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in cand.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        mine = []
        for p, a in cand.items():
            if 100 * longer[p] >= covered * a and longer[p]:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(11)
    vocabulary = ["the", "of", "New", "york", "CITY", "Été", "日本", "x", "a b", "-", "z" * 40]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!?"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 80)), rng.choice(["en", "en", "de", None, ""]), "s", 0) for i in range(60)]
    rows += [(3, rows[3][1], rows[3][2], "s", 0)] * 5 + [(None, None, None, None, None), (7, None, "en", "s", 0), (8, "", "xx", "s", 0), (9, " .,\n ", "yy", "s", 0)]
    return rows + [(10, text(20_000), "en", "s", 0), (11, "the of " * 3000, "de", "s", 0)]


@pytest.mark.parametrize("sizes", [{}, {"shard": 5_000, "chunk": 40, "per_range": 150}, {"shard": 500, "chunk": 7, "per_range": 20}])
def test_collocations(spark, phrases, sizes):
    docs = with_clashes(spark.createDataFrame(phrases, DOCS))
    got = collocations.collocations(docs, least=5, top=40, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r[2], r[1]) for r in phrases], 5, 40)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_trie_packs_and_splits():
    rng = random.Random(2)
    for _ in range(20):
        run = collocations.trie("".join(rng.choice(["a", "b ", " c", "dd", ".", " "]) for _ in range(rng.randint(0, 200))).encode())
        back = collocations.unpack(collocations.pack(run))
        listed = lambda r: [(collocations.entry(r, i), int(r[2][i])) for i in range(len(r[2]))]
        assert listed(run) == listed(back) == sorted(listed(run))
        cuts = sorted({tuple(rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rng.randint(1, 3))) for _ in range(5)})
        parts = list(collocations.split(run, cuts))
        assert [e for _, p in parts for e in listed(p)] == listed(run)
        for k, p in parts:
            assert all((k == 0 or cuts[k - 1] <= e) and (k == len(cuts) or e < cuts[k]) for e, _ in listed(p))


def test_exact_products(spark):
    huge = spark.createDataFrame([(3 * 10**15, 4 * 10**15, 3 * 10**15 + 1)], "a long, l long, r long")
    got = huge.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 10**6 * (3 * 10**15) ** 2 // (4 * 10**15 * (3 * 10**15 + 1))


# --- 12 --------------------------------------------------------------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows):
    import sentencepiece
    import tokenizers

    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    sign = crosstok.byte_of_sign()
    with open(A) as f:
        a_bytes = {i: bytes(sign[c] for c in w) for w, i in json.load(f)["model"]["vocab"].items() if all(c in sign for c in w)}
    b_bytes = lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := sp.id_to_piece(i)) else p.replace("▁", " ").encode()
    held, all_links, out = Counter(), [], []
    for doc, x in rows:
        links, row = Counter(), (doc, 0, 0, 0, 0, "")
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        if x and b"".join(a_bytes[i] for i in a) == b"".join(map(b_bytes, b)) == (" " + x).encode():
            ea, eb = (np.cumsum([0, *n]).tolist() for n in ([len(a_bytes[i]) for i in a], [len(b_bytes(i)) for i in b]))
            ends = sorted(set(ea) & set(eb))
            groups = [",".join(map(str, a[ea.index(p) : ea.index(q)])) + "|" + ",".join(map(str, b[eb.index(p) : eb.index(q)])) for p, q in zip(ends, ends[1:], strict=False)]
            j = 0
            for i in range(len(a)):
                while eb[j + 1] <= ea[i]:
                    j += 1
                k = j
                while k < len(b) and eb[k] < ea[i + 1]:
                    links[a[i], b[k]] += 1
                    k += 1
            row = (doc, len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest())
        held.update(links.keys())
        all_links.append(links)
        out.append(row)
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(*r[:5], sum(v for p, v in ls.items() if held[p] == top[p[0]]), sum(v * held[p] for p, v in ls.items()), r[5]) for r, ls in zip(out, all_links, strict=True)]


@pytest.fixture(scope="module")
def hostile():
    rng = random.Random(4)
    parts = ["the ", "of", " Ouenstre", "\n", "\n\n", "  ", "   x", "\t", "café", "日本語", "\U0001f600", "<|endoftext|>", "</s>", "<s>", "<0x41>", "12345", "don't", " ", "　", "\x1c", "é", "½", "--", "=" * 30]
    texts = [None, "", " ", "  ", "a", "a ", "a  ", " a", "\n", "a\n b", "a\n  b", "▁", "a▁b", "\x00", "x" * 3000, "ab cd " * 2000, " " * 3000 + "a", "é" * 700]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (20, texts[20]), (None, texts[21]), (None, None)]


@pytest.mark.parametrize("sizes", [{}, {"block": 700, "slice_": 50, "meet": 300}])
def test_alignment(spark, hostile, sizes):
    docs = with_clashes(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in hostile], DOCS))
    got = crosstok.align(docs, A, B, **sizes)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_alignment(hostile), key=key)
    assert crosstok.align(spark.createDataFrame([], DOCS), A, B).count() == 0


def align_rows(tokens, rows):
    a, a_at = crosstok._ragged([[tokens.index(t) for t in r[0]] for r in rows])
    b, b_at = crosstok._ragged([[tokens.index(t) for t in r[1]] for r in rows])
    return (a_at, b_at), *crosstok.Transducer(tokens, tokens).align(a, a_at, b, b_at)


@pytest.mark.parametrize("n", [3, 300])
def test_transducer_alone(n):
    rng = random.Random(n)
    tokens = [bytes(rng.choice(b"ab") for _ in range(k)) for k in (1, 2, 3, 4) for _ in range(2**k)]
    tokens = sorted({b"a", b"b", *tokens})
    rows, sides = [], []
    for _ in range(n):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)))
        own, cuts = [], []
        for _ in range(2):
            at = [0]
            while at[-1] < len(text):
                at.append(at[-1] + rng.choice([k for k in (1, 2, 3, 4) if text[at[-1] : at[-1] + k] in tokens and at[-1] + k <= len(text)]))
            own.append([text[p:q] for p, q in zip(at, at[1:], strict=False)])
            cuts.append(at)
        if rng.random() < 0.1:
            own[1] = own[1][:-1] if rng.random() < 0.5 else [b"a" if t == b"b" else b"b" if t == b"a" else t for t in own[1]]
        rows.append(own)
        sides.append(cuts)
    (a_at, b_at), good, groups, links = align_rows(tokens, rows)
    for r, (own, cuts) in enumerate(zip(rows, sides, strict=True)):
        same = b"".join(own[0]) == b"".join(own[1])
        assert good[r] == same
        if not same:
            assert not (groups[0] == r).any() and not (links[0] == r).any()
            continue
        g = groups[:, groups[0] == r]
        ends = sorted(set(cuts[0]) & set(cuts[1]))[1:]
        assert [cuts[0][p - a_at[r]] for p in g[1]] == [cuts[1][q - b_at[r]] for q in g[2]] == ends
        want = Counter(
            (tokens.index(text), tokens.index(other)) for p, q, text in zip(cuts[0], cuts[0][1:], own[0], strict=False) for u, v, other in zip(cuts[1], cuts[1][1:], own[1], strict=False) if p < v and u < q
        )
        ours = links[1:, links[0] == r]
        assert Counter(zip(ours[0].tolist(), ours[1].tolist(), strict=True)) == want


# --- 13 --------------------------------------------------------------------------------------------------------------


def plain_topk(rows, k, step):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [int(math.floor(1024 * x)) for x in v]))
    out = []
    for q, v in good:
        if q is not None and q % step == 0:
            found = sorted((-max(min(sum(a * b for a, b in zip(v, w, strict=True)), 2**63 - 1), -(2**63)), i is None, i or 0, i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r, e[3], -e[0]) for r, e in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize(("k", "block"), [(10, 2048), (3, 20), (10, 40)])
def test_topk(spark, k, block):
    rng = random.Random(9)
    vector = lambda d=6: [rng.choice([-1.5, -0.25, 0.0, 0.001, 0.3, 2.0, rng.uniform(-1, 1)]) for _ in range(d)]
    rows = [(i, vector()) for i in range(200)]
    rows += [(10, rows[10][1]), (10, vector()), (None, vector()), (None, rows[20][1]), (300, None), (310, [None] + [0.0] * 5), (320, [math.nan] * 6), (330, [math.inf] + [0.0] * 5), (340, [0.0] * 6)]
    rows += [(400, []), (401, []), (410, [1.0, 2.0]), (411, [2.0, -1.0]), (420, [1e9] * 6), (430, [-3e15] * 6), (440, [1e300] + [0.0] * 5)]
    rows += [(500 + i, rows[30][1]) for i in range(40)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(df, F.col("vec_id") % 10 == 0, k, block=block)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_topk(rows, k, 10), key=key)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(4000, 3)) * 1024)
    lists = topk.Lists(list(range(4000)), rows)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, np.ndarray):
                read.append(len(i))
            return super().__getitem__(i)

    q = np.array([1024.0, 10.0, -500.0])
    got = lists.search(lists.rows.view(Counted), q, None, 10, None)
    assert [p for _, p in got] == np.lexsort((np.arange(4000), -(rows @ q)))[:10].tolist()
    assert sum(read) < 2000


# --- SQL, whole tables, large lists ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_collocations", "op13_threshold_topk", "decoded_digests", "edited_digests", "payload_digests"])
def test_same_as_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = Q.queries()[name](spark, folder)
    want = c.sql(Q.oracle_sql()[name])
    order = [df.columns.index(x) for x in want.columns]
    assert sorted(want.columns) == sorted(df.columns)
    assert Counter(tuple(r[k] for k in order) for r in df.collect()) == Counter(want.fetchall())


def test_alignment_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, crosstok.align(docs, A, B).collect())) == sorted(plain_alignment(rows))


def test_repeats_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = {}
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k] += 1
                gone[min(k + 200, len(t))] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(docs).collect()} == want


def test_large_list_behind_a_small_filter(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    listed = {(f"{name()}.{name()}{i % 7}.net", rng.choice(["/", "/a/", f"/{name()}"]), rng.choice(["allow", "block"])) for i in range(60_000)}
    best: dict = {}
    for host, path, verdict in listed:
        best[host, path] = max(verdict, best.get((host, path), ""))
    hosts = [h for h, _ in rng.sample(sorted(best), 300)]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice([rng.choice(hosts), name() + '.net'])}/{rng.choice(['', 'a/', name()])}" for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(sorted(listed), "host string, path string, verdict string")
    lengths = {(len(h), len(p)) for h, p in best}
    want, tried = {}, 0
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        keys = [(h, ("/" + path)[:k]) for h in (host[j:] for j in range(len(host)) if j == 0 or host[j - 1] == ".") for k in range(len(path) + 2)]
        tried += sum((len(h), len(p)) in lengths for h, p in keys)
        found = [(len(h) + len(p), len(h), h + p, best[h, p]) for h, p in keys if (h, p) in best]
        want[i] = max(found)[2:] if found else (None, "allow")
    got = {}
    for size in (64, 1):
        got[size] = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules, max_filter_mb=size).collect()}
        assert got[size] == want
    # A filter far too small lets nearly everything through, and the join takes it out again.
    keys = [f"{h}\0{p}" for h, p in best]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    others = [f"{name()}{name()}.org\0/{i}" for i in range(5000)]
    for bits, share in ((16, 0.01), (1, 1.0)):
        bloom = urlfilter.build_filter(frame, len(keys), bits_per_key=bits)
        assert urlfilter.maybe(bloom, urlfilter.hash_keys(keys)).all()
        assert urlfilter.maybe(bloom, urlfilter.hash_keys(others)).mean() <= share
    assert 0 < sum(v[0] is not None for v in want.values()) < len(urls) and tried


def test_quality_fit_equals_a_plain_discriminant(spark):
    rng = np.random.default_rng(5)
    d = len(quality.FEATURES)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + y[:, None] * rng.normal(size=d)
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)] + [(x[0].tolist(), None), (x[1].tolist(), 7)], "stats array<double>, label int").repartition(4)
    model = quality.fit(rows, shrink=0.3, ridge=0.05)
    pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
    density = []
    for c in (0, 1):
        own = x[y == c]
        cov = 0.7 * np.cov(own.T, bias=True) + 0.3 * pooled + 0.05 * np.diag(np.diag(pooled))
        gap = x - own.mean(axis=0)
        density.append(-0.5 * (gap @ np.linalg.inv(cov) * gap).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own)))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -40, 40)))
    assert np.allclose(model.score(x), want, atol=1e-8)
