"""Whitening, URL filter and Merkle manifest against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relscope.llm import merkle, queries, url_filter, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, n long, component string, x string"


def solve(matrix, k, **settings):
    calls = []

    def multiply(block):
        calls.append(block.shape[1])
        return matrix @ block

    values, vectors = whitening.jacobi_davidson(multiply, len(matrix), k, **settings)
    return values, vectors, calls


@pytest.mark.parametrize("dim,rows,k", [(64, 2000, 8), (64, 5, 8), (200, 900, 8), (3, 50, 3), (1, 9, 1)])
def test_jacobi_davidson_meets_dense_eigenvectors(dim, rows, k):
    x = np.random.default_rng(dim).standard_normal((rows, dim)) * np.linspace(1, 3, dim)
    v = np.cov(x.T, bias=True).reshape(dim, dim)
    values, vectors, _ = solve(v, k)
    exact, axes = np.linalg.eigh(v)
    assert np.abs(values - exact[::-1][:k]).max() <= 1e-13 * exact[-1]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * exact[-1]
    known = values > 1e-9 * values[0]
    assert np.abs(np.abs((axes[:, ::-1][:, :k] * vectors).sum(0))[known] - 1).max() < 1e-12


def test_jacobi_davidson_restarts_and_uses_inner_steps():
    x = np.random.default_rng(5).standard_normal((3000, 300))
    v = np.cov(x.T, bias=True)
    values, vectors, calls = solve(v, 4, widest=24)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * values[0]
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:4]).max() <= 1e-12 * values[0]
    assert len(calls) > 20 and max(calls) <= 8  # blocks, never the matrix


def test_jacobi_davidson_equal_and_no_eigenvalues():
    values, vectors, _ = solve(np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]), 6)
    assert np.allclose(values, [3, 3, 3, 2, 2, 1]) and np.allclose(vectors.T @ vectors, np.eye(6))
    assert np.allclose(solve(np.zeros((9, 9)), 4)[0], 0)


def test_jacobi_davidson_says_when_it_fails():
    rng = np.random.default_rng(0)
    with pytest.raises(ArithmeticError):
        whitening.jacobi_davidson(lambda b: b + rng.standard_normal(b.shape), 40, 3, rounds=5)


def test_minres_solves_indefinite_systems():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    b = np.column_stack([np.ones(30), np.zeros(30), np.arange(30.0)])
    x = whitening.minres(lambda v: a @ v, b, 60)
    assert np.abs(a @ x - b).max() < 1e-8 and not x[:, 1].any()


def brute_whitening(rows, k=8):
    """rows: (vec_id, list); exact integers, dense eigenvectors."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    c = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [i for i, _ in kept], n, deviation, c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def check_whitening(got, rows, k):
    ids, n, deviation, white, share = brute_whitening(rows, k)
    assert len(got) == len(ids) * k and {r.component for r in got} == set(range(1, k + 1))
    place = {i: at for at, i in enumerate(ids)}
    mine = np.zeros_like(white)
    for r in got:
        mine[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained - share[r.component - 1]) <= 1e-9 * share[r.component - 1]
    signs = np.sign((mine * white).sum(0))
    assert np.abs(mine - white * signs).max() < 1e-8
    cov = np.cov(mine.T, bias=True).reshape(k, k)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-10
    assert abs(got[0].identity_error - np.abs(cov - np.eye(k)).max()) < 1e-10


def test_whitening_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SF).collect(), rows, 8)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(2 ** 60 + i, [float(np.float32(c)) for c in rng.standard_normal(5)]) for i in range(40)]
    odd = [(1, None), (2, []), (3, [0.0, None, 0.0, 0.0, 0.0]), (4, [float("nan")] * 5), (5, [float("inf")] * 5), (6, [1.0]), (7, [1.0] * 4)]
    got = whitening.components(spark.createDataFrame([(*r, 1, "c", "x") for r in rows + odd], VECTORS)).collect()
    check_whitening(got, rows, 5)
    # Repeated rows count each; a null id stays null.
    twice = spark.createDataFrame([(None, rows[0][1], 1, "c", "x")] * 2 + [(*r, 1, "c", "x") for r in rows], VECTORS)
    again = whitening.components(twice, 2).collect()
    assert len(again) == 84 and sum(r.vec_id is None for r in again) == 4 and {r.n for r in again} == {42}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_variance(spark, rows):
    out = whitening.components(spark.createDataFrame([(*r, 1, "c", "x") for r in rows], VECTORS))
    assert out.collect() == []
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def test_whitening_less_rows_than_dimensions_and_large_entries(spark):
    rows = [(1, [1.0, 0.0, 0.0, 5.0]), (2, [0.0, 3.0, 0.0, 5.0]), (3, [0.0, 0.0, 40.0, 5.0]), (4, [2.0 ** 31, 0.0, 0.0, 0.0])]
    got = whitening.components(spark.createDataFrame([(*r, 1, "c", "x") for r in rows], VECTORS)).collect()
    check_whitening(got, rows[:3], 2)
    # A deviation beyond 64 bits is null.
    huge = [(i, [float(i % 2) * 2.0 ** 29, float(i)]) for i in range(8)]
    got = whitening.components(spark.createDataFrame([(*r, 1, "c", "x") for r in huge], VECTORS), 1).collect()
    assert len(got) == 8 and all(r.deviation is None for r in got)


# --- URL filter

def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute_rule(host, path):
    fits = [(len(d + p), d + p, what) for what, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no url", "http://", "https://EXAMPLE.Org/es/1", "http://example.org", "http://a.example.org/en/17?x", "http://a.example.org/en/2#/",
        "http://badexample.org/es/", "ftp://org/x", "http://x.com/fr/", "http://x.com/fr", "http://com/de/y", "http://x.com?y=/de/", "http://x.com#://z/de/",
        "http://é.com/dé/", "http://user@x.com:80/de/", "x://y://z/fr/a", "http://a.b.net/\n?q", "http:///fr/", "http://x.org/" + "a" * 50_000, "HTTP://Ä.ORG/"]


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def test_urls_split_and_rules(spark, model):
    rows = [(i, u, "h", "p", "r") for i, u in enumerate(URLS)] + [(None, "http://x.org/", "h", "p", "r")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string")
    got = url_filter.judge(pages, model).collect()
    assert len(got) == len(rows) and sum(r.page_id is None for r in got) == 2
    for r in got:
        url = "http://x.org/" if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path) == brute_split(url), url
        rule, what = brute_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (what or r.verdict) and r.verdict in ("allow", "block"), url
        if not r.host and not r.path:
            assert r.verdict == "allow"


def test_regression_weighs_the_ngrams_of_host_and_path(spark, model):
    """Probabilities by hand: the sigmoid of the intercept and the weights of the distinct hashed n-grams."""
    from pyspark.ml.feature import HashingTF
    urls = [u for u in URLS if u and len(u) < 100] + ["http://casino.net/pills", "http://ab.net/a"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model, ()).collect()
    hashing = HashingTF(numFeatures=url_filter.BUCKETS)
    weights, base = model.regression.coefficients.toArray(), model.regression.intercept

    def grams(text, mark):
        t = f"^{text}$"
        return {mark + t[i:i + n] for n in url_filter.SIZES for i in range(max(len(t) - n + 1, 1))}

    for r in got:
        found = grams(r.host, "h") | grams(r.path, "p") if r.host or r.path else set()
        p = 1 / (1 + np.exp(-base - sum(weights[i] for i in {hashing.indexOf(g) for g in found})))
        assert abs(r.p_block - p) < 1e-9, urls[r.page_id]
        if found:
            assert r.verdict == ("block" if p >= 0.5 else "allow")


def test_regression_on_held_out_urls(spark):
    table = url_filter.labelled_urls(spark)
    out = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    fitted = url_filter.train(table.where(~out))
    rest = table.where(out).collect()
    urls = spark.createDataFrame([(i, r.url) for i, r in enumerate(rest)], "page_id long, url string")
    right = {True: [], False: []}
    for r in url_filter.judge(urls, fitted, ()).collect():
        right[rest[r.page_id].blocked].append((r.verdict == "block") == rest[r.page_id].blocked)
    assert np.mean(right[True]) > 0.7 and np.mean(right[False]) > 0.95


def test_unseen_names(spark, model):
    bad = ["http://my-casino-royal.biz/", "http://adult-videos.net/x", "http://free-poker-bets.info/a", "http://marbon.net/cheap-viagra-pills/1"]
    good = ["http://www.natural-history-museum.net/en/1", "http://gardening-journal.info/", "http://bolnar.net/music/review"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string"), model, ()).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == ["block"] * len(bad) + ["allow"] * len(good)


def test_training_tables_without_two_labels(spark):
    schema = "url string, blocked boolean, host string"
    pages = spark.createDataFrame([(1, "http://x.net/a"), (2, "http://x.com/fr/"), (3, None)], "page_id long, url string")
    for rows, verdict in (([], "allow"), ([("http://a.net", True, "h"), (None, False, "h"), ("http://b.net", None, "h")], "block"), ([("http://a.net", False, "h")], "allow")):
        got = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.train(spark.createDataFrame(rows, schema))).collect()}
        assert got == {1: verdict, 2: "allow", 3: "allow"}


def test_url_query_on_the_whole_table(spark, model):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = queries.op12_url_filter(spark, SF).collect()
    assert len(first) == len(rows)
    for r in first:
        assert (r.host, r.path) == brute_split(rows[r.page_id])
        rule, what = brute_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (what or r.verdict)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), model).collect() == []


# --- Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """(root, for every node its runs of siblings by level: (run, slot))."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i in range(len(at)):
            lo = at[i] // 16 * 16
            steps[i].append((nodes[lo:lo + 16], at[i] - lo))
            at[i] //= 16
        nodes = [H(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def brute_manifest(docs):
    """Sorted result rows of (doc_id, source, lang, n_chars, text) rows."""
    leaf = [(d, s, H(enc(d), enc(s), enc(l), enc(n), enc(t)), H(enc(d), enc(s), enc(l), enc(n), enc(lower(t)))) for d, s, l, n, t in docs]
    sources = sorted({x[1] for x in leaf}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        mine = sorted((x for x in leaf if x[1] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        trees.append((mine, *climb([x[2] for x in mine])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, steps), top in zip(trees, tops):
        for (doc, _, whole, changed), path in zip(mine, steps):
            tampered = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
            digest, siblings = changed if tampered else whole, []
            for run, slot in path + top:
                siblings += run[:slot] + run[slot + 1:]
                digest = H(*run[:slot], digest, *run[slot + 1:])
            out.append((doc, whole, subroot, root, H(*siblings), digest, digest == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long, idx long, root string"


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, 2, "y") for d in docs], DOCS)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_odd_tables(spark, levels):
    docs = [(i, "hot", "en", 5, f"Text {i}") for i in range(700)] + [(i, f"s{i % 23}", None, None, f"ÄB {i}") for i in range(300, 360)]
    docs += [(i, None, "de", 0, "") for i in range(17)] + [(2 ** 60 + 1, "big", "x", 1, None), (2 ** 60 + 2, "big", "x", 1, "A" * 100_000)]
    docs += [(None, None, None, None, None)] * 3 + [(7, "hot", "en", 5, "Text 7")] * 2 + [(5, "", "", -3, "lower"), (5, "é", "", -3, "UPPER É")]
    got = sorted((tuple(r) for r in merkle.manifest(frame(spark, docs), levels).collect()), key=str)
    assert got == brute_manifest(docs)


@pytest.mark.parametrize("docs", [[(5, "a", "en", 1, "ALONE")], [(5, None, None, None, None)], [(1, "b", "x", 1, "T"), (2, "a", "x", 1, "T")]])
def test_manifest_of_few_documents(spark, docs):
    got = sorted((tuple(r) for r in merkle.manifest(frame(spark, docs)).collect()), key=str)
    assert got == brute_manifest(docs)


def test_manifest_of_an_empty_table(spark):
    out = merkle.manifest(frame(spark, []))
    assert out.collect() == [] and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_the_whole_table(spark):
    docs = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, SF).collect()), key=str)
    assert got == brute_manifest(docs)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_parent_folds_from_the_kept_state():
    children = [H(str(i)).encode() for i in range(16)]
    parent = merkle.Parent(children)
    for slot in range(16):
        new = H("new").encode()
        assert parent.fold(slot, new).decode() == H(*[c.decode() for c in children[:slot]], "".join([new.decode()]), *[c.decode() for c in children[slot + 1:]])
        assert parent.fold(slot, children[slot]) == parent.digest
        assert parent.states[slot].hexdigest() == H(*[c.decode() for c in children[:slot]])
