"""WARC archives, the embedding join and components against brute force."""

import hashlib
import io
import zipfile

import duckdb
import numpy as np
import pytest

from relscope.llm import ego_join, queries, warc
from relscope.llm.common import components, offsets
from relscope.llm.oracle import ORACLE
from relscope.llm.simhash import forest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    big = "x" * 200
    data = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "line\nbreak", "é" * 60), (8, "u", "é" * 60), (None, "u", big), (9, "u", "y" * 1_000_000)]
    return spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, html string, payload string")


def test_round_trip(pages, spark):
    got = {(r.page_id, r.payload_digest): r for r in warc.round_trip(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.html or "").encode()
        x = got[(r.page_id, hashlib.sha256(raw).hexdigest())]
        same = [p.page_id for p in rows if len(raw) >= 100 and (p.html or "").encode() == raw and p.page_id is not None]
        first = min(same) if same else None
        kind = "revisit" if first is not None and first != r.page_id else "response"
        assert (x.payload_bytes, x.record_type, x.refers_to) == (len(raw), kind, first if kind == "revisit" else None)
        assert x.payload is None if kind == "revisit" else bytes(x.payload) == raw
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("limit", [None, 10])
def test_zip_directories(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)  # small archives then need ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("first", b"12345678901234567890")
        z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), b"abcdefghijklmnopqrst" * 3)
        z.writestr("packed", b"0" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = raw.getvalue()
    m = warc.read_members(lambda at, n: data[at:at + n], len(data))
    at, n = m["archive/data.warc.gz"]
    assert data[at:at + n] == b"abcdefghijklmnopqrst" * 3 and "packed" not in m
    with pytest.raises(ValueError):
        warc.read_members(lambda at, n: b"no archive"[at:at + n], 10)


def test_changed_payload_is_noticed():
    raw = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    v = np.concatenate([c + rng.normal(0, 0.13, (n, 16)) for c, n in zip(centres, rng.integers(1, 60, 40))]).astype(np.float32)
    v = np.concatenate([v, v[:50], 3 * v[:5]])
    data = [(i, x.tolist(), "k") for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    data += [(len(v) + i, x, "k") for i, x in enumerate(odd)] + [(3, v[3].tolist(), "k"), (None, v[4].tolist(), "k")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, a string")
    old = ego_join.BLOCK, ego_join.PART
    ego_join.BLOCK, ego_join.PART = 64, 8  # several levels
    try:
        got = ego_join.near_duplicates(df).collect()
    finally:
        ego_join.BLOCK, ego_join.PART = old
    u = ego_join.unit(np.array([x for _, x, _ in data if x is not None and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]))
    ids = [i for i, x, _ in data if x is not None and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]
    m = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    a, b = np.nonzero(m)
    root = forest(len(u), a, b)
    names = {r: min(i for i, q in zip(ids, root) if q == r and i is not None) for r in set(root.tolist())}
    want = sorted([(i, int(n), names[r]) for i, n, r in zip(ids, m.sum(1), root)] + [(len(v) + 6, 1, len(v) + 6), (len(v) + 7, 1, len(v) + 6)]
                  + [(len(v) + i, 0, len(v) + i) for i in range(6)], key=repr)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert ego_join.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 600)]
    other = [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (200, 2))]
    edges = chain + star + other + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    e = np.array([x for x in edges if x[0] != x[1]])
    root = forest(2000, e[:, 0], e[:, 1])
    assert got == {int(n): int(root[n]) for n in np.unique(e)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_of_a_long_ascending_chain(spark, monkeypatch):
    from relscope.llm import common
    rounds, real = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: (rounds.append(name) if name.endswith("-step") else None) or real(df, name))
    got = components(spark.createDataFrame([(i, i + 1) for i in range(1, 64)] + [(100, 101)], "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys(range(1, 65), 1), 100: 100, 101: 100} and len(got) == 66
    assert len(rounds) <= 24
    print("rounds", len(rounds))


def test_offsets(spark):
    d = spark.createDataFrame([(g, i, i % 7) for g in "ab" for i in range(50)], "g string, i long, n long")
    for r in offsets(d, "g", "i", "n", span=8).collect():
        assert r.before == sum(i % 7 for i in range(r.i))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel, df = con.sql(ORACLE[key]), queries.QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(
        (tuple(r) for r in rel.project(", ".join(cols)).fetchall()), key=repr)


def test_embedding_links_in_tiles_and_rounds(spark, monkeypatch):
    """Tiles of several intervals in several rounds give all pairs' links; an interval is sent to a tile once, not with each of its pairs."""
    from relscope.llm.common import written
    monkeypatch.setattr(ego_join, "BLOCK", 16)
    monkeypatch.setattr(ego_join, "RUNS", 4)
    monkeypatch.setattr(ego_join, "ROUND_BYTES", 1)
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(12, 8))[rng.integers(0, 12, 300)] + rng.normal(0, 0.2, (300, 8))).astype(np.float32)
    v = np.concatenate([v, v[:9]])
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(400 + i, v[i].tolist()[:5]) for i in range(40)]
    rounds = []
    monkeypatch.setattr(ego_join, "written", lambda df, name: rounds.append(name) or written(df, name))
    got = ego_join.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    ids, dims = np.array([i for i, _ in data]), np.array([len(x) for _, x in data])
    m = np.zeros((len(data), len(data)), bool)
    for d in (8, 5):
        at = np.nonzero(dims == d)[0]
        u = ego_join.unit(np.array([data[i][1] for i in at]))
        m[np.ix_(at, at)] = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    root = forest(len(data), *np.nonzero(m))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(int(i), int(n), int(ids[q])) for i, n, q in zip(ids, m.sum(1), root)]
    assert rounds.count("ego-links") > 2
    pairs = spark.range(8).selectExpr("id AS i").crossJoin(spark.range(8).selectExpr("id AS j")).where("i <= j")
    tiles = ego_join._tiles(pairs, 4).collect()
    assert len(tiles) == 4 + 8 + 4 and sorted((t.block, j) for t in tiles for j in t.js) == [(i, j) for i in range(8) for j in range(i, 8)]
