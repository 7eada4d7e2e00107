"""Vector operators against brute force, with vectors that take no part, repeated ones and ties."""

import numpy as np
import pytest

from quarry.llm import annq, ego_join
from quarry.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * rng.choice([0.1, 0.3, 1.0], (300, 1)), np.repeat(rng.normal(size=(1, 16)), 40, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    odd = [(900, None, 1, None), (901, [0.0] * 16, 1, ""), (902, [float("nan")] + [1.0] * 15, 1, ""), (903, [float("inf")] + [1.0] * 15, 1, ""), (904, [None] + [1.0] * 15, 1, ""), (905, [1.0, 2.0], 1, ""), (906, [], 1, "")]
    return x.astype(float), odd, spark.createDataFrame(rows + odd, SCHEMA)


@pytest.mark.parametrize(("block", "leaf"), [(None, 512), (32, 8)])
def test_epsilon_join(table, block, leaf):
    x, odd, df = table
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    hit = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    while True:
        new = np.minimum(root, np.where(hit, root[None, :], len(u)).min(1))
        if (new == root).all():
            break
        root = new
    got = {r["vec_id"]: r for r in ego_join.link(df, block=block, leaf=leaf).collect()}
    assert len(got) == len(x) + len(odd)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (hit[i].sum(), root[i], root[i] == i)
    assert all((got[o[0]]["n_links"], got[o[0]]["component_id"], got[o[0]]["kept"]) == (0, o[0], True) for o in odd)


def test_distant_blocks_are_skipped(spark):
    """Twenty clusters on a sphere of three of 24 dimensions: most pairs of blocks and of vectors are left out, no link is."""
    rng = np.random.default_rng(6)
    c = np.zeros((20, 24))
    c[:, :3] = rng.normal(size=(20, 3))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = (np.repeat(c, 100, 0) + 0.01 * rng.normal(size=(2000, 24))).astype(np.float32)
    report = []
    out = ego_join.link(spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA), block=100, leaf=25, report=report)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in out.collect()} == dict(enumerate(want.tolist()))
    n, blocks, pairs, _, compared = report[0]
    assert n == 2000 and pairs < blocks * (blocks + 1) / 2 / 2 and compared < 2000 * 2000 / 2 / 4


def test_places_bound_distances():
    rng = np.random.default_rng(7)
    u = rng.normal(size=(60, 12))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    p = ego_join.places(u, np.linalg.qr(rng.normal(size=(12, 12)))[0][:, :4])
    far = lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)
    assert (far(p) <= far(u) + 1e-9).all()


def test_a_hot_vector(spark, monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, float(i + 1)], 0, "") for i in range(30)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ego_join.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (19, 1) if i % 3 else (9, 0) for i in range(30)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ego_join.link(none).count() == 0 and annq.search(none).count() == 0
    bad = spark.createDataFrame([(20, None, 0, "")], SCHEMA)
    assert annq.search(bad).count() == 0 and ego_join.link(bad).count() == 1


def test_search(table):
    x, _, df = table
    got = {}
    for r in annq.search(df, every=20, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, len(x), 20))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        assert [r for r, _, _ in rows] == list(range(1, 21)) and np.allclose([p for _, _, p in rows], s[[v for _, v, _ in rows]], rtol=0, atol=1e-12)
        assert [(-p, v) for _, v, p in rows] == sorted((-p, v) for _, v, p in rows)
        hits += len({v for _, v, _ in rows} & set(want.tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_each_length_is_served(spark):
    """Vectors of 16 and, fewer, of 8 components: each length has its links and its neighbours."""
    rng = np.random.default_rng(8)
    sets = [(i0, x[rng.integers(0, 6, n)] + 0.1 * rng.normal(size=(n, x.shape[1]))) for i0, n, x in ((0, 60, rng.normal(size=(6, 16))), (60, 40, rng.normal(size=(6, 8))))]
    sets = [(i0, x.astype(np.float32).astype(float)) for i0, x in sets]
    df = spark.createDataFrame([(i0 + i, v.tolist(), 0, "") for i0, x in sets for i, v in enumerate(x)], SCHEMA)
    links = {r["vec_id"]: r["n_links"] for r in ego_join.link(df).collect()}
    found = {}
    for r in annq.search(df, every=20, k=5).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(found) == [0, 20, 40, 60, 80]
    for i0, x in sets:
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        assert [links[i0 + i] for i in range(len(x))] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()
        for q in range(-i0 % 20, len(x), 20):
            s = x @ x[q]
            s[q] = -np.inf
            assert [found[i0 + q][r] - i0 for r in range(1, 6)] == np.lexsort((np.arange(len(x)), -s))[:5].tolist()


def test_recall_with_few_reranked(spark):
    """6,000 vectors, 300 of them queries, of which rerank_of() scores 300 codes each exactly: a twentieth."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)
    assert annq.rerank_of(6000, 20) == 300
    got = {}
    for r in annq.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(float)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hits / 6000 >= 0.9
    # and the codes tell: random ones would find about a twentieth
    codes, _ = annq.encode(x, books := annq.fit_codebooks(x))
    shuffled = annq.best_codes(x[:64], codes[rng.permutation(len(codes))], books, 300)
    true = np.argpartition(-(x[:64] @ x.T), 20, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(shuffled.tolist(), true.tolist(), strict=True)]) / 20 < 0.2


def test_large_k_and_repeated_queries(spark, monkeypatch):
    """k beyond RERANK times 20, several shards and query groups, classes whose query repeats more than k times."""
    monkeypatch.setattr(annq, "SHARD", 1 << 14)
    monkeypatch.setattr(annq, "QUERY_BYTES", 1 << 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)
    n = {r["query_id"]: r["count"] for r in annq.search(df, every=500, k=500).groupBy("query_id").count().collect()}
    assert n == {0: 500, 500: 500}
    same = [(20, [1.0, 0.0], 0, "")] * 9 + [(i, [1.0, 0.0], 0, "") for i in (7, 41, 42, 43, 44)] + [(3, [0.5, 0.5], 0, "")] * 2
    got = [(r["rank"], r["vec_id"], r["score"]) for r in annq.search(spark.createDataFrame(same, SCHEMA), k=6).orderBy("rank").collect()]
    assert got == [(1, 7, 1.0), (2, 41, 1.0), (3, 42, 1.0), (4, 43, 1.0), (5, 44, 1.0), (6, 3, 0.5)]
    other = [(i, [1.0, 0.0], 0, "") for i in (20, 21, 22)] + [(21, [1.0, 0.0], 0, "")] * 9
    assert [r["vec_id"] for r in annq.search(spark.createDataFrame(other, SCHEMA), k=4).collect()] == [21] * 4


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (20, [1.0, 0.0], 0, ""), (20, [1.0, 0.0], 0, ""), (3, [0.5, 0.5], 0, "")], SCHEMA)
    assert [tuple(r) for r in annq.search(df).orderBy("query_id", "rank").collect()] == [(0, 1, 20, 1.0), (0, 2, 20, 1.0), (0, 3, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]


def test_beam_encoding_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    books = annq.fit_codebooks(x, 4, 16)
    err = [((x - sum(books[m][annq.encode(x, books, b)[0][:, m]] for m in range(4))) ** 2).sum() for b in (1, 8)]
    codes, norms = annq.encode(x, books, 8)
    assert err[1] <= err[0] and np.allclose(norms, (sum(books[m][codes[:, m]] for m in range(4)) ** 2).sum(1))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (None, 5), (12, 11), *((100 + i, 101 + i) for i in range(40)), *((500, 501 + i) for i in range(50))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}
    assert all(got[100 + i] == 100 for i in range(41)) and all(got[501 + i] == 500 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
