"""Yinyang clustering, piecewise hashing and periodic runs against plain versions and on edge cases: nulls, empty and long texts,
ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ctph, periodic, yinyang
from quarry.llm.queries import QUERIES, laced

SF = "/root/testdata/sf0.001"
LONG = "word " * 40_000
EDGE = [(1, ""), (2, None), (3, "a  b\n\n c\td "), (4, LONG), (5, "é́ 日本語 🙂🙂\x00\x1c x y"), (6, "same words here"), (6, "same words here"), (7, "x" * 70_000), (None, "no number"), (None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    # clashing names: columns that operators add
    return spark.createDataFrame([(i, t, 9, "z", "f") for i, t in EDGE], "doc_id long, text string, n_words int, RUNS string, fingerprint string")


# ---- clusters


def plain_lloyd(rows, k, rounds, dims):
    """Python's integers, all distances."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [q for _, q in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(q, c), j) for j, c in enumerate(centroids)) for _, q in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            if mine := [q for (_, q), (_, c) in zip(kept, own, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((i is None, i or 0, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)), centroids


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 6)) * 3
    x = middles[rng.integers(0, 9, 400)] + rng.normal(size=(400, 6)) * 0.4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [0.5, -0.5, 0.0, 1.0, 2.0, 3.0]) for i in range(30)] + [(7, x[8].tolist()), (None, x[9].tolist())]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [None] + [1.0] * 5), (2004, [float("nan")] + [1.0] * 5), (2005, [float("inf")] + [1.0] * 5), (2006, [0.0] * 6)]
    return rows + odd, spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, distance int")


@pytest.mark.parametrize(("k", "groups"), [(8, None), (8, 1), (20, 5), (1, None)])
def test_clusters_are_those_of_the_plain_rounds(vectors, k, groups):
    rows, df = vectors
    out, centroids = yinyang.cluster(df, k=k, dims=6, groups=groups, rounds=6)
    want, middles = plain_lloyd(rows, k, 6, 6)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in out.collect()) == want and centroids == middles
    full = yinyang.with_inertia(out, centroids).collect()
    assert {r["inertia"] for r in full} == {sum(w[3] for w in want)} and len(full) == len(want)
    assert all(r["cluster_inertia"] == sum(w[3] for w in want if w[2] == r["cluster"]) and r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middles[r["cluster"]])).encode()).hexdigest() for r in full)


def test_bounds_spare_distances(vectors):
    _, df = vectors
    report = []
    yinyang.cluster(df, k=20, dims=6, rounds=8, report=report)
    later = report[2:]
    assert report[0][1] == report[0][2] and sum(r[1] for r in later) < 0.4 * sum(r[2] for r in later)


def test_ties_and_large_components(spark):
    # two centroids at equal distance of all others; the smaller number wins
    rows = [(i, [float(i % 2 * 2)]) for i in range(40)] + [(100 + i, [1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, middles = plain_lloyd(rows, 4, 5, 1)
    out, centroids = yinyang.cluster(df, k=4, dims=1, rounds=5)
    assert sorted((False, r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()) == want and centroids == middles
    wide = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).integers(-130_000, 130_000, (60, 3)))]
    want, _ = plain_lloyd(wide, 5, 4, 3)
    assert sorted((False, r["vec_id"], r["cluster"], r["distance"]) for r in yinyang.cluster(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), k=5, dims=3, rounds=4)[0].collect()) == want
    with pytest.raises(Exception, match="components beyond"):
        yinyang.cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dims=1)


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for df in (none, none.limit(0)):
        out = yinyang.with_inertia(*yinyang.cluster(df))
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# ---- fingerprints


def plain_fingerprint(data: bytes) -> str:
    """Byte by byte."""
    if not data:
        return "1::"
    hashes = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 7) : i + 1]:
            h = (h * 0x01000193 + int(ctph._BYTES[b])) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        hashes.append(h ^ h >> 13)
    ends = lambda bits: [i for i, h in enumerate(hashes) if h % (1 << bits) == 0] if bits < 32 else []

    def signature(bits):
        out, at = "", 0
        for e in [*ends(bits), len(data) - 1]:
            if e >= at:
                out += ctph.ALPHABET[zlib.crc32(data[at : e + 1]) % 64]
                at = e + 1
        return out

    bits = next(b for b in range(40) if len(ends(b)) < 64)
    return f"{1 << bits}:{signature(bits)}:{signature(bits + 1)}"


def plain_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0

    def pair(x, y):
        short = min(len(x), len(y))
        need = min(7, (short + 1) // 2)
        if not short or not any(x[i : i + need] in y for i in range(len(x) - need + 1)):
            return 0.0
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return 1.0 - row[-1] / max(len(x), len(y))

    (m, *x), (n, *y) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    return max(pair(x[0], y[0]), pair(x[1], y[1])) if m == n else pair(x[0], y[1]) if m == 2 * n else pair(x[1], y[0]) if n == 2 * m else 0.0


def test_fingerprints_of_texts(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [b"", b"a", b"abcdefg", b"ab" * 40, b"z" * 3000, rng.bytes(63), rng.bytes(64), rng.bytes(5000), ("wörter " * 5 + "x").encode() * 30]
    assert [ctph.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(ctph, "STRETCH", 97)
    assert [ctph.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_documents_beside_the_next(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df, rows in ((docs, [tuple(r) for r in docs.collect()]), (edge.coalesce(1), EDGE), (edge.repartition(3).limit(1), None)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()] if rows is None else rows
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
        want = []
        for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
            t, u = t or "", u or ""
            half = len(t) // 2
            new = t[: len(t) - half] + u[:half]
            f, g, h = (plain_fingerprint(x.encode()) if len(x) < 60_000 else ctph.fingerprint(x.encode()) for x in (t, new, u))
            want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h)))
        out = ctph.against_next(df)
        out = out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", ctph.likeness(F.col("fingerprint"), F.col("edited_fingerprint")), ctph.likeness(F.col("next_fingerprint"), F.col("fingerprint")))
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert ctph.against_next(docs.limit(0)).count() == 0


def test_half_a_text_is_recognised(spark):
    rows = QUERIES["op12_piecewise_hash"](spark, SF).where("n_chars >= 200").collect()
    other = [r for r in rows if r["near_next"] < 1]
    assert np.mean([r["near_edited"] > r["near_next"] for r in other]) > 0.95 and np.median([r["near_edited"] for r in other]) > 0.35
    assert np.mean([r["near_next"] for r in other]) < 0.1


def test_fingerprint_column(edge):
    out = ctph.fingerprints(edge)
    assert out.columns == ["doc_id", "text", "n_words", "RUNS", "fingerprint"]
    assert sorted(r["fingerprint"] for r in out.where("text is null or text = ''").collect()) == ["1::"] * 3
    assert len({r["fingerprint"] for r in out.where("doc_id = 6").collect()}) == 1


# ---- runs


def plain_runs(w, least=12):
    """All maximal stretches of every period; the smallest period of each counts."""
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def plain_collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_sequences(monkeypatch):
    rng = np.random.default_rng(9)
    cases = [rng.integers(0, k, n) for k in (1, 2, 3, 9) for n in (1, 2, 11, 12, 13, 30, 200)]
    for _ in range(60):
        piece = rng.integers(0, 3, rng.integers(1, 9))
        cases.append(np.concatenate([rng.integers(0, 4, rng.integers(0, 20)), np.resize(piece, rng.integers(8, 60)), rng.integers(0, 4, rng.integers(0, 20)), np.resize(piece, rng.integers(8, 60))]))
    for least in (12, 2, 5):
        for c in cases:
            assert [tuple(r) for r in periodic.runs_of(c, least).tolist()] == [(s, p_n, p) for s, p_n, p in sorted(plain_runs(c.tolist(), least), key=lambda r: (r[0], r[2]))]
    monkeypatch.setattr(periodic, "TABLE", 8)
    monkeypatch.setattr(periodic, "POINTS", 50)
    monkeypatch.setattr(periodic, "_table", [])
    for c in cases:
        assert [tuple(r) for r in periodic.runs_of(c).tolist()] == sorted(plain_runs(c.tolist()), key=lambda r: (r[0], r[2]))


def test_extensions():
    rng = np.random.default_rng(10)
    c = rng.integers(0, 2, 70)
    e = periodic.Extensions(c)
    for i in range(71):
        for j in range(i + 1, 71):
            k = 0
            while j + k < 70 and c[i + k] == c[j + k]:
                k += 1
            assert e(np.array([i]), np.array([j]))[0] == k


def test_runs_of_documents(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = [(10, " ".join(["one two three"] * 9) + " end"), (11, "x " * 11), (12, "x " * 12), (13, "a b a b a b a b a b a b c c c c c c c c c c c c")]
    for df in (docs, edge.where("doc_id <> 4 or doc_id is null"), spark.createDataFrame(planted, "doc_id long, text string")):
        for r in periodic.find(df).collect():
            w = (next(t for t in [r["text"]]) if "text" in r else None) or ""
            words = [x.decode() for x in w.encode().split()]
            want = sorted(plain_runs(words), key=lambda x: (x[0], x[2]))
            assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), want, plain_collapse(words, want))
    assert periodic.find(edge).columns == ["doc_id", "text", "fingerprint", "n_words", "runs", "collapsed"]
    long = periodic.find(edge.where("doc_id = 4")).first()
    assert [tuple(x) for x in long["runs"]] == [(0, 40_000, 1)] and long["collapsed"] == "word"
    assert periodic.find(edge.limit(0)).count() == 0


def test_op13_digests(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in QUERIES["op13_harmonic_runs"](spark, SF).collect()}
    some = 0
    for i, t in docs.collect():
        w = [x.decode() for x in (t or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
        most = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        r = got[i]
        assert r["n_runs"] == len(runs) and r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*most, 1000 * most[1] // most[2]) if most else (None,) * 4)
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5
    odd = {r["doc_id"]: r["text"] for r in laced(spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")).collect()}
    assert odd == {None: "a b", 3: None}
