"""Approximate nearest neighbours by inner product with additive quantisation.

A vector is coded as a sum of codewords, one from each full-dimensional codebook. Codebooks are fitted in turn to the residuals
of a bounded sample; encoding keeps a beam of the best partial sums. A query's score for a code is a sum of looked-up inner
products of the query with codewords. The best codes of each query are then scored exactly on the vectors themselves.

The index (codes, norms of the coded sums, vectors) is dealt in shards that fit a task's memory. A task holds a shard and all queries
pass by it, in blocks, or a group of the queries if that moves fewer bytes. Scores by inner product need no norms; they are stored
for readers that search by distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, join_hot, release, small_batches
from quarry.llm.vectors import by_length, matrix, parted

#: Codebooks, codewords of each, and width of the beam.
BOOKS, WORDS, BEAM = 32, 64, 4
#: Vectors in the sample that codebooks are fitted to, at most, the first by a hash; rounds of each fit, and
#: of refitting all together.
SAMPLE, ROUNDS, REFITS = 8192, 5, 2
#: Codes of a query that are scored exactly, for each of the k that it gets: at least, and for this root of the number of vectors.
RERANK, PER_ROOT = 15, 8
#: Vectors of a block of codes, queries of a block, codes looked up at a time, bytes of a shard, tasks at least, and comparisons of a task.
CODES, QUERIES, CHUNK, SHARD, TILES, WORK = 1024, 64, 8192, 64 << 20, 12, 1 << 33
#: Bytes that a query and its results take, about.
QUERY_BYTES = 900


def rerank_of(n: int, k: int) -> int:
    """Codes of a query that are scored exactly: RERANK times k, more where many vectors are nearly as near."""
    return k * max(RERANK, math.isqrt(n) // PER_ROOT)


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, d): each by k-means on what the beam encodings so far leave over, then all refitted together by
    least squares on the codes."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    out = np.zeros((0, words, x.shape[1]))
    rest = x.copy()
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(ROUNDS):
            at = (rest @ c.T * 2 - (c * c).sum(1)).argmax(1)
            n = np.bincount(at, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, at, rest)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
            if (n == 0).any():
                c[n == 0] = rest[rng.choice(len(rest), int((n == 0).sum()))]
        out = np.concatenate([out, c[None]])
        rest = rest - c[(rest @ c.T * 2 - (c * c).sum(1)).argmax(1)]
    for _ in range(REFITS):
        codes, _ = encode(x, out, beam)
        gram, right = np.eye(books * words), out.reshape(books * words, -1).copy()
        for i in range(0, len(x), 1024):
            part = codes[i : i + 1024]
            hot = np.zeros((len(part), books * words))
            hot[np.arange(len(part))[:, None], part + words * np.arange(books)] = 1
            gram += hot.T @ hot
            right += hot.T @ x[i : i + 1024]
        out = np.linalg.solve(gram, right).reshape(out.shape)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) uint8 and squared norms of the sums: at each codebook the beam keeps the partial sums nearest to x."""
    n, d = x.shape
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for c in books:
        width = rest.shape[1]
        # squared distance after adding a word, less a constant: what was left over before, and the word's share
        error = ((rest * rest).sum(2))[:, :, None] - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, width, -1) + (c * c).sum(1)
        flat = error.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        top = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        row, word = top // c.shape[0], top % c.shape[0]
        rest = np.take_along_axis(rest, row[:, :, None], 1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    best = (rest * rest).sum(2).argmin(1)
    left = rest[np.arange(n), best]
    return codes[np.arange(n), best], ((x - left) ** 2).sum(1)


def best_codes(q: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int) -> np.ndarray:
    """For each query the places of the k codes (or all) with the largest looked-up scores, in no order."""
    table = np.einsum("qd,mwd->mqw", q, books).astype(np.float32)
    scores, places = np.empty((len(q), 0), np.float32), np.empty((len(q), 0), np.int64)

    def shrink():
        nonlocal scores, places
        if scores.shape[1] > k:
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            scores, places = np.take_along_axis(scores, top, 1), np.take_along_axis(places, top, 1)

    for i in range(0, len(codes), CHUNK):
        part = codes[i : i + CHUNK]
        s = np.zeros((len(q), len(part)), np.float32)
        for m in range(codes.shape[1]):
            s += table[m].take(part[:, m], axis=1)
        scores = np.concatenate([scores, s], 1)
        places = np.concatenate([places, np.broadcast_to(np.arange(i, i + len(part)), s.shape)], 1)
        if scores.shape[1] > 8 * k:
            shrink()
    shrink()
    return places


def search(vectors: DataFrame, *, every: int = 20, k: int = 20, rerank: int | None = None) -> DataFrame:
    """vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by `every`; each gets its k nearest of all other
    rows by inner product: query_id, rank, vec_id, score, ties to the smaller vec_id; fewer rows if there are fewer candidates.
    rerank: codes of a query that are scored exactly, about; rerank_of() by default.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without vec_id. Those of
    each length are searched among themselves, with codebooks of their own. Equal vectors are searched as one class and each
    returned: a class hands on its k + 1 smallest distinct vec_ids, each with its number of rows, k at most, more than which no list can hold. Repeated rows of a query's
    vec_id are one query and not its own candidates. An empty table gives an empty result; other columns are not read. To the driver
    comes a sample of each length alone."""
    spark = vectors.sparkSession
    small_batches(spark)
    good, _ = parted(vectors)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, part in enumerate(by_length(good.where("vec_id is not null"))):
        found = _search(part, every, k, rerank)
        out = out.unionByName(found) if i else found
    return out


def _search(good: DataFrame, every: int, k: int, rerank: int | None) -> DataFrame:
    """search() of vectors that all take part and are of one length, one at least."""
    spark = good.sparkSession
    kind = "<f4" if dict(good.dtypes)["embedding"] == "array<float>" else "<f8"
    own = good.groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("rows"))
    few = own.withColumn("at", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    members = cut(few.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list(F.struct("vec_id", "rows"))).alias("ids")))
    first = members.agg(F.count("*"), F.first(F.size("embedding"))).first()
    n, d = first
    # a share of the classes by a hash, so that what tasks send does not grow with their number
    share = min(1.0, (SAMPLE + 6 * SAMPLE**0.5) / n)
    h = F.xxhash64("cid")
    sample = members.where(F.shiftrightunsigned(h, 11) <= int(share * (1 << 53))).orderBy(h, "cid").select("embedding").limit(SAMPLE).toPandas()
    books = spark.sparkContext.broadcast(fit_codebooks(np.array(sample["embedding"].tolist(), np.float64)))
    queries = cut(good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumnRenamed("vec_id", "query_id"))
    asked = queries.count()
    size = n * (int(kind[2]) * d + BOOKS + 12)
    tiles = max(TILES, -(-n * asked // WORK))
    groups = max(1, math.isqrt(tiles * asked * QUERY_BYTES // size))
    shards = max(-(-size // SHARD), -(-tiles // groups))
    rerank = rerank or rerank_of(n, k)
    # a shard has its share of a query's best codes, give or take
    rerank = min(rerank, k + -(-2 * rerank // shards)) if shards > 1 else rerank

    def code(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        for batch in batches:
            x = matrix(batch.column(1)) if batch.num_rows else None
            for i in range(0, batch.num_rows, CODES):
                j = min(i + CODES, batch.num_rows)
                codes, norms = encode(x[i:j], books.value)
                raw = [batch.column(0).to_numpy()[i:j].astype("<i8"), codes, norms.astype("<f4"), x[i:j].astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array([at % shards], pa.int64()), *(pa.array([r.tobytes()], pa.binary()) for r in raw)], names=["shard", "cids", "codes", "norms", "vectors"])
                at += 1

    # the stored index
    index = cut(members.select("cid", "embedding").repartition(max(1, min(4 * shards, -(-n // CODES)))).mapInArrow(code, "shard long, cids binary, codes binary, norms binary, vectors binary"))
    of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sent = index.select("shard", of(groups).alias("g"), F.lit(0).alias("kind"), "cids", "codes", "vectors")
    sent = sent.unionByName(queries.select(of(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("long").alias("g"), F.lit(1).alias("kind"), "query_id", "embedding"), allowMissingColumns=True)
    dealt = sent.repartition(shards * groups, "shard", "g").sortWithinPartitions("shard", "g", "kind")

    def look(batches):
        at, parts, index = None, [], None
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            shard, g, what = (col[c].to_numpy() for c in ("shard", "g", "kind"))
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (g[1:] != g[:-1]) | (what[1:] != what[:-1]), True]) if len(shard) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if (shard[i], g[i]) != at:
                    at, parts, index = (shard[i], g[i]), [], None
                if what[i] == 0:
                    parts += zip(*(col[c].slice(i, j - i).to_pylist() for c in ("cids", "codes", "vectors")), strict=True)
                    continue
                if index is None and parts:
                    cids, codes, vecs = (b"".join(p) for p in zip(*parts, strict=True))
                    cids = np.frombuffer(cids, "<i8")
                    index, parts = (cids, np.frombuffer(codes, np.uint8).reshape(len(cids), -1), np.frombuffer(vecs, kind).reshape(len(cids), -1)), []
                if index is None:
                    continue  # a shard without vectors
                cids, codes, vecs = index
                ids, q = col["query_id"].slice(i, j - i).to_numpy(), matrix(col["embedding"].slice(i, j - i))
                for a in range(0, len(ids), QUERIES):
                    out = []
                    for b, places in enumerate(best_codes(q[a : a + QUERIES], codes, books.value, rerank), a):
                        score = (vecs[places].astype(np.float64) * q[b]).sum(1)
                        top = np.lexsort((cids[places], -score))[: k + 1]
                        out.append((np.full(len(top), ids[b]), cids[places[top]], score[top]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "cid", "score"])

    near = dealt.select("shard", "g", "kind", "query_id", "embedding", "cids", "codes", "vectors").mapInArrow(look, "query_id long, cid long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
    near = cut(near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at"))
    release(index, queries)
    wanted = cut(near.groupBy("cid").agg(F.count("*").alias("n")).join(members.select("cid", "ids"), "cid"))
    rows = join_hot(near, wanted, "cid", "n", near.count()).select("query_id", F.explode("ids").alias("id"), "score").where("id.vec_id <> query_id")
    rows = rows.select("query_id", F.col("id.vec_id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.col("id.rows"))))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
