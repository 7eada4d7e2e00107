"""Centroid clustering of integer vectors by Lloyd's rounds with Yinyang bounds; exact.

The centroids are put into groups once. A vector keeps an upper bound of the distance to its centroid and one lower bound a group, of the
distances to the group's other centroids; both follow the centroids' moves. A vector whose upper bound is below all lower ones
stays where it is (global filter), else the groups with a lower bound above it are passed over (group filter), and in the others the
centroids whose own move cannot have brought them near (local filter). What is left is scanned exactly. Bounds are rounded outwards,
and ties are always scanned, so clusters are those of the plain rounds.

The vectors stay in their partitions with their bounds, written once a round to the shared folder. What moves is a row a
cluster and task: the sums of the vectors that changed clusters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, release, small_batches

#: Centroids of a group, about, and the most groups.
GROUP, MOST_GROUPS = 3, 64
_OUT, _IN = 1 + 1e-9, 1 - 1e-9
_STATE = "vec_id long, q array<int>, cluster int, was int, upper double, lower array<double>, distance long, scanned long"


def most(bits: int, d: int) -> int:
    """The largest magnitude of d components whose squared distances stay within so many bits."""
    return int(np.sqrt((1 << bits) / d) / 2)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, exact."""
    # doubles hold integers of 53 bits
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= most(53, x.shape[-1]) else np.int64
    d = x.astype(kind) - c.astype(kind)
    return np.einsum("...i,...i->...", d, d).astype(np.int64)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Each centroid's group: a few plain rounds over the centroids, on the driver. Groups that end empty are left out."""
    c = centroids.astype(float)
    middles = c[:groups].copy()
    for _ in range(rounds):
        own = ((c[:, None] - middles[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                middles[g] = c[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def _assign(x: np.ndarray, c: np.ndarray, group: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> int:
    """Brings a batch up to the centroids, which moved by as much since; returns the number of distances computed."""
    t, scanned = lower.shape[1], 0
    upper += moved[cluster]
    old = lower.copy()
    lower -= np.array([moved[group == g].max() for g in range(t)])
    rows = np.flatnonzero(upper >= lower.min(1))
    # the bound is made tight before it is compared again
    own = squared(x[rows], c[cluster[rows]])
    scanned += len(rows)
    upper[rows] = np.sqrt(own) * _OUT
    still = upper[rows] >= lower[rows].min(1)
    rows, own = rows[still], own[still]
    if not len(rows):
        return scanned
    at = np.arange(len(rows))
    exact = np.full((len(rows), len(c)), np.iinfo(np.int64).max)
    exact[at, cluster[rows]] = own
    # distances known so far, from below: exact ones, else the group's old bound less the centroid's own move
    below = old[rows][:, group] - moved
    below[at, cluster[rows]] = np.sqrt(own) * _IN
    for g in range(t):
        near = lower[rows, g] <= upper[rows]
        for k in np.flatnonzero(group == g):
            scan = np.flatnonzero(near & (cluster[rows] != k) & (below[:, k] <= upper[rows]))
            if len(scan):
                exact[scan, k] = squared(x[rows[scan]], c[k])
                below[scan, k] = np.sqrt(exact[scan, k]) * _IN
                scanned += len(scan)
    best = exact.argmin(1)  # the first, so the smaller number, of equal ones
    upper[rows] = np.sqrt(exact[at, best]) * _OUT
    below[at, best] = np.inf
    lower[rows] = np.stack([below[:, group == g].min(1) for g in range(t)], 1)
    cluster[rows] = best
    return scanned


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).reshape(-1)))


def _round(rows: DataFrame, c: np.ndarray, group: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """One round of assignments; moved is None where vectors have no bounds yet. The last one has the exact distances."""
    d, t = c.shape[1], int(group.max()) + 1
    limit = most(62, d)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            if np.abs(x.astype(np.int64)).max() > limit:
                raise ValueError(f"components beyond {limit} have distances that a long may not hold")
            if moved is None:
                # all distances, as no bound is known
                exact = np.stack([squared(x, k) for k in c], 1)
                was, cluster = np.full(n, -1, np.int32), exact.argmin(1).astype(np.int64)
                upper = np.sqrt(exact[np.arange(n), cluster]) * _OUT
                below = np.sqrt(exact) * _IN
                below[np.arange(n), cluster] = np.inf
                lower, scanned = np.stack([below[:, group == g].min(1) for g in range(t)], 1), n * len(c)
            else:
                was = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
                cluster = was.astype(np.int64)
                upper = batch.column(3).to_numpy(zero_copy_only=False).copy()
                lower = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, t).copy()
                scanned = _assign(x, c, group, cluster, upper, lower, moved)
            distance = pa.array(squared(x, c[cluster])) if last else pa.nulls(n, pa.int64())
            counts = np.zeros(n, np.int64)
            counts[0] = scanned
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(x.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(was), pa.array(upper), _lists(lower), distance, pa.array(counts)],
                names=[f.split()[0] for f in _STATE.split(", ")],
            )

    read = ["vec_id", "q"] if moved is None else ["vec_id", "q", "cluster", "upper", "lower"]
    return rows.select(*read).mapInArrow(run, _STATE)


def _moves(state: DataFrame, k: int, dims: int) -> DataFrame:
    """(c, i, s): by how much the round changed cluster c's sum of component i, and at i = -1 its number of vectors. Only vectors that changed
    clusters are read into it; tasks sum theirs first."""

    def run(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            x = np.ones((n, dims + 1), np.int64)
            x[:, 1:] = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            for column, sign in ((0, 1), (1, -1)):
                own = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(own[own >= 0]):
                    total[c] += sign * x[own == c].sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // (dims + 1)).astype(np.int32)), pa.array((at % (dims + 1) - 1).astype(np.int32)), pa.array(total.reshape(-1)[at])], names=["c", "i", "s"])

    moved = state.where("cluster <> was").select("cluster", "was", "q").mapInArrow(run, "c int, i int, s long")
    return moved.groupBy("c", "i").agg(F.sum("s").alias("s"))


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) of the vectors with exactly `dims` components, none null or non-finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("d"))
    good = rows.where(F.coalesce(F.expr(f"size(d) = {int(dims)} and forall(d, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"), F.lit(False)))
    return good.select("vec_id", F.transform("d", lambda x: F.floor(x * scale)).alias("q"))


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", groups: int | None = None, report: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of the vectors that take part, and the final centroids, after `rounds` rounds of assigning vectors to the
    nearest centroid and moving centroids to the floor of their means, and one more assignment.

    Vectors of exactly `dims` components, none null or non-finite, take part, as integers floor(scale * x); others have no row. Centroids
    start as the k vectors of the smallest SHA-256 of "seed:vec_id"; of equal vec_ids the smaller vector comes first, a null
    vec_id is written null; fewer vectors make fewer centroids. Equal distances go to the smaller number; empty centroids stay. Repeated rows are
    clustered each for itself; an empty table gives an empty result; other columns are not read. Components beyond
    most(62, dims), 134,217,728 for 64 of them, raise ValueError: a long could not hold their distances.

    report gets (round, distances computed, distances of the plain method, vectors that changed) a round. To the driver come k rows a round."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = quantised(vectors, dims, scale)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = [r["q"] for r in rows.select(named.alias("h"), "q").orderBy("h", "q").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = np.array(first, np.int64)
    k = len(centroids)
    group = grouped(centroids, min(MOST_GROUPS, max(1, -(-k // GROUP))) if groups is None else min(groups, k))
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    state, moved = rows, None
    for i in range(rounds + 1):
        last = i == rounds or (moved is not None and not moved.any())
        new = cut(_round(state, centroids, group, moved, last))
        if i:
            release(state)
        state = new
        if report is not None:
            report.append((i, *(state.agg(F.sum("scanned"), F.count("*") * k, F.sum((F.col("cluster") != F.col("was")).cast("long"))).first())))
        if last:
            break
        for r in _moves(state, k, dims).collect():
            if r["i"] < 0:
                counts[r["c"]] += r["s"]
            else:
                sums[r["c"]][r["i"]] += r["s"]
        target = np.array([[s // counts[j] for s in sums[j]] if counts[j] else centroids[j].tolist() for j in range(k)], np.int64)
        moved = np.sqrt(squared(target, centroids)) * _OUT
        centroids = target
    out = state.select("vec_id", "cluster", "distance")
    return out, centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to cluster()'s rows: sums of distances over the cluster and over all, and the hash of
    the centroid's components as decimals joined by commas. Sums are a row a cluster."""
    spark = assigned.sparkSession
    if not centroids:
        return assigned.selectExpr("*", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    own = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(own.values())
    facts = [(c, own.get(c, 0), total, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for c, m in enumerate(centroids)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
