"""Epsilon grid order join: all pairs of vectors whose cosine reaches a threshold.

Unit vectors of cosine c are sqrt(2 - 2c) apart, which is epsilon. Vectors are sorted by the cells of a grid of that width on
their leading principal axes; the sequence is cut into blocks. Pairs of intervals of the sequence are joined recursively, from
the whole down to blocks and on within them, and left out once their boxes are more than epsilon apart. Boxes have more axes than the
grid and the length of what the axes leave over as one more, which keeps their distance a lower bound. What is left of two small
intervals is compared in double precision.

Blocks are an eighth of the vectors, or what fits a task's memory if that is less, so each is sent to nine tasks at most until there
are more than eight of that size; then to as many as it has blocks in reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, cut, join_hot, release, small_batches
from quarry.llm.vectors import by_length, classes, matrix, parted, unit

#: Axes of the grid and of boxes, vectors of the smallest interval, and intervals that one is divided into at a step.
AXES, BOX_AXES, LEAF, FAN_BITS = 6, 16, 512, 3
#: Blocks of the whole sequence, at least, and bytes of a block, at most.
BLOCKS, BLOCK_BYTES = 8, 32 << 20
_NEAR = 1e-12  # cosines as close to the threshold are computed once more, as one plain sum


def principal_axes(distinct: DataFrame, axes: int = AXES) -> np.ndarray:
    """Leading eigenvectors (columns) of the covariance of all unit vectors, summed over the cluster."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column(0)))
                part = np.concatenate([[len(u)], u.sum(0), (u.T @ u).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    got = dict(distinct.select("embedding").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect())
    if not got:
        return np.empty((0, 0))
    v = np.array([got[i] for i in range(len(got))])
    d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
    n, mean = v[0], v[1 : d + 1] / v[0]
    _, vectors = np.linalg.eigh(v[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    return vectors[:, ::-1][:, :axes]


def places(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors by axes, and the length of what these leave over. No two are farther apart here than they are."""
    p = u @ axes
    return np.concatenate([p, np.sqrt(np.maximum(1 - (p * p).sum(1, keepdims=True), 0))], 1)


def _blocks(distinct: DataFrame, axes: np.ndarray, epsilon: float, parts: int, block: int, kind: str) -> DataFrame:
    """(pid, seq, n, cids, counts, vecs, lo, hi): blocks of the sequence with their boxes. kind: the vectors' type in bytes."""
    m = min(AXES, axes.shape[1])

    def cells(batches):
        for b in batches:
            p = unit(matrix(b.column(b.schema.get_field_index("embedding")))) @ axes if b.num_rows else np.empty((0, axes.shape[1]))
            # cells are centred on 0, where most of what an axis has is; within a cell, halves of it on all axes go on sorting
            g = np.concatenate([np.floor(p[:, :m] / epsilon + 0.5), np.floor(p * 2 / epsilon + 0.5)], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(g[:, i]) for i in range(len(names)))], names=[*b.schema.names, *names])

    names = [*(f"g{i}" for i in range(m)), *(f"h{i}" for i in range(axes.shape[1]))]
    gridded = distinct.mapInArrow(cells, f"cid long, n long, embedding {distinct.select('embedding').dtypes[0][1]}, " + ", ".join(f"{g} int" for g in names))
    # the hash parts the vectors of one crowded cell
    order = [*names, F.xxhash64("cid")]
    dealt = gridded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("pid"), "cid", "n", "embedding")

    def cut_up(batches):
        held, size, seq = [], 0, 0

        def flush(rows):
            t = pa.Table.from_batches(rows).combine_chunks()
            x = matrix(t.column("embedding").chunk(0))
            p = places(unit(x), axes)
            one = lambda v, k: pa.array([v], k)
            return pa.RecordBatch.from_arrays([one(t.column("pid")[0].as_py(), pa.int64()), one(seq, pa.int64()), one(t.column("cid").to_numpy().astype("<i8").tobytes(), pa.binary()), one(t.column("n").to_numpy().astype("<i8").tobytes(), pa.binary()), one(x.astype(kind).tobytes(), pa.binary()), one(p.min(0), pa.list_(pa.float64())), one(p.max(0), pa.list_(pa.float64()))], names=["pid", "seq", "cids", "counts", "vecs", "lo", "hi"])

        for b in batches:
            while b.num_rows:
                take = b.slice(0, block - size)
                held.append(take)
                size += take.num_rows
                b = b.slice(take.num_rows)
                if size == block:
                    yield flush(held)
                    held, size, seq = [], 0, seq + 1
        if size:
            yield flush(held)

    return cut(dealt.mapInArrow(cut_up, "pid long, seq long, cids binary, counts binary, vecs binary, lo array<double>, hi array<double>"))


def _interval_pairs(boxes: DataFrame, m: int, epsilon: float, bits: int) -> DataFrame:
    """Pairs i <= j of blocks whose boxes are within epsilon, found from the whole sequence downwards. boxes: (i, lo*, hi*)."""
    spark = boxes.sparkSession
    levels = -(-bits // FAN_BITS)
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    fan = F.sequence(F.lit(0), F.lit((1 << FAN_BITS) - 1))
    apart = " + ".join(f"pow(greatest(0D, a_lo{k} - b_hi{k}, b_lo{k} - a_hi{k}), 2)" for k in range(m)) or "0D"
    for level in range(levels - 1, -1, -1):
        own = boxes.groupBy(F.shiftright("i", level * FAN_BITS).alias("i")).agg(*(F.min(f"lo{k}").alias(f"lo{k}") for k in range(m)), *(F.max(f"hi{k}").alias(f"hi{k}") for k in range(m)))
        side = lambda p, key: own.select(F.col("i").alias(key), *(F.col(f"{s}{k}").alias(f"{p}_{s}{k}") for s in ("lo", "hi") for k in range(m)))  # noqa: B023, E731
        below = pairs.withColumn("x", F.explode(fan)).select(F.shiftleft("i", FAN_BITS).alias("p"), "j", "x").select((F.col("p") + F.col("x")).alias("i"), "j")
        below = below.join(side("a", "i"), "i").withColumn("y", F.explode(fan)).withColumn("j", F.shiftleft("j", FAN_BITS) + F.col("y")).where("i <= j")
        pairs = cut(below.join(side("b", "j"), "j").where(F.expr(apart) <= epsilon * epsilon * (1 + 1e-9)).select("i", "j"))
    return pairs


def _compare(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    c = x @ y.T
    hit = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < _NEAR), strict=True):
        a, b = x[i], y[j]
        hit[i, j] = sum((a * b).tolist()) / (sum((a * a).tolist()) * sum((b * b).tolist())) ** 0.5 >= cosine
    return hit


def join_blocks(x, y, px, py, cosine: float, epsilon: float, same: bool, leaf: int, found) -> tuple[int, int]:
    """Recursive join of two intervals, x and y being unit vectors and px and py their places(); found(row, column, hits) gets each
    compared pair of small ones that has hits. Returns the pairs of small intervals compared, and of vectors."""
    todo, pairs, compared = [(0, len(x), 0, len(y))], 0, 0
    while todo:
        a, b, c, d = todo.pop()
        if same and c + d < a + b:
            continue  # the mirror image is joined
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > epsilon * epsilon * (1 + 1e-9):
            continue
        if b - a <= leaf and d - c <= leaf:
            pairs, compared = pairs + 1, compared + (b - a) * (d - c)
            hit = _compare(x[a:b], y[c:d], cosine)
            if same and a == c:
                hit &= ~np.tri(b - a, d - c, dtype=bool)
            if hit.any():
                found(a, c, hit)
            continue
        cuts_x, cuts_y = ([(p, (p + q) // 2), ((p + q) // 2, q)] if q - p > leaf else [(p, q)] for p, q in ((a, b), (c, d)))
        todo += [(*i, *j) for i in cuts_x for j in cuts_y]
    return pairs, compared


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _stars(hit: np.ndarray) -> list[tuple[int, tuple[str, int]]]:
    """Pairs that connect what the hits connect: rows with the least row of their component, and columns with it."""
    rows, cols = hit.shape
    label = np.where(hit.any(1), np.arange(rows), rows)
    while True:
        of_col = np.where(hit, label[:, None], rows).min(0)
        new = np.minimum(label, np.where(hit, of_col[None, :], rows).min(1))
        if (new == label).all():
            break
        label = new
    return [(r, ("r", int(k))) for r, k in enumerate(label) if k < r] + [(int(k), ("c", c)) for c, k in enumerate(of_col) if k < rows]


def link(vectors: DataFrame, *, cosine: float = 0.9, axes: int = BOX_AXES, block: int | None = None, leaf: int = LEAF, report: list | None = None) -> DataFrame:
    """vectors: vec_id, embedding (array of float or double). Returns a row for each input row: vec_id, n_links (other vectors of
    cosine >= the threshold), component_id (the smallest vec_id reachable by links, itself included), kept (whether it is that).

    Vectors that are null, empty, zero, or hold null or non-finite components have no links and are their own component.
    Vectors of different lengths have no cosine: those of each length are joined among themselves. Equal vectors are one class
    in the join and count each for themselves; repeated vec_ids each have their row. An empty table gives an empty result; other
    columns are not read. Every pair within reach is compared. Moved are blocks of bounded size; only sums over axes and intervals
    come to the driver. block: vectors of a block. report, a list, gets a tuple of each length: vectors, blocks, pairs of
    blocks in reach, pairs of small intervals compared, and vector pairs compared."""
    spark = vectors.sparkSession
    small_batches(spark)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good, others = parted(every)
    out = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for part in by_length(good):
        out = _link(part, cosine, axes, block, leaf, report).unionByName(out)
    return out


def _link(good: DataFrame, cosine: float, axes: int, block: int | None, leaf: int, report: list | None) -> DataFrame:
    """link() of vectors that all take part and are of one length, one at least."""
    spark = good.sparkSession
    distinct = cut(classes(good))
    n, rows, d = distinct.agg(F.count("*"), F.sum("n"), F.first(F.size("embedding"))).first()
    kind = "<f4" if dict(good.dtypes)["embedding"] == "array<float>" else "<f8"
    block = block or max(LEAF, min(-(-n // BLOCKS), BLOCK_BYTES // (int(kind[2]) * d)))
    epsilon = float(np.sqrt(2 - 2 * cosine))
    base = principal_axes(distinct, axes)
    # ranges are of about equal size; one that is somewhat larger is still one block
    blocks = _blocks(distinct, base, epsilon, max(1, -(-n // block)), block + block // 2, kind)
    top = blocks.agg(F.max("pid"), F.max("seq")).first()
    shift = int(top[1]).bit_length()
    blocks = blocks.withColumn("i", F.shiftleft("pid", shift) + F.col("seq"))
    m = base.shape[1] + 1
    boxes = cut(blocks.select("i", *(F.col("lo")[k].alias(f"lo{k}") for k in range(m)), *(F.col("hi")[k].alias(f"hi{k}") for k in range(m))))
    pairs = _interval_pairs(boxes, m, epsilon, max(1, int(top[0]).bit_length() + shift))

    def pair(x_row, y_row):
        same = y_row is None
        (cx, nx, vx), (cy, ny, vy) = ((np.frombuffer(r["cids"], "<i8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["vecs"], kind)) for r in (x_row, x_row if same else y_row))
        x, y = unit(vx.reshape(len(cx), -1).astype(np.float64)), unit(vy.reshape(len(cy), -1).astype(np.float64))
        sx, sy, forest = np.zeros(len(cx), np.int64), np.zeros(len(cy), np.int64), _Forest(len(cx) + (0 if same else len(cy)))
        off = 0 if same else len(cx)

        def found(a, c, hit):
            sx[a : a + hit.shape[0]] += hit @ ny[c : c + hit.shape[1]]
            sy[c : c + hit.shape[1]] += nx[a : a + hit.shape[0]] @ hit
            for row, (what, k) in _stars(hit):
                forest.join(a + row, a + k if what == "r" else off + c + k)

        compared = join_blocks(x, y, places(x, base), places(y, base), cosine, epsilon, same, leaf, found)
        ids = cx if same else np.concatenate([cx, cy])
        sums = sx + sy if same else np.concatenate([sx, sy])
        at = np.flatnonzero(sums)
        roots = ids[[forest.root(k) for k in at.tolist()]] if len(at) else ids[:0]
        return [*zip(ids[at].tolist(), roots.tolist(), sums[at].tolist(), strict=True), (None, *compared)]

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["alone"]:
                    out += pair(r, None)
                elif held is None:
                    held = r
                else:
                    out += pair(held, r)
                    held = None
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    # a block goes once to each of its pairs: both of a pair meet in one task, next to each other
    ends = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("k"))
    work = ends.join(blocks.select(F.col("i").alias("k"), "cids", "counts", "vecs"), "k").repartition("i", "j").sortWithinPartitions("i", "j", "k")
    work = work.select((F.col("i") == F.col("j")).alias("alone"), "cids", "counts", "vecs")
    found = cut(work.mapInArrow(run, "a long, b long, n long"))
    if report is not None:
        done = found.where("a is null").agg(F.sum("b"), F.sum("n")).first()
        report.append((n, blocks.count(), pairs.count(), done[0], done[1]))
    found = found.where("a is not null")
    sums = found.groupBy("a").agg(F.sum("n").alias("linked"))
    roots = components(found.select("a", "b"))
    labelled = distinct.join(sums, distinct["cid"] == sums["a"], "left").join(roots, F.col("cid") == F.col("node"), "left")
    labelled = cut(labelled.select("embedding", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id")))
    release(blocks, boxes, pairs, found, roots, distinct)
    return join_hot(good, labelled, "embedding", "n", rows).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
