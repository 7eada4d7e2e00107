"""N-gram Jaccard join by T-occurrence search, for components of near-identical texts.

Two sets of sizes a and b reach Jaccard p/100 if they share at least T = ceil(p (a + b) / (100 + p)) elements. DivideSkip divides
a query's inverted lists: the longest are only probed, the others, the short ones, are merged, and what turns up in them often
enough is probed for. Over a cluster:

1. A pass over the texts counts shingles into a table of slots, in number by the texts' bytes up to a bound; it orders shingles from
   rare to frequent.
2. Equal sets are one from here on. Each puts its rarest elements, size - ceil(p size / 100) + SHORT of them, into inverted lists:
   the short lists. Sets that reach Jaccard p/100 share SHORT of them at least (or T, if that is less).
3. Each list's members meet its pivot, the set in whose order the element comes first, so the one with the fewest rarer elements
   of its own, if sizes and positions leave T in reach. Of the pivots that it meets, a set goes on with the one that it meets most often.
4. Components of the links found settle most lists: those whose members are all in one component are done. The others are merged:
   tiles of bounded size of the lists are dealt to tasks, each task merges the lists of each query set in it and counts
   occurrences; sums over the tasks are the occurrences in all short lists, as sets of two components meet in none that is done.
   Sets that occur SHORT times (or T) go on. That is exact, and no list is capped.
5. Candidates of both kinds are probed: elements of the smaller set are sought in the larger by binary search, ending as soon as T
   is reached or out of reach. A query set travels once to each group of its candidates.

Each set has a parity sketch: a bit for each residue of its elements' hashes, set if their number is odd. Two sketches differ in at
most as many bits as the sets in elements, so pairs whose sketches differ too much for T are left out before texts are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common
from quarry.llm.common import components, cut, join_hot, pick, release, small_batches

#: log2 of the least and most slots that shingles are counted in, a byte each where they are broadcast (16 MB at most); words of texts
#: that a slot is there for, and bytes of a word, about; slots whose counts travel as a row.
SLOT_BITS, WORDS_A_SLOT, WORD_BYTES, BLOCK = (16, 24), 64, 6, 1 << 14
#: log2 of the bits of the filter of elements that several lists hold: broadcast, 4 MB at most.
FILTER_BITS = 25
#: Long words of a parity sketch.
SKETCH = 8
#: Elements that must turn up in short lists; members of a tile's side; candidates that a query's text is sent with, about.
SHORT, TILE, GROUP = 2, 1024, 256
#: Pairs of members that a task counts at a time, and members of lists of a task, about.
PAIRS, TASK = 1 << 21, 50_000
#: Members of a list that meet in one task at most. Of longer lists there are at most a millionth of all members: a broadcast of 32 MB at 10^12.
LIST = 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if there are fewer words; empty if none.
    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case (what bytes.lower and bytes.split do)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    s = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        s = (s ^ (s >> np.uint64(31))) * _M1 + h[i : i + n] * _M2
    s = (s ^ (s >> np.uint64(29))) * _M3
    return np.unique(s ^ (s >> np.uint64(32)))


def least_overlap(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sorted sets' Jaccard is at least percent/100, by binary probes of the smaller set's elements in the larger, in
    blocks, until that is settled."""
    if len(a) > len(b):
        a, b = b, a
    need, got = least_overlap(len(a), len(b), percent), 0
    if need > len(a):
        return False
    for i in range(0, len(a), 256):
        x = a[i : i + 256]
        at = np.searchsorted(b, x)
        at[at == len(b)] = 0
        got += int((b[at] == x).sum())
        if got >= need:
            return True
        if got + len(a) - i - len(x) < need:
            return False
    return got >= need


def slot_bits(size: int) -> int:
    """log2 of the slots for texts of that many bytes: slots grow with them, so that what is rare stands out alike at each size."""
    return min(max(SLOT_BITS[0], (size // (WORDS_A_SLOT * WORD_BYTES)).bit_length()), SLOT_BITS[1])


def _count_slots(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """How often shingles fall into each slot, as eighths of a power of two. Counts are added up by blocks of slots."""
    size = min(BLOCK, 1 << bits)

    def run(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, (shingles(x, k) >> np.uint64(64 - bits)).astype(np.int64), 1)
        for i, part in enumerate(total.reshape(-1, size)):
            if part.any():
                # small counts, which most are, in a byte
                width = "<u1" if part.max() < 256 else "<u4"
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype(width).tobytes()], pa.binary())], names=["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in rows:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, "<u4" if len(x) > size else "<u1")
        low = np.minimum(np.round(8 * np.log2(1 + total)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([low.tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros((1 << bits) // size * size, np.uint8)
    for r in docs.select("text").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.uint8)
    return out


def _sets(docs: DataFrame, k: int, percent: int, counts, bits: int) -> DataFrame:
    """docs with rid, sid, n, prefix and sketch: rid numbers the rows; sid is the set's id (a 128-bit hash of its elements; null if
    it is empty), then its size, rarest elements and parities."""

    def run(batches):
        order = counts.value
        for batch in batches:
            sid, size, prefix, odd = [], [], [], []
            for x in batch.column(batch.schema.get_field_index("text")).to_pylist():
                s = shingles(x, k)
                n = len(s)
                size.append(n)
                sid.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                odd.append(np.packbits((np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(bool)).view(np.int64))
                first = n + percent * n // -100 + SHORT
                rank = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
                prefix.append(s[np.lexsort((s, rank))[:first]].view(np.int64) if n else s.view(np.int64))
            lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)], dtype=np.int32)), pa.array(np.concatenate([*xs, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sid, pa.binary()), pa.array(size, pa.int32()), lists(prefix), lists(odd)], names=[*kept, "sid", "n", "prefix", "sketch"])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), *docs.columns)
    kept = numbered.columns
    longs = T.ArrayType(T.LongType())
    new = [T.StructField("sid", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", longs), T.StructField("sketch", longs)]
    return numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, *new]))


def _in_reach(n: str, i: str, m: str, j: str, percent: int) -> str:
    """SQL: sets of sizes n and m that share no element before positions i and j, and that one, can share T elements."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and (100 + {percent}) * least({n} - {i}, {m} - {j}) >= {percent} * ({n} + {m})"


def _alike(n: str, x: str, m: str, y: str, percent: int) -> str:
    """SQL: the sketches x and y differ in no more bits than sets of sizes n and m may in elements, if they share T."""
    bits = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(SKETCH))
    return f"(100 + {percent}) * ({bits}) <= (100 - {percent}) * ({n} + {m})"


def _verify(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among pairs (q, x) of query and candidate, distinct. Texts travel, as they are smaller than sets of hashes, and only those
    of candidates; a query's goes once to each group of its candidates."""
    wanted = pairs.select(F.explode(F.array("q", "x")).alias("rid")).distinct()
    texts = cut(pick(sets.select("rid", "text"), wanted), compression="zstd")
    degrees = cut(pairs.groupBy("q").agg(F.count("*").alias("rows")).withColumn("groups", F.ceil(F.col("rows") / GROUP).cast("int")))
    asked = degrees.join(texts.withColumnRenamed("rid", "q"), "q").select("q", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("long").alias("x"), "text")
    # written first: as a table of known size it is broadcast where it is small, and the texts stay where they are
    dealt = cut(join_hot(pairs, degrees, "q", "rows", pairs.count()).select("q", F.pmod(F.xxhash64("x"), F.col("groups")).cast("int").alias("g"), F.col("x").alias("rid")))
    given = dealt.join(texts, "rid").select("q", "g", F.col("rid").alias("x"), "text")

    def run(batches):
        query = None
        for batch in batches:
            q, x, t = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("q", "x", "text"))
            keep = []
            for i in range(len(q)):
                if x[i] is None:  # nulls come first: the query itself
                    query = shingles(t[i], k)
                elif reaches(query, shingles(t[i], k), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([q[i] for i in keep], pa.int64()), pa.array([x[i] for i in keep], pa.int64())], names=["a", "b"])

    met = given.unionByName(asked).repartition("q", "g").sortWithinPartitions("q", "g", F.col("x").asc_nulls_first())
    links = cut(met.select("q", "x", "text").mapInArrow(run, "a long, b long"))
    release(texts, degrees, dealt)
    return links


def merge_lists(tile, asks, meets, node, n, pos, root, percent: int):
    """Arrays of list members: the tile, whether they ask and are met there, the set, its size, the element's place in it and the set's
    component. Yields (a, b, occ, n, m): sets a < b of different components, how often one asks where the other is met,
    and their sizes. The lists of each set are merged by sorting, some PAIRS of members at a time.

    The i-th element that two sets share leaves them T - i + 1 to share from there on, at least; what leaves fewer than that for
    i = SHORT is not counted."""
    order = np.lexsort((meets & ~asks, tile))
    tile, asks, meets, node, n, pos, root = (c[order] for c in (tile, asks, meets, node, n, pos, root))
    rows = np.arange(len(tile))
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else rows
    sizes = np.diff(np.r_[starts, len(tile)])
    # in a tile those that only ask come first; others ask of those after them
    met_from = starts + np.add.reduceat((asks & ~meets).astype(np.int64), starts) if len(tile) else rows
    low = np.maximum(rows + 1, np.repeat(met_from, sizes))
    count = np.where(asks, np.maximum(np.repeat(starts + sizes, sizes) - low, 0), 0)
    ids, local = np.unique(node, return_inverse=True)
    size_of = np.zeros(len(ids), np.int64)
    size_of[local] = n
    total, first = np.r_[0, np.cumsum(count)], 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, "right")) - 1)
        i = np.repeat(rows[first:last], count[first:last])
        j = np.repeat(low[first:last] - total[first:last], count[first:last]) + np.arange(total[first], total[last])
        first = last
        least, both, left = np.minimum(n[i], n[j]), n[i] + n[j], np.minimum(n[i] - pos[i], n[j] - pos[j])
        ok = (root[i] != root[j]) & (100 * least >= percent * (both - least)) & ((100 + percent) * (left + SHORT - 1) >= percent * both)
        x, y = local[i[ok]], local[j[ok]]
        pair, occ = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y), return_counts=True)
        a, b = np.divmod(pair, max(len(ids), 1))
        if len(pair):
            yield ids[a], ids[b], occ, size_of[a], size_of[b]


def _occurrences(held: DataFrame, percent: int) -> DataFrame:
    """(a, b, occ, n, m): pairs of sets of different components, in how many lists they meet, and their sizes, if T is in
    reach. held: (token, node, n, pos, root, c), lists of sets of several components and their numbers of rows, cut().

    A list is cut into parts of TILE members, and a tile is a pair of parts, one that asks, one that is met."""
    rows = held.count()
    own = held.withColumn("parts", F.ceil(F.col("c") / TILE).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # part i asks in tiles (i, j) with j >= i, and is met in tiles (j, i) with j <= i
    tiles = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j")).select("token", F.least("i", "j").alias("t"), F.greatest("i", "j").alias("u"), (F.col("i") <= F.col("j")).alias("asks"), (F.col("j") <= F.col("i")).alias("meets"), "node", "n", "pos", "root")
    tiles = tiles.select(F.xxhash64("token", "t", "u").alias("tile"), "token", "t", "u", "asks", "meets", "node", "n", "pos", "root")

    def out(group):
        for cols in merge_lists(*(np.concatenate(c) for c in zip(*group, strict=True)), percent):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["a", "b", "occ", "n", "m"])

    def run(batches):
        group, size, last = [], 0, None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            tile, new = rows[0], 0
            if size > 64 * TILE:
                # a group ends with a tile
                new = int(np.argmax(tile != last)) if (tile != last).any() else len(tile)
                group.append([c[:new] for c in rows])
                if new < len(tile):
                    yield from out(group)
                    group, size = [], 0
            if new < len(tile):
                group.append([c[new:] for c in rows])
                size, last = size + len(tile) - new, tile[-1]
        if group:
            yield from out(group)

    # merging takes time where the rows are few bytes: tasks by their number
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK))
    dealt = tiles.repartition(parts, "token", "t", "u").sortWithinPartitions("tile")
    found = dealt.select("tile", "asks", "meets", "node", "n", "pos", "root").mapInArrow(run, "a long, b long, occ long, n long, m long")
    return found.groupBy("a", "b").agg(F.sum("occ").alias("occ"), F.min("n").alias("n"), F.min("m").alias("m"))


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, x) whose sketches leave T in reach."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_s"))
    degrees = cut(pairs.groupBy("q").agg(F.count("*").alias("rows")).join(side("q"), "q"))
    out = cut(join_hot(pairs.join(side("x"), "x"), degrees, "q", "rows", pairs.count()).where(_alike("q_n", "q_s", "x_n", "x_s", percent)).select("q", "x"))
    release(degrees)
    return out


def join(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id long, text. Returns a row for each input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links of Jaccard >= percent/100, itself included).

    Null or empty texts, and those without words, have no shingles and are linked with nothing. Repeated rows and equal
    texts are one set, so they are linked. A null doc_id links as any other and is no component_id unless all of the component are
    null; rows that share a doc_id but not the text are told apart. Very long texts are taken whole. An empty table gives an empty
    result; other columns are not read. Sets are told apart by 128-bit hashes of their shingles' 64-bit hashes."""
    rows, sets = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    release(sets)
    least = cut(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    out = join_hot(rows.select("doc_id", "n", "root"), least, "root", "rows", rows.count()).select("doc_id", "n", "least")
    out = out.unionByName(rows.where("root is null").select("doc_id", "n", F.col("doc_id").alias("least")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text and any others), one of each component that join() finds: the one of the smallest doc_id,
    null being the largest, and of the smallest hash of the text among equals. Rows without shingles are nobody's copies: all stay."""
    others = [c for c in docs.columns if c != "text"]
    rows, sets = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(docs[c] for c in others)).alias("row")), k, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "rid"))
    kept = rows.where("root is not null").groupBy("root").agg(first.alias("first")).select("first.rid")
    kept = kept.unionByName(rows.where("root is null").select("rid"))
    return pick(sets, kept).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def _rooted(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((rid, doc_id, n, h, root), sets): a row for each row of docs (doc_id long, text, and a row struct or nothing), n shingles, a hash of the text and the
    component that it is in, null if it has no shingles; and the table of _sets(). Both are cut()."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = slot_bits(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    counts = spark.sparkContext.broadcast(_count_slots(docs, k, bits))
    sets = cut(_sets(docs, k, percent, counts, bits), compression="zstd")
    firsts = cut(sets.where("sid is not null").groupBy("sid").agg(F.min("rid").alias("node"), F.count("*").alias("rows")))
    reps = pick(sets.select("rid", "n", "prefix", "sketch"), firsts.select(F.col("node").alias("rid"))).withColumnRenamed("rid", "node")
    sketches = reps.select("node", "n", "sketch")
    lists = reps.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    total = reps.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    # most elements are in one list alone: counts are of elements only, and a filter of fixed size drops those before lists move
    shared = cut(lists.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    # by low bits: the high ones decide what is rare, so the rarest elements crowd in few values of them
    slot = F.col("token").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("slot")
    lists = pick(lists.select("*", slot), shared.select(slot), "slot").drop("slot")
    # the pivot: first by place, then by size. Long lists stay where they are, the others meet by element, once
    lists = lists.withColumn("place", F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n"))
    hot = cut(shared.where(F.col("c") > min(max(total // common.MOST_HOT, common.LEAST_HOT), LIST)).select("token"))
    w = Window.partitionBy("token").orderBy("place", "node")
    cold = lists.join(F.broadcast(hot), "token", "left_anti").select("*", F.first("node").over(w).alias("pivot"), F.first("place").over(w).alias("first"), F.count("*").over(Window.partitionBy("token")).alias("c")).where("c > 1")
    long = lists.join(F.broadcast(hot), "token")
    heads = long.groupBy("token").agg(F.min_by("node", "place").alias("pivot"), F.min("place").alias("first"), F.count("*").alias("c"))
    short = cold.unionByName(long.join(F.broadcast(heads), "token"))
    short = cut(short.select("token", "node", "n", "pos", "pivot", F.col("first").bitwiseAND(F.lit((1 << 32) - 1)).alias("m"), F.shiftright("first", 32).alias("at")))
    release(shared, hot)

    # of the pivots that a set meets, the one that it shares most lists with: step 4 finds what that misses
    near = short.where("node <> pivot").where(_in_reach("n", "pos", "m", "at", percent)).groupBy("node", "pivot").agg(F.count("*").alias("occ"))
    near = cut(near.groupBy(F.col("node").alias("x")).agg(F.max_by("pivot", F.shiftleft("occ", 32) - F.pmod("pivot", F.lit(1 << 31))).alias("q")).select("q", "x"))
    met = _sketched(near, sketches, percent)
    release(near)
    links = _verify(met, sets, k, percent)
    roots = components(links)

    # lists that still hold sets of several components
    held = short.select("token", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = cut(held)
    release(short)
    mixed = cut(held.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("c")).where("r <> s").select("token", "c"))
    held_mixed = cut(join_hot(held, mixed, "token", "c", total))
    release(held, mixed)
    least = f"least({SHORT}, ceil({percent} * (n + m) / {100 + percent}))"
    rest = cut(_occurrences(held_mixed, percent).where(f"occ >= {least}").select(F.col("a").alias("q"), F.col("b").alias("x")))
    release(held_mixed)
    if not rest.isEmpty():
        known = met.select("q", "x").unionByName(met.select(F.col("x").alias("q"), F.col("q").alias("x")))
        more = _sketched(rest.join(known, ["q", "x"], "left_anti"), sketches, percent)
        links = links.unionByName(_verify(more, sets, k, percent))
        roots = components(links)
    release(rest)

    # rows of a set of its own are its node
    again = cut(firsts.where("rows > 1"))
    rows = sets.where("sid is not null").select("rid", "doc_id", "n", F.xxhash64("text").alias("h"), "sid")
    at = join_hot(rows, again, "sid", "rows", sets.count()).select("rid", "doc_id", "n", "h", "node")
    at = at.unionByName(rows.join(again.select("sid"), "sid", "left_anti").select("rid", "doc_id", "n", "h", F.col("rid").alias("node"))).join(roots, "node", "left")
    at = at.select("rid", "doc_id", "n", "h", F.coalesce("root", "node").alias("root"))
    none = sets.where("sid is null").select("rid", "doc_id", "n", F.xxhash64("text").alias("h"), F.lit(None).cast("long").alias("root"))
    out = cut(at.unionByName(none))
    release(firsts, again, met, links, roots)
    return out, sets
