"""Context-triggered piecewise hashing: fingerprints of whole texts, and how like two of them are.

A hash of the last eight bytes, rolled over the whole UTF-8 text, ends a chunk wherever its low bits are zero; a chunk becomes one of
64 characters. The block size is a power of two: the smallest that leaves 64 chunks at most. A fingerprint has the chunks'
signatures at that size and at twice that, so texts whose sizes are a factor of two apart can still be compared.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut, release, small_batches

#: The most chunks of a signature, and characters in a row that two signatures share at least if they are alike at all.
CHUNKS, SHARED = 64, 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes that are rolled at once; each stretch begins with the eight bytes before it.
STRETCH = 1 << 20
_FACTOR = 0x01000193
_BYTES = np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B1) ^ np.arange(256, dtype=np.uint32) * np.uint32(0x85EBCA6B) >> np.uint32(7)


def rolled(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the eight bytes that end there, or of as many as there are: windows of one byte, doubled three times."""
    h, factor = _BYTES[data], _FACTOR
    for width in (1, 2, 4):
        out = h.copy()
        out[width:] += h[:-width] * np.uint32(factor)
        h, factor = out, factor * factor & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _ends(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the low bits of the rolling hash are zero, and the hashes there."""
    mask, at, hashes = np.uint32((1 << bits) - 1), [], []
    for k in range(0, len(data), STRETCH):
        skip = min(k, 8)
        h = rolled(data[k - skip : k + STRETCH])[skip:]
        hit = np.flatnonzero(h & mask == 0)
        at.append(hit + k)
        hashes.append(h[hit])
    return np.concatenate(at), np.concatenate(hashes)


def _signature(data: bytes, ends: list[int]) -> str:
    cuts = [0, *(e + 1 for e in ends)]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    view = memoryview(data)
    return "".join([ALPHABET[zlib.crc32(view[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False)])


def fingerprint(data: bytes) -> str:
    """block size:signature:signature at twice the size. Of the whole data; 1:: for none."""
    if not data:
        return "1::"
    raw = np.frombuffer(data, np.uint8)
    # the size that leaves about CHUNKS, and two steps below, where the ends are looked for; all larger sizes' ends are among them
    bits = max(0, (len(data) // CHUNKS).bit_length() - 3)
    while True:
        at, hashes = _ends(raw, bits)
        if len(at) >= CHUNKS or not bits:
            break
        bits = max(0, bits - 3)
    few = lambda b: at[hashes & np.uint32((1 << b) - 1) == 0].tolist() if b < 32 else []  # noqa: E731  beyond 32 bits the text is one chunk
    while len(few(bits)) >= CHUNKS:
        bits += 1
    return f"{1 << bits}:{_signature(data, few(bits))}:{_signature(data, few(bits + 1))}"


def _pair(a: Column, b: Column) -> Column:
    """One less the edit distance by the longer signature's length; 0 if they share no stretch of SHARED characters, or of half the
    shorter one's where that is less."""
    short = F.least(F.length(a), F.length(b))
    need = F.least(F.lit(SHARED), F.floor((short + 1) / 2).cast("int"))
    shared = F.exists(F.sequence(F.lit(1), F.length(a) - need + 1), lambda i: b.contains(a.substr(i, need)))
    return F.when(short == 0, 0.0).when(shared, 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """How like two fingerprints are, from 0 to 1, symmetric: 1 if they are equal, else by the signatures of one block size, the better if
    both sizes are the same; 0 if their sizes are more than a factor of two apart. Null if one is null."""
    x, y = (F.split(c, ":") for c in (a, b))
    size = lambda c: c[0].cast("long")
    same = F.greatest(_pair(x[1], y[1]), _pair(x[2], y[2]))
    out = F.when(a == b, 1.0).when(size(x) == size(y), same).when(size(x) == 2 * size(y), _pair(x[1], y[2])).when(2 * size(x) == size(y), _pair(x[2], y[1]))
    return F.when(a.isNotNull() & b.isNotNull(), out.otherwise(0.0))


def fingerprints(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the text's fingerprint to each row.

    Null texts count as empty: 1::; long texts are hashed whole; repeated rows and texts have equal fingerprints; an empty table stays
    empty; other columns stay, one of the new name is replaced. Narrow."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != name.lower()]

    def run(batches):
        for batch in batches:
            out = [fingerprint((x or "").encode()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.string())], names=[*kept, name])

    return docs.select(*kept, docs[text].alias("_text")).mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.StringType())]))


def edit(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many code points of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_EDGE = "edge int, part int, place long, blob binary"
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]


def _row(doc_id: int | None, text: str, own: str, following: str, its: str) -> tuple:
    made = edit(text, following).encode()
    return doc_id, len(text), hashlib.sha256(made).hexdigest(), own, fingerprint(made), its


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def against_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint): each document beside the next one in
    descending doc_id, the first being next to the last, and beside its own text with the last half taken from that one.

    Null doc_ids come last, rows of one doc_id in the order of their places in the input's partitions; null texts count as empty; long texts
    are taken whole; a table of one row is next to itself; an empty table gives an empty result; other columns are not read.

    Texts are packed, dealt by ranges of the order in one shuffle, and read in order; only the first and last text of each range are
    written and joined, by the ranges' numbers."""
    spark = docs.sparkSession
    small_batches(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.col(text).alias("text"))

    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = [packer.compress((x or "").encode()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "place", "blob"])

    packed = rows.mapInArrow(pack, "doc_id long, place long, blob binary")
    order = [F.col("doc_id").desc_nulls_last(), F.col("place").asc()]
    dealt = packed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "*")

    def pairs(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        nothing = (None,) * 6
        before = None
        for batch in batches:
            out = []
            for part, doc, place, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = unpacker.decompress(blob).decode()
                own = fingerprint(value.encode())
                if before is None:
                    out.append((*nothing[:3], own, None, None, 1, part, place, blob))
                else:
                    out.append((*_row(before[1], before[4], before[5], value, own), 0, None, None, None))
                before = part, doc, place, blob, value, own
            yield _batch(out, f"{_DONE}, {_EDGE}")
        if before is not None:
            part, doc, place, blob, _, own = before
            yield _batch([(doc, None, None, own, None, None, 2, part, place, blob)], f"{_DONE}, {_EDGE}")

    met = cut(dealt.mapInArrow(pairs, f"{_DONE}, {_EDGE}"), compression="zstd")
    from pyspark.sql import Window

    # a row a range: the next range that has rows, the first one after the last
    heads = met.where("edge = 1").select(F.col("part").alias("head"), F.col("fingerprint").alias("its"), F.col("blob").alias("following"))
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tails = met.where("edge = 2").select("part", "doc_id", "fingerprint", "blob")
    ranges = tails.select("part", after.alias("head"))
    edges = tails.join(ranges, "part").join(heads, "head").select("doc_id", "fingerprint", "blob", "its", "following")

    def close(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [_row(doc, unpacker.decompress(blob).decode(), own, unpacker.decompress(following).decode(), its) for doc, own, blob, its, following in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch(out, _DONE)

    closed = cut(edges.mapInArrow(close, _DONE))
    done = cut(met.where("edge = 0").select(*_names(_DONE)).unionByName(closed))
    release(met, closed)
    return done
