"""Token ids as Parquet list columns: delta or dictionary encoded, in row groups and pages of stated size with page indexes,
in ascending order of document, so that readers can pick rows and columns; and the way back."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import new_path, small_batches

#: Bytes of a row group and of a page before compression, and rows of a page. The page index has an entry a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 128 << 10, 256
#: Entries of each of the two generations of a worker's memo of strings between white space; a full generation replaces the
#: older one.
MEMO = 800_000
#: Other characters than these, separators that Python alone counts as white space, and what could begin an added token
#: send a text through the library whole. Without them Python's lower case and character classes are the library's, and composing changes nothing.
_STRANGE = re.compile("[^\0-\u0130\u0132-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
_APART = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
# The tokenizer's pattern of words, spelled out for that range.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
_KNOWN = '[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\\\s+"},"content":" "},{"type":"Lowercase"}]', "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_held: dict[str, _Encoder] = {}


class _Memo(dict):
    """Remembers what a function of a short string gave."""

    def __init__(self, f) -> None:
        super().__init__()
        self.f, self.older = f, {}

    def __missing__(self, x: str) -> bytes:
        if (got := self.older.get(x)) is None:
            got = self.f(x)
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        if len(x) <= 64:
            self[x] = got
        return got


class _Encoder:
    """The library's tokenizer with memos of words.

    Its normaliser composes, joins white space and lowers case; its splitter takes the words and drops white space. Words
    never reach across white space and are merged each for itself, so a text's ids are its words' ids in a row. Tokenizers that are built otherwise are
    given every text whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        state = json.loads(self.lib.to_str())
        split = (state["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_word = json.dumps((state["normalizer"] or {}).get("normalizers"), separators=(",", ":")) == _KNOWN[0] and split.get("behavior") == "Removed" and split.get("invert") is True and split["pattern"]["Regex"].endswith(_KNOWN[1]) and not state["model"].get("ignore_merges")
        self.chunks = _Memo(self.chunk)
        self.signs = _Memo(self.word)  # digits and short runs of signs
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

        self.codes = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size())]

    def word(self, word: str) -> bytes:
        # printable ASCII stands for itself in the alphabet
        spelled = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        codes = self.codes
        return b"".join([codes[t.id] for t in self.lib.model.tokenize(spelled)])

    def chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isalpha():
            # a word is merged once, in whatever case and beside whatever signs it stands
            return self.word(low) if low == chunk else self.chunks[low]
        return b"".join([self.signs[m] if len(m) < 3 else self.chunks[m] if m.isalpha() else self.word(m) for m in _WORD.findall(low)])

    def whole(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        if not self.by_word or any(x in text for x in _APART) or (not text.isascii() and _STRANGE.search(text)):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int, *, text: str = "text") -> DataFrame:
    """Replaces the text by ids array<int>, the end id after each document's.

    A null or empty text has the end id alone; long texts are taken whole; rows, ties and repeated rows stay as they are; an
    empty table stays empty; other columns stay, one named ids is replaced. Narrow."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c not in (text, "ids")]
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _held:
            _held[tokenizer] = _Encoder(tokenizer)
        encode = _held[tokenizer].text
        for batch in batches:
            coded = [(encode(x) if x else b"") + end for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), lists], names=[*kept, "ids"])

    return docs.select(*kept, F.col(text).alias(text)).mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str, *, encoding: str = "delta", doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes (doc_id, part, row, n_tokens, ids) to path: files (part) and their rows (row, from 0) in ascending doc_id, nulls
    first; part and row tell the order of equal doc_ids, which is that of their places in the input's partitions.

    encoding: "delta" (version 2 pages: DELTA_BINARY_PACKED) or "dictionary". The texts are dealt by ranges of that order
    before they are encoded, as text is dearer to encode than to move; one shuffle, and a doc_id of many rows may fill several
    files. Null texts have the end id alone; repeated rows follow one another; other columns are not read. An empty table writes an
    empty folder with the schema."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError(encoding)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("at"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("at").asc()]
    dealt = texts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # rows of a task are numbered in the low 33 bits
    placed = dealt.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "text")
    out = encode_ids(placed, tokenizer, end_id).select("doc_id", "part", "row", F.size("ids").cast("long").alias("n_tokens"), "ids")
    out.write.options(**{
        "compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "v2" if encoding == "delta" else "v1", "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.page.write-checksum.enabled": "true",
    }).parquet(path)


def read_ids(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Reads documents back: (doc_id, part, row, n_tokens, ids). A condition on doc_id, part, row or n_tokens reaches the row
    groups and, by the page index, the pages; columns that the plan does not use are not read. An empty folder gives an empty table."""
    df = spark.read.schema("doc_id long, part int, row long, n_tokens long, ids array<int>").parquet(path)
    return df if where is None else df.where(where)


def starts(ids: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """ids with start: the number of ids of all documents before it in the files' order (part, row), which tells rows of one
    doc_id apart. A column named start is replaced; other columns stay. A prefix sum within each file follows one over the files'
    sums (a row a file), which are taken from sizes, the same rows with part and n_tokens, if ids is dear to compute twice."""
    ids = ids.drop("start")
    sums = (ids if sizes is None else sizes).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    w = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = ids.withColumn("own", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    return own.join(before, "part").withColumn("start", F.col("before") + F.col("own")).select(*ids.columns, "start")


def digest(ids: DataFrame) -> DataFrame:
    """Replaces the ids by ids_crc32, the checksum of the ids as little-endian unsigned 32-bit integers. Null ids count as none;
    other columns stay, one named ids_crc32 is replaced; rows stay as they are. Narrow."""
    kept = [c for c in ids.columns if c not in ("ids", "ids_crc32")]

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    return ids.select(*kept, "ids").mapInArrow(run, T.StructType([*ids.select(*kept).schema.fields, T.StructField("ids_crc32", T.LongType())]))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, *, encoding: str = "delta") -> DataFrame:
    """Writes the ids of documents (doc_id, text) to the shared folder, reads them back and returns from the files doc_id,
    start, n_tokens and ids_crc32.

    Null texts have the end id alone; repeated rows and doc_ids each have their own ids and start, in the files' order;
    an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    path = new_path(spark)
    write_ids(docs, tokenizer, end_id, path, encoding=encoding)
    ids = read_ids(spark, path)
    return starts(digest(ids), ids).select("doc_id", "start", "n_tokens", "ids_crc32")
