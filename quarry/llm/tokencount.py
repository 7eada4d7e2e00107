"""Token counts by the whole-token shortcut.

Offline, on the driver, the vocabulary is merged string by string: those that end as one token are whole tokens. A text is cut
into pre-tokens where no piece crosses (proven against the vocabulary, see spm.prove_cuts). A pre-token that is a whole
token counts 1 by look-up; only the rest is merged, by the model's own library, and remembered in a bounded memo.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import small_batches
from quarry.llm.spm import MARK, MEMO, Compiled, compile_model, merge


def whole_tokens(model: Compiled) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token. For a unigram model that cannot be read off the merges: none."""
    return frozenset(p for p in model.pieces if merge(p, model.scores) == [p]) if model.kind == "bpe" else frozenset()


class _Counts(dict):
    def __init__(self, whole: frozenset[str], library) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.library, self.older = whole, library, {}

    def __missing__(self, s: str) -> int:
        if (n := self.older.get(s)) is None:
            n = self.merged(s)
        if len(self) > len(self.whole) + MEMO:
            self.older = dict(self)
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(s) <= 64:
            self[s] = n
        return n

    def merged(self, s: str) -> int:
        # the library puts a mark before every text; a line feed, one token of its own that no piece holds, shields the rest
        return len(self.library.encode(s[1:])) if s[0] == MARK and len(s) > 1 else len(self.library.encode("\n" + s)) - 2 if s[0] != MARK else 1


_held: dict[str, tuple] = {}


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, text: str = "text") -> DataFrame:
    """Adds n_bytes long (UTF-8), n_tokens long and over_limit boolean (n_tokens > limit) to each row.

    A null text counts as empty: 0 tokens. Long texts are counted whole; ties, repeated rows and an empty table need
    nothing special; other columns stay, those that bear a new column's name are replaced. One narrow pass, no shuffle. The
    whole tokens (at most the vocabulary) are broadcast; model_path must be readable on every executor."""
    spark = docs.sparkSession
    small_batches(spark)
    model = compile_model(model_path)
    if model.cut_pattern is None or not model.prefix or any("\n" in p for p in model.pieces) or len(model.bytes_) < 256 or model.user or model.charsmap or model.remove_extra:
        raise ValueError("the shortcut is not proven for this vocabulary")
    shared = spark.sparkContext.broadcast((model.cut_pattern, whole_tokens(model)))
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c not in new]
    read = kept if text in kept else [*kept, text]

    def run(batches):
        import sentencepiece

        if model_path not in _held:
            pattern, whole = shared.value
            _held.clear()
            _held[model_path] = re.compile(pattern).findall, _Counts(whole, sentencepiece.SentencePieceProcessor(model_file=model_path))
        find, counts = _held[model_path]
        get = counts.__getitem__
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n = [sum(map(get, find(MARK + x.replace(" ", MARK)))) if x else 0 for x in texts]
            cols = [pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *cols], names=[*kept, *new])

    full = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(*read).mapInArrow(run, full)
