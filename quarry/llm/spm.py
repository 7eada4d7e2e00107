"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model is compiled once on the driver into three parts: the normaliser (arcs of the model's character map, of which the longest
that fits is taken, runs of spaces, a dummy prefix, spaces to U+2581), the lexicon (a trie with an arc for each piece) and the byte
fallback (an arc path for each character that is no piece). An input is composed with them into a lattice, and its shortest path in
the tropical semiring is the encoding. User-defined pieces pass the normaliser as they are; in BPE models nothing merges with them.

* Unigram models: an arc weighs minus its piece's score.
* BPE models: the lattice's states carry the last piece, and an arc weighs 0 when merging the two pieces' joined text gives
  these two pieces back, else infinity. Merges of a whole text act inside a window of two final pieces as they act on that
  window alone, in the same order, so the one path of finite weight is the merge procedure's result. Every prefix has one
  such encoding, hence one live state a position: the search is linear in the text.

Texts are cut, without loss, where no piece has such a pair of characters: before U+2581 and between letters and others.
That is proven against the vocabulary when compiling (Compiled.cut_pattern); a model that breaks it is handled whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import small_batches

MARK = "▁"
#: Entries of each of the two generations of a worker's memo of segments; a full one replaces the older one.
MEMO = 200_000


@dataclass
class Compiled:
    kind: str  # "bpe" or "unigram"
    pieces: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]  # id of each byte's piece; empty: no byte fallback
    unknown: int
    prefix: bool
    cut_pattern: str | None
    surface: list[bytes] = field(default_factory=list)  # of each id, for decoding
    user: dict[str, int] = field(default_factory=dict)  # user-defined pieces
    charsmap: dict[str, str] = field(default_factory=dict)
    remove_extra: bool = False  # spaces at the ends, and all but one of a run


def read_charsmap(blob: bytes) -> dict[str, str]:
    """The strings that a model's character map replaces, and by what. The map is four bytes of the length of a double-array trie, that
    trie, in units of four bytes, and the replacements, each ended by a zero byte; a leaf's value is its replacement's place."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    # a unit: the low byte and the top bit are its label, bit 8 tells of a leaf, the bits from 10 on, in units of 256 if bit 9 is set, lead to its children
    children = lambda at: at ^ ((units[at] >> 10) << (8 if units[at] & 512 else 0))
    out, todo = {}, [(children(0), b"")]
    while todo:
        base, key = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at < len(units) and units[at] & 0x800000FF == c:
                below = children(at)
                if units[at] & 256:
                    start = units[below] & 0x7FFFFFFF
                    out[(key + bytes([c])).decode()] = texts[start : texts.index(0, start)].decode()
                todo.append((below, key + bytes([c])))
    return out


def compile_model(path: str) -> Compiled:
    """Reads a .model file. What is not compiled raises ValueError: word and character models, pieces that are marked as unused, spaces as
    suffixes or left as they are, denormalisers, and replacements or user-defined pieces with several spaces in a row."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if proto.denormalizer_spec.precompiled_charsmap or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or train.model_type not in (1, 2):
        raise ValueError("this normaliser or kind of model is not supported")
    charsmap = read_charsmap(norm.precompiled_charsmap)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, surface, bytes_, user = {}, {}, [], {}, {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(p[3:5], 16)] = i
            surface.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i):
            surface.append(b"")
        elif sp.is_unknown(i):
            surface.append(" ⁇ ".encode())
        else:
            if sp.is_unused(i):
                raise ValueError("a model with unused pieces is not supported")
            if proto.pieces[i].type == pb.ModelProto.SentencePiece.USER_DEFINED:
                user[p] = i
            else:
                pieces[p], scores[p] = i, sp.get_score(i)
            surface.append(p.replace(MARK, " ").encode())
    if any("  " in x for x in (*charsmap.values(), *user)):
        raise ValueError("several spaces in a row are not supported here")
    kind = "bpe" if train.model_type == 2 else "unigram"
    cuts = prove_cuts(pieces if kind == "bpe" else {**pieces, **user})
    return Compiled(kind, pieces, scores, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], sp.unk_id(), norm.add_dummy_prefix, cuts, surface, user, charsmap, norm.remove_extra_whitespaces)


class Normaliser:
    """The first transducer: at each position a user-defined piece passes as it is, else the longest string of the character map is
    replaced, else the character passes."""

    def __init__(self, m: Compiled) -> None:
        self.m = m
        self.longest = max(map(len, m.charsmap), default=0)
        one = lambda cs: f"[{''.join(map(re.escape, sorted(cs)))}]"
        heads, tails = {k[0] for k in m.charsmap if len(k) > 1}, {k[1] for k in m.charsmap if len(k) > 1}
        singles = {k for k in m.charsmap if len(k) == 1}
        # where an arc other than the character's own may begin
        arcs = [user_pattern(m.user)] if m.user else []
        arcs += [one(singles)] if singles else []
        arcs += [f"{one(heads)}(?={one(tails)})"] if heads else []
        self.next = re.compile("|".join(arcs)).search if arcs else None

    def mapped(self, text: str) -> str:
        if not self.next:
            return text
        out, at = [], 0
        user, replaced = self.m.user, self.m.charsmap
        while found := self.next(text, at):
            i = found.start()
            out.append(text[at:i])
            if found[0] in user:
                out.append(found[0])
                at = found.end()
                continue
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if (by := replaced.get(text[i : i + n])) is not None:
                    break
            else:
                n, by = 1, text[i]
            out.append(by)
            at = i + n
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        s = self.mapped(text)
        if self.m.remove_extra:
            s = re.sub("  +", " ", s).lstrip(" ")
        s = (MARK if self.m.prefix else "") + s.replace(" ", MARK)
        return s.rstrip(MARK) if self.m.remove_extra else s

    def surface(self, text: str) -> str:
        """What decoding an encoded text gives, unless characters are unknown."""
        s = self(text).replace(MARK, " ")
        return s[1:] if (self.m.prefix or self.m.remove_extra) and s[:1] == " " else s


def user_pattern(user: dict[str, int]) -> str:
    """The longest user-defined piece at a position."""
    return "|".join(map(re.escape, sorted(user, key=len, reverse=True)))


def prove_cuts(pieces: dict[str, int]) -> str | None:
    """A pattern whose matches no piece crosses: every piece is one match of it. Letters that pieces join to non-letters
    are counted among the non-letters. None if that does not settle."""
    odd: set[str] = set()
    for _ in range(20):
        x = "".join(map(re.escape, sorted(odd)))
        pattern = rf"{MARK}*[^\W\d_{x}]+|{MARK}*(?:[\d_{x}]|[^\w{MARK}])+|{MARK}+"
        whole = re.compile(pattern)
        bad = [p for p in pieces if whole.findall(p) != [p]]
        if not bad:
            return pattern
        more = {c for p in bad for c in p if re.match(r"[^\W\d_]", c)} - odd
        if not more or len(odd | more) > 200:
            return None
        odd |= more
    return None


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The merge procedure itself on a short text: best score first, leftmost among equals."""
    parts = list(text)
    while len(parts) > 1:
        at, best = -1, None
        for i in range(len(parts) - 1):
            s = scores.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                at, best = i, s
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes and decodes with a compiled model; one for each worker process."""

    def __init__(self, model: Compiled) -> None:
        self.m = model
        self.trie: dict = {}
        self.normalise = Normaliser(model)
        # of least cost wherever it fits: a user-defined piece scores as its bytes' number of best pieces do
        best, self.worst = max(model.scores.values(), default=0.0), min(model.scores.values(), default=0.0) - 10
        self.scores = {**model.scores, **({p: len(p.encode()) * best - 0.1 for p in model.user} if model.kind == "unigram" else {})}
        self.parts = re.compile(f"({user_pattern(model.user)})").split if model.user and model.kind == "bpe" else None
        for p in self.scores:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.find = re.compile(model.cut_pattern).findall if model.cut_pattern else lambda s: [s] if s else []
        self.out = {p: i.to_bytes(4, "little") for p, i in (*model.pieces.items(), *model.user.items())}

    def fits(self, a: str, b: str) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 4 * MEMO:
                self.pairs.clear()
            ok = self.pairs[a, b] = merge(a + b, self.m.scores) == ([a, b] if a else [b])
        return ok

    def fallback(self, c: str) -> bytes:
        return b"".join(self.m.bytes_[b].to_bytes(4, "little") for b in c.encode("utf-8", "surrogatepass")) if self.m.bytes_ else self.m.unknown.to_bytes(4, "little")

    def arcs(self, s: str, i: int) -> list[str]:
        """Labels of the arcs that leave position i, the longest last."""
        node, out = self.trie, []
        for j in range(i, len(s)):
            if (node := node.get(s[j])) is None:
                break
            if (p := node.get("")) is not None:
                out.append(p)
        return out if i == len(s) or out and len(out[0]) == 1 else [s[i], *out]

    def path(self, s: str) -> list[str]:
        """Labels of the shortest path through s's lattice; a label that is no piece stands for its byte path."""
        return self.path_bpe(s) if self.m.kind == "bpe" else self.path_unigram(s)

    def path_bpe(self, s: str) -> list[str]:
        """Depth-first search for the path of finite weight. A position has one live state at most, so one that failed is
        never entered again."""
        n, i, before, out, failed = len(s), 0, "", [], set()
        todo = [self.arcs(s, 0)] if n else []
        while i < n:
            left = todo[-1]
            while left:
                p = left.pop()
                if i + len(p) not in failed and self.fits(before, p):
                    i, before = i + len(p), p
                    out.append(p)
                    todo.append(self.arcs(s, i))
                    break
            else:
                failed.add(i)
                todo.pop()
                i -= len(out.pop())
                before = out[-1] if out else ""
        return out

    def path_unigram(self, s: str) -> list[str]:
        n, worst = len(s), self.worst
        best: list[tuple[float, str]] = [(0.0, "")] + [(float("inf"), "")] * n
        for i in range(n):
            for p in self.arcs(s, i):
                w = best[i][0] - self.scores.get(p, worst)
                if w < best[i + len(p)][0]:
                    best[i + len(p)] = w, p
        out, j = [], n
        while j:
            out.append(best[j][1])
            j -= len(out[-1])
        return out[::-1]

    def segment(self, s: str) -> bytes:
        if (got := self.memo.get(s)) is None:
            if (got := self.older.get(s)) is None:
                got = b"".join(self.out.get(p) or self.fallback(p) for p in self.path(s))
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            if len(s) <= 64:
                self.memo[s] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        s = self.normalise(text)
        if self.parts:
            out = b"".join(self.out[x] if i % 2 else b"".join(map(self.segment, self.find(x))) for i, x in enumerate(self.parts(s)))
        else:
            out = b"".join(map(self.segment, self.find(s)))
        if not self.m.bytes_:
            # unknown characters in a row are one
            ids = np.frombuffer(out, "<u4")
            again = (ids[1:] == self.m.unknown) & (ids[:-1] == self.m.unknown)
            out = ids[np.r_[True, ~again]].tobytes() if len(ids) else out
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.m.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if (self.m.prefix or self.m.remove_extra) and text[:1] == " " else text


_held: dict[str, Transducer] = {}


def _transducer(key: str, shared) -> Transducer:
    if key not in _held:
        _held.clear()
        _held[key] = Transducer(shared.value)
    return _held[key]


def encode(docs: DataFrame, model_path: str, *, text: str = "text", ids: str = "token_ids", check: bool = True) -> DataFrame:
    """Adds to each row: ids array<int>, n_bytes and n_tokens long, ids_crc32 long (of the ids as little-endian 32-bit
    integers), round_trip boolean (decoding gives the text back as the model's normaliser leaves it, U+2581 read as a space; null if
    check is false).

    A null text counts as empty and has no ids; long texts are encoded whole; rows, ties and repeated rows stay as they
    are; an empty table gives an empty table. Other columns stay; those that bear a new column's name are replaced. One
    narrow pass without a shuffle. The compiled model (bounded by its vocabulary) is broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(compile_model(model_path))
    new = [ids, "n_bytes", "n_tokens", "ids_crc32", "round_trip"]
    kept = [c for c in docs.columns if c not in new]
    if text not in kept:
        raise ValueError(f"the text column {text} bears the name of a new column")
    schema = docs.select(*kept).schema

    def run(batches):
        t = _transducer(model_path, shared)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            coded = [t.encode(x or "") for x in texts]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
            trip = [t.decode(c) == t.normalise.surface(x or "") for c, x in zip(coded, texts, strict=True)] if check else [None] * len(coded)
            cols = [lists, pa.array([len((x or "").encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(trip, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])

    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
    full = T.StructType([*schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))])
    return docs.select(*kept).mapInArrow(run, full)


def decode(coded: DataFrame, model_path: str, *, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """Replaces the ids by the text they stand for. Null ids give null; ids outside the vocabulary raise."""
    spark = coded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(compile_model(model_path))
    kept = [c for c in coded.columns if c not in (ids, text)]

    def run(batches):
        t = _transducer(model_path, shared)
        for batch in batches:
            k = batch.schema.get_field_index(ids)
            texts = [None if x is None else t.decode(np.asarray(x, "<u4").tobytes()) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != k), pa.array(texts, pa.string())], names=[*kept, text])

    full = T.StructType([*coded.select(*kept).schema.fields, T.StructField(text, T.StringType())])
    return coded.select(*kept, F.col(ids)).mapInArrow(run, full)
