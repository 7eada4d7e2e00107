"""Toxicity: a logistic classifier on words and word beginnings with a counterfactual regulariser.

It learns from a bounded, hash-ordered sample of labelled documents. For every sampled document that mentions identity terms,
counterfactuals swap each term for another of its group; the squared change of the score's logit is penalised, so that the
mention of a group alone moves no score. Weights of identity terms that the sample lacks stay at zero.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import small_batches

#: Labelled documents in the sample, of each label, and features at most: the bounds of what the driver gets.
SAMPLE, FEATURES = 3000, 20_000
#: A feature is kept if this many sampled documents have it, and its shares in the labels are so many standard errors apart:
#: what is kept by chance would add up in very long texts.
LEAST_DOCS, APART = 6, 3.5
THRESHOLD = 0.7
RIDGE, COUNTERFACTUAL, ROUNDS = 5e-5, 1.0, 250

# Identity terms by group; terms of a group are swapped for one another.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("juden", "christen", "muslime"), ("juifs", "chrétiens", "musulmans"), ("judíos", "cristianos", "musulmanes"),
)
SWAP = {w: g[(i + 1) % len(g)] for g in IDENTITY for i, w in enumerate(g)}
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_~^`+=…«»„“”’‘"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words, without signs at their ends; words with signs inside count by their runs of letters."""
    out = set()
    for w in set(text.lower().split()):
        w = w.strip(_EDGES)
        if w.isalpha():
            out.add(w)
        else:
            out.update(_LETTERS.findall(w))
    return out


def features(word: str) -> list[str]:
    """A word and its first five and four letters. Identity terms have no beginnings, which swaps would not reach."""
    return [word] if len(word) < 5 or word in SWAP else [word, "4" + word[:4]] if len(word) == 5 else [word, "5" + word[:5], "4" + word[:4]]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, words: set[str], memo: dict[str, tuple[str, ...]] | None = None) -> float:
        w, seen = self.weights, set()
        for x in words:
            got = memo.get(x) if memo is not None else None
            if got is None:
                got = tuple(f for f in features(x) if f in w)
                if memo is not None:
                    if len(memo) > 300_000:
                        memo.clear()
                    memo[x] = got
            if got:
                seen.update(got)
        z = self.bias + sum(map(w.__getitem__, sorted(seen)))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(docs: Iterable[tuple[int, set[str]]]) -> Model:
    """docs: (label, words), read once and held as numbers of features. Both labels weigh the same, so a score of 0.5 is where they
    balance. With one label only, or none, there is nothing to tell apart: no weights."""
    # features by number; a word's are found once, so that each string is held once
    number: dict[str, int] = {}
    known: dict[str, tuple[int, ...]] = {}

    def of(word: str) -> tuple[int, ...]:
        if (got := known.get(word)) is None:
            got = known[word] = tuple(number.setdefault(f, len(number)) for f in features(word))
        return got

    for w in SWAP:
        of(w)
    given, rows_of, pairs = [], [], []
    for y, ws in docs:
        if not ws.isdisjoint(SWAP):
            pairs.append((len(given), np.unique(np.fromiter((i for w in ws for i in of(SWAP.get(w, w))), np.int32))))
        given.append(y)
        rows_of.append(np.unique(np.fromiter((i for w in ws for i in of(w)), np.int32)))
    known.clear()
    labels = np.array(given, float)
    pos = labels.sum()
    if not 0 < pos < len(labels):
        return Model(-4.0 if not pos else 4.0, {})
    count = np.stack([np.bincount(np.concatenate([np.empty(0, np.int32), *(r for r, y in zip(rows_of, labels, strict=True) if y == v)]), minlength=len(number)) for v in (0, 1)])
    least = min(LEAST_DOCS, max(2, len(labels) // 200))
    both = count.sum(0)
    neg, share = len(labels) - pos, both / len(labels)
    # how far a feature's shares in the two labels are apart, in standard errors
    ratio = np.abs(count[1] / pos - count[0] / neg) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / neg))
    every = np.array(list(number))
    number.clear()
    kept = np.flatnonzero((both >= least) & (ratio >= APART))
    kept = kept[np.lexsort((every[kept], -ratio[kept]))][:FEATURES]
    kept = np.concatenate([kept, np.setdiff1d(np.arange(len(SWAP)), kept)])
    names = every[kept].tolist()
    column = np.full(len(every), -1, np.int64)
    column[kept] = np.arange(len(kept))
    del every, count, both, ratio

    def matrix(rows):
        at = [c[c >= 0] for c in (column[r] for r in rows)]
        return np.concatenate([np.empty(0, np.int64), *at]), np.repeat(np.arange(len(at)), [len(c) for c in at])

    xi, xr = matrix(rows_of)
    ai, ar = matrix([np.setdiff1d(rows_of[k], r) for k, r in pairs])
    bi, br = matrix([np.setdiff1d(r, rows_of[k]) for k, r in pairs])
    at = {f: i for i, f in enumerate(names)}
    n, d = len(labels), len(names)
    # Adam on the full sample, from zero
    row = np.where(labels == 1, 0.5 / pos, 0.5 / (n - pos))
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(xr, w[xi], n) + b
        e = row * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.append(np.bincount(xi, e[xr], d) + RIDGE * w, e.sum())
        if pairs:
            change = (np.bincount(ar, w[ai], len(pairs)) - np.bincount(br, w[bi], len(pairs))) * (2 * COUNTERFACTUAL / len(pairs))
            g[:d] += np.bincount(ai, change[ar], d) - np.bincount(bi, change[br], d)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:d], b - step[d]
    return Model(float(b), {f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """docs (doc_id, text) and labels (doc_id, label 0 or 1): fits on at most `sample` documents of each label, the first by
    a hash of doc_id. Rows with null or other labels or null doc_id, and labelled documents that are missing, teach nothing; null
    texts teach as empty ones; of several labels of a doc_id and label one counts; rows that repeat a labelled doc_id all teach, within
    twice the sample; empty tables give the model of no weights. Other columns are not read."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            y, x = batch.column(batch.schema.get_field_index("y")), batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([y, pa.array(["\n".join(sorted(words_of(t or ""))) for t in x], pa.string())], names=["y", "words"])

    small_batches(docs.sparkSession)
    taught = got.select("y", "text").mapInArrow(run, "y int, words string").orderBy("y", F.xxhash64("words"), "words").limit(2 * sample)
    return fit((r["y"], set(r["words"].split("\n")) - {""}) for r in taught.toLocalIterator())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, mod 3, is 1; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, *, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score double (0 to 1) and predicted int (1 from THRESHOLD on) to each row, under these names.

    Null texts score as empty ones (the bias); long texts are read whole; rows stay as they are, repeated rows score the
    same; an empty table stays empty; columns that bear these names are replaced. Narrow; the model (at most FEATURES
    weights) is broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    read = kept if text in kept else [*kept, text]

    def run(batches):
        memo: dict = {}
        m = shared.value
        for batch in batches:
            s = [m.score(words_of(x or ""), memo) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=[*kept, *names])

    return docs.select(*read).mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))
