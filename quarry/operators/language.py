"""The language of texts by character trigrams: a naive Bayes model counted from labelled texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.lineage import bounded_batches

#: Trigrams that a model keeps of each language, the most frequent ones: it is sent to the tasks.
MOST_GRAMS = 3000
#: Characters whose trigrams are counted at once, about.
CHUNK = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str) -> Counter:
    """Trigrams of the lower-cased words, each between spaces."""
    words = Counter(_LETTERS.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        padded = f" {w} "
        for i in range(len(padded) - 2):
            out[padded[i : i + 3]] += n
    return out


def _codes(text: str) -> np.ndarray:
    """The trigrams of grams(), as numbers, with repeats: three code points of 21 bits each."""
    words = _LETTERS.findall(text.lower())
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # one around each letter: those around a space cross words
    at = np.flatnonzero(c[1:-1] != 32)
    return c[at] << 42 | c[at + 1] << 21 | c[at + 2]


def _gram(code: int) -> str:
    return "".join(chr(code >> bits & 0x1FFFFF) for bits in (42, 21, 0))


def train(texts: DataFrame, *, text: str = "text", language: str = "lang", most: int = MOST_GRAMS) -> DataFrame:
    """(language, gram, weight): logarithms of the trigrams' shares in each language's texts, smoothed. Rows without a text or a language are
    left out. All texts are counted, within batches first; a language's most frequent trigrams are kept."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = {}
        held: dict[str, list[np.ndarray]] = {}
        size: Counter = Counter()

        def add(lang: str) -> None:
            found, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            size[lang] = 0
            own = total.setdefault(lang, Counter())
            for c, k in zip(found.tolist(), n.tolist(), strict=True):
                own[c] += k

        for pdf in batches:
            for lang, value in zip(pdf["language"], pdf["text"], strict=True):
                held.setdefault(lang, []).append(_codes(value))
                size[lang] += len(value)
                if size[lang] > CHUNK:
                    add(lang)
        for lang in list(held):
            add(lang)
        rows = [(lang, _gram(c), n) for lang, own in total.items() for c, n in own.items()]
        yield pd.DataFrame(rows, columns=["language", "gram", "n"])

    rows = texts.select(F.col(language).alias("language"), F.col(text).alias("text")).dropna()
    sums = rows.mapInPandas(count, "language string, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    kept = sums.withColumn("_at", F.row_number().over(first)).withColumn("total", F.sum("n").over(Window.partitionBy("language"))).where(F.col("_at") <= most)
    return kept.select("language", "gram", F.log((F.col("n") + 1) / (F.col("total") + most)).alias("weight"))


class Guess:
    """A model on the driver and in tasks: at most MOST_GRAMS rows a language."""

    def __init__(self, model: DataFrame) -> None:
        rows = model.collect()
        self.languages = sorted({r["language"] for r in rows})
        # sorted alike as strings and as numbers
        self.index = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows}))}
        self.codes = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in self.index], dtype=np.int64)
        at = {lang: i for i, lang in enumerate(self.languages)}
        least = min((r["weight"] for r in rows), default=0.0) - 1.0
        self.weights = np.full((len(self.index), len(self.languages)), least)
        for r in rows:
            self.weights[self.index[r["gram"]], at[r["language"]]] = r["weight"]

    def __call__(self, text: str | None) -> str | None:
        """The likeliest language; the first by name among equals; null for a text without known trigrams."""
        own = _codes(text or "")
        i = np.searchsorted(self.codes, own)
        found = i[(i < len(self.codes)) & (self.codes[np.minimum(i, len(self.codes) - 1)] == own)] if len(self.codes) else i[:0]
        return self.languages[int(self.weights[found].sum(0).argmax())] if len(found) else None


def classify(texts: DataFrame, model: DataFrame, *, text: str = "text", name: str = "language") -> DataFrame:
    """texts with the likeliest language of each. Narrow."""
    bounded_batches(texts.sparkSession)
    guess = Guess(model)
    return texts.withColumn(name, F.pandas_udf(lambda s: s.map(guess), "string")(F.col(text)))
