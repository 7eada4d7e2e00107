"""Periodic runs of words by a harmonic grid.

A run of period p that is at least 2p long holds two neighbouring points jp and (j+1)p of the grid of step p. For each p and j the
words that agree from there on, forwards and backwards, are the longest common extensions of the two points: range minima over the
LCP array of the document's suffix array, and of the reversed document's. Summed over all p the grids have n ln n points. Points
whose nearest words differ so early that no run can lie there have their answer without a look-up.

A document is one row's work; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import small_batches

#: Words up to which the grid's points are kept as a table in each worker; longer documents walk them period by period.
TABLE = 1 << 15
#: Points that are looked up at once.
POINTS = 1 << 19
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
NEW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and each suffix's rank; ranks double the length that they tell apart."""
    n, k = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = np.diff(key[order]) != 0
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order, rank
        k *= 2


class Extensions:
    """Longest common extensions of pairs of positions: suffix array, LCP array and a sparse table of its range minima."""

    def __init__(self, codes: np.ndarray) -> None:
        order, self.rank = suffix_array(codes)
        self.n = n = len(codes)
        c, at, lcp, h = codes.tolist(), order.tolist(), np.zeros(n, np.int32), 0
        for i, r in enumerate(self.rank.tolist()):
            if not r:
                h = 0
                continue
            j = at[r - 1]
            most = n - max(i, j)
            while h < most and c[i + h] == c[j + h]:
                h += 1
            lcp[r] = h
            h -= h > 0
        self.least = [lcp]
        while 2 << (len(self.least) - 1) <= n:
            last, s = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-s], last[s:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For positions a and b, different and up to n; n is the end, from where nothing extends."""
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero((a < self.n) & (b < self.n))
        x, y = self.rank[a[inside]], self.rank[b[inside]]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            t = self.least[k]
            out[inside[own]] = np.minimum(t[low[own]], t[high[own] - (1 << int(k)) + 1])
        return out


_table: list[tuple[np.ndarray, np.ndarray]] = []


def _points(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grids' neighbouring points (jp, (j+1)p) below n."""
    if n <= TABLE:
        if not _table:
            a = np.concatenate([np.arange(0, TABLE - p, p, dtype=np.int32) for p in range(1, TABLE)])
            b = a + np.repeat(np.arange(1, TABLE, dtype=np.int32), [len(range(0, TABLE - p, p)) for p in range(1, TABLE)])
            order = np.argsort(b, kind="stable")
            _table.append((a[order], b[order]))
        a, b = _table[0]
        m = np.searchsorted(b, n)
        yield a[:m], b[:m]
        return
    for p in range(1, n // 2 + 1):
        a = np.arange(0, n - p, p)
        yield a, a + p


def _likely(codes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The points where a run of `least` words or more can be: of the max(p, least - p) words that must agree with those p further
    on, half at least lie in one direction."""
    n, depth = len(codes), min(3, -(-(-(-least // 2)) // 2))
    # positions outside agree with nothing
    wide = np.concatenate([np.arange(-1, -1 - depth, -1), codes, np.arange(-1 - depth, -1 - 2 * depth, -1)])
    held, size = [], 0
    for a, b in _points(n):
        same = codes[a] == codes[b]
        back = wide[a + depth - 1] == wide[b + depth - 1]
        hit = np.flatnonzero(same | back)
        if len(hit):
            x, y = a[hit] + depth, b[hit] + depth
            ahead, behind = same[hit], back[hit]
            for i in range(1, depth):
                ahead = ahead & (wide[x + i] == wide[y + i])
                behind = behind & (wide[x - 1 - i] == wide[y - 1 - i])
            hit = hit[ahead | behind]
        if len(hit):
            held.append((a[hit], b[hit]))
            size += len(hit)
        if size >= POINTS:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, size = [], 0
    if size:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def runs_of(codes: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers from 0 on, by start, then period: stretches of smallest period p
    and of max(least, 2p) or more, that no neighbour extends."""
    n, found, ahead, behind = len(codes), [], None, None
    for a, b in _likely(codes, least):
        if ahead is None:
            ahead, behind = Extensions(codes), Extensions(codes[::-1])
        for k in range(0, len(a), POINTS):
            x, y = a[k : k + POINTS].astype(np.int64), b[k : k + POINTS].astype(np.int64)
            # position i - 1 is n - i in the reversed sequence
            back = behind(n - x, n - y)
            p = y - x
            length = p + back + ahead(x, y)
            run = length >= np.maximum(least, 2 * p)
            found.append(np.unique(np.stack([x - back, length, p], 1)[run], axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.unique(np.concatenate(found), axis=0)
    # a stretch that is found at multiples of its smallest period counts once, with that
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that any run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def find(docs: DataFrame, *, least: int = 12, text: str = "text") -> DataFrame:
    """Adds n_words long, runs array<struct<start, length, period>> by start, then period, and collapsed string to each row. Words are
    what lies between ASCII white space.

    A null or empty text has no words, no runs and an empty collapsed text; long texts are taken whole, of any length; ties (runs of one
    start) go by period; repeated rows have equal results; an empty table stays empty; other columns stay, those that bear a
    new column's name are replaced. Narrow: a document's work is n ln n comparisons, and memory in proportion to n log n
    where it has what may be runs."""
    if least < 2:
        raise ValueError("a run has two words at least")
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in NEW.names]

    def run(batches):
        for batch in batches:
            numbers, ends, found, texts = [], [0], [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                words = (value or "").encode().split()
                known: dict[bytes, int] = {}
                codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                # all words different: no run
                runs = runs_of(codes, least) if len(known) < len(words) else np.zeros((0, 3), np.int64)
                numbers.append(len(words))
                ends.append(ends[-1] + len(runs))
                found.append(runs)
                texts.append(collapse(words, runs).decode())
            every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], fields=[pa.field(c, pa.int64(), False) for c in RUN.names])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(numbers, pa.int64()), lists, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *NEW.names])

    rows = docs.select(*kept, docs[text].alias("_text"))
    return rows.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *NEW.fields]))
