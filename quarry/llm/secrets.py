"""Secret scans: patterns for credentials, and a guess-cost measure for values that stand in a credential's context.

The guess cost of a value is the least cost, in powers of ten, of cutting it into spans that an attacker would try in turn:
known words (with capitals and look-alike characters), dates, repeats, keyboard walks, and brute force for the rest. Each
cut costs a further power. The table runs over end positions; walks, repeats and brute force are states that grow from one position
to the next, so every segmentation counts and long values take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import small_batches
from quarry.llm.words import MOST, common, installed

# The base patterns, as the contract of the query has them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: What makes a context in which a value's guess cost is measured.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|bearer|(?:api|access|private|client|secret)[_-]?(?:key|secret))["']?[\x20\t]*(?:[:=]|=>|\bis\b)[\x20\t]*["']?([^\s"'<>,;]{8,})""", re.I | re.A)
#: The same in headers.
HEADER = re.compile(r"""(?<![A-Za-z0-9])(?:authorization["']?[\x20\t]*[:=][\x20\t]*["']?(?:bearer|basic|token)|bearer)[\x20\t]+([^\s"'<>,;]{8,})""", re.I | re.A)
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Values as dear as this, in powers of ten guesses, count as secrets.
LEAST_COST = 10.0

# Words that people choose, by rank; after them come the words of the vocabularies.
WORDS = (
    "password love hello welcome admin login letmein monkey dragon master sunshine princess football baseball shadow michael "
    "superman batman trustno ninja mustang access flower freedom whatever starwars computer summer winter spring autumn "
    "secret test user guest root qwerty iloveyou charlie jordan pepper ginger cookie cheese orange banana purple silver "
    "golden diamond hunter ranger soccer hockey killer george thomas andrew daniel robert jessica ashley nicole michelle "
    "joshua matthew chelsea arsenal liverpool london paris berlin madrid system server database change default temp public "
    "private token key example sample my your the and for you me is pass word com net org"
).split()
LOOKS = str.maketrans({"4": "a", "@": "a", "3": "e", "0": "o", "1": "l", "!": "i", "5": "s", "$": "s", "7": "t", "8": "b"})
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")


#: Places of the keys: row, and column with the half-key offset of the rows.
KEYS = {c: (r, i + r / 2) for r, row in enumerate(ROWS) for i, c in enumerate(row)}


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from a key to one that it touches; None if they don't touch."""
    if a not in KEYS or b not in KEYS or a == b:
        return None
    (r, x), (s, y) = KEYS[a], KEYS[b]
    return (s - r, 1 if y > x else -1) if abs(r - s) <= 1 and abs(x - y) <= 1 else None


_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:1[0-2]|0?[1-9])[-/.]?(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])[-/.]?(?:1[0-2]|0?[1-9])[-/.]?(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")
#: Characters of a date; of a repeated unit, at most; of a walk, at least.
DATES, UNIT, WALK = range(4, 11), 8, 4
#: What a walk costs for its first key and length, and for each turn; what a repeat costs for its number.
FIRST_KEY, TURN, TIMES = math.log10(len(KEYS)) + 1, math.log10(4) / 2, 1.0


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


@lru_cache(maxsize=4)
def ranks(vocabularies: tuple[str, ...] | None = None) -> dict[str, int]:
    """Known words by rank: WORDS, then those of the vocabulary files (None: the installed ones). Kept a worker and choice of files."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *common(installed() if vocabularies is None else vocabularies)]))}


def word_cost(value: str, known: dict[str, int] | None = None) -> float | None:
    """What a known word of three letters at least costs, by rank, capitals and look-alikes; None for others."""
    low = value.lower()
    plain = low.translate(LOOKS)
    rank = (ranks() if known is None else known).get(plain) if len(value) >= 3 else None
    return math.log10(rank) + 0.3 * (value != low) + 0.3 * (low != plain) if rank else None


def date_cost(value: str) -> float | None:
    return math.log10(365 * 120 if len(value) > 4 else 120) if len(value) in DATES and _DATE.fullmatch(value) else None


def unit_cost(value: str, known: dict[str, int] | None = None) -> float:
    """What the unit of a repeat costs: as a word or by brute force."""
    return min(sum(map(_alphabet, value)), word_cost(value, known) or math.inf)


def guess_cost(value: str, known: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation takes; 0 for an empty value.

    Spans: a word, a date, a unit of up to UNIT characters two or more times in a row, a walk of WALK or more keys, and any span
    by brute force. Each costs its own, and 1 more unless it is the first. known: words by rank, ranks() if None."""
    known = ranks() if known is None else known
    n = len(value)
    low = value.lower()
    plain = low.translate(LOOKS)
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    walks = [[math.inf] * (n + 1) for _ in range(WALK)]  # by keys so far, the last of them for WALK or more
    repeats = [[math.inf] * (n + 1) for _ in range(UNIT + 1)]
    same = [0] * (UNIT + 1)  # characters in a row that equal the ones a unit before
    way = None
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], best[j - 1] + (j > 1)) + _alphabet(value[j - 1])
        least = brute[j]
        for i in range(max(0, j - MOST), j - 2):
            if plain[i:j] in known:
                least = min(least, best[i] + (i > 0) + word_cost(value[i:j], known))
        if low[j - 1].isdigit():
            for i in range(max(0, j - DATES[-1]), j - DATES[0] + 1):
                if low[i].isdigit() and (cost := date_cost(low[i:j])) is not None:
                    least = min(least, best[i] + (i > 0) + cost)
        before, way = way, _step(low[j - 2], low[j - 1]) if j > 1 else None
        if low[j - 1] in KEYS:
            walks[0][j] = best[j - 1] + (j > 1) + FIRST_KEY
        if way is not None:
            walks[1][j] = walks[0][j - 1] + TURN
            on = TURN * (way != before)
            for k in range(2, WALK):
                walks[k][j] = walks[k - 1][j - 1] + on
            walks[-1][j] = min(walks[-1][j], walks[-1][j - 1] + on)
            least = min(least, walks[-1][j])
        for p in range(1, UNIT + 1):
            same[p] = same[p] + 1 if j > p and value[j - 1] == value[j - 1 - p] else 0
            if same[p] >= p:
                i = j - 2 * p
                repeats[p][j] = min(repeats[p][j - p], best[i] + (i > 0) + unit_cost(value[j - p : j], known) + TIMES)
                least = min(least, repeats[p][j])
        best[j] = least
    return best[n]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping within a kind; too short matches are dropped."""
    low, out = text.lower(), []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def guessed_spans(text: str, base: list[tuple[int, str, int]], least: float = LEAST_COST, known: dict[str, int] | None = None) -> list[tuple[int, str, int, float]]:
    """Values in a credential's context that no base span meets and whose guess cost is at least that, whatever characters
    they consist of."""
    low = text.lower()
    if not any(h in low for h in _CONTEXT_HINTS):
        return []
    out = []
    for m in sorted([*CONTEXT.finditer(text), *HEADER.finditer(text)], key=lambda m: m.start(1)):
        value, a = m[1].rstrip(".:)]}!?"), m.start(1)
        b = a + len(value)
        if len(value) >= 8 and not any(s < b and a < e for s, _, e in base) and not (out and a < out[-1][2]):
            if (cost := guess_cost(value, known)) >= least:
                out.append((a, "guess", b, cost))
    return out


def assigned_cost(text: str, base: list[tuple[int, str, int]], known: dict[str, int] | None = None) -> float | None:
    """The largest guess cost of the values of assignments that base spans hold; None if there is none."""
    return max((guess_cost(ASSIGN.match(text, a)[2], known) for a, kind, _ in base if kind == "assign"), default=None)


def join_spans(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def scan(docs: DataFrame, *, text: str = "text", least: float = LEAST_COST, vocabularies: Sequence[str] | None = None) -> DataFrame:
    """Replaces the text by n_assign, n_access, n_hex, n_guess long, base_sha256 string, spans string, max_guess_cost
    double (of the added spans; null if there is none) and max_assign_cost double (of the values that the base pattern of assignments
    finds, which count whatever they cost). Spans are kind:start:end in code points, end exclusive. vocabularies: paths of the
    files that known words are read from, by each worker (None: those of the installed public_tokenizers package).

    A null text counts as empty; long texts are scanned whole; rows, ties and repeated rows stay as they are; an empty
    table gives an empty table; other columns stay, those with a new column's name are replaced. Narrow, no shuffle."""
    small_batches(docs.sparkSession)
    new = ["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "max_guess_cost", "max_assign_cost"]
    kept = [c for c in docs.columns if c not in new and c != text]

    files = None if vocabularies is None else tuple(vocabularies)

    def run(batches):
        known = ranks(files)
        for batch in batches:
            rows = []
            for x in batch.column(batch.schema.get_field_index(text)).to_pylist():
                base = base_spans(x or "")
                more = guessed_spans(x or "", base, least, known)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), len(more), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans([*base, *(m[:3] for m in more)]), max((m[3] for m in more), default=None), assigned_cost(x or "", base, known)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [pa.array(c, pa.int64() if i < 4 else pa.string() if i < 6 else pa.float64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *arrays], names=[*kept, *new])

    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType()] * 2
    return docs.select(*kept, text).mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))]))
