"""Keywords of one text by its own statistics: where a word stands, how often, in how many sentences, in what case, among how many others."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from statistics import median, pstdev

_SENTENCE, _WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W_]+")


def keywords(text: str, most: int = 10, shortest: int = 4) -> list[str]:
    """Up to `most` lower-cased words, the most telling first; ties by the alphabet. Words of fewer than `shortest` characters and numbers are
    none; words that stand beside many different ones, as those that tie a text together do, come last."""
    sentences = [s for s in (_WORD.findall(p) for p in _SENTENCE.split(text)) if s]
    tf, upper, places = Counter(), Counter(), defaultdict(list)
    before, after = defaultdict(Counter), defaultdict(Counter)
    for i, words in enumerate(sentences):
        low = [w.lower() for w in words]
        for j, (w, raw) in enumerate(zip(low, words, strict=True)):
            tf[w] += 1
            places[w].append(i)
            upper[w] += raw[0].isupper() and j > 0
            if j:
                before[w][low[j - 1]] += 1
                after[low[j - 1]][w] += 1
    counts = [n for w, n in tf.items() if len(w) >= shortest and not w.isdigit()]
    if not counts:
        return []
    mean, spread, top = sum(counts) / len(counts), pstdev(counts), max(tf.values())

    def weight(w: str) -> float:
        """Smaller is more telling."""
        spread_out = len(set(places[w])) / len(sentences)
        sides = [len(c) / sum(c.values()) for c in (before[w], after[w]) if c]
        ties = 1 + (sum(sides) if sides else 0.0) * tf[w] / top
        position = math.log(math.log(3 + median(places[w])))
        case = upper[w] / (1 + math.log(tf[w]))
        often = tf[w] / (mean + spread)
        return ties * ties * position / (case + often / ties + spread_out / ties)

    found = [(weight(w), w) for w in tf if len(w) >= shortest and not w.isdigit()]
    return [w for _, w in sorted(found)[:most]]
