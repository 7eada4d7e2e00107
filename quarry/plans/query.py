"""The query language, parsed on the driver into a SearchPlan: words, "phrases", OR, -exclusion, and ext: path: title: size: language: keywords:.

Operators stand at the start of a token; the last of a kind wins. What is left is the text query; an empty one matches all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime
from zoneinfo import ZoneInfo

KIB = 1024
DAY = 86_400
_OPERATOR = re.compile(r'(?<!\S)(ext|path|title|size|language|keywords):(?:"([^"]*)"|(\S+))', re.I)
_SIZE = re.compile(r"([<>]?)(\d+(?:\.\d+)?)(B|KB|MB|GB)?", re.I)
_POWER = {"": 0, "B": 0, "K": 1, "KB": 1, "M": 2, "MB": 2, "G": 3, "GB": 3}
#: Rolling look-backs of modified:, in days.
LOOK_BACK = {"today": 1, "yesterday": 2, "week": 7, "last-week": 7, "month": 30, "last-month": 30, "year": 365, "last-year": 365}
#: Extension presets.
CATEGORIES = {"documents": ("pdf", "docx", "md", "txt"), "source": ("rs", "py", "js", "ts", "cpp"), "data": ("json", "csv", "log", "xml"), "images": ("png", "jpg", "jpeg", "svg")}


@dataclass(frozen=True)
class ParsedQuery:
    text: str
    extension: str | None = None
    path: str | None = None
    title: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    case_sensitive: bool = False
    language: str | None = None
    keywords: tuple[str, ...] = ()


def size_bounds(value: str) -> tuple[int | None, int | None]:
    """Bounds of a size: operator, both inclusive; a bare size is both. (None, None) if it is none."""
    if not (m := _SIZE.fullmatch(value)):
        return None, None
    # halves go away from zero
    n = int(float(m[2]) * KIB ** _POWER[(m[3] or "").upper()] + 0.5)
    return {">": (n, None), "<": (None, n), "": (n, n)}[m[1]]


def parse(query: str, case_sensitive: bool = False) -> ParsedQuery:
    fold = (lambda s: s) if case_sensitive else str.lower
    out = ParsedQuery("", case_sensitive=case_sensitive)
    for m in _OPERATOR.finditer(query):
        value = m[2] if m[2] is not None else m[3]
        kind = m[1].lower()
        if kind == "ext":
            out = replace(out, extension=value.lstrip(".").lower() or None)
        elif kind == "size":
            low, high = size_bounds(value)
            if low is not None:
                out = replace(out, min_size=low)
            if high is not None:
                out = replace(out, max_size=high)
        elif kind == "language":
            out = replace(out, language=value.lower() or None)
        elif kind == "keywords":
            out = replace(out, keywords=(*out.keywords, *value.lower().split()))
        elif value:
            out = replace(out, **{kind: fold(value)})
    return replace(out, text=" ".join(_OPERATOR.sub(" ", query).split()) or "*")


def highlight_terms(query: str, case_sensitive: bool = False) -> list[str]:
    """Words to mark in results: the residual text's, without *, unless it stands alone, and the title filter's."""
    q = parse(query, case_sensitive)
    words = [w if case_sensitive else w.lower() for w in q.text.split() if w != "*"] or q.text.split()
    return words + [q.title] * bool(q.title)


def size_value(value: str) -> int | None:
    """An integer with k, kb, m, mb, g or gb in one case, or nothing."""
    m = re.fullmatch(r"\s*(\+?\d+)(kb?|mb?|gb?|KB?|MB?|GB?)?\s*", value)
    return int(m[1]) * KIB ** _POWER[(m[2] or "").upper()] if m else None


def size_filter(value: str) -> tuple[int | None, int | None]:
    """Bounds of a size field: > and < exclude the size itself; a bare size is a lower bound; decimals are cut off."""
    m = re.fullmatch(r"\s*(>=|<=|>|<)?\s*(\d+(?:\.\d*)?|\.\d+)\s*(B|KB|MB|GB)?\s*", value, re.I)
    if not m:
        return None, None
    n = int(float(m[2]) * KIB ** _POWER[(m[3] or "").upper()])
    return {">": (n + 1, None), "<": (None, max(0, n - 1)), "<=": (None, n)}.get(m[1], (n, None))


@dataclass(frozen=True)
class SearchPlan:
    """All that a search needs: text, filters and limit. Extensions are kept sorted, so equal plans are equal."""

    text: str = "*"
    limit: int = 50
    min_size: int | None = None
    max_size: int | None = None
    min_modified: int | None = None
    extensions: tuple[str, ...] = ()
    path: str | None = None
    title: str | None = None
    case_sensitive: bool = False
    fuzzy: bool = True
    highlights: tuple[str, ...] = field(default=())
    language: str | None = None
    keywords: tuple[str, ...] = ()


def inline_filters(query: str, now: int) -> tuple[str, dict]:
    """Lifts ext: (adds up), size: and modified: tokens out of a search box's text: what is left, and the values found."""
    rest, got = [], {"extensions": set(), "min_size": None, "max_size": None, "min_modified": None}
    for w in query.split():
        kind, _, value = w.partition(":")
        if kind == "ext" and _:
            got["extensions"].add(value.lower())
        elif kind == "size" and _:
            n = size_value(value.lstrip("<>") if value[:1] in "<>" else value)
            if n is not None:
                got["max_size" if value[0] == "<" else "min_size"] = n
        elif kind == "modified" and _:
            if days := LOOK_BACK.get(value.lower()):
                got["min_modified"] = max(0, now - days * DAY)
        else:
            rest.append(w)
    return " ".join(rest), got


def date_preset(name: str, now: int, zone: str = "UTC") -> int | None:
    """Lower bound of anytime, today (midnight in the zone), week or month (rolling)."""
    if name == "today":
        at = datetime.fromtimestamp(now, ZoneInfo(zone))
        return int(at.replace(hour=0, minute=0, second=0, microsecond=0).timestamp())
    return {"anytime": None, "week": max(0, now - 7 * DAY), "month": max(0, now - 30 * DAY)}[name]


def whole_words(query: str) -> str:
    """The query as one phrase, unless it starts or ends with a quote or has an operator."""
    return query if query[:1] == '"' or query[-1:] == '"' or ":" in query else f'"{query}"'


def toggle_category(chosen: set[str], category: str) -> set[str]:
    """Adds a preset's extensions, or takes them away if all are chosen already."""
    preset = set(CATEGORIES[category])
    return chosen - preset if preset <= chosen else chosen | preset


def plan(query: str, *, limit: int = 50, now: int = 0, case_sensitive: bool = False, whole_word: bool = False, fuzzy: bool = True, extensions: set[str] | None = None, min_size: int | None = None, max_size: int | None = None, min_modified: int | None = None) -> SearchPlan:
    """The whole front end: box text and fields to a plan. Filters in the text override the fields; extensions add up."""
    modified = re.compile(r"(?<!\S)modified:(\S+)", re.I)
    for m in modified.finditer(query):
        if days := LOOK_BACK.get(m[1].lower()):
            min_modified = max(0, now - days * DAY)
    query = modified.sub(" ", query).strip()
    terms = tuple(highlight_terms(query, case_sensitive))
    q = parse(whole_words(query) if whole_word and query else query, case_sensitive)
    every = set(extensions or ()) | ({q.extension} if q.extension else set())
    return SearchPlan(q.text, limit, q.min_size if q.min_size is not None else min_size, q.max_size if q.max_size is not None else max_size, min_modified, tuple(sorted(every)), q.path, q.title, case_sensitive, fuzzy, terms, q.language, q.keywords)


def front(text: str, *, limit: int = 50, now: int = 0, case_sensitive: bool = False, whole_word: bool = False, fuzzy: bool = True, types: str = "", chosen: set[str] | None = None, min_size: str = "", max_size: str = "", unit: str = "MB", size: str = "", date: str = "anytime", zone: str = "UTC", folder: str | None = None) -> SearchPlan:
    """A search form's plan: the box' text, a comma-separated list of types with those chosen besides, sizes in a unit or, where both are empty,
    one size filter, a date preset, and a folder. Filters in the text override the fields; extensions add up."""
    bounds: list[int | None] = [None, None]
    for i, value in enumerate((min_size, max_size)):
        # a number of units, decimals cut off; what is none is no bound
        if m := re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*", value):
            bounds[i] = int(float(m[1]) * KIB ** _POWER[unit.upper()])
    if not min_size.strip() and not max_size.strip():
        bounds = list(size_filter(size))
    every = {x.strip().lstrip(".").lower() for x in types.split(",")} - {""} | set(chosen or ())
    seed = f'path:"{folder}" ' if folder else ""
    words = text.split()
    # ext: and size: of the box add up and are integers with a unit; quoted values are the query language's
    lifted, got = inline_filters(" ".join(w for w in words if '"' not in w and w.partition(":")[0] in ("ext", "size", "modified")), now)
    rest = " ".join([*(w for w in words if '"' in w or w.partition(":")[0] not in ("ext", "size", "modified")), *lifted.split()])
    every |= {x.lstrip(".") for x in got["extensions"]} - {""}
    low, high = (got[k] if got[k] is not None else b for k, b in zip(("min_size", "max_size"), bounds, strict=True))
    since = got["min_modified"] if got["min_modified"] is not None else date_preset(date, now, zone)
    return plan(seed + rest, limit=limit, now=now, case_sensitive=case_sensitive, whole_word=whole_word, fuzzy=fuzzy, extensions=every, min_size=low, max_size=high, min_modified=since)


# ---- boolean text queries


@dataclass(frozen=True)
class Node:
    """word, phrase (words in a row), and, or, not, all, none. `words` are tokens of the index."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()


TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> tuple[str, ...]:
    """The tokeniser for query text: lower-cased runs of letters and numbers."""
    return tuple(TOKEN.findall(text.lower()))


def boolean(text: str) -> Node:
    """Words are all needed; OR joins its neighbours' groups; - excludes a word or phrase; an unclosed quote ends with the text."""
    groups: list[list[Node]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', text):
        word = m[3]
        if word == "OR":
            groups.append([])
            continue
        if word == "*":
            groups[-1].append(Node("all"))
            continue
        minus = m[1] if word is None else word[0] if word[0] == "-" and len(word) > 1 else ""
        ts = tokens(m[2] if word is None else word)
        if ts:
            leaf = Node("word", ts) if len(ts) == 1 else Node("phrase", ts)
            groups[-1].append(Node("not", (), (leaf,)) if minus else leaf)
    ands = [g[0] if len(g) == 1 else Node("and", (), tuple(g)) for g in groups if g]
    return Node("none") if not ands else ands[0] if len(ands) == 1 else Node("or", (), tuple(ands))


def scoring_words(node: Node) -> tuple[str, ...]:
    """Words outside of exclusions, once each, in order: those that score."""
    if node.kind == "not":
        return ()
    return tuple(dict.fromkeys([*node.words, *(w for p in node.parts for w in scoring_words(p))]))


def all_words(node: Node) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*node.words, *(w for p in node.parts for w in all_words(p))]))


def near_pattern(word: str) -> str:
    """A regular expression for all words within one substitution, insertion, deletion or swap of neighbours."""
    c = [re.escape(x) if not x.isalnum() else x for x in word]
    n = len(c)
    out = {"".join(c)}
    for i in range(n + 1):
        out.add("".join(c[:i]) + "." + "".join(c[i:]))
        if i < n:
            out |= {"".join(c[:i]) + "." + "".join(c[i + 1 :]), "".join(c[:i] + c[i + 1 :])}
        if i + 1 < n:
            out.add("".join(c[:i] + [c[i + 1], c[i]] + c[i + 2 :]))
    return "^(?:" + "|".join(sorted(x for x in out if x)) + ")$"
