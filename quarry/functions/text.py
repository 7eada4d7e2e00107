"""Column functions of the engine, all on Catalyst's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenise(text: Column) -> Column:
    """Lower-cased runs of letters and numbers, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension of the file name, null if there is none; dot-files have none."""
    e = F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)
    return F.when(e != "", F.lower(e))


def display_title(title: Column, path: Column) -> Column:
    name = file_name(path)
    return F.coalesce(title, F.when(name != "", name), path)


def _fixed(size: Column, bits: int, places: int) -> Column:
    """size / 2**bits with that many places; halves go to the even digit, exactly."""
    whole = size.cast("decimal(38,0)") * 10**places
    q = F.floor(whole / (1 << bits))
    r2 = (whole - q * (1 << bits)) * 2
    up = (r2 > 1 << bits) | ((r2 == 1 << bits) & (q % 2 == 1))
    digits = F.lpad((q + F.when(up, 1).otherwise(0)).cast("long").cast("string"), 20, "0")
    return F.concat(F.regexp_replace(F.substring(digits, 1, 20 - places), "^0+(?=.)", ""), F.lit("."), F.substring(digits, 21 - places, places))


def human_size(size: Column) -> Column:
    """Bytes below 1 KB, one place of KB and MB, two of GB."""
    out = F.when(size >= 1 << 30, F.concat(_fixed(size, 30, 2), F.lit(" GB"))).when(size >= 1 << 20, F.concat(_fixed(size, 20, 1), F.lit(" MB")))
    return out.when(size >= 1 << 10, F.concat(_fixed(size, 10, 1), F.lit(" KB"))).otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))


def human_date(seconds: Column, zone: str | None = None) -> Column:
    """Date and minute in the zone, the session's by default."""
    at = F.timestamp_seconds(seconds)
    return F.date_format(at if zone is None else F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone), "yyyy-MM-dd HH:mm")


# Classes of files by extension.
BADGES = {
    "pdf": ["pdf"],
    "code": "rs py js ts cpp c cs java go html css json toml yaml".split(),
    "text": "md txt doc docx rtf".split(),
    "image": "png jpg jpeg svg gif webp".split(),
    "media": "mp4 mkv mp3 wav flac".split(),
}


def badge(ext: Column) -> Column:
    out = None
    for name, exts in BADGES.items():
        c = F.lower(ext).isin(exts)
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise("other")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression that finds a match of one path component or of the whole path. * and ? stay within
    components, ** crosses them; a pattern that ends in / is a folder's name."""
    p, out, i = pattern.rstrip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + (re.escape(p[i]) if not p[i].isalnum() else p[i]), i + 1
    return f"^{out}$" if "/" in p and p.startswith(("/", "**")) else f"(?:^|/){out}(?:/|$)"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern meets the path. One regular expression, so one pass of the path."""
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def _alternation(terms: list[str], case_sensitive: bool) -> str | None:
    """Longer terms first, so that overlapping ones mark the longest."""
    ts = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return ("" if case_sensitive else "(?iu)") + "(" + "|".join(re.escape(t) if not t.isalnum() else t for t in ts) + ")" if ts else None


def spans(text: Column, terms: list[str], case_sensitive: bool = False) -> Column:
    """array<struct<text, hit>>: the text cut into runs that match a term and runs that don't, without empty ones."""
    rx = _alternation(terms, case_sensitive)
    if rx is None:
        return F.when(text != "", F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))).otherwise(F.array().cast("array<struct<text:string,hit:boolean>>"))
    rest, hits = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(1))
    one = lambda t, hit: F.struct(t.alias("text"), F.lit(hit).alias("hit"))
    pairs = F.flatten(F.transform(F.arrays_zip(rest.alias("a"), hits.alias("b")), lambda x: F.array(one(x["a"], False), one(x["b"], True))))
    return F.filter(pairs, lambda s: s["text"].isNotNull() & (s["text"] != ""))


def marked(text: Column, terms: list[str], case_sensitive: bool = False) -> Column:
    rx = _alternation(terms, case_sensitive)
    return F.regexp_replace(text, rx, "<b>$1</b>") if rx else text


def snippet(text: Column, terms: list[str], width: int = 150) -> Column:
    """The stretch of `width` characters around the first whole-word match, with matches of terms as whole words in <b>; null
    without a match."""
    words = [t for t in terms if t]
    if not words:
        return F.lit(None).cast("string")
    alt = "|".join(sorted(words, key=lambda t: (-len(t), t)))
    word = rf"(?iu)(?<![\p{{L}}\p{{N}}])({alt})(?![\p{{L}}\p{{N}}])"
    at = F.length(F.split(text, word, 2)[0])
    cut = F.substring(text, F.greatest(at - width // 2, F.lit(0)) + 1, F.lit(width))
    return F.when(text.rlike(word), F.regexp_replace(cut, word, "<b>$1</b>"))


#: Words of a fragment; fragments begin at every half of that.
FRAGMENT = 24


def with_fragments(rows: DataFrame, text: str, terms: list[str], name: str, weights: Column | None = None, most: int = 3) -> DataFrame:
    """rows with `name`, array<string>: up to `most` disjoint stretches of FRAGMENT words that have terms (single tokens, lower-case), the best
    first, with the terms in <b>. A stretch's score is the sum of the weights (array<double>, in the terms' order; 1 each by default)
    of the different terms in it; the earlier is the better among equals. Empty for a null text and without a match."""
    if not terms:
        return rows.withColumn(name, F.array().cast("array<string>"))
    half = FRAGMENT // 2
    once = lambda df, column, value: df.select("*", F.explode(F.array(value)).alias(column))  # noqa: E731  computed once a row
    weights = F.array(*[F.lit(1.0)] * len(terms)) if weights is None else weights
    out = once(rows, "_p", F.coalesce(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+[^\p{L}\p{N}]*)"), F.lit(1)), F.array().cast("array<string>")))
    out = once(out, "_t", F.transform("_p", lambda p: F.lower(F.regexp_extract(p, r"^[\p{L}\p{N}]+", 0))))
    # for each half stretch, which terms it has
    halves = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / half).cast("int")))
    out = once(out, "_h", F.coalesce(F.transform(halves, lambda k: F.transform(F.array(*map(F.lit, terms)), lambda w: F.array_contains(F.slice("_t", k * half + 1, half), w))), F.array().cast("array<array<boolean>>")))
    out = once(out, "_w", weights)
    has = lambda k, i: F.element_at(F.get("_h", k), i + 1) | F.coalesce(F.element_at(F.get("_h", k + 1), i + 1), F.lit(False))
    score = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(len(terms) - 1)), F.lit(0.0), lambda a, i: a + F.when(has(k, i), F.get("_w", i)).otherwise(0.0))
    every = F.filter(F.transform("_h", lambda h, k: F.struct(score(k).alias("score"), (-k).alias("at"))), lambda c: c["score"] > 0)
    out = once(out, "_c", every)
    # the best, then the best of those that don't touch it, and so on
    empty = F.array().cast("array<struct<score:double,at:int>>")
    pick = lambda left, chosen: F.array_max(F.filter(left, lambda c: ~F.exists(chosen, lambda d: F.abs(c["at"] - d["at"]) < 2)))
    out = once(out, "_chosen", F.aggregate(F.sequence(F.lit(1), F.lit(most)), empty, lambda a, _: F.concat(a, F.filter(F.array(pick(F.col("_c"), a)), lambda c: c.isNotNull()))))
    mark = lambda p, t: F.when(t.isin(terms), F.concat(F.lit("<b>"), F.regexp_extract(p, r"^[\p{L}\p{N}]+", 0), F.lit("</b>"), F.regexp_extract(p, r"[^\p{L}\p{N}]*$", 0))).otherwise(p)
    words = lambda c: F.slice(F.arrays_zip(F.col("_p").alias("p"), F.col("_t").alias("t")), -c["at"] * half + 1, FRAGMENT)
    shown = F.transform("_chosen", lambda c: F.rtrim(F.array_join(F.transform(words(c), lambda x: mark(x["p"], x["t"])), "")))
    return out.select(*rows.columns, shown.alias(name))


def snippet_spans(snip: Column) -> Column:
    """array<struct<text, hit>> of a snippet with <b> marks."""
    one = lambda t, hit: F.struct(t.alias("text"), F.lit(hit).alias("hit"))
    pieces = F.split(snip, "<b>", -1)
    rest = F.flatten(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.array(one(F.split(p, "</b>", 2)[0], True), one(F.coalesce(F.get(F.split(p, "</b>", 2), F.lit(1)), F.lit("")), False))))
    return F.filter(F.concat(F.array(one(pieces[0], False)), rest), lambda s: s["text"] != "")
