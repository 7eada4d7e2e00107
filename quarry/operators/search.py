"""Full-text search: a plan becomes one lazy DataFrame, over texts as they are or over a written index.

Scores are Okapi BM25 (k1 = 1.2, b = 0.75) with idf = ln(1 + (n - df + 0.5) / (df + 0.5)), rounded to 6 places before they
order anything; ties go by path. Filters never score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.plans.lineage import cut
from quarry.plans.query import Node, SearchPlan, all_words, boolean, near_pattern, scoring_words, tokens

K1, B = 1.2, 0.75
FUZZY_WEIGHT = 0.8
#: Words up to which each is a column of counts; with more, a text's own words of the query are an array.
FEW = 8


def filters(plan: SearchPlan) -> list[Column]:
    """The plan's conditions on documents; those on plain columns reach the Parquet scan."""
    fold = (lambda c: c) if plan.case_sensitive else F.lower
    out = []
    if plan.min_size is not None:
        out.append(F.col("size") >= plan.min_size)
    if plan.max_size is not None:
        out.append(F.col("size") <= plan.max_size)
    if plan.min_modified is not None:
        out.append(F.col("modified") >= plan.min_modified)
    if plan.extensions:
        out.append(F.col("extension").isin(list(plan.extensions)))
    if plan.language:
        out.append(F.lower("language") == plan.language)
    for w in plan.keywords:
        out.append(F.array_contains(F.split(F.lower("keywords"), " "), w))
    if plan.path:
        out.append(fold(F.col("path")).contains(plan.path))
    if plan.title:
        out.append(F.coalesce(fold(F.col("title")).contains(plan.title), F.lit(False)))
    return out


def filtered(docs: DataFrame, plan: SearchPlan) -> DataFrame:
    for c in filters(plan):
        docs = docs.where(c)
    return docs


def joined(kind: str, parts: list[Column]) -> Column:
    """The conditions' conjunction or disjunction, as a balanced tree, so that long queries nest little."""
    while len(parts) > 1:
        parts = [(a & b[0] if kind == "and" else a | b[0]) if b else a for a, *b in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0]


def _matches(node: Node, at: dict[str, int]) -> Column:
    """The boolean query over columns tf (counts by word) and tokens."""
    if node.kind in ("all", "none"):
        return F.lit(node.kind == "all")
    if node.kind == "word":
        return F.col("tf")[at[node.words[0]]] > 0
    if node.kind == "phrase":
        return F.when(joined("and", [F.col("tf")[at[w]] > 0 for w in node.words]), _run(node)).otherwise(False)
    parts = [_matches(p, at) for p in node.parts]
    return ~parts[0] if node.kind == "not" else joined(node.kind, parts)


def _maybe(node: Node) -> Column:
    """A cheap condition on the text that all matches meet: words are substrings of the lower-cased text."""
    if node.kind in ("word", "phrase"):
        return joined("and", [F.lower("content").contains(w) for w in node.words])
    if node.kind in ("and", "or"):
        return joined(node.kind, [_maybe(p) for p in node.parts])
    return F.lit(node.kind != "none")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often plans above use it: they are not merged into a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def over_terms(node: Node, phrase: Callable[[Node], Column]) -> Column:
    """The boolean query over a column terms; phrase(node) has the condition of a phrase whose words are all there. Words side by side are
    one condition, however many they are."""
    has = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains("terms", w))
    if node.kind in ("all", "none"):
        return F.lit(node.kind == "all")
    if node.kind == "word":
        return F.array_contains("terms", node.words[0])
    if node.kind == "phrase":
        return F.when(has(node.words), phrase(node)).otherwise(False)
    if node.kind == "not":
        return ~over_terms(node.parts[0], phrase)
    words = [p.words[0] for p in node.parts if p.kind == "word"]
    own = [has(words) if node.kind == "and" else F.arrays_overlap("terms", F.array(*map(F.lit, words)))] if words else []
    return joined(node.kind, [*own, *(over_terms(p, phrase) for p in node.parts if p.kind != "word")])


def _run(node: Node) -> Column:
    # tokens hold no spaces, so a run of them is a substring between spaces
    return F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).contains(f" {' '.join(node.words)} ")


def counted(docs: DataFrame, words: list[str]) -> DataFrame:
    """docs with tokens, dl, and tf, an array of the words' counts."""
    out = once(docs, "tokens", fn.tokenise(F.col("content")))
    return once(out, "tf", F.array(*(F.size("tokens") - F.size(F.array_remove("tokens", w)) for w in words))).withColumn("dl", F.size("tokens"))


def _scored_long(docs: DataFrame, node: Node, words: list[str]) -> DataFrame:
    """scored() for queries of many words: what a text has of them is an array, and so are their counts."""
    own = once(once(docs, "tokens", fn.tokenise(F.col("content"))), "_own", F.filter("tokens", lambda t: t.isin(words))).withColumn("dl", F.size("tokens"))
    own = once(own, "_hits", F.transform(F.array_distinct("_own"), lambda w: F.struct(w.alias("term"), (F.size("_own") - F.size(F.array_remove("_own", w))).alias("tf"))))
    own = own.withColumn("terms", F.transform("_hits", lambda h: h["term"]))
    stats = own.where("content is not null").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # a row a word of the query at most
    df = own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("term", "k"))).alias("df"))
    hit = own.where(over_terms(node, _run)).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(df))
    plus = list(scoring_words(node))
    part = lambda h: F.when(h["term"].isin(plus), bm25(h["tf"].cast("double"), F.col("df")[h["term"]].cast("double"), F.col("dl").cast("double"), F.col("n").cast("double"), F.col("avgdl"))).otherwise(0.0)
    return hit.withColumn("score", F.round(F.aggregate("_hits", F.lit(0.0), lambda a, h: a + part(h)), 6)).select(*docs.columns, "score")


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def scored(docs: DataFrame, query: str) -> DataFrame:
    """docs with score (double) of those that match the boolean query; docs: content and more columns.

    Two scans: one for the statistics (a row, broadcast), one that matches and scores the texts that hold the words as
    substrings. Each cuts a text into tokens once. No shuffle of documents."""
    node = boolean(query) if query.strip() != "*" else Node("all")
    words = list(all_words(node))
    if not words:
        return docs.where(_matches(node, {})).withColumn("score", F.lit(1.0))
    if len(words) > FEW:
        return _scored_long(docs, node, words)
    at = {w: i for i, w in enumerate(words)}
    stats = counted(docs.where("content is not null").select("content"), words).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*(F.coalesce(F.sum((F.col("tf")[i] > 0).cast("long")), F.lit(0)) for i in range(len(words)))).alias("df"))
    hit = counted(docs.where(_maybe(node)), words).where(_matches(node, at)).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for w in scoring_words(node):
        score = score + bm25(F.col("tf")[at[w]].cast("double"), F.col("df")[at[w]].cast("double"), F.col("dl").cast("double"), F.col("n").cast("double"), F.col("avgdl"))
    return hit.withColumn("score", F.round(score, 6)).select(*docs.columns, "score")


def _near(docs: DataFrame, word: str) -> DataFrame:
    """(path, exact, score): documents with the word (exact; BM25) or else with words within one edit of it (substitution, insertion,
    deletion or swap; the sum of those words' BM25, times FUZZY_WEIGHT). One scan, which writes the matching words of each document that
    has any, and takes the statistics on its way."""
    rx, n = near_pattern(word), len(word)
    read = once(docs.select("path", "content"), "tokens", fn.tokenise(F.col("content"))).withColumn("dl", F.size("tokens"))
    seen = Observation()
    read = read.observe(seen, F.count("content").alias("n"), F.sum(F.when(F.col("content").isNotNull(), F.col("dl"))).alias("total"))
    found = once(read, "near", F.filter("tokens", lambda t: F.length(t).between(n - 1, n + 1) & t.rlike(rx))).where(F.size("near") > 0)
    # no shuffle before the write: what tasks observe counts once, even if executors are lost
    held = cut(found.select("path", "dl", "near"))
    rows = held.select("path", "dl", F.explode("near").alias("term")).groupBy("path", "dl", "term").agg(F.count("*").alias("tf"))
    count, total = seen.get["n"], seen.get["total"] or 0
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    part = bm25(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("dl").cast("double"), F.lit(float(count)), F.lit(total / max(count, 1)))
    own = F.col("term") == word
    per = rows.join(df, "term").groupBy("path").agg(F.max(own).alias("exact"), F.round(F.sum(F.when(own, part)), 6).alias("own"), F.round(FUZZY_WEIGHT * F.sum(F.when(~own, part)), 6).alias("others"))
    return per.select("path", "exact", F.when(F.col("exact"), F.col("own")).otherwise(F.col("others")).alias("score"))


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "path").limit(limit)


def search(docs: DataFrame, plan: SearchPlan) -> DataFrame:
    """The limit's best hits with all of docs' columns and score.

    docs: path (unique), content, title, extension, size, modified. Statistics are of all docs, filters apply after. If a
    single word has fewer hits than the limit, near words fill up the rest."""
    node = boolean(plan.text)
    if not (plan.fuzzy and node.kind == "word" and " " not in plan.text and '"' not in plan.text):
        return ranked(filtered(scored(docs, plan.text), plan), plan.limit)
    hits = filtered(docs, plan).join(_near(docs, node.words[0]), "path")
    exact = hits.where("exact")
    # whether near words count is decided in the plan, by the number of exact hits on the page
    found = F.broadcast(exact.limit(plan.limit).agg(F.count("*").alias("found")))
    return ranked(hits.crossJoin(found).where(F.col("exact") | (F.col("found") < plan.limit)).select(*docs.columns, "score"), plan.limit)


def page(hits: DataFrame, plan: SearchPlan, weights: Column | None = None) -> DataFrame:
    """What a result list shows: path, score, title, extension, modified, size, matched_terms, snippets (the three best fragments; weights: of
    the words of shown_words(plan), such as their idf)."""
    terms = list(plan.highlights)
    words = shown_words(plan) if plan.text != "*" else []
    out = fn.with_fragments(hits, "content", words, "snippets", weights)
    return out.select("path", "score", "title", "extension", "modified", "size", F.array(*map(F.lit, terms)).cast("array<string>").alias("matched_terms"), "snippets")


def shown_words(plan: SearchPlan) -> list[str]:
    """The tokens that snippets mark: those that score, and the title filter's."""
    return list(dict.fromkeys([*scoring_words(boolean(plan.text)), *tokens(plan.title or "")]))


def resort(hits: DataFrame, by: str) -> DataFrame:
    """Orders a page that is already limited: relevance, modified, size (nulls count as 0) or name."""
    keys = {"relevance": F.desc("score"), "modified": F.coalesce("modified", F.lit(0)).desc(), "size": F.coalesce("size", F.lit(0)).desc(), "name": F.lower(fn.display_title(F.col("title"), F.col("path"))).asc()}
    return hits.orderBy(keys[by], F.desc("score"), "path")


def recent(docs: DataFrame, limit: int) -> DataFrame:
    return docs.orderBy(F.desc("modified"), "path").limit(limit)
