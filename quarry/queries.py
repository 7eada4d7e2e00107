"""Registered queries of the engine, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators import filename, index, language, preview, search, sinks, state, stats
from quarry.operators.store import Store
from quarry.plans import folders
from quarry.plans import query as q
from quarry.plans.lineage import cut, new_path
from quarry.plans.settings import Settings
from quarry.sources.files import select_files
from quarry.sources.tree import folder_paths
from quarry.streaming import watch

#: The moment that queries with look-backs take for now: an hour after document 600.
NOW = 1704067200 + 601 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as indexed documents."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("txt", "md", "pdf", "rs", "json"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return d.select(
        "doc_id",
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.col("text").alias("content"), F.element_at(F.split("text", "\n", 2), 1).alias("title"), ext.alias("extension"), F.col("lang").alias("language"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).cast("long").alias("modified"), F.octet_length("text").cast("long").alias("size"),
    )


DOCS = """docs AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.' || (['txt','md','pdf','rs','json'])[doc_id % 5 + 1] AS path,
 text AS content, split_part(text, chr(10), 1) AS title, (['txt','md','pdf','rs','json'])[doc_id % 5 + 1] AS extension, lang AS language,
 1704067200 + doc_id * 3600 AS modified, strlen(text)::BIGINT AS size FROM documents)"""
TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def ranked_sql(words: list[str], plus: list[str], match: str, limit: int, where: str = "TRUE", columns: str = "path, score") -> str:
    """SQL of a scored query: match is over tf1, tf2, ... and content."""
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(words, 1))
    df = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(1, len(words) + 1))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, w in enumerate(words, 1) if w in plus) or "0.0::DOUBLE"
    return f"""WITH {DOCS}, t AS (SELECT *, {TOKENS} AS toks FROM docs), c AS (SELECT *, len(toks)::DOUBLE AS dl, {tf} FROM t),
 s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM c), h AS (SELECT c.*, round({score}, 6) AS score FROM c, s WHERE {match})
 SELECT {columns} FROM h WHERE {where} ORDER BY score DESC, path LIMIT {limit}"""


PLANS: dict[str, q.SearchPlan] = {"ft_all_star": q.plan("*"), "ft_fuzzy_backfill": q.plan("wiht", limit=500), "index_one_word": q.plan("with", limit=20)}


def text_query(name: str, text: str, words: list[str], match: str, plus: list[str] | None = None, limit: int = 50, where: str = "TRUE", **fields) -> None:
    PLANS[name] = plan = q.plan(text, limit=limit, now=NOW, fuzzy=False, **fields)
    register(name, ranked_sql(words, words if plus is None else plus, match, limit, where))(lambda spark, d: search.search(corpus(spark, d), plan).select("path", "score"))


text_query("ft_and_bm25", "the and with", ["the", "and", "with"], "tf1 > 0 AND tf2 > 0 AND tf3 > 0")
text_query("ft_or", "licensed OR reserved OR privacy", ["licensed", "reserved", "privacy"], "tf1 > 0 OR tf2 > 0 OR tf3 > 0")
text_query("ft_not", "der die -und", ["der", "die", "und"], "tf1 > 0 AND tf2 > 0 AND NOT tf3 > 0", ["der", "die"])
text_query("ft_phrase", '"of the"', ["of", "the"], r"regexp_matches(lower(content), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the($|[^\p{L}\p{N}])')")
text_query("ft_mixed", '"of the" with OR les -de', ["of", "the", "with", "les", "de"], r"(regexp_matches(lower(content), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the($|[^\p{L}\p{N}])') AND tf3 > 0) OR (tf4 > 0 AND NOT tf5 > 0)", ["of", "the", "with", "les"])
text_query("ft_whole_word", "is the", ["is", "the"], r"regexp_matches(lower(content), '(^|[^\p{L}\p{N}])is[^\p{L}\p{N}]+the($|[^\p{L}\p{N}])')", whole_word=True)
text_query("filter_combined", "ext:md path:src1 size:>500B the", ["the"], "tf1 > 0", where="extension = 'md' AND lower(path) LIKE '%src1%' AND size >= 500 AND modified >= 1704067200 + 100 * 3600", min_modified=1704067200 + 100 * 3600)


@register("ft_all_star", f"WITH {DOCS} SELECT path, 1.0::DOUBLE AS score FROM docs ORDER BY path LIMIT 50")
def ft_all_star(spark, d):
    return search.search(corpus(spark, d), PLANS["ft_all_star"]).select("path", "score")


NEAR = q.near_pattern("wiht")


@register(
    "ft_fuzzy_backfill",
    f"""WITH {DOCS}, t AS (SELECT *, {TOKENS} AS toks FROM docs), c AS (SELECT *, len(toks)::DOUBLE AS dl, len(list_filter(toks, lambda t: t = 'wiht'))::DOUBLE AS tf FROM t),
 s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, sum((tf > 0)::INT)::DOUBLE AS df FROM c),
 e AS (SELECT path, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE tf > 0),
 x AS (SELECT path, dl, unnest(toks) AS term FROM c), r AS (SELECT path, dl, term, count(*)::DOUBLE AS tf FROM x WHERE regexp_full_match(term, '{NEAR}') AND term <> 'wiht' GROUP BY ALL),
 v AS (SELECT term, count(*)::DOUBLE AS df FROM r GROUP BY term),
 f AS (SELECT path, round(0.8 * sum(ln(1 + (n - v.df + 0.5) / (v.df + 0.5)) * r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM r JOIN v USING (term), s GROUP BY path),
 u AS (SELECT * FROM e UNION ALL SELECT * FROM f WHERE path NOT IN (SELECT path FROM e) AND (SELECT count(*) FROM e) < 500)
 SELECT path, score FROM u ORDER BY score DESC, path LIMIT 500""",
)
def ft_fuzzy_backfill(spark, d):
    return search.search(corpus(spark, d), PLANS["ft_fuzzy_backfill"]).select("path", "score")


def by_index(spark: SparkSession, d: str, plan: q.SearchPlan) -> DataFrame:
    """The plan's page from an index of the documents, which is written to the shared folder, searched, and deleted when the page is held: the work is
    the same whatever ran before, and no index is left."""
    path = new_path(spark)
    index.write(corpus(spark, d), path)
    page = cut(index.search(spark, path, plan).select("path", "score"))
    folders.delete(spark, path)
    return search.ranked(page, plan.limit)


@register("ft_index_search", ranked_sql(["the", "of", "threr"], ["the", "of", "threr"], "(tf1 > 0 AND tf2 > 0) OR tf3 > 0", 100))
def ft_index_search(spark, d):
    """The same scores from a written index, the writing included."""
    return by_index(spark, d, q.plan("the of OR threr", limit=100))


# the scan's queries once more, with their SQL, by the index
for _name in ("ft_and_bm25", "ft_or", "ft_not", "ft_phrase", "ft_mixed", "ft_whole_word", "filter_combined", "ft_all_star", "ft_fuzzy_backfill"):
    register(f"index_{_name}", ORACLE[_name])(lambda spark, d, p=PLANS[_name]: by_index(spark, d, p))


@register("index_one_word", ranked_sql(["with"], ["with"], "tf1 > 0", 20))
def index_one_word(spark, d):
    """Most blocks of a frequent word cannot reach the page, and are not read."""
    return by_index(spark, d, PLANS["index_one_word"])


@register("index_exclusion", ranked_sql(["the", "der"], [], "NOT tf1 > 0 AND NOT tf2 > 0", 50))
def index_exclusion(spark, d):
    """Documents without words, by the index: only exclusions."""
    return by_index(spark, d, q.plan("-the -der"))


def filter_query(name: str, text: str, where: str, **fields) -> None:
    register(name, f"WITH {DOCS} SELECT path, title, size, modified FROM docs WHERE {where}")(lambda spark, d: search.filtered(corpus(spark, d), q.plan(text, now=NOW, **fields)).select("path", "title", "size", "modified"))


filter_query("filter_ext", "ext:.PDF", "extension = 'pdf'")
filter_query("filter_path", "path:SRC12", "contains(lower(path), 'src12')")
filter_query("filter_title", 'title:"the and"', "coalesce(contains(lower(title), 'the and'), false)")
filter_query("filter_size", "size:>1.5KB size:<4KB", "size >= 1536 AND size <= 4096")
filter_query("filter_modified", "modified:week", f"modified >= {NOW - 7 * 86400}")
filter_query("filter_category", "*", "extension IN ('pdf', 'docx', 'md', 'txt')", extensions=q.toggle_category(set(), "documents"))
for _mode, _order in (("modified", "coalesce(modified, 0) DESC"), ("size", "coalesce(size, 0) DESC"), ("name", "lower(title)"), ("relevance", "score DESC")):
    register(f"sort_{_mode}", f"SELECT row_number() OVER (ORDER BY {_order}, score DESC, path) AS place, path FROM ({ranked_sql(['the'], ['the'], 'tf1 > 0', 40, columns='path, score, modified, size, title')})")(
        lambda spark, d, mode=_mode: _placed(search.search(corpus(spark, d), q.plan("the", limit=40, fuzzy=False)), mode)
    )


def _placed(hits: DataFrame, mode: str) -> DataFrame:
    from pyspark.sql import Window

    keys = {"modified": F.coalesce("modified", F.lit(0)).desc(), "size": F.coalesce("size", F.lit(0)).desc(), "name": F.lower(fn.display_title(F.col("title"), F.col("path"))).asc(), "relevance": F.desc("score")}
    # a page of at most the plan's limit: one task's window is bounded
    return search.resort(hits, mode).withColumn("place", F.row_number().over(Window.orderBy(keys[mode], F.desc("score"), "path")).cast("long")).select("place", "path")


@register("recent_files", f"WITH {DOCS} SELECT path, title, modified, size FROM docs ORDER BY modified DESC, path LIMIT 50")
def recent_files(spark, d):
    return search.recent(corpus(spark, d), 50).select("path", "title", "modified", "size")


@register("index_stats", "SELECT count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_bytes FROM documents")
def index_stats(spark, d):
    return stats.index_stats(corpus(spark, d))


@register("vocab_df", f"WITH {DOCS}, x AS (SELECT doc_id, unnest({TOKENS}) AS term FROM docs), t AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM t GROUP BY term")
def vocab_df(spark, d):
    return index.vocabulary(corpus(spark, d))


@register("postings_rows", f"WITH {DOCS}, t AS (SELECT path, {TOKENS} AS toks FROM docs), x AS (SELECT path, len(toks) AS dl, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM t) SELECT term, path, count(*)::INT AS tf, any_value(dl)::INT AS dl, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos FROM x GROUP BY term, path")
def postings_rows(spark, d):
    return index.postings(corpus(spark, d)).select("term", "path", "tf", "dl", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


def names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string"), F.lit("/"), "p_name").alias("path"), F.col("p_name").alias("name"))


NAMES = "f AS (SELECT '/parts/' || p_partkey || '/' || p_name AS path, p_name AS name, lower(p_name) AS l FROM part)"


def name_sql(text: str) -> str:
    """Scores spelled out by characters; the table's names are ASCII."""
    t, n = text.lower(), len(text)
    first = f"instr(l, '{t[0]}')"
    ctes = [f"s1 AS (SELECT *, {first} AS p1 FROM f)"]
    for i, c in enumerate(t[1:], 2):
        ctes.append(f"s{i} AS (SELECT *, CASE WHEN p{i - 1} > 0 AND instr(substr(l, p{i - 1} + 1), '{c}') > 0 THEN p{i - 1} + instr(substr(l, p{i - 1} + 1), '{c}') ELSE 0 END AS p{i} FROM s{i - 1})")
    score = f"CASE WHEN l = '{t}' THEN 0 WHEN starts_with(l, '{t}') THEN 1 + (strlen(l) - {n}) * 0.001::DOUBLE WHEN contains(l, '{t}') THEN 2 + (instr(l, '{t}') - 1) * 0.01::DOUBLE + (strlen(l) - {n}) * 0.001::DOUBLE ELSE 3 + greatest(p{n} - p1 + 1 - {n}, 0) * 0.1::DOUBLE + (p1 - 1) * 0.01::DOUBLE + strlen(l) * 0.001::DOUBLE END"
    return f"WITH {NAMES}, {', '.join(ctes)} SELECT path, name, round(({score})::DOUBLE, 6) AS score FROM s{n} WHERE p{n} > 0 ORDER BY score, l, path LIMIT 100"


for _name, _text in (("exact", "small ring"), ("prefix", "small"), ("substr", "ring"), ("subseq", "smg")):
    register(f"fn_search_{_name}", name_sql(_text))(lambda spark, d, text=_text: filename.search(names(spark, d), text, 100))


_indexes: dict[tuple[str, str], str] = {}


def dictionary(spark: SparkSession, d: str) -> str:
    """A written dictionary of the names, in the shared folder; one for the session."""
    key = spark.sparkContext.applicationId, f"{d} names"
    if key not in _indexes:
        path = new_path(spark)
        filename.write(names(spark, d), path)
        _indexes[key] = path
    return _indexes[key]


for _name, _text in (("prefix", "small"), ("subseq", "smg")):
    register(f"fn_lookup_{_name}", name_sql(_text))(lambda spark, d, text=_text: filename.lookup(spark, dictionary(spark, d), text, 100))


@register("filename_stats", f"WITH {NAMES} SELECT count(*) AS n_files, sum(strlen(path) + strlen(name) + 32)::BIGINT AS n_bytes FROM f")
def filename_stats(spark, d):
    return filename.stats(names(spark, d))


def file_state(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return docs.where(i % 3 != 0).select("path", (F.col("modified") - F.when(i % 7 == 0, 60).otherwise(0)).alias("modified"), (F.col("size") + F.when(i % 11 == 0, 1).otherwise(0)).alias("size"), fn_hash().alias("content_hash"))


def fn_hash():
    return state.content_hash(F.col("content"))


STATE = "state AS (SELECT path, modified - CASE WHEN doc_id % 7 = 0 THEN 60 ELSE 0 END AS modified, size + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size, sha256(content) AS content_hash FROM docs WHERE doc_id % 3 <> 0)"


@register("stale_check", f"WITH {DOCS}, {STATE} SELECT d.path, CASE WHEN s.path IS NULL THEN 'new' WHEN d.modified <> s.modified OR d.size <> s.size THEN 'stale' ELSE 'same' END AS status FROM docs d LEFT JOIN state s ON d.path = s.path")
def stale_check(spark, d):
    docs = corpus(spark, d)
    return state.staleness(docs, file_state(docs)).select("path", "status")


@register("change_gate", f"WITH {DOCS}, {STATE} SELECT d.path, CASE WHEN s.path IS NOT NULL AND d.modified = s.modified AND d.size = s.size THEN 'skip' WHEN s.content_hash = sha256(d.content) THEN 'touch' ELSE 'index' END AS action FROM docs d LEFT JOIN state s ON d.path = s.path")
def change_gate(spark, d):
    docs = corpus(spark, d)
    return state.change_gate(docs, docs.withColumn("content_hash", fn_hash()), file_state(docs)).select("path", "action")


@register("content_dedup", f"WITH {DOCS} SELECT sha256(content) AS content_hash, min(path) AS path, count(*) AS copies FROM docs GROUP BY 1")
def content_dedup(spark, d):
    return state.distinct_content(corpus(spark, d))


@register("ext_allowlist", f"WITH {DOCS} SELECT path FROM docs WHERE extension IN ('md', 'rs', 'toml')")
def ext_allowlist(spark, d):
    out = select_files(corpus(spark, d).select(fn.file_name(F.col("path")).alias("name"), F.col("path").alias("full"), "size").withColumn("path", F.col("name")), Settings(exclude_patterns=[], exclude_folders=[], include_hidden=True), allowed=["md", "rs", "toml"])
    return out.select(F.col("full").alias("path"))


@register("size_limit", f"WITH {DOCS} SELECT path, size FROM docs WHERE size <= 2048")
def size_limit(spark, d):
    return select_files(corpus(spark, d), Settings(exclude_patterns=[], exclude_folders=[]), allowed=["txt", "md", "pdf", "rs", "json"], limit=2048).select("path", "size")


@register("exclude_globs", f"WITH {DOCS} SELECT path FROM docs WHERE NOT regexp_matches(path, '/src1/|/doc_[^/]*7\\.pdf$|/de/')")
def exclude_globs(spark, d):
    return corpus(spark, d).where(~fn.excluded(F.col("path"), ["src1/", "doc_*7.pdf", "de"])).select("path")


UPDATE = "i AS (SELECT path, size, modified AS indexed_at FROM docs), n AS (SELECT path, size + 10 AS size, indexed_at + 60 AS indexed_at FROM i WHERE size % 4 = 0 UNION ALL SELECT path || '.new', size, indexed_at FROM i WHERE size % 10 = 0)"


@register("upsert_latest", f"WITH {DOCS}, {UPDATE}, u AS (SELECT *, 0 AS k FROM i UNION ALL SELECT *, 1 FROM n) SELECT path, size, indexed_at FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, k DESC) = 1")
def upsert_latest(spark, d):
    i = corpus(spark, d).select("path", "size", F.col("modified").alias("indexed_at"))
    n = i.where("size % 4 = 0").select("path", (F.col("size") + 10).alias("size"), (F.col("indexed_at") + 60).alias("indexed_at"))
    n = n.unionByName(i.where("size % 10 = 0").withColumn("path", F.concat("path", F.lit(".new"))))
    return state.upsert(i, n)


@register("delete_paths", f"WITH {DOCS} SELECT path FROM docs WHERE size >= 1000")
def delete_paths(spark, d):
    docs = corpus(spark, d).select("path", "size")
    return state.delete(docs, docs.where("size < 1000")).select("path")


@register("purge_prefix", f"WITH {DOCS} SELECT path FROM docs WHERE NOT (path = '/corpus/src1' OR starts_with(path, '/corpus/src1/'))")
def purge_prefix(spark, d):
    return state.purge(corpus(spark, d), "/corpus/src1/").select("path")


TREE = """tree AS (SELECT 0::BIGINT AS id, 0::BIGINT AS parent_id, '' AS name UNION ALL SELECT 1 + r_regionkey, 0, r_name FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name FROM nation)"""


@register("mft_paths", f"WITH RECURSIVE {TREE}, p AS (SELECT id, '' AS path FROM tree WHERE id = parent_id UNION ALL SELECT t.id, p.path || '/' || t.name FROM tree t JOIN p ON t.parent_id = p.id WHERE t.id <> t.parent_id) SELECT p.path || '/' || c_name AS path FROM customer JOIN p ON p.id = 100 + c_nationkey")
def mft_paths(spark, d):
    root = spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.lit("").alias("name"))
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    dirs = folder_paths(root.unionByName(r).unionByName(n)).select("id", F.col("path").alias("dir"))
    files = table(spark, d, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("id"), "c_name")
    return files.join(dirs, "id").select(F.concat("dir", F.lit("/"), "c_name").alias("path"))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("/corpus/user_"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_type") == "error", "Remove").otherwise("Index").alias("action"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type")


EVENTS = "e AS (SELECT '/corpus/user_' || user_id AS path, CASE WHEN event_type = 'error' THEN 'Remove' ELSE 'Index' END AS action, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type FROM events)"


@register("events_lww", f"WITH {EVENTS} SELECT path, arg_max(action, seq) AS action, max(seq) AS seq FROM e GROUP BY path")
def events_lww(spark, d):
    return watch.last_of_each(events(spark, d))


@register("events_debounce", f"""WITH RECURSIVE {EVENTS}, o AS (SELECT event_type, seq, t, row_number() OVER (PARTITION BY event_type ORDER BY t, seq) AS r FROM e),
 w AS (SELECT event_type, seq, t, r, t AS first, 0::BIGINT AS flush FROM o WHERE r = 1 UNION ALL
 SELECT o.event_type, o.seq, o.t, o.r, CASE WHEN o.t - w.t > 300 OR o.t - w.first > 1800 THEN o.t ELSE w.first END, w.flush + CASE WHEN o.t - w.t > 300 OR o.t - w.first > 1800 THEN 1 ELSE 0 END FROM w JOIN o ON o.event_type = w.event_type AND o.r = w.r + 1)
 SELECT event_type, seq, flush FROM w""")
def events_debounce(spark, d):
    return watch.debounce(events(spark, d), key="event_type", gap=300, cap=1800).select("event_type", "seq", "flush")


@register("event_exclude", f"WITH {EVENTS} SELECT path, action, seq FROM e WHERE NOT regexp_matches(path, '(^|/)user_[^/]*7(/|$)') AND action = 'Remove'")
def event_exclude(spark, d):
    return watch.relevant(events(spark, d), ["user_*7"], ["md"]).select("path", "action", "seq")


def search_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))


LOG = "l AS (SELECT text AS query, conv_id * 1000 + turn AS asked FROM conversations WHERE role = 'user')"


@register("search_history", f"WITH {LOG} SELECT query, count(*) AS frequency, max(asked) AS last_used FROM l GROUP BY query ORDER BY frequency DESC, last_used DESC, query LIMIT 50")
def search_history(spark, d):
    return stats.history(search_log(spark, d))


@register("recent_searches", f"WITH {LOG} SELECT query, max(asked) AS last_used FROM l GROUP BY query ORDER BY last_used DESC, query LIMIT 10")
def recent_searches(spark, d):
    return stats.recent_searches(search_log(spark, d))


@register("pinned", "WITH p AS (SELECT conv_id, arg_max(turn % 2, turn) AS last, max(turn) AS pinned_at FROM conversations GROUP BY conv_id) SELECT 'conv_' || conv_id AS path, pinned_at FROM p WHERE last = 0")
def pinned(spark, d):
    c = table(spark, d, "conversations")
    return stats.pinned(c.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("path"), F.when(F.col("turn") % 2 == 0, "pin").otherwise("unpin").alias("action"), F.col("turn").alias("at")))


@register("snippet_html", rf"""WITH {DOCS}, m AS (SELECT path, content, regexp_extract(content, '(?is)^(.*?(?:^|[^\p{{L}}\p{{N}}]))the(?:$|[^\p{{L}}\p{{N}}])', 1) AS pre FROM docs WHERE regexp_matches(content, '(?i)(^|[^\p{{L}}\p{{N}}])the($|[^\p{{L}}\p{{N}}])')),
 c AS (SELECT path, substr(content, greatest(length(pre) - 75, 0)::BIGINT + 1, 150) AS cut FROM m)
 SELECT path, array_to_string(list_transform(regexp_extract_all(cut, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), lambda t: CASE WHEN lower(t) = 'the' THEN '<b>' || t || '</b>' ELSE t END), '') AS snippet FROM c""")
def snippet_html(spark, d):
    return corpus(spark, d).select("path", fn.snippet(F.col("content"), ["the"]).alias("snippet")).where("snippet is not null")


@register("snippet_best", rf"""WITH {DOCS}, w AS (SELECT path, regexp_extract_all(content, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS p FROM docs WHERE content IS NOT NULL),
 t AS (SELECT path, p, list_transform(p, lambda x: lower(regexp_extract(x, '^[\p{{L}}\p{{N}}]+'))) AS t FROM w),
 s AS (SELECT count(*)::DOUBLE AS n, sum(list_contains(t, 'the')::INT)::DOUBLE AS d1, sum(list_contains(t, 'with')::INT)::DOUBLE AS d2, sum(list_contains(t, 'der')::INT)::DOUBLE AS d3 FROM t),
 v AS (SELECT ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) AS w1, ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) AS w2, ln(1 + (n - d3 + 0.5) / (d3 + 0.5)) AS w3 FROM s),
 k AS (SELECT path, p, t, unnest(range(0, (len(t) + 11) // 12)) AS k FROM t),
 c AS (SELECT path, k, p[12 * k + 1 : 12 * k + 24] AS fp, t[12 * k + 1 : 12 * k + 24] AS ft FROM k),
 f AS (SELECT path, k, fp, ft, CASE WHEN list_contains(ft, 'the') THEN w1 ELSE 0 END + CASE WHEN list_contains(ft, 'with') THEN w2 ELSE 0 END + CASE WHEN list_contains(ft, 'der') THEN w3 ELSE 0 END AS score FROM c, v),
 g AS (SELECT * FROM f WHERE score > 0),
 b1 AS (SELECT path, max({{'score': score, 'at': -k}}) AS b FROM g GROUP BY path),
 b2 AS (SELECT g.path, max({{'score': score, 'at': -k}}) AS b FROM g JOIN b1 USING (path) WHERE abs(k + b1.b.at) >= 2 GROUP BY g.path),
 b3 AS (SELECT g.path, max({{'score': score, 'at': -k}}) AS b FROM g JOIN b1 USING (path) JOIN b2 USING (path) WHERE abs(k + b1.b.at) >= 2 AND abs(k + b2.b.at) >= 2 GROUP BY g.path),
 a AS (SELECT path, 1 AS place, b FROM b1 UNION ALL SELECT path, 2, b FROM b2 UNION ALL SELECT path, 3, b FROM b3)
 SELECT a.path, place, rtrim(array_to_string(list_transform(list_zip(fp, ft), lambda z: CASE WHEN z[2] IN ('the', 'with', 'der') THEN '<b>' || regexp_extract(z[1], '^[\p{{L}}\p{{N}}]+') || '</b>' || regexp_extract(z[1], '[^\p{{L}}\p{{N}}]*$') ELSE z[1] END), ''), ' ') AS snippet FROM a JOIN g ON g.path = a.path AND g.k = -a.b.at""")
def snippet_best(spark, d):
    """The three best fragments of every text for three words, weighed by their rarity in all texts."""
    docs, words = corpus(spark, d), ["the", "with", "der"]
    found = search.counted(docs.where("content is not null").select("content"), words).agg(F.count("*").cast("double").alias("n"), *(F.sum((F.col("tf")[i] > 0).cast("double")).alias(f"d{i}") for i in range(3)))
    rarity = found.select(F.array(*(F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)) for i in range(3))).alias("rarity"))
    rows = fn.with_fragments(docs.select("path", "content").crossJoin(F.broadcast(rarity)), "content", words, "snippets", F.col("rarity"))
    return rows.select("path", F.posexplode("snippets").alias("place", "snippet")).select("path", (F.col("place") + 1).alias("place"), "snippet")


@register("highlight_spans", f"WITH {DOCS} SELECT path, len(regexp_extract_all(content, '(?i)(the|and)')) AS hits, strlen(content)::BIGINT AS bytes FROM docs")
def highlight_spans(spark, d):
    s = corpus(spark, d).select("path", fn.spans(F.col("content"), ["the", "and"]).alias("s"))
    return s.select("path", F.size(F.filter("s", lambda x: x["hit"])).cast("long").alias("hits"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["text"])).alias("bytes"))


@register("preview_elements", r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS h FROM pages),
 x AS (SELECT page_id, k, unnest(regexp_extract_all(h, '(?is)<' || k || '\b[^>]*>(.*?)</' || k || '\s*>', 1)) AS t FROM c, (SELECT unnest(['title', 'h1', 'p', 'li']) AS k)),
 y AS (SELECT page_id, k, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS content FROM x)
 SELECT page_id, CASE k WHEN 'title' THEN 'Title' WHEN 'h1' THEN 'Heading' WHEN 'p' THEN 'NarrativeText' ELSE 'ListItem' END AS element_type, content FROM y WHERE content <> ''""")
def preview_elements(spark, d):
    return preview.elements(table(spark, d, "pages")).select("page_id", "element_type", "content")


@register("export_rows", f"SELECT score AS \"Score\", path AS \"File Path\", coalesce(title, '') AS \"Title\" FROM ({ranked_sql(['die'], ['die'], 'tf1 > 0', 20, columns='path, score, title')})")
def export_rows(spark, d):
    return sinks.export_rows(search.search(corpus(spark, d), q.plan("die", limit=20, fuzzy=False)))


@register("export_json", f"""SELECT path, '{{"path":' || to_json(path) || ',"score":' || CASE WHEN score >= 0.001 AND score < 10000000 THEN score::VARCHAR ELSE NULL END || ',"title":' || coalesce(to_json(title)::VARCHAR, 'null') || ',"size":' || size || '}}' AS json
 FROM ({ranked_sql(['die'], ['die'], 'tf1 > 0', 20, columns='path, score, title, size')})""")
def export_json(spark, d):
    return sinks.json_rows(search.search(corpus(spark, d), q.plan("die", limit=20, fuzzy=False)).select("path", "score", "title", "size"))


CHANGES = """cur AS (SELECT path, content, title, extension, modified, size FROM docs WHERE NOT starts_with(path, '/corpus/src2/') AND size >= 300 AND size % 4 <> 0
 UNION ALL SELECT path, 'the ' || content, title, extension, modified + 60, size + 4 FROM docs WHERE NOT starts_with(path, '/corpus/src2/') AND size >= 300 AND size % 4 = 0)"""


def changed(spark: SparkSession, d: str, what: Callable[[Store], DataFrame]) -> DataFrame:
    """what of a store of the documents after an upsert, a deletion and a purge, and after its segments were merged. The store is deleted
    when the rows are held."""
    docs = corpus(spark, d).drop("doc_id").withColumn("content_hash", fn_hash())
    none = docs.limit(0).select("path")
    store = Store(spark, new_path(spark))
    store.apply(docs, none, 1)
    new = docs.where("size % 4 = 0").withColumns({"content": F.concat(F.lit("the "), "content"), "modified": F.col("modified") + 60, "size": F.col("size") + 4})
    # what is both changed and small is put in anew, then deleted
    store.apply(new, docs.where("size < 300").select("path"), 2)
    store.remove(docs.where("size < 300").select("path"))
    store.purge("/corpus/src2/")
    store.compact(2)
    rows = cut(what(store))
    store.pages.clear()
    folders.delete(spark, store.root)
    return rows


@register("store_rows", f"WITH {DOCS}, {CHANGES} SELECT path, size, modified, sha256(content) AS digest FROM cur")
def store_rows(spark, d):
    return changed(spark, d, lambda store: store.read("documents").select("path", "size", "modified", fn_hash().alias("digest")))


@register("store_search", ranked_sql(["the", "with", "die"], ["the", "with", "die"], "(tf1 > 0 AND tf2 > 0) OR tf3 > 0", 100).replace(DOCS, f"{DOCS}, {CHANGES}").replace("AS toks FROM docs", "AS toks FROM cur"))
def store_search(spark, d):
    """Ranked search over the store's segments: documents that no longer count are in no statistic."""
    plan = q.plan("the with OR die", limit=100)
    return search.ranked(changed(spark, d, lambda store: store.search(plan).select("path", "score")), plan.limit)


@register("language_guess")
def language_guess(spark, d):
    """The language of every document by trigrams, beside the one it is labelled with."""
    docs = table(spark, d, "documents")
    return language.classify(docs.select("doc_id", "lang", "text"), language.train(docs), name="guess").select("doc_id", "lang", "guess")


@register("human_size", f"WITH {DOCS}, x AS (SELECT path, size * 1000 * (doc_id % 7) AS s FROM docs) SELECT path, CASE WHEN s >= 1073741824 THEN printf('%.2f GB', s / 1073741824) WHEN s >= 1048576 THEN printf('%.1f MB', s / 1048576) WHEN s >= 1024 THEN printf('%.1f KB', s / 1024) ELSE printf('%d B', s) END AS human FROM x")
def human_size(spark, d):
    return corpus(spark, d).select("path", fn.human_size(F.col("size") * 1000 * (F.col("doc_id") % 7)).alias("human"))


@register("human_date", f"WITH {DOCS} SELECT path, strftime(to_timestamp(modified) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS human FROM docs")
def human_date(spark, d):
    return corpus(spark, d).select("path", fn.human_date(F.col("modified"), "UTC").alias("human"))


@register("badges", f"WITH {DOCS} SELECT path, CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'rs' THEN 'code' WHEN 'json' THEN 'code' ELSE 'text' END AS badge FROM docs")
def badges(spark, d):
    return corpus(spark, d).select("path", fn.badge(F.col("extension")).alias("badge"))
