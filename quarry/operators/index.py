"""A written inverted index: a document table in an order that puts like ones together, postings in blocks, a dictionary for look-ups of near words; and top-k
search that reads no block which cannot reach the page.

Documents are numbered by language, where they have one, and length, within the tasks that they are read in, so no text is shuffled; 2**BITS neighbours in that
order are a range. A block has one term's postings in one range, with their number and its peaks: the pairs of frequency and length that no other pair of the block exceeds in both, whose best score
is the block's best whatever the corpus' averages are. A search adds up the bounds of its words range by range from those
few columns, scores the best ranges' blocks, and then only ranges whose bound reaches the page's last score.

An index has one part or several (segments of a store), and documents that no longer count. Statistics are always those of the documents
that count, so scores are the same as a scan's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators.search import FUZZY_WEIGHT, bm25, filtered, filters, joined, once, over_terms, ranked
from quarry.plans import folders
from quarry.plans.lineage import bounded_batches
from quarry.plans.query import Node, SearchPlan, all_words, boolean, near_pattern, scoring_words

VERSION = "3"
#: Documents of a range, as a power of two.
BITS = 6
#: Bytes of a row group of documents, which a task can read alone; bytes of documents whose blocks a task orders in memory; blocks whose words a
#: task of the dictionary gets, about.
GROUP, READ, WORDS = 4 << 20, 16 << 20, 1 << 20
#: Ranges that are scored first: these, and one more for each so many hits of the page, up to a number that the driver can hold the hits of.
FIRST, HITS_A_RANGE, MOST_FIRST = 12, 8, 512
#: Characters up to which a word's neighbours are written as keys; longer words are compared one by one.
LONG = 48
#: The term of all documents that have a text.
EVERY = ""
#: docs: places in the range; positions: those of all postings, one after the other, tf of each.
_BLOCKS = "term string, range long, n int, total long, peaks array<struct<tf:int,dl:int>>, docs array<tinyint>, tf array<int>, dl array<int>, positions array<int>"


# ---- writing


def _blocks_of(docs: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
    """Blocks of a batch of documents in their order: tokens sorted by range, term, document and place in one go."""
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    owner = np.repeat(np.arange(len(docs)), length)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    ranges, group = np.unique(docs >> BITS, return_inverse=True)
    # each document with a text once more, under the term of all
    every = np.flatnonzero(there)
    key = np.concatenate([group[owner] * (len(words) + 1) + code, group[every] * (len(words) + 1) + len(words)])
    owner, place = np.concatenate([owner, every]), np.concatenate([place, np.zeros(len(every), np.int64)])
    order = np.argsort(key, kind="stable")
    key, owner, place = key[order], owner[order], place[order]
    change = lambda a: np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    posting = np.union1d(change(key), change(owner))
    block = np.searchsorted(posting, change(key))
    of = key[posting[block]]
    term = of % (len(words) + 1)
    tf, dl = np.diff(np.append(posting, len(key))), length[owner[posting]]
    n, ends = np.diff(np.append(block, len(posting))), pa.array(np.append(block, len(posting)).astype(np.int32))
    total = np.where(term == len(words), np.add.reduceat(dl, block), np.add.reduceat(tf, block)) if len(block) else np.zeros(0, np.int64)
    # peaks: by falling frequency, the documents shorter than all before; earlier blocks are lifted above, so that each begins anew
    at = np.repeat(np.arange(len(block)), n)
    falling = np.lexsort((dl, -tf, at))
    lifted = dl[falling] + (len(block) - at[falling]) * (int(dl.max(initial=0)) + 1)
    peak = falling[np.concatenate([[True], lifted[1:] < np.minimum.accumulate(lifted)[:-1]])] if len(block) else falling
    peaks = pa.StructArray.from_arrays([pa.array(x[peak].astype(np.int32)) for x in (tf, dl)], names=["tf", "dl"])
    peaks = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[peak], np.arange(len(block) + 1)).astype(np.int32)), peaks)
    names = pa.concat_arrays([words.cast(pa.string()), pa.array([EVERY], pa.string())]).take(pa.array(term))
    listed = lambda a, kind: pa.ListArray.from_arrays(ends, pa.array(a.astype(kind)))
    places = pa.ListArray.from_arrays(pa.array(np.append(posting[block], len(key)).astype(np.int32)), pa.array(place.astype(np.int32)))
    columns = [names, pa.array(ranges[of // (len(words) + 1)]), pa.array(n.astype(np.int32)), pa.array(total.astype(np.int64)), peaks, listed(docs[owner[posting]] & ((1 << BITS) - 1), np.int8), listed(tf, np.int32), listed(dl, np.int32), places]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCKS.split(", ")])


def blocks(docs: DataFrame) -> DataFrame:
    """docs: doc (long), content. Rows (term, range, n, total, peaks, docs, tf, dl, positions): texts are cut into tokens once, and a batch's
    blocks are complete in it but for ranges that it cuts, which have several. Nothing is shuffled."""
    bounded_batches(docs.sparkSession, 1 << 10)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _blocks_of(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))

    return docs.select("doc", fn.tokenise(F.col("content")).alias("tokens")).mapInArrow(run, _BLOCKS)


def postings(docs: DataFrame) -> DataFrame:
    """(term, path, tf, dl, positions) of documents (path, content): made within each document's row, without a shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                # a range a document: a block is a posting
                made = _blocks_of(np.arange(batch.num_rows, dtype=np.int64) << BITS, batch.column(1))
                term = made.column(0)
                own = pc.not_equal(term, EVERY)
                out = pa.RecordBatch.from_arrays([term, batch.column(0).take(made.column(1)), made.column(6).flatten(), made.column(7).flatten(), made.column(8)], names=["term", "path", "tf", "dl", "positions"])
                yield out.filter(own)

    return docs.select("path", fn.tokenise(F.col("content")).alias("tokens")).mapInArrow(run, "term string, path string, tf int, dl int, positions array<int>")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term, in one pass: terms are summed within tasks, so what is shuffled is a row for
    each term and task. Built-in expressions only."""
    own = once(docs.select("content"), "tokens", fn.tokenise(F.col("content")))
    one = lambda terms, df, cf: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(df).cast("long").alias("df"), F.lit(cf).cast("long").alias("cf")))
    # each token once, and each of a document's terms once more
    rows = own.select(F.inline(F.concat(one("tokens", 0, 1), one(F.array_distinct("tokens"), 1, 0))))
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _keys(term: Column) -> Column:
    """Hashes of a word and of what is left of it without one of its characters: words within one edit, or a swap of neighbours, share one."""
    less = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.concat(term.substr(F.lit(1), i - 1), term.substr(i + 1, F.length(term))))
    return F.array_distinct(F.transform(F.concat(F.array(term), less), lambda k: F.hash(k)))


def _bloom(column: str) -> dict[str, str]:
    """A Bloom filter of a column, as large as its values ask for: a small part's are small."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true", f"parquet.bloom.filter.candidates.number#{column}": "14"}


def write_docs(docs: DataFrame, path: str) -> DataFrame:
    """Writes documents (path, not null; content; more columns), numbered as doc in each task's order of language and length, and reads them
    back. Nothing is shuffled, and each is computed once."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    order = [*(F.col(c) for c in docs.columns if c == "language"), size, F.col("path")]
    # numbers begin anew with each task, so ranges don't cross them
    numbered = docs.sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())
    numbered.write.options(**_bloom("path"), **{"parquet.block.size": str(GROUP)}).parquet(path)
    return docs.sparkSession.read.parquet(path)


def write_blocks(rows: DataFrame, path: str) -> None:
    """Writes the blocks and the dictionary of written documents below path. A task's blocks are ordered by term, so that a term's are
    side by side in each file; shuffled are words alone."""
    spark = rows.sparkSession
    name = "spark.sql.files.maxPartitionBytes"
    now = spark.conf.get(name)
    try:
        spark.conf.set(name, str(READ))
        _write_blocks(rows, path)
    finally:
        spark.conf.set(name, now)


def _write_blocks(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    blocks(rows).sortWithinPartitions("term", "range").write.options(**_bloom("term"), **{"parquet.page.size": str(128 << 10), "compression": "zstd"}).parquet(f"{path}/blocks")
    written = spark.read.parquet(f"{path}/blocks")
    words = written.where(F.col("term") != EVERY).select("term").distinct().repartition(1 + written.count() // WORDS, "term")
    keyed = words.select("term", F.explode(F.when(F.length("term") <= LONG, _keys(F.col("term"))).otherwise(F.array(F.lit(None).cast("int")))).alias("key"))
    keyed.sortWithinPartitions("key").write.options(**_bloom("key"), compression="zstd").parquet(f"{path}/near")


def write_part(docs: DataFrame, path: str) -> int:
    """Writes documents (path, unique and not null; content; more columns), their blocks and their dictionary below path; the number of
    documents."""
    rows = write_docs(docs, f"{path}/docs")
    write_blocks(rows, path)
    return rows.count()


def write(docs: DataFrame, path: str) -> None:
    """An index of one part, at a path where there is none, or in place of the one there: a new one is written beside and named last, in a file
    of which there is a new one each time, so readers see the old one or the new one."""
    spark = docs.sparkSession
    numbers = [int(n) for n, _ in folders.entries(spark, path) if n.isdigit()]
    new = str(max(numbers, default=0) + 1)
    n = write_part(docs, f"{path}/{new}")
    spark.createDataFrame([(VERSION, n)], "version string, n long").coalesce(1).write.parquet(f"{path}/{new}/marker")
    for old in numbers[:-1]:  # the one before stays, for readers that hold it
        folders.delete(spark, f"{path}/{old}")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the newest part that is whole and of this version."""
    for n in sorted((int(n) for n, _ in folders.entries(spark, path) if n.isdigit()), reverse=True):
        if folders.exists(spark, f"{path}/{n}/marker/_SUCCESS"):
            if (found := spark.read.parquet(f"{path}/{n}/marker").first()["version"]) != VERSION:
                raise ValueError(f"an index of version {found}, not {VERSION}")
            return f"{path}/{n}"
    raise ValueError(f"no index at {path}")


def open_or_rebuild(spark: SparkSession, path: str, docs: DataFrame) -> bool:
    """Rebuilds an index that is missing, unreadable or of another version, keeping it as .backup; whether it did."""
    try:
        current(spark, path)
        return False
    except Exception:  # noqa: BLE001  whatever makes it unreadable
        pass
    if folders.exists(spark, path):
        folders.delete(spark, f"{path}.backup")
        folders.move(spark, path, f"{path}.backup")
    write(docs, path)
    return True


# ---- searching


@dataclass(frozen=True)
class Stats:
    n: float
    avgdl: float
    df: dict[str, float]


class Index:
    """Parts of an index (folders that write_part() filled) and, in dead (seg, doc), the documents that no longer count; seg is a
    folder's last name."""

    def __init__(self, spark: SparkSession, parts: list[str], dead: DataFrame | None = None) -> None:
        self.spark, self.parts, self.dead = spark, parts, dead

    def _read(self, table: str) -> DataFrame:
        seg = F.regexp_extract(F.col("_metadata.file_path"), f"([^/]+)/{table}/[^/]*$", 1)
        return self.spark.read.parquet(*(f"{p}/{table}" for p in self.parts)).select("*", seg.alias("seg"))

    def all_docs(self) -> DataFrame:
        """Rows of all parts with seg and doc, those that no longer count as well."""
        return self._read("docs")

    def docs(self) -> DataFrame:
        docs = self.all_docs()
        return docs if self.dead is None else docs.join(self.dead.select("seg", "doc"), ["seg", "doc"], "left_anti")

    def _of(self, words: list[str]) -> DataFrame:
        return self._read("blocks").where(F.col("term").isin(words))

    @staticmethod
    def _opened(rows: DataFrame, phrase: bool) -> DataFrame:
        """A row a posting."""
        before = lambda i: F.aggregate(F.slice("tf", F.lit(1), i), F.lit(0), lambda a, n: a + n)
        own = F.transform("docs", lambda p, i: F.struct(p.alias("place"), F.get("tf", i).alias("tf"), F.get("dl", i).alias("dl"), *([F.slice("positions", before(i) + 1, F.get("tf", i)).alias("positions")] if phrase else [])))
        doc = (F.shiftleft("range", BITS) + F.col("p.place")).alias("doc")
        return rows.select("seg", "term", "range", F.explode(own).alias("p")).select("seg", "term", doc, "p.tf", "p.dl", *(["p.positions"] if phrase else []))

    def stats(self, words: list[str]) -> Stats:
        """Statistics of the documents that count: sums over blocks' numbers, less the postings of the others, read in their ranges alone."""
        rows = self._of([*words, EVERY])
        sums = {r["term"]: (r["n"], r["total"]) for r in rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
        gone: dict[str, tuple[int, int]] = {}
        if self.dead is not None:
            where = self.dead.select("seg", F.shiftright("doc", BITS).alias("range")).distinct()
            lost = self._opened(rows.join(where, ["seg", "range"], "left_semi"), False).join(self.dead.select("seg", "doc"), ["seg", "doc"], "left_semi")
            gone = {r["term"]: (r["n"], r["dl"]) for r in lost.groupBy("term").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()}
        left = {w: sums.get(w, (0, 0))[0] - gone.get(w, (0, 0))[0] for w in [*words, EVERY]}
        length = sums.get(EVERY, (0, 0))[1] - gone.get(EVERY, (0, 0))[1]
        return Stats(float(left[EVERY]), length / left[EVERY] if left[EVERY] else 0.0, {w: float(left[w]) for w in words})

    def search(self, plan: SearchPlan, report: dict | None = None) -> DataFrame:
        """The plan's page: all columns of the documents, and score; what search.search() gives of the same documents.

        Runs small jobs to find the page's last score; the driver gets a row a word, and the hits of the FIRST ranges. report gets
        ranges and blocks: of the query's words, and how many were read."""
        if plan.text.strip() == "*":
            return ranked(filtered(self.docs(), plan).withColumn("score", F.lit(1.0)).drop("seg", "doc"), plan.limit)
        node = boolean(plan.text)
        hits = self._top(node, plan, report=report)
        if not (plan.fuzzy and node.kind == "word" and " " not in plan.text and '"' not in plan.text):
            return self._page(hits, plan)
        page = self._page(hits, plan)
        if len(page.select("path").collect()) >= plan.limit:
            return page
        near = self.near(node.words[0])
        if not near:
            return page
        # documents with a near word and not the word itself
        either = Node("or", (), tuple(Node("word", (w,)) for w in near)) if len(near) > 1 else Node("word", (near[0],))
        more = self._top(Node("and", (), (either, Node("not", (), (node,)))), plan, weight=FUZZY_WEIGHT)
        return self._page(hits.unionByName(more), plan)

    def near(self, word: str) -> list[str]:
        """Words of the dictionary within one edit of the word, or a swap of neighbours, other than itself. As many as there are characters, times
        the word's length and twice that, at most."""
        keys = [r["k"] for r in self.spark.range(1).select(F.explode(_keys(F.lit(word))).alias("k")).collect()] if len(word) <= LONG + 1 else []
        key = F.col("key").isin(keys)
        if len(word) >= LONG:
            # some words within an edit are too long for keys
            key = key | (F.col("key").isNull() & F.length("term").between(len(word) - 1, len(word) + 1))
        found = self._read("near").where(key).where(F.col("term").rlike(near_pattern(word)) & (F.col("term") != word))
        return sorted(r["term"] for r in found.select("term").distinct().collect())

    def _page(self, hits: DataFrame, plan: SearchPlan) -> DataFrame:
        docs = self.all_docs()
        # the page is cut by paths alone, then its rows get their other columns: texts are not shuffled
        page = ranked(hits.join(docs.select("seg", "doc", "path"), ["seg", "doc"]), plan.limit).select("seg", "doc", "score")
        return ranked(docs.join(F.broadcast(page), ["seg", "doc"]).select(*(c for c in docs.columns if c not in ("seg", "doc")), "score"), plan.limit)

    def _top(self, node: Node, plan: SearchPlan, weight: float = 1.0, report: dict | None = None) -> DataFrame:
        """(seg, doc, score) of the hits that can be on the page, all that tie with its last among them."""
        words, plus = list(all_words(node)), list(scoring_words(node))
        none = self.spark.createDataFrame([], "seg string, doc long, score double")
        if node.kind == "none" or not self.parts:
            return none
        read = words + ([EVERY] if _empty(node) else [])
        stats = self.stats(words)
        facts = self.spark.createDataFrame([(w, stats.df.get(w, 0.0), w in plus) for w in read], "term string, df double, scores boolean")
        part = lambda tf, dl: F.when(F.col("scores"), bm25(tf.cast("double"), F.col("df"), dl.cast("double"), F.lit(stats.n), F.lit(stats.avgdl))).otherwise(0.0)
        rows = self._of(read).join(F.broadcast(facts), "term")
        # from the small columns alone: what a range's documents can reach
        bound = rows.groupBy("seg", "range", "term").agg(F.max(F.array_max(F.transform("peaks", lambda p: part(p["tf"], p["dl"])))).alias("b"), F.count("*").alias("k"))
        bounds = bound.groupBy("seg", "range").agg(F.collect_set("term").alias("terms"), (F.sum("b") * weight).alias("bound"), F.sum("k").alias("blocks"))
        bounds = bounds.where(over_terms(_can(node), _phrase)).select("seg", "range", "bound", "blocks")
        first = bounds.orderBy(F.desc("bound"), "seg", "range").limit(min(FIRST + plan.limit // HITS_A_RANGE, MOST_FIRST)).collect()
        if not first:
            return none
        score = F.round(F.sum(part(F.col("tf"), F.col("dl"))) * weight, 6) if weight != 1.0 else F.round(F.sum(part(F.col("tf"), F.col("dl"))), 6)
        phrase = _has_phrase(node)
        keep = filters(plan)

        def scored(chosen: DataFrame, pruned: Column | None = None) -> DataFrame:
            own = rows if pruned is None else rows.where(pruned)
            open_ = self._opened(own.join(F.broadcast(chosen) if pruned is not None else chosen, ["seg", "range"], "left_semi"), phrase)
            if self.dead is not None:
                open_ = open_.join(self.dead.select("seg", "doc"), ["seg", "doc"], "left_anti")
            if keep:
                open_ = open_.join(filtered(self.all_docs(), plan).select("seg", "doc"), ["seg", "doc"], "left_semi")
            per = open_.join(F.broadcast(facts), "term").groupBy("seg", "doc").agg(F.collect_set("term").alias("terms"), score.alias("score"), *([F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")] if phrase else []))
            return per.where(over_terms(node, _phrase)).select("seg", "doc", "score")

        chosen = self.spark.createDataFrame([(r["seg"], r["range"]) for r in first], "seg string, range long")
        hits = scored(chosen, F.col("range").isin([r["range"] for r in first])).collect()
        best = sorted((r["score"] for r in hits), reverse=True)
        least = best[plan.limit - 1] if len(best) >= plan.limit > 0 else float("-inf")
        got = self.spark.createDataFrame([tuple(r) for r in hits if r["score"] >= least], "seg string, doc long, score double")
        # a margin for the sixth place
        rest = bounds.where(F.col("bound") >= least - 1e-6).join(F.broadcast(chosen), ["seg", "range"], "left_anti")
        if report is not None:
            every = bounds.agg(F.count("*"), F.sum("blocks")).first()
            later = rest.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
            report.update(ranges=every[0], blocks=every[1], ranges_read=len(first) + later[0], blocks_read=sum(r["blocks"] for r in first) + later[1])
        return got.unionByName(scored(rest.select("seg", "range")).where(F.col("score") >= least))


def search(spark: SparkSession, path: str, plan: SearchPlan, report: dict | None = None) -> DataFrame:
    """The plan's page from the index at path."""
    return Index(spark, [current(spark, path)]).search(plan, report)


def _has_phrase(node: Node) -> bool:
    return node.kind == "phrase" or any(map(_has_phrase, node.parts))


def _empty(node: Node) -> bool:
    """Whether documents without any of the query's words match."""
    if node.kind in ("and", "or"):
        return (all if node.kind == "and" else any)(map(_empty, node.parts))
    return node.kind in ("all", "not")


def _can(node: Node) -> Node:
    """What a range's terms must meet for a match to be possible: exclusions rule nothing out, nor do places."""
    if node.kind == "not":
        return Node("all")
    if node.kind == "phrase":
        return Node("and", (), tuple(Node("word", (w,)) for w in node.words))
    return Node(node.kind, node.words, tuple(map(_can, node.parts)))


def _phrase(node: Node) -> Column:
    """Over column at, positions by term."""
    at = F.col("at")
    follows = [(w, i) for i, w in enumerate(node.words) if i]
    return F.exists(at[node.words[0]], lambda p: joined("and", [F.array_contains(at[w], p + i) for w, i in follows]))
