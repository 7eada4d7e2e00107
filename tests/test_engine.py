"""Operators on small hand-made tables."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators import filename, index, ingest, preview, search, sinks, state, stats
from quarry.plans import folders
from quarry.plans.query import plan
from quarry.plans.settings import Settings
from quarry.sources import files as src
from quarry.sources.tree import folder_paths
from quarry.streaming import watch

DOCS = "path string, content string, title string, extension string, size long, modified long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("/a/hello.txt", "This is a unique test string for searching.", "Hello", "txt", 100, 10),
        ("/a/notes.md", "# Notes about keyboards. Searching strings", None, "md", 200, 20),
        ("/b/x.pdf", "string test", "Annual Report", "pdf", 300, 30),
        ("/b/y.pdf", None, "Empty", "pdf", 0, None),
        ("/b/teh.txt", "teh cat saw the größe", "Cat", "txt", None, 40),
    ]
    return spark.createDataFrame(rows, DOCS)


def paths(df):
    return [r["path"] for r in df.collect()]


def test_words_are_all_needed(docs):
    assert paths(search.search(docs, plan("unique test string", fuzzy=False))) == ["/a/hello.txt"]
    assert paths(search.search(docs, plan("keyboards"))) == ["/a/notes.md"]
    assert paths(search.search(docs, plan("test string", fuzzy=False))) == ["/b/x.pdf", "/a/hello.txt"]


def test_boolean_search(docs):
    got = lambda text: set(paths(search.search(docs, plan(text, fuzzy=False))))
    assert got("keyboards OR cat") == {"/a/notes.md", "/b/teh.txt"}
    assert got("string -unique") == {"/b/x.pdf"}
    assert got('"test string"') == {"/a/hello.txt"} and got('"string test"') == {"/b/x.pdf"}
    assert got("GRÖSSE") == set() and got("Größe") == {"/b/teh.txt"}
    assert got("*") == {"/a/hello.txt", "/a/notes.md", "/b/x.pdf", "/b/y.pdf", "/b/teh.txt"}
    assert got("...") == set()


def test_fuzzy_fills_up(docs):
    hits = search.search(docs, plan("strign"))
    assert {r["path"] for r in hits.collect()} == {"/a/hello.txt", "/b/x.pdf"}
    assert paths(search.search(docs, plan("strign", fuzzy=False))) == []
    exact = search.search(docs, plan("string", limit=2)).collect()
    assert [r["path"] for r in exact] == ["/b/x.pdf", "/a/hello.txt"]
    assert "/a/notes.md" in paths(search.search(docs, plan("string", limit=3)))


def test_filters(docs):
    got = lambda text, **f: set(paths(search.filtered(docs, plan(text, **f))))
    assert got("ext:PDF") == {"/b/x.pdf", "/b/y.pdf"} and got("path:A/") == {"/a/hello.txt", "/a/notes.md"}
    assert got("title:report") == {"/b/x.pdf"} and got("size:>200B") == {"/a/notes.md", "/b/x.pdf"} and got("size:<0B") == {"/b/y.pdf"}
    assert got("*", min_modified=30) == {"/b/x.pdf", "/b/teh.txt"}


def test_page_and_order(docs):
    p = plan("test title:hello")
    row = search.page(search.search(docs, p), p).first()
    assert row["snippets"] == ["This is a unique <b>test</b> string for searching."] and row["matched_terms"] == ["test", "hello"]
    assert paths(search.resort(search.search(docs, plan("*")), "name"))[0] == "/b/x.pdf"
    assert paths(search.recent(docs, 2)) == ["/b/teh.txt", "/b/x.pdf"]


def test_index_gives_the_same(spark, docs, tmp_path):
    at = f"file://{tmp_path}/index"
    index.write(docs, at)
    for text in ("test string", "keyboards OR cat", '"test string"', "string -unique"):
        p = plan(text, fuzzy=False)
        assert [tuple(r) for r in index.search(spark, at, p).select("path", "score").collect()] == [tuple(r) for r in search.search(docs, p).select("path", "score").collect()]
    assert paths(index.search(spark, at, plan("ext:pdf string"))) == ["/b/x.pdf"]
    assert not index.open_or_rebuild(spark, at, docs)
    index.write(docs, at)
    index.write(docs, at)
    assert index.current(spark, at).endswith("/3") and [n for n, _ in folders.entries(spark, at)] == ["2", "3"]
    spark.createDataFrame([("0", 1)], "version string, n long").write.mode("overwrite").parquet(f"{at}/3/marker")
    assert index.open_or_rebuild(spark, at, docs) and folders.exists(spark, f"{at}.backup")


def test_file_names(spark):
    f = spark.createDataFrame([("/1/ring", "ring"), ("/2/Ringer", "Ringer"), ("/3/string", "string"), ("/4/r-i-n-g", "r-i-n-g"), ("/5/none", "none")], "path string, name string")
    rows = filename.search(f, "Ring", 9).collect()
    assert [(r["path"], r["score"]) for r in rows] == [("/1/ring", 0.0), ("/2/Ringer", 1.002), ("/3/string", 2.022), ("/4/r-i-n-g", 3.307)]
    assert filename.stats(f).first()["n_bytes"] == sum(len(p) + len(n) + 32 for p, n in f.collect())


def test_dictionary_of_names(spark, tmp_path):
    import json
    import random

    rnd = random.Random(1)
    items = [(f"/p/{i}", "".join(rnd.choices("abcdefghij -_XÄß9", k=rnd.randint(1, 9)))) for i in range(3000)] + [("/p/q", "Quartz Quiz")]
    (tmp_path / "old.json").write_text(json.dumps([{"path": p, "name": n} for p, n in items]))
    filename.migrate(spark, str(tmp_path / "old.json"), f"{tmp_path}/names")
    f = spark.createDataFrame(items, "path string, name string")
    for query in ("ab", "x9", "ß", "qz", "", "zzzz", "A-b"):
        report = {}
        assert filename.lookup(spark, f"{tmp_path}/names", query, 50, report).collect() == filename.search(f, query, 50).collect()
        assert report["read"] == 1 if query == "qz" else report["read"] < report["blocks"] / 2 if query in ("x9", "zzzz") else True


def test_state(spark):
    s = "path string, modified long, size long, content_hash string, indexed_at long"
    old = spark.createDataFrame([("/a", 1, 1, "x", 1), ("/b", 1, 1, "y", 1), ("/ab/c", 1, 1, "z", 1)], s)
    new = spark.createDataFrame([("/a", 2, 1, "x", 2), ("/b", 1, 2, "q", 2), ("/d", 1, 1, "d", 2), ("/ab/c", 1, 1, "z", 2)], s)
    assert {r["path"]: r["status"] for r in state.staleness(new, old).collect()} == {"/a": "stale", "/b": "stale", "/d": "new", "/ab/c": "same"}
    events = spark.createDataFrame([("/a",), ("/b",), ("/ab/c",), ("/gone",)], "path string")
    assert {r["path"]: r["action"] for r in state.change_gate(events, new, old).collect()} == {"/a": "touch", "/b": "index", "/ab/c": "skip", "/gone": "skip"}
    assert {r["path"]: r["modified"] for r in state.upsert(old, new).collect()} == {"/a": 2, "/b": 1, "/d": 1, "/ab/c": 1}
    assert set(paths(state.purge(old, "/a/"))) == {"/b", "/ab/c"} and set(paths(state.delete(old, events))) == set()


def test_tree(spark):
    n = spark.createDataFrame([(0, 0, ""), (1, 0, "a"), (2, 1, "b:c"), (3, 2, "d"), (4, 9, "orphan")], "id long, parent_id long, name string")
    assert {r["id"]: r["path"] for r in folder_paths(n).collect()} == {0: "", 1: "/a", 2: "/a", 3: "/a/d"}


def test_text_functions(spark):
    df = spark.createDataFrame([("One two one", "/x/.gitignore"), ("", "/x/a.TAR.GZ"), (None, "c")], "t string, p string")
    rows = df.select(fn.spans(F.col("t"), ["ONE"]).alias("s"), fn.extension(F.col("p")).alias("e"), fn.file_name(F.col("p")).alias("n")).collect()
    assert [(x["text"], x["hit"]) for x in rows[0]["s"]] == [("One", True), (" two ", False), ("one", True)]
    assert rows[1]["s"] == [] and [r["e"] for r in rows] == [None, "gz", None] and [r["n"] for r in rows] == [".gitignore", "a.TAR.GZ", "c"]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (416000,), (1 << 20,), (5 << 30,), (1 << 62,)], "s long").select(fn.human_size(F.col("s")).alias("h"))
    assert [r["h"] for r in sizes.collect()] == ["0 B", "1023 B", "1.0 KB", "406.2 KB", "1.0 MB", "5.00 GB", "4294967296.00 GB"]
    snip = spark.createDataFrame([("a <b>hit</b> and <b>two</b>",), ("none",), ("<b>x",)], "s string").select(fn.snippet_spans(F.col("s")).alias("x")).collect()
    assert [[(p["text"], p["hit"]) for p in r["x"]] for r in snip] == [[("a ", False), ("hit", True), (" and ", False), ("two", True)], [("none", False)], [("x", True)]]


def test_preview(spark):
    html = "<html><title>T &amp; t</title><script>var p='<p>no</p>'</script><body><h1>Head</h1><P class=x>One <b>two</b></P><ul><li>i</li></ul><pre>code</pre><p> </p></body>"
    e = preview.elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    assert [(r["element_type"], r["content"]) for r in e.orderBy("pos").collect()] == [("Title", "T & t"), ("Heading", "Head"), ("NarrativeText", "One two"), ("ListItem", "i"), ("CodeBlock", "code")]
    p = preview.preview(e, "page_id", ["two"]).first()
    assert p["n_elements"] == 5 and [s["text"] for s in p["elements"][2]["spans"]] == ["One ", "two"]


def test_stats(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "query string, at long")
    assert [tuple(r) for r in stats.history(log, 2).collect()] == [("a", 2, 3), ("c", 1, 4)]
    assert [r["query"] for r in stats.recent_searches(log, 2).collect()] == ["c", "a"]
    pins = spark.createDataFrame([("/a", "pin", 1), ("/b", "pin", 2), ("/a", "unpin", 3)], "path string, action string, at long")
    assert paths(stats.pinned(pins)) == ["/b"]


def test_exports(spark, docs, tmp_path):
    hits = search.search(docs, plan("keyboards"))
    sinks.export(hits, f"{tmp_path}/csv", "csv")
    text = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert text[0] == "Score,File Path,Title" and text[1].split(",")[1] == "/a/notes.md"
    sinks.export(hits, f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == 1 and "/a/notes.md" in sinks.lines(hits)[0] and '"title": null' in sinks.lines(hits, True)[0]


def test_ingest(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub" / ".git").mkdir(parents=True)
    for name, text in {"hello.txt": "a unique test string", "sub/copy.txt": "a unique test string", "notes.md": "# Title\nflashing", "x.bin": "no", "sub/.git/a.txt": "no", "t.tmp": "no", "skip.txt": "no", "bad.pdf": "no extractor"}.items():
        (root / name).write_text(text)
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    assert ingest.ingest(spark, str(root), store, Settings(), now=5, ignore="skip.*\n# no\n!other") is not None
    d = {r["path"]: r for r in store.read("documents").collect()}
    assert set(d) == {"hello.txt", "sub/copy.txt", "notes.md"} and d["notes.md"]["title"] == "Title"
    assert set(paths(store.all_paths())) == {"hello.txt", "sub/copy.txt", "notes.md", "bad.pdf"}
    assert ingest.ingest(spark, str(root), store, Settings(), ignore="skip.*") is None
    time.sleep(1.1)
    (root / "hello.txt").write_text("changed entirely")
    ingest.ingest(spark, str(root), store, Settings(), now=6, ignore="skip.*")
    assert store.read("documents").count() == 3 and paths(search.search(store.read("documents"), plan("changed"))) == ["hello.txt"]
    store.purge("sub/")
    assert set(paths(store.all_paths())) == {"hello.txt", "notes.md", "bad.pdf"} and store.get_metadata("hello.txt").count() == 1
    store.clear()
    assert store.read("filenames").count() == 0


def test_extractors(spark):
    files = spark.createDataFrame([("a.html", bytearray(b"<title>T</title><p>x &lt; y</p>")), ("b.zzz", bytearray(b"")), ("c.boom", bytearray(b"1"))], "path string, content binary")

    def boom(_):
        raise RuntimeError("no")

    got = {r["path"]: r for r in src.extract(files, {**src.EXTRACTORS, "boom": boom}).collect()}
    assert (got["a.html"]["title"], got["a.html"]["content"]) == ("T", "T x < y") and "no extractor" in got["b.zzz"]["error"] and got["c.boom"]["error"] == "RuntimeError: no"


def test_debounce(spark):
    assert watch._flushes([0, 0.4, 1.0, 1.3, 1.7, 2.1], 0.5, 1.0) == [0, 0, 1, 1, 1, 2]
    e = spark.createDataFrame([("r", 1, 0.0), ("r", 2, 0.3), ("r", 3, 2.0), ("s", 4, 2.0)], "k string, seq long, t double")
    assert {(r["seq"], r["flush"]) for r in watch.debounce(e, key="k").collect()} == {(1, 0), (2, 0), (3, 1), (4, 0)}


def test_stream_of_changes(spark, tmp_path):
    rows = [("/a.md", "Index", 1), ("/a.md", "Remove", 2), ("/b.md", "Index", 3), ("/c.bin", "Index", 4), ("/c.bin", "Remove", 5), ("/x.tmp", "Index", 6)]
    schema = "path string, action string, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events")
    seen = []
    q = watch.apply_to(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), lambda gone, new, n: seen.append((set(paths(gone)), set(paths(new)))), f"{tmp_path}/cp", excludes=["*.tmp"], extensions=["md"])
    q.awaitTermination(120)
    assert seen == [({"/a.md", "/c.bin"}, {"/b.md"})]


def test_debounced_stream(spark, tmp_path):
    schema = "root string, path string, action string, seq long, t double"
    rows = [("r", "/a", "Index", 1, 0.0), ("r", "/a", "Remove", 2, 0.2), ("r", "/b", "Index", 3, 0.3), ("r", "/c", "Index", 4, 9.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events")
    q = watch.debounced(spark.readStream.schema(schema).parquet(f"{tmp_path}/events")).writeStream.format("memory").queryName("flushed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    # a stream with open timers does not end by itself
    for _ in range(60):
        time.sleep(1)
        if spark.sql("select 1 from flushed where flush = 0").count() == 2:
            break
    q.stop()
    assert {tuple(r) for r in spark.sql("select path, action, flush from flushed where flush = 0").collect()} == {("/a", "Remove", 0), ("/b", "Index", 0)}


def test_debounce_by_pieces(spark):
    """Against the sequential rule: keys of many events and of one, a null key, ties, pieces longer than the cap over several ranges."""
    import random

    rnd = random.Random(2)
    rows = [(k, i, round(rnd.random() * n / 3, 1)) for k, n in (("hot", 900), ("b", 40), (None, 25), ("one", 1)) for i in range(n)]
    e = spark.createDataFrame(rows, "k string, seq long, t double").repartition(3)
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, s) for x, s, t in rows if x == k)
        want |= {(k, s): f for (t, s), f in zip(own, watch._flushes([t for t, _ in own], 0.5, 4.0), strict=True)}
    assert {(r["k"], r["seq"]): r["flush"] for r in watch.debounce(e, key="k", gap=0.5, cap=4.0).collect()} == want
    assert watch.debounce(e.limit(0), key="k").count() == 0


def test_fragments(spark):
    words = [f"w{i}" for i in range(100)]
    words[5], words[30], words[31], words[80] = "Cat,", "cat", "DOG!", "dog"
    df = spark.createDataFrame([(1, "... " + " ".join(words)), (2, None), (3, ""), (4, "none"), (5, "cat")], "id int, text string")
    got = {r["id"]: r["s"] for r in fn.with_fragments(df, "text", ["cat", "dog"], "s").collect()}
    assert [x.count("<b>") for x in got[1]] == [2, 1] and "<b>cat</b> <b>DOG</b>! w32" in got[1][0] and "<b>dog</b> w81" in got[1][1]
    assert got[2] == got[3] == got[4] == [] and got[5] == ["<b>cat</b>"]
    rare = {r["id"]: r["s"] for r in fn.with_fragments(df, "text", ["cat", "dog"], "s", F.array(F.lit(0.1), F.lit(5.0)), most=1).collect()}
    assert "DOG" in rare[1][0] and len(rare[1]) == 1
    assert search.shown_words(plan('c++ "foo-bar" -not OR')) == ["c", "foo", "bar"]
