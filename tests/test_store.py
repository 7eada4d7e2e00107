"""Segments, manifests, live updates, ignore files, and the index's search against the scan's."""

import json
import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.__main__ import find, main, server
from quarry.operators import index, ingest, search
from quarry.operators.store import Store
from quarry.plans import folders
from quarry.plans.query import front, plan
from quarry.plans.settings import Settings
from quarry.sources import files as src
from quarry.streaming import watch

DOC = "path string, content string, title string, extension string, modified long, size long, content_hash string, error string"


def rows_of(spark, items, modified=1):
    return spark.createDataFrame([(p, t, None, p.rpartition(".")[2], modified, len(t or ""), str(hash(t)), None) for p, t in items], DOC).coalesce(1)


def gone(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def hits(df):
    return [(r["path"], r["score"]) for r in df.select("path", "score").collect()]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "apha", "eps", "zeta"]
    return [(f"d{i // 50}/f{i:04d}.{rnd.choice(['md', 'txt'])}", " ".join(rnd.choices(words, [9, 6, 4, 2, 1, 1, 1], k=rnd.randint(1, 60)))) for i in range(700)] + [("d0/empty.md", ""), ("d0/null.md", None)]


QUERIES = ["alpha", "alpha beta", "delta OR eps", "alpha -beta", '"alpha beta"', '"gamma alpha" delta OR zeta -eps', "-alpha", "*", "...", "ext:md alpha", "path:d3 beta", "size:>100B gamma", "apla", "alpah", "nothing", "a b c d e f g h alpha OR delta OR \"beta gamma\" OR gamma"]


def same_as_scan(spark, store, queries=QUERIES):
    docs = store.read("documents").persist()
    for i, text in enumerate(queries):
        p = plan(text, limit=(60, 5)[i % 2])
        want = hits(search.search(docs, p))
        assert [(a, round(b, 5)) for a, b in hits(store.search(p))] == [(a, round(b, 5)) for a, b in want], text
    docs.unpersist()


def test_segments_search_like_a_scan(spark, tmp_path, texts):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.read("documents").count() == 0 and store.search(plan("alpha")).count() == 0
    store.apply(rows_of(spark, texts[:400]), gone(spark), 1)
    store.apply(rows_of(spark, texts[400:]), gone(spark), 2)
    # a third of one folder is replaced, some are removed
    store.apply(rows_of(spark, [(p, "alpha alpha beta new") for p, _ in texts[100:130]], 9), gone(spark, *(p for p, _ in texts[:20])), 3)
    assert store.purge("d5/") == 50
    known = store.manifest()
    assert known["number"] == 4 and len(known["segments"]) == 3 and sum(known["deletes"].values()) == 100
    assert store.read("file_state").count() == 702 - 20 - 50
    same_as_scan(spark, store)
    before = {t: sorted(map(str, store.read(t).collect())) for t in ("documents", "filenames")}
    assert store.compact(fan=8) is None and store.compact(fan=2) == 5
    assert len(store.manifest()["segments"]) < 3
    assert before == {t: sorted(map(str, store.read(t).collect())) for t in ("documents", "filenames")}
    same_as_scan(spark, store, QUERIES[4:6])
    assert len(store.vacuum(keep=1, grace=-1)) >= 3 and store.manifests() == [5]
    same_as_scan(spark, store, QUERIES[12:13])


def test_blocks_are_skipped(spark, tmp_path):
    rnd = random.Random(5)
    items = [(f"{i:05d}.md", " ".join(["common"] * rnd.randint(1, 3) + [f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(5, 200))])) for i in range(4000)]
    df = rows_of(spark, items)
    index.write(df, f"file://{tmp_path}/i")
    report = {}
    p = plan("common", limit=10)
    assert hits(index.search(spark, f"file://{tmp_path}/i", p, report)) == hits(search.search(df, p))
    assert report["blocks"] >= 60 and report["blocks_read"] <= 0.5 * report["blocks"]


def test_long_words_and_queries(spark, tmp_path):
    long = "x" * 300
    df = rows_of(spark, [("a.md", f"{long} one"), ("b.md", f"{long}y"), ("c.md", "y" + "z" * 48), ("d.md", "z" * 48)])
    index.write(df, f"file://{tmp_path}/i")
    for text in (long, "z" * 49, "z" * 47, "y" + "z" * 47):
        p = plan(text)
        assert hits(index.search(spark, f"file://{tmp_path}/i", p)) == hits(search.search(df, p)) != []
    many = plan(" OR ".join(f"word{i}" for i in range(600)) + " OR one")
    assert [h[0] for h in hits(search.search(df, many))] == ["a.md"]


def test_a_change_writes_its_own_size(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.apply(rows_of(spark, [(f"{i}.md", "some words " * 50 + str(i)) for i in range(3000)]), gone(spark), 1)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet"))
    first = size()
    store.apply(rows_of(spark, [(f"{i}.md", "other") for i in range(10)], 2), gone(spark), 2)
    assert size() - first < first / 4 and store.read("documents").count() == 3000
    assert store.remove(gone(spark, "7.md", "none.md")) == 1 and store.remove(gone(spark, "7.md")) == 0


def test_half_a_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.apply(rows_of(spark, [("a.md", "old")]), gone(spark), 1)
    held = store.snapshot().docs()

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(folders, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        store.apply(rows_of(spark, [("a.md", "new"), ("b.md", "new")], 2), gone(spark), 2)
    monkeypatch.undo()
    assert store.version() == 1 and [r["content"] for r in store.read("documents").collect()] == ["old"]
    # a temporary file beside the manifests is none
    folders.publish(spark, f"{store.root}/manifests/.x", "{")
    store.apply(rows_of(spark, [("a.md", "newer")], 3), gone(spark), 3)
    assert [r["content"] for r in store.read("documents").collect()] == ["newer"] and [r["content"] for r in held.collect()] == ["old"]


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    a.apply(rows_of(spark, [("x.md", "zero"), ("y.md", "zero")]), gone(spark), 1)
    real, done = a._commit, []

    def late(before, **changes):
        if not done:
            done.append(b.apply(rows_of(spark, [("x.md", "b")], 2), gone(spark), 2))
        return real(before, **changes)

    monkeypatch.setattr(a, "_commit", late)
    assert a.apply(rows_of(spark, [("x.md", "a"), ("z.md", "a")], 3), gone(spark), 3) == 3 and done == [2]
    assert {r["path"]: r["content"] for r in b.read("documents").collect()} == {"x.md": "a", "y.md": "zero", "z.md": "a"}


def test_one_row_a_path_in_all_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.apply(rows_of(spark, [("a.md", "one")], 1).unionByName(rows_of(spark, [("a.md", "two")], 5)).unionByName(rows_of(spark, [("a.md", "three")], 3)), gone(spark), 1)
    assert store.read("documents").first()["content"] == "two" and store.get_metadata("a.md").first()["modified"] == 5 and store.read("filenames").count() == 1


def test_broken_stores_are_put_aside(spark, tmp_path):
    store, reset = Store.opened(spark, f"file://{tmp_path}/s")
    assert not reset
    store.apply(rows_of(spark, [("a.md", "text"), ("b.md", "text")]), gone(spark), 1)
    store.remove(gone(spark, "b.md"))
    size = sum(f.stat().st_size for d in ("segments", "deletes") for f in (tmp_path / "s" / d).rglob("*") if f.suffix != ".crc" and f.is_file())
    assert tuple(store.statistics().first()) == (1, size)
    assert Store.opened(spark, f"file://{tmp_path}/s")[1] is False
    for broken in ("{", '{"version": 0, "segments": {}, "deletes": {}, "batches": {}}', '{"version": 1, "segments": {"none": 3}, "deletes": {}, "batches": {}}'):
        assert folders.publish(spark, f"{store.root}/manifests/{store.version() + 1:020d}", broken)
        store, reset = Store.opened(spark, f"file://{tmp_path}/s")
        assert reset and store.version() == 0 and store.read("documents").count() == 0
        store.apply(rows_of(spark, [("a.md", "text")]), gone(spark), 1)
    assert Store(spark, f"file://{tmp_path}/s.backup").version() == 2


# ---- ingest


def tree(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_ignore_files_of_the_tree(spark, tmp_path):
    root = tmp_path / "in"
    names = ["a.log", "a.md", "build/x.md", "sub/b.log", "sub/keep.log", "sub/c.md", "sub/deep/keep.log", "sub/deep/d.md", "sub/only/e.md", "other/only/e.md", "odd#name.md", "gone/back.md", "tmp.md", "x/tmp.md"]
    tree(root, dict.fromkeys(names, "text"))
    tree(root, {".gitignore": "*.log\nbuild/\n# comment\n/tmp.md\ngone/\n!gone/back.md\n", "sub/.gitignore": "!keep.log\nonly/\n", "sub/deep/.ignore": "*.log\n", "sub/deep/.gitignore": "!keep.log"})
    paths = lambda **k: {r["path"] for r in src.scan(spark, str(root), Settings(**{x: k[x] for x in k if x != "ignore"}), k.get("ignore", "")).select("path").collect()}
    want = {"a.md", "sub/keep.log", "sub/c.md", "sub/deep/d.md", "other/only/e.md", "odd#name.md", "x/tmp.md"}
    assert paths() == want
    assert paths(ignore="*.md\n!sub/**") == {"sub/keep.log", "sub/c.md", "sub/deep/d.md"}
    assert paths(use_gitignore=False) == set(names)
    store = Store(spark, f"file://{tmp_path}/s")
    ingest.ingest(spark, str(root), store, now=1)
    assert {r["path"] for r in store.all_paths().collect()} == want
    ingest.rebuild(spark, str(root), store, now=2, ignore="other/")
    assert {r["path"] for r in store.all_paths().collect()} == want - {"other/only/e.md"}
    assert {r["path"] for r in src.some(spark, str(root), ["sub/b.log", "sub/keep.log", "a.md", "none.md", "gone/back.md"]).collect()} == {"sub/keep.log", "a.md"}


def test_depth(spark, tmp_path):
    deep = "/".join(str(i) for i in range(19))
    tree(tmp_path / "in", {f"{deep}/a.md": "x", f"{deep}/one/b.md": "x"})
    assert [r["path"] for r in src.scan(spark, str(tmp_path / "in")).select("path").collect()] == [f"{deep}/a.md"]


def test_removed_files_go(spark, tmp_path):
    root, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/s")
    tree(root, {"a.md": "first", "b.md": "second"})
    ingest.ingest(spark, str(root), store, now=1)
    (root / "a.md").unlink()
    assert ingest.ingest(spark, str(root), store, now=2) == 2
    assert [r["path"] for r in store.all_paths().collect()] == ["b.md"] and store.search(plan("first", fuzzy=False)).count() == 0
    assert ingest.ingest(spark, str(root), store, now=3) is None


def test_live_updates_once(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/s")
    tree(root, {"a.md": "alpha", "b.md": "beta", "same.md": "same", "x.tmp": "no"})
    (tmp_path / "events").mkdir()
    say = lambda n, rows: (tmp_path / "events" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "action", "seq"), r, strict=True))) for r in rows))
    run = lambda: ingest.live(spark, str(root), store, watch.source(spark, str(tmp_path / "events"), most_files=1), f"{tmp_path}/cp").awaitTermination(240)
    say(1, [("a.md", "Index", 1), ("same.md", "Index", 2), ("x.tmp", "Index", 3), ("none.md", "Index", 4)])
    say(2, [("b.md", "Index", 5), ("a.md", "Remove", 6)])
    run()
    # a file a batch, so two changes
    assert store.version() == 2 and {r["path"] for r in store.all_paths().collect()} == {"b.md", "same.md"}
    # the process dies between the store's change and the stream's checkpoint: the batch runs again
    time.sleep(1.1)
    (root / "b.md").write_text("beta two")
    (root / "same.md").write_text("same")
    say(3, [("b.md", "Index", 7), ("same.md", "Index", 8)])
    real = Store.apply

    def dies(self, *args, **kwargs):
        real(self, *args, **kwargs)
        raise RuntimeError("killed")

    monkeypatch.setattr(Store, "apply", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.undo()
    assert store.version() == 3
    number = store.manifest()["batches"]["changes"]
    state = {r["path"]: tuple(r) for r in store.read("file_state").collect()}
    run()
    assert store.version() == 3 and store.manifest()["batches"]["changes"] == number and {r["path"]: tuple(r) for r in store.read("file_state").collect()} == state
    assert {r["path"]: r["content"] for r in store.read("documents").collect()} == {"b.md": "beta two", "same.md": "same"}
    assert state["same.md"][1] > 0


def test_roots_that_change(spark, tmp_path):
    for r in ("r1", "r2"):
        (tmp_path / r).mkdir()
        (tmp_path / r / "1.json").write_text('{"path": "p", "action": "Index", "seq": 1}')
    seen = []
    start = lambda root, cp: watch.apply_to(watch.source(spark, f"{tmp_path}/{root}"), lambda g, n, k: seen.append((root, k)), cp, excludes=[], extensions=["md"], every="1 second")
    w = watch.Watch(spark, start, f"{tmp_path}/cps")
    assert w.update(["r1"]) == {"r1": "start"} and w.update(["r2"]) == {"r1": "stop", "r2": "start"} and w.update(["r2"]) == {}
    assert list(w.running) == ["r2"] and w.update([]) == {"r2": "stop"}
    both = watch.merged(watch.source(spark, f"{tmp_path}/r1"), watch.source(spark, f"{tmp_path}/r2"))
    assert both.isStreaming and both.columns == ["path", "action", "seq"]


# ---- front ends


def test_form():
    p = front("report ext:.PDF size:>1mb modified:week", types="md, .TXT", chosen={"rs"}, min_size="2", max_size="x", unit="KB", now=10_000_000)
    assert (p.text, p.extensions, p.min_size, p.max_size, p.min_modified) == ("report", ("md", "pdf", "rs", "txt"), 1 << 20, None, 10_000_000 - 7 * 86400)
    p = front('a title:"x y"', size=">=1.5KB", date="today", now=1704110400, zone="America/New_York", folder="/home/me", limit=7)
    assert (p.min_size, p.min_modified, p.path, p.title, p.limit, p.text) == (1536, 1704085200, "/home/me", "x y", 7, "a")
    assert front("a", size="<2B").max_size == 1 and front("a b", whole_word=True).text == '"a b"'


def test_command_and_server(spark, tmp_path):
    root, corpus = tmp_path / "in", f"file://{tmp_path}/s"
    tree(root, {"notes.md": "# Head\nalpha beta", "other.txt": "beta"})
    shown = []
    main(["alpha", "--corpus", corpus, "--ingest", str(root)], shown.append)
    main(["nts", "--corpus", corpus, "--names", "--json"], shown.append)
    assert shown[0].endswith("| notes.md") and json.loads(shown[1]) == {"score": 1.0, "path": "notes.md", "title": "notes.md"}
    store = Store(spark, corpus)
    page = find(store, "beta", 5)
    assert find(store, "beta", 5, now=2) is page and page.is_cached
    store.remove(gone(spark, "other.txt"))
    assert find(store, "beta", 5).count() == 1 and not page.is_cached
    with pytest.raises(ValueError, match="no corpus"):
        find(Store(spark, f"file://{tmp_path}/none"), "a", 5, names=True)
    s = server(store, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with socket.create_connection(s.server_address, timeout=120) as c:
        f = c.makefile("rw")
        f.write("beta\nnames:notes ext:md\nnames:zzz\n")
        f.flush()
        got = [json.loads(f.readline()) for _ in range(3)]
    s.shutdown()
    assert [h["path"] for h in got[0]] == ["notes.md"] and [h["path"] for h in got[1]] == ["notes.md"] and got[2] == []


def shuffled(spark, run):
    """Bytes that run() shuffles."""
    def total():
        time.sleep(1)
        return sum(e.totalShuffleWrite() for e in _list(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    before = total()
    run()
    return total() - before


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def prose(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(300)]
    return [(f"p/{i:03d}.md", " ".join(rnd.choices(words, k=1500))) for i in range(n)]


def test_an_index_is_written_without_shuffling_texts_or_postings(spark, tmp_path):
    items = prose(200, 6)
    df = rows_of(spark, items)
    moved = shuffled(spark, lambda: index.write(df, f"file://{tmp_path}/i"))
    assert 0 < moved < sum(len(t) for _, t in items) / 10
    # positions are held one after the other for all documents of a range
    words = items[70][1].split()
    p = plan(f'"{words[700]} {words[701]} {words[702]}"', limit=30)
    found = hits(index.search(spark, f"file://{tmp_path}/i", p))
    assert "p/070.md" in [path for path, _ in found] and found == hits(search.search(df, p))


def test_a_store_takes_documents_without_shuffling_texts(spark, tmp_path):
    items = prose(200, 7)
    store = Store(spark, f"file://{tmp_path}/s")
    moved = shuffled(spark, lambda: store.apply(rows_of(spark, items), gone(spark), 1))
    assert 0 < moved < sum(len(t) for _, t in items) / 10 and store.read("documents").count() == 200
    # nor does a page
    moved = shuffled(spark, lambda: store.search(plan(items[0][1].split()[0], limit=200)).collect())
    assert moved < sum(len(t) for _, t in items) / 10
    # paths that are there several times: the last modified, then that of the greater hash, then size; nulls are last
    same = [("a.md", "old", 1, 3, "z"), ("a.md", "new", 2, 3, "a"), ("a.md", "newer", 2, 5, "b"), ("a.md", "no time", None, 9, "zz"), ("b.md", "alone", None, 5, None), ("c.md", "short", 1, 5, "h"), ("c.md", "longest", 1, 7, "h")]
    rows = spark.createDataFrame([(p, t, None, "md", m, n, h, None) for p, t, m, n, h in same], DOC).repartition(3)
    other = Store(spark, f"file://{tmp_path}/t")
    assert other.apply(rows, gone(spark), 1) == 1 and other.manifest()["deletes"] == {} and list(other.manifest()["segments"].values()) == [3]
    assert {r["path"]: r["content"] for r in other.read("documents").collect()} == {"a.md": "newer", "b.md": "alone", "c.md": "longest"}
    same_as_scan(spark, other, ["newer", "-alone"])
    assert folders.entries(spark, f"{other.root}/staged") == []


@pytest.mark.parametrize("name", ["index_ft_not", "index_ft_fuzzy_backfill", "index_exclusion", "store_search"])
def test_a_query_does_the_same_work_each_time_and_leaves_no_index(spark, monkeypatch, name):
    made, real = [], queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda s: made.append(real(s)) or made[-1])
    first, again = (hits(queries.QUERIES[name](spark, "/root/testdata/sf0.001")) for _ in range(2))
    assert first == again and len(made) == 2 and not any(folders.exists(spark, p) for p in made)


def test_vocabulary_counts_without_python(spark):
    df = rows_of(spark, [("a", "One two two"), ("b", "two THREE three three"), ("c", ""), ("d", None)])
    found = index.vocabulary(df)
    assert {tuple(r) for r in found.collect()} == {("one", 1, 1), ("two", 2, 3), ("three", 1, 3)}
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
