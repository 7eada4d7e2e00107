"""The query language: pure Python, no session."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.functions.text import glob_regex
from quarry.plans import query as q
from quarry.plans import settings as se


def test_operators():
    p = q.parse("ext:pdf path:reports annual size:<10MB")
    assert (p.text, p.extension, p.path, p.min_size, p.max_size) == ("annual", "pdf", "reports", None, 10 << 20)
    p = q.parse('size:>1MB title:"Annual Report" document EXT:..MD')
    assert (p.text, p.min_size, p.title, p.extension) == ("document", 1 << 20, "annual report", "md")
    assert q.parse("ext:pdf").text == "*"
    assert q.parse("context:foo").text == "context:foo"
    assert q.parse("ext:.").extension is None
    assert q.parse("size:1.5KB").min_size == q.parse("size:1.5KB").max_size == 1536
    assert q.parse("size:huge x").text == "x"
    assert q.parse("path:Docs x", case_sensitive=True).path == "Docs"


@pytest.mark.parametrize(("text", "want"), [("> 1MB", (1048577, None)), (">= 2MB", (2097152, None)), ("< 10KB", (None, 10239)), ("<=1B", (None, 1)), ("5", (5, None)), ("x", (None, None)), ("", (None, None)), ("<0", (None, 0))])
def test_size_filter(text, want):
    assert q.size_filter(text) == want


@pytest.mark.parametrize(("text", "want"), [("500", 500), ("10KB", 10240), ("5mb", 5 << 20), ("2g", 2 << 30), ("1Kb", None), ("1.5k", None), ("", None), ("7B", None)])
def test_size_value(text, want):
    assert q.size_value(text) == want


def test_inline_filters():
    rest, got = q.inline_filters("hello world ext:pdf size:>2MB modified:today ext:MD", now=1_000_000)
    assert rest == "hello world"
    assert got == {"extensions": {"pdf", "md"}, "min_size": 2 << 20, "max_size": None, "min_modified": 1_000_000 - 86_400}


def test_highlight_terms():
    assert q.highlight_terms("Annual ext:pdf title:Report") == ["annual", "report"]
    assert q.highlight_terms("*") == ["*"]


def test_front_end():
    p = q.plan("ext:md annual modified:week", now=10**9, extensions={"pdf"})
    assert (p.text, p.extensions, p.min_modified) == ("annual", ("md", "pdf"), 10**9 - 7 * 86400)
    assert q.plan("of the", whole_word=True).text == '"of the"'
    assert q.whole_words('"a b"') == '"a b"' and q.whole_words("ext:a b") == "ext:a b"
    assert q.toggle_category({"pdf"}, "documents") == {"pdf", "docx", "md", "txt"}
    assert q.toggle_category({"pdf", "docx", "md", "txt", "rs"}, "documents") == {"rs"}
    assert q.date_preset("today", 86_400 * 3 + 5) == 86_400 * 3


def test_boolean():
    n = q.boolean('a "b c" OR d -e')
    assert n.kind == "or" and [p.kind for p in n.parts] == ["and", "and"]
    assert q.scoring_words(n) == ("a", "b", "c", "d") and q.all_words(n) == ("a", "b", "c", "d", "e")
    assert q.boolean("").kind == "none" and q.boolean("*").kind == "all" and q.boolean('"open end').kind == "phrase"


def test_near_pattern():
    rx = re.compile(q.near_pattern("teh"))
    assert all(rx.match(w) for w in ("the", "eth", "te", "tehx", "tel", "teß", "xteh", "teh"))
    assert not any(rx.match(w) for w in ("tx", "texy", "hte1", "thex"))


@given(st.text())
def test_any_input_parses(text):
    p = q.parse(text)
    assert p.text
    q.boolean(p.text), q.inline_filters(text, 0), q.size_filter(text), q.size_value(text), q.plan(text)


@given(st.sampled_from(["ext", "path", "title"]), st.from_regex(r"[a-zA-Z0-9_-][a-zA-Z0-9_.-]*", fullmatch=True), st.from_regex(r"[a-z ]*", fullmatch=True))
def test_operators_come_back(kind, value, rest):
    p = q.parse(f"{rest} {kind}:{value}")
    assert getattr(p, "extension" if kind == "ext" else kind) == value.lower()
    assert p.text == (" ".join(rest.split()) or "*")


def test_globs():
    hit = lambda g, p: bool(re.search(glob_regex(g), p))
    assert hit("*.tmp", "a/b.tmp") and not hit("*.tmp", "a/b.tmpx")
    assert hit(".git/", "x/.git/config") and not hit(".git/", "x/.github/a")
    assert hit("a?c", "abc/d") and hit("[ab]x", "bx") and not hit("[!ab]x", "bx") and hit("**/c/*.md", "a/b/c/d.md")


def test_settings(tmp_path, monkeypatch):
    path = str(tmp_path / "s.json")
    se.save(se.Settings(custom_extensions=" .Foo, bar,, "), path)
    assert {"foo", "bar", "pdf", "svg"} <= set(se.load(path).allowed_extensions())
    monkeypatch.setenv("QUARRY_MAX_RESULTS", "7")
    monkeypatch.setenv("QUARRY_FUZZY", "false")
    assert (se.load(path).max_results, se.load(path).fuzzy) == (7, False)
    (tmp_path / "s.json").write_text("{")
    assert se.load(path).size_limit_mb == 100
