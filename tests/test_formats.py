"""Containers, office formats, content types, languages and keywords."""

import gzip
import io
import math
import tarfile
import zipfile
from collections import Counter
from email.message import EmailMessage

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.keywords import keywords
from quarry.operators import ingest, language
from quarry.operators.store import Store
from quarry.plans.query import plan
from quarry.sources import files as src
from quarry.sources import formats


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(parts):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in parts.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


CORE = '<cp xmlns:dc="d"><dc:title> The title </dc:title></cp>'
W, A = 'xmlns:w="w"', 'xmlns:a="a"'
DOCX = pack({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First &amp; </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:tbl><w:p><w:r><w:t>cell</w:t><w:tab/><w:t>two</w:t></w:r></w:p></w:tbl></w:body></w:document>", "docProps/core.xml": CORE})
XLSX = pack({"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>", "xl/worksheets/sheet1.xml": '<ws><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>3.5</v></c><c t="inlineStr"><is><t>own</t></is></c></row></sheetData></ws>'})
PPTX = pack({"ppt/presentation.xml": "<p/>", **{f"ppt/slides/slide{i}.xml": f"<p {A}><a:p><a:r><a:t>slide {i}</a:t></a:r></a:p></p>" for i in (1, 2, 10)}})
ODT = pack({"mimetype": formats.TYPES["odt"], "content.xml": '<o xmlns:text="t"><text:h>Head</text:h><text:p>Body <text:span>text</text:span></text:p></o>', "meta.xml": CORE})
EPUB = pack({"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<package xmlns:dc="d"><dc:title>Book</dc:title><item id="a" href="1.xhtml"/><item id="b" href="2.xhtml"/><itemref idref="b"/><itemref idref="a"/></package>', "O/1.xhtml": "<html><p>end</p></html>", "O/2.xhtml": "<html><p>start</p></html>"})


def mail():
    m = EmailMessage()
    m["subject"] = "Invoice"
    m.set_content("See the attachment.\n")
    m.add_attachment(pack({"in/deep.txt": "deep text"}), maintype="application", subtype="zip", filename="more.zip")
    m.add_attachment("plain words", filename="note.txt")
    return m.as_bytes()


def test_office_formats():
    assert formats.docx(DOCX) == ("First & line\ncell\ttwo", "The title")
    assert formats.xlsx(XLSX) == ("name\trich\n3.5\town", None)
    assert formats.pptx(PPTX)[0] == "slide 1\nslide 2\nslide 10"
    assert formats.odt(ODT) == ("Head\nBody text", "The title")
    assert formats.epub(EPUB) == ("start\nend", "Book")
    assert formats.mail(mail()) == ("See the attachment.\n", "Invoice")


def test_content_types():
    kinds = {"docx": DOCX, "xlsx": XLSX, "pptx": PPTX, "odt": ODT, "epub": EPUB}
    assert {formats.content_type(v): k for k, v in kinds.items()} == {formats.TYPES[k]: k for k in kinds}
    got = [formats.content_type(d, e) for d, e in ((b"%PDF-1.7", "txt"), (pack({"a": "b"}), "docx"), (gzip.compress(b"x"), ""), (tarred({"a": b"x"}), ""), (b"\xef\xbb\xbf <!DOCTYPE html>", ""), (b"<?xml version='1.0'?><svg/>", ""), (b"a,b", "csv"), (b"plain", ""), (b"\0\1", "txt"), (b"\xff\xfe\xfa", ""), (b"", "md"))]
    assert got == ["application/pdf", "application/zip", "application/gzip", "application/x-tar", "text/html", "image/svg+xml", "text/csv", "text/plain", "application/octet-stream", "application/octet-stream", "text/markdown"]


def test_members(monkeypatch):
    inner = tarred({"./x/a.txt": b"a", "b.gz": gzip.compress(b"b text")})
    got = dict(formats.members(pack({"d/": "", "d/in.tar": inner, "c.txt": "c"}), "o.zip"))
    assert set(got) == {"o.zip!/d/in.tar", "o.zip!/c.txt", "o.zip!/d/in.tar!/x/a.txt", "o.zip!/d/in.tar!/b.gz", "o.zip!/d/in.tar!/b.gz!/b"} and got["o.zip!/d/in.tar!/b.gz!/b"] == b"b text"
    assert dict(formats.members(gzip.compress(inner), "t.tgz"))["t.tgz!/t.tar!/x/a.txt"] == b"a"
    assert {k for k in dict(formats.members(mail(), "m.eml"))} == {"m.eml!/more.zip", "m.eml!/note.txt", "m.eml!/more.zip!/in/deep.txt"}
    nest = b"core"
    for _ in range(8):
        nest = gzip.compress(nest)
    assert len(list(formats.members(nest, "n.gz"))) == formats.MOST_DEPTH
    monkeypatch.setattr(formats, "MOST_BYTES", 1000)
    with pytest.raises(formats.TooLarge):
        list(formats.members(pack({"bomb": "0" * 100_000}), "b.zip"))


def test_ingest_of_containers(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, data in {"r.docx": DOCX, "s.xlsx": XLSX, "p.pptx": PPTX, "o.odt": ODT, "e.epub": EPUB, "m.eml": mail(), "a.zip": pack({"one.txt": "first member", "two.md": "# Two\nsecond member", "no.bin": "x", "node_modules/x.txt": "no"}), "bad.zip": b"PK\x03\x04broken"}.items():
        (root / name).write_bytes(data)
    store = Store(spark, f"file://{tmp_path}/s")
    ingest.ingest(spark, str(root), store, now=1)
    docs = {r["path"]: r for r in store.read("documents").collect()}
    assert set(docs) == {"r.docx", "s.xlsx", "p.pptx", "o.odt", "e.epub", "m.eml", "a.zip", "a.zip!/one.txt", "a.zip!/two.md", "m.eml!/more.zip", "m.eml!/note.txt", "m.eml!/more.zip!/in/deep.txt"}
    assert docs["a.zip!/two.md"]["title"] == "Two" and docs["m.eml"]["title"] == "Invoice" and docs["r.docx"]["mime"] == formats.TYPES["docx"] and "one.txt" in docs["a.zip"]["content"]
    assert [r["path"] for r in store.search(plan("deep text", fuzzy=False)).collect()] == ["m.eml!/more.zip!/in/deep.txt"]
    assert [r["path"] for r in store.search(plan("keywords:second member")).collect()] == ["a.zip!/two.md"]
    assert ingest.ingest(spark, str(root), store, now=2) is None
    (root / "a.zip").write_bytes(pack({"one.txt": "first member", "three.txt": "third"}))
    (root / "m.eml").unlink()
    ingest.ingest(spark, str(root), store, now=3)
    assert {r["path"] for r in store.read("documents").collect()} == {"r.docx", "s.xlsx", "p.pptx", "o.odt", "e.epub", "a.zip", "a.zip!/one.txt", "a.zip!/three.txt"}


def test_language(spark):
    sample, docs = (spark.read.parquet(f"/root/testdata/{d}/documents.parquet") for d in ("sf0.001", "sf0.01"))
    model = language.train(sample)
    assert model.groupBy("language").count().agg(F.max("count")).first()[0] <= language.MOST_GRAMS
    got = language.classify(docs.where("length(text) >= 20"), model, name="guess").select(F.avg((F.col("guess") == F.col("lang")).cast("double")), F.count("*")).first()
    assert got[0] > 0.9 and got[1] > 900
    guess = language.Guess(model)
    assert guess(None) is None and guess("123 ...") is None
    some = src.extract(spark.createDataFrame([("a.txt", bytearray(sample.where("lang = 'de'").first()["text"].encode()))], "path string, content binary"), language=guess).first()
    assert some["language"] == "de" and some["keywords"] and some["mime"] == "text/plain"
    p = plan("language:DE keywords:cat keywords:dog x")
    assert (p.language, p.keywords, p.text) == ("de", ("cat", "dog"), "x")


def test_keywords():
    text = "The engine reads files. The Engine writes an index. An index of the engine is small. It is the best of all, and it is quick."
    got = keywords(text, most=5)
    assert {"engine", "index"} <= set(got) and "the" not in got and keywords("") == [] and keywords("a 12 b") == [] and keywords(text) == keywords(text)


def test_language_finds_trigrams_without_a_loop_over_them(spark, monkeypatch):
    model = spark.createDataFrame([("de", " di", -1.0), ("de", "die", -1.5), ("en", " th", -1.0), ("en", "the", -1.25), ("fr", "die", -3.0), ("fr", " \u00e0 ", -0.5)], "language string, gram string, weight double")
    guess, real = language.Guess(model), language.grams
    texts = ["die the die", "The THE die", "die unknown, the_die", "die", "the2", "\u00c0 a", "xyz", " ", "", None]
    weights = lambda t, i: sum(n * guess.weights[guess.index[g], i] for g, n in real(t).items() if g in guess.index)
    want = [max(range(3), key=lambda i, t=t: weights(t, i)) if t and any(g in guess.index for g in real(t)) else None for t in texts]

    def slow(_):
        raise AssertionError

    monkeypatch.setattr(language, "grams", slow)
    assert [guess(t) for t in texts] == [None if i is None else guess.languages[i] for i in want]
    assert want[-4:] == [None] * 4 and set(want[:6]) == {0, 1, 2}
    # the trigrams are those of grams(), joined over texts and chunks
    mixed = ["a bc d\u00e9f \U0001d400x 12a", "", "bc bc Bc"]
    for t in mixed:
        assert {language._gram(int(c)): int(n) for c, n in zip(*np.unique(language._codes(t), return_counts=True), strict=True)} == dict(real(t))
    rows = language.train(spark.createDataFrame([("x", t) for t in mixed] + [("y", None), (None, "a")], "lang string, text string").repartition(2), most=50).collect()
    sums = sum((real(t) for t in mixed), Counter())
    assert {r["gram"]: round(r["weight"], 9) for r in rows} == {g: round(math.log((n + 1) / (sums.total() + 50)), 9) for g, n in sums.items()}
