"""Structural elements of documents and their highlighted form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as fn

#: Tags that make elements; others are unknown to a preview.
ELEMENTS = {"title": "Title", "h1": "Heading", "h2": "Heading", "h3": "Heading", "h4": "Heading", "h5": "Heading", "h6": "Heading", "p": "NarrativeText", "li": "ListItem", "pre": "CodeBlock", "code": "CodeBlock", "table": "Table", "blockquote": "Quote"}
_TAG = r"(?is)<({})\b[^>]*>(.*?)</\1\s*>".format("|".join(ELEMENTS))


def _plain(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, element_type, content): in the document's order, from 0, without empty ones. Scripts, styles and comments are
    taken out first; elements do not nest."""
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tags = F.regexp_extract_all(body, F.lit(_TAG), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(_TAG), F.lit(2))
    kinds = F.create_map(*(F.lit(x) for kv in ELEMENTS.items() for x in kv))
    rows = F.transform(F.arrays_zip(tags.alias("t"), texts.alias("c")), lambda x: F.struct(kinds[F.lower(x["t"])].alias("element_type"), _plain(x["c"]).alias("content")))
    return pages.select(key, F.posexplode(F.filter(rows, lambda r: r["content"] != "")).alias("pos", "e")).select(key, "pos", "e.element_type", "e.content")


def highlighted(rows: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """Elements with spans array<struct<text, hit>> in place of content."""
    return rows.withColumn("spans", fn.spans(F.col("content"), terms, case_sensitive)).drop("content")


def preview(rows: DataFrame, key: str, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """A row a document: its elements in order, as array<struct<pos, element_type, spans>>, and their number."""
    out = highlighted(rows, terms, case_sensitive).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "element_type", "spans"))).alias("elements"))
    return out.withColumn("n_elements", F.size("elements"))
