"""Fuzzy look-ups of file names: subsequence candidates, scored in bytes; lower is better."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.lineage import bounded_batches

#: Characters whose presence in a block of a written dictionary is a column, the rarer ones of names first, and names of a block.
CHARACTERS, BLOCK = "qxzjkvw0123456789ybhfgpumdclnotrisae", 32


def _subsequence(query: str) -> str:
    return "(?s)" + ".*?".join(re.escape(c) if not c.isalnum() else c for c in query)


def match_score(name: Column, query: str) -> Column:
    """Equal 0; beginning 1 and a thousandth for each byte more; inside 2, a hundredth for each byte before and a thousandth for
    each byte more; subsequence 3, a tenth for each byte of gaps, a hundredth for each before, a thousandth for each byte."""
    q, low = query.lower(), F.lower(name)
    n, m = F.octet_length(low), len(q.encode())
    more = (n - m) * 0.001
    before = lambda rx: F.octet_length(F.split(low, rx, 2)[0])  # noqa: E731  bytes in front of the first match
    exact = re.escape(q) if not q.isalnum() else q
    span = F.octet_length(F.regexp_extract(low, f"({_subsequence(q)})", 1)) - (len(q[-1].encode()) if q else 0) + 1
    gap = F.greatest(span - m, F.lit(0))
    loose = 3 + gap * 0.1 + before(_subsequence(q)) * 0.01 + n * 0.001
    return F.round(F.when(low == q, 0.0).when(low.startswith(q), 1 + more).when(low.contains(q), 2 + before(exact) * 0.01 + more).otherwise(loose), 6)


def search(files: DataFrame, query: str, limit: int) -> DataFrame:
    """files: path, name. The limit's best (path, name, score), ties by lower-cased name, then path."""
    q = query.lower()
    hits = files.where(F.lower("name").rlike(_subsequence(q))) if q else files
    return hits.select("path", "name", match_score(F.col("name"), q).alias("score")).orderBy("score", F.lower("name"), "path").limit(limit)


def as_hits(found: DataFrame) -> DataFrame:
    """Hits as a result list shows them: score 1, the name as title, neither size nor time."""
    return found.select(F.lit(1.0).alias("score"), "path", F.col("name").alias("title"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("modified"))


def write(files: DataFrame, path: str) -> None:
    """A dictionary of files (path, name; more columns): blocks of names that have the same characters, in that order, then lower-cased; columns
    has_<character> tell what is in a block, so Parquet's statistics pass over row groups and pages that lack one of a query's."""
    bounded_batches(files.sparkSession)
    low = F.lower("name")
    # ascending strings of digits put names without rare characters first
    key = F.concat(*(F.when(low.contains(c), "1").otherwise("0") for c in CHARACTERS))
    more = [c for c in files.columns if c not in ("path", "name")]
    rows = files.where("name is not null").select("path", "name", low.alias("low"), key.alias("key"), *more)
    rows = rows.repartitionByRange("key", "low", "path").sortWithinPartitions("key", "low", "path")
    fields = [f"{f.name}:{f.dataType.simpleString()}" for f in files.select("path", "name", *more).schema]
    names = [f.partition(":")[0] for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), BLOCK):
                part = pdf.iloc[i : i + BLOCK]
                there = [any(bits) for bits in zip(*([b == "1" for b in k] for k in part["key"]), strict=True)]
                out.append((part["low"].iloc[0], *there, part[names].to_dict("records")))
            yield pd.DataFrame(out, columns=["first", *(f"has_{c}" for c in CHARACTERS), "files"])

    schema = f"first string, {', '.join(f'has_{c} boolean' for c in CHARACTERS)}, files array<struct<{','.join(fields)}>>"
    rows.mapInPandas(run, schema).write.options(**{"parquet.page.row.count.limit": "16", "parquet.block.row.count.limit": "4096"}).parquet(path)


def candidates(blocks: DataFrame, query: str) -> DataFrame:
    """The rows of a dictionary's blocks that have all of a query's characters."""
    for c in sorted(set(query.lower()) & set(CHARACTERS)):
        blocks = blocks.where(F.col(f"has_{c}"))
    return blocks


def opened(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.inline("files"))


def lookup(spark: SparkSession, path: str, query: str, limit: int, report: dict | None = None) -> DataFrame:
    """What search() gives of the files in a written dictionary. report gets its blocks and those that were opened."""
    blocks = spark.read.parquet(path)
    own = candidates(blocks, query)
    if report is not None:
        report.update(blocks=blocks.count(), read=own.count())
    return search(opened(own), query, limit)


def migrate(spark: SparkSession, source: str, path: str) -> None:
    """Writes the dictionary of an older list, a JSON array of objects with path and name."""
    write(spark.read.schema("path string, name string").option("multiLine", "true").json(source), path)


def stats(files: DataFrame) -> DataFrame:
    """Number of names and their bytes: path, name and 32 more for each."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.octet_length("path") + F.octet_length("name") + 32), F.lit(0)).alias("n_bytes"))
