"""Exports of hits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("score", "path", "title")


def export_rows(hits: DataFrame) -> DataFrame:
    """Score, File Path, Title; a null title is empty."""
    return hits.select(F.col("score").alias("Score"), F.col("path").alias("File Path"), F.coalesce("title", F.lit("")).alias("Title"))


def export_csv(hits: DataFrame, path: str) -> None:
    export_rows(hits).write.mode("overwrite").option("header", "true").csv(path)


def json_rows(hits: DataFrame) -> DataFrame:
    """(path, json): each hit with all of its columns."""
    return hits.select("path", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def export_json(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export(hits: DataFrame, path: str, kind: str) -> None:
    {"csv": export_csv, "json": export_json}[kind](hits, path)


def lines(hits: DataFrame, as_json: bool = False) -> list[str]:
    """What a terminal shows of a limited page: score | path, or JSON of score, path and title."""
    rows = [r.asDict() for r in hits.select(*COLUMNS).collect()]
    return [json.dumps(r) for r in rows] if as_json else [f"{r['score']:.6f} | {r['path']}" for r in rows]
