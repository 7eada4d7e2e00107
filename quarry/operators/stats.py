"""Statistics and lists over the index and the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def history(log: DataFrame, limit: int = 50) -> DataFrame:
    """log: query, at (orderable). Queries with frequency and last_used, the most frequent first, the newer among equals."""
    return log.groupBy("query").agg(F.count("*").alias("frequency"), F.max("at").alias("last_used")).orderBy(F.desc("frequency"), F.desc("last_used"), "query").limit(limit)


def recent_searches(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.groupBy("query").agg(F.max("at").alias("last_used")).orderBy(F.desc("last_used"), "query").limit(limit)


def pinned(pins: DataFrame) -> DataFrame:
    """pins: path, action (pin or unpin), at. Paths whose last action is pin, with the time since which they are."""
    last = pins.groupBy("path").agg(F.max_by("action", "at").alias("action"), F.max("at").alias("pinned_at"))
    return last.where("action = 'pin'").select("path", "pinned_at")
