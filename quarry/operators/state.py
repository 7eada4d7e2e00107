"""File state: what is stale, upserts, deletions, purges, and changes of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staleness(files: DataFrame, state: DataFrame) -> DataFrame:
    """files (path, modified, size, ...) with status: new, stale (modified or size differs) or same."""
    s = state.select("path", F.col("modified").alias("s_modified"), F.col("size").alias("s_size"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(~(F.col("modified").eqNullSafe(F.col("s_modified")) & F.col("size").eqNullSafe(F.col("s_size"))), "stale").otherwise("same")
    return files.join(s, "path", "left").withColumn("status", status).drop("s_modified", "s_size", "known")


def needs_index(files: DataFrame, state: DataFrame) -> DataFrame:
    return staleness(files, state).where("status <> 'same'").drop("status")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def distinct_content(docs: DataFrame) -> DataFrame:
    """(content_hash, path, copies): the first path of each content, which alone need be extracted."""
    return docs.withColumn("content_hash", content_hash(F.col("content"))).groupBy("content_hash").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def upsert(old: DataFrame, new: DataFrame, order: str = "indexed_at") -> DataFrame:
    """Both tables' rows with one for each path: the latest by `order`, the new table's among equals."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("path").orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at", "_new")


def delete(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path").distinct(), "path", "left_anti")


def under(path: Column, folder: str) -> Column:
    """Whether a path is the folder or lies in it; separators at the folder's end don't matter."""
    f = folder.rstrip("/\\")
    return (path == f) | path.startswith(f + "/") | path.startswith(f + "\\")


def purge(table: DataFrame, folder: str) -> DataFrame:
    return table.where(~under(F.col("path"), folder))


def change_gate(events: DataFrame, files: DataFrame, state: DataFrame) -> DataFrame:
    """What an Index event calls for: events (path), files (path, modified, size, content_hash), state (same and hash). action is
    skip (file gone or state the same), touch (same content: state only) or index."""
    f = files.select("path", *(F.col(c).alias(f"f_{c}") for c in ("modified", "size", "content_hash")))
    s = state.select("path", *(F.col(c).alias(f"s_{c}") for c in ("modified", "size", "content_hash")))
    both = events.select("path").distinct().join(f, "path", "left").join(s, "path", "left")
    same = (F.col("f_modified") == F.col("s_modified")) & (F.col("f_size") == F.col("s_size"))
    action = F.when(F.col("f_modified").isNull() | F.coalesce(same, F.lit(False)), "skip").when(F.col("f_content_hash").eqNullSafe(F.col("s_content_hash")), "touch").otherwise("index")
    return both.select("path", F.col("f_modified").alias("modified"), F.col("f_size").alias("size"), F.col("f_content_hash").alias("content_hash"), action.alias("action"))
