"""Ingest of a folder into a store, and live changes of it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import state as st
from quarry.operators.language import Guess
from quarry.operators.store import Store
from quarry.plans.settings import Settings
from quarry.sources import files as src
from quarry.streaming import watch

__all__ = ["Store", "change", "ingest", "live", "rebuild"]


def ingest(spark: SparkSession, root: str, store: Store, settings: Settings | None = None, *, now: int | None = None, ignore: str = "", language: Guess | None = None) -> int | None:
    """Scans a folder and brings the store up to date: files that are new or changed are read, and what containers among them hold; equal
    contents are extracted once; files that the scan no longer has go, with their members. The new version, or None if nothing changed."""
    files = src.scan(spark, root, settings, ignore)
    state = store.read("file_state")
    todo = st.needs_index(files.drop("content"), state).select("path", "uri")
    gone = state.select("path", src.owner(F.col("path")).alias("owner"))
    # members of changed containers are put in anew
    gone = gone.join(files.select(F.col("path").alias("owner")), "owner", "left_anti").select("path").unionByName(_members(gone, todo))
    if todo.isEmpty() and gone.isEmpty():
        return None
    return store.apply(src.extract_distinct(src.expand(src.contents(spark, files, todo), settings), language=language), gone, int(time.time()) if now is None else now)


def _members(owned: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of the members of files, of owned (path, owner)."""
    return owned.where("path <> owner").join(files.select(F.col("path").alias("owner")), "owner", "left_semi").select("path")


def rebuild(spark: SparkSession, root: str, store: Store, settings: Settings | None = None, *, now: int | None = None, ignore: str = "", language: Guess | None = None) -> int | None:
    """Empties the store and ingests the folder, by the same rules."""
    store.clear()
    return ingest(spark, root, store, settings, now=now, ignore=ignore, language=language)


def change(spark: SparkSession, root: str, store: Store, removed: DataFrame, changed: DataFrame, *, settings: Settings | None = None, ignore: str = "", now: int | None = None, batch: tuple[str, int] | None = None, language: Guess | None = None) -> int | None:
    """Applies a batch of changed paths (relative to root): removed ones go; of the others files that are not there, excluded or of the same
    time and size are passed over, those of the same content get their new time and size alone, the rest is extracted. A batch that
    the store has already changes nothing. The driver holds the batch's paths, whose number the stream bounds."""
    files = src.some(spark, root, [r["path"] for r in changed.select("path").distinct().collect()], settings, ignore)
    state = store.read("file_state")
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    gate = st.change_gate(changed, hashed.drop("content"), state).where("action <> 'skip'")
    anew = gate.where("action = 'index'").select("path")
    docs = src.extract_distinct(src.expand(files.join(anew, "path", "left_semi"), settings), language=language)
    owned = state.select("path", src.owner(F.col("path")).alias("owner"))
    removed = removed.select("path").unionByName(_members(owned, removed)).unionByName(_members(owned, anew))
    old = store.read("documents").drop("modified", "size", "indexed_at")
    touched = old.join(gate.where("action = 'touch'").select("path", "modified", "size"), "path").withColumn("error", F.lit(None).cast("string"))
    return store.apply(docs.unionByName(touched, allowMissingColumns=True), removed, int(time.time()) if now is None else now, batch)


def live(spark: SparkSession, root: str, store: Store, events: DataFrame, checkpoint: str, *, name: str = "changes", settings: Settings | None = None, ignore: str = "", every: str | None = None, language: Guess | None = None) -> StreamingQuery:
    """Keeps a store up to date with a stream of events (path relative to root, action, seq), such as watch.source() or watch.merged() give.
    Each batch is one change of the store, once: its number is in the manifest, so a batch that is run again after a restart
    between the store's change and the stream's checkpoint changes nothing."""
    settings = settings or Settings()
    run = lambda gone, new, number: change(spark, root, store, gone, new, settings=settings, ignore=ignore, batch=(name, number), language=language)
    return watch.apply_to(events, run, checkpoint, excludes=settings.excludes(), extensions=settings.allowed_extensions(), every=every)
