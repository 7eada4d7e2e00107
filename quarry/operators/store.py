"""A corpus as immutable segments under numbered manifests.

A segment is a part of an index (see index.py) whose document table also is the corpus' document table, file state and list of names. A
change writes one segment with the new rows, and a set of the (segment, document) that no longer count; then a manifest with the next
number, which names all that counts. The highest manifest is the corpus; it is put there in one step, and never over another, so
readers see all of a change or nothing, and of two writers one begins again. What a change writes is in proportion to it;
compact() merges segments of like sizes, vacuum() removes what only old manifests name.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.operators import filename
from quarry.operators import state as st
from quarry.operators.cache import PageCache
from quarry.operators.index import Index, write_blocks, write_docs
from quarry.plans import folders
from quarry.plans.query import SearchPlan

ROW = "path string, name string, content string, title string, extension string, language string, keywords string, mime string, modified long, size long, content_hash string, indexed_at long, error string"
TABLES = {
    "documents": "path string, content string, title string, extension string, language string, keywords string, mime string, modified long, size long, content_hash string, indexed_at long",
    "file_state": "path string, modified long, size long, content_hash string, indexed_at long",
    "filenames": "path string, name string",
}
#: The form of manifests and segments.
VERSION = 2
#: Segments of like size that are merged, and attempts of a change whose manifest another writer's took the place of.
FAN, TRIES = 8, 10


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Snapshot(Index):
    """What one manifest names. Rows whose extraction failed are files, but no documents."""

    def rows(self) -> DataFrame:
        return super().docs()

    def names(self, query: str, limit: int) -> DataFrame:
        found = filename.candidates(self._read("names"), query).select("seg", F.inline("files"))
        found = found if self.dead is None else found.join(self.dead.select("seg", "doc"), ["seg", "doc"], "left_anti")
        return filename.search(found, query, limit)

    def docs(self) -> DataFrame:
        return super().docs().where("error is null")


class Store:
    """The corpus below a root folder. Any number of readers and writers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.pages = spark, root.rstrip("/"), PageCache()

    # ---- manifests

    def manifests(self) -> list[int]:
        return [int(n) for n, _ in folders.entries(self.spark, f"{self.root}/manifests") if n.isdigit()]

    def manifest(self, number: int | None = None) -> dict:
        """The newest manifest, or one of the older: number, segments and deletes (rows by name), batches (the last one of each stream)."""
        number = max(self.manifests(), default=0) if number is None else number
        if not number:
            return {"number": 0, "segments": {}, "deletes": {}, "batches": {}}
        return json.loads(folders.content(self.spark, f"{self.root}/manifests/{number:020d}")) | {"number": number}

    def version(self) -> int:
        return max(self.manifests(), default=0)

    def _commit(self, before: dict, **changes: dict) -> int | None:
        """Puts the manifest after `before`; None if there is one already."""
        new = {k: before[k] for k in ("segments", "deletes", "batches")} | changes | {"version": VERSION}
        number = before["number"] + 1
        return number if folders.publish(self.spark, f"{self.root}/manifests/{number:020d}", json.dumps(new, sort_keys=True)) else None

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> tuple[Store, bool]:
        """The store at root, and whether what was there could not be used: a broken manifest, one of another version, or one whose
        segments are gone. That is put aside as .backup, and the store is empty."""
        store = cls(spark, root)
        try:
            known = store.manifest()
            paths = [f"{store.root}/segments/{n}/{t}/_SUCCESS" for n in known["segments"] for t in ("docs", "blocks", "near", "names")]
            if known.get("version", VERSION) == VERSION and all(folders.exists(spark, p) for p in (*paths, *(f"{store.root}/deletes/{n}/_SUCCESS" for n in known["deletes"]))):
                return store, False
        except (ValueError, KeyError):
            pass
        folders.delete(spark, f"{store.root}.backup")
        folders.move(spark, store.root, f"{store.root}.backup")
        return store, True

    # ---- reading

    def snapshot(self, known: dict | None = None) -> Snapshot:
        known = self.manifest() if known is None else known
        dead = self.spark.read.schema("seg string, doc long").parquet(*(f"{self.root}/deletes/{n}" for n in sorted(known["deletes"]))) if known["deletes"] else None
        return Snapshot(self.spark, [f"{self.root}/segments/{n}" for n in sorted(known["segments"])], dead)

    def _rows(self, known: dict) -> DataFrame:
        return self.snapshot(known).rows() if known["segments"] else self.spark.createDataFrame([], f"{ROW}, doc long, seg string")

    def read(self, table: str) -> DataFrame:
        rows = self._rows(self.manifest())
        return (rows.where("error is null") if table == "documents" else rows).select(*columns(TABLES[table]))

    def get_metadata(self, path: str) -> DataFrame:
        return self.read("file_state").where(F.col("path") == path)

    def all_paths(self) -> DataFrame:
        return self.read("file_state").select("path")

    def search(self, plan: SearchPlan, report: dict | None = None) -> DataFrame:
        """The plan's page, by the segments' indexes; pages are kept until the corpus changes."""
        known = self.manifest()
        if not known["segments"]:
            return self.spark.createDataFrame([], f"{ROW}, score double")
        return self.pages.get(plan, lambda p: self.snapshot(known).search(p, report), known["number"])

    def search_names(self, query: str, limit: int) -> DataFrame:
        """(path, name, score) of the limit's best file names, by the segments' dictionaries."""
        known = self.manifest()
        if not known["segments"]:
            raise ValueError("there is no corpus")
        return self.snapshot(known).names(query, limit)

    def statistics(self) -> DataFrame:
        """A row: n_docs, the documents that count, and n_bytes, of the files that the manifest names."""
        known = self.manifest()
        bytes_ = sum(folders.size(self.spark, f"{self.root}/{kind}/{n}") for kind in ("segments", "deletes") for n in known[kind])
        return self.read("documents").agg(F.count("*").alias("n_docs")).withColumn("n_bytes", F.lit(bytes_).cast("long"))

    # ---- changes

    def _segment(self, rows: DataFrame, repeats: bool = False) -> dict[str, int]:
        """Writes a segment of the rows, each computed once; nothing if there are none. repeats: paths may be there several times; their last
        modified row counts, among equals that of the greater hash, then size."""
        name = f"s{uuid.uuid4().hex}"
        path, beside = f"{self.root}/segments/{name}", f"{self.root}/staged/{uuid.uuid4().hex}"
        try:
            own = write_docs(rows, f"{beside}/docs")
            if own.isEmpty():
                return {}
            w = Window.partitionBy("path").orderBy(F.desc_nulls_last("modified"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("size"), "doc")
            older = own.withColumn("_at", F.row_number().over(w)).where("_at > 1").select("doc") if repeats else None
            if older is not None:
                # no texts go through the window
                older.write.parquet(f"{beside}/older")
                older = self.spark.read.schema("doc long").parquet(f"{beside}/older")
            if older is None or older.isEmpty():
                folders.make(self.spark, path)
                folders.move(self.spark, f"{beside}/docs", f"{path}/docs")
            else:
                write_docs(own.join(older, "doc", "left_anti").drop("doc"), f"{path}/docs")
        finally:
            folders.delete(self.spark, beside)
        own = self.spark.read.parquet(f"{path}/docs")
        write_blocks(own, path)
        filename.write(own.select("path", "name", "doc"), f"{path}/names")
        return {name: own.count()}

    def _lost(self, rows: DataFrame) -> dict[str, int]:
        """Writes which documents no longer count; nothing if there are none."""
        name = f"d{uuid.uuid4().hex}"
        path = f"{self.root}/deletes/{name}"
        rows.select("seg", "doc").write.parquet(path)
        n = self.spark.read.schema("seg string, doc long").parquet(path).count()
        if not n:
            folders.delete(self.spark, path)
        return {name: n} if n else {}

    def _drop(self, condition, segment: dict[str, int], batch: tuple[str, int] | None) -> tuple[int | None, int]:
        """Commits a segment and the deletion of what condition(rows) gives of the rows that count; the manifest's number and how
        many were deleted. Begins again where another writer came first."""
        for _ in range(TRIES):
            known = self.manifest()
            if batch and known["batches"].get(batch[0], -1) >= batch[1]:
                return None, 0
            lost = self._lost(condition(self._rows(known))) if known["segments"] else {}
            if not lost and not segment and not batch:
                return None, 0
            batches = known["batches"] | ({batch[0]: batch[1]} if batch else {})
            number = self._commit(known, segments=known["segments"] | segment, deletes=known["deletes"] | lost, batches=batches)
            if number:
                return number, sum(lost.values())
            for name in lost:
                folders.delete(self.spark, f"{self.root}/deletes/{name}")
        raise RuntimeError(f"{TRIES} other changes came first")

    def apply(self, docs: DataFrame, removed: DataFrame, now: int, batch: tuple[str, int] | None = None) -> int | None:
        """Removes paths, then puts documents in: the same path's older row goes. Of rows of one path the last modified counts, among
        equals that of the greater hash. The manifest's number; None if nothing changed.

        batch: a stream's name and the number of its batch. It goes into the manifest; a batch that is there already, or a later
        one, changes nothing."""
        if batch and self.manifest()["batches"].get(batch[0], -1) >= batch[1]:
            return None
        for c in ("mime", "language", "keywords", "error", "title"):
            docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("string"))
        own = docs.where("path is not null").withColumn("indexed_at", F.lit(now).cast("long")).withColumn("name", fn.file_name(F.col("path"))).select(*columns(ROW))
        segment = self._segment(own, repeats=True)
        new = [self.spark.read.parquet(f"{self.root}/segments/{name}/docs").select("path") for name in segment]
        changed = removed.select("path")
        for paths in new:
            changed = changed.unionByName(paths)
        changed = changed.distinct()
        return self._drop(lambda live: live.select("seg", "doc", "path").join(changed, "path", "left_semi"), segment, batch)[0]

    def remove(self, paths: DataFrame) -> int:
        """Deletes paths; how many of them there were."""
        gone = paths.select("path").distinct()
        return self._drop(lambda live: live.select("seg", "doc", "path").join(gone, "path", "left_semi"), {}, None)[1]

    def purge(self, folder: str) -> int:
        """Deletes all that lies in a folder; how many documents that were."""
        return self._drop(lambda live: live.where(st.under(F.col("path"), folder)), {}, None)[1]

    def clear(self) -> None:
        for _ in range(TRIES):
            known = self.manifest()
            if not known["segments"] or self._commit(known, segments={}, deletes={}):
                return
        raise RuntimeError(f"{TRIES} other changes came first")

    # ---- upkeep

    def compact(self, fan: int = FAN) -> int | None:
        """Merges segments where `fan` or more are of one size (rows between two powers of fan), without what no longer counts in them. The
        manifest's number; None if there was nothing to do, or another change came first."""
        known = self.manifest()
        tiers: dict[int, list[str]] = {}
        for name, n in known["segments"].items():
            tiers.setdefault(int(math.log(max(n, 1), fan) + 1e-9), []).append(name)
        merged = [name for names in tiers.values() if len(names) >= fan for name in names]
        if not merged:
            return None
        own = {"segments": {n: known["segments"][n] for n in merged}, "deletes": known["deletes"]}
        rows = self.snapshot(own).rows().select(*columns(ROW))
        segment = self._segment(rows)
        left = self._lost(self.snapshot(known).dead.where(~F.col("seg").isin(merged))) if known["deletes"] else {}
        return self._commit(known, segments={n: k for n, k in known["segments"].items() if n not in merged} | segment, deletes=left)

    def vacuum(self, keep: int = 2, grace: float = 3600.0) -> list[str]:
        """Removes all manifests but the last `keep`, then segments and deletions that none of those names and that are older than `grace`
        seconds, so that what running changes have written stays. The names removed."""
        numbers = sorted(self.manifests())
        kept = [self.manifest(n) for n in numbers[-keep:]]
        named = {n for m in kept for n in (*m["segments"], *m["deletes"])}
        before, gone = (time.time() - grace) * 1000, []
        for n in numbers[:-keep]:
            folders.delete(self.spark, f"{self.root}/manifests/{n:020d}")
        for kind in ("segments", "deletes", "staged"):
            for name, changed in folders.entries(self.spark, f"{self.root}/{kind}"):
                if name not in named and changed <= before:
                    folders.delete(self.spark, f"{self.root}/{kind}/{name}")
                    gone.append(name)
        return gone
