"""Live updates: a stream of change events (path, action, seq, ts), debounced, reduced to the last of each path, and applied."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions import text as fn
from quarry.plans.lineage import cut

#: Quiet time that ends a batch, and the longest that a batch stays open, in seconds.
GAP, CAP = 0.5, 5.0


def last_of_each(events: DataFrame) -> DataFrame:
    """(path, action, seq): each path's last event."""
    return events.groupBy("path").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def relevant(events: DataFrame, excludes: list[str], extensions: list[str]) -> DataFrame:
    """Without events on excluded paths, and Index events on other extensions; Remove events pass whatever the extension."""
    keep = (F.col("action") == "Remove") | F.coalesce(fn.extension(F.col("path")).isin(extensions), F.lit(False))
    return events.where(~fn.excluded(F.col("path"), excludes)).where(keep)


def _flushes(times: list[float], gap: float, cap: float) -> list[int]:
    """Number of the batch of each time, ascending: a batch ends before a pause of more than gap, or beyond cap since it began."""
    out, n, first, before = [], -1, 0.0, float("-inf")
    for t in times:
        if n < 0 or t - before > gap or t - first > cap:
            n, first = n + 1, t
        out.append(n)
        before = t
    return out


def debounce(events: DataFrame, *, key: str, gap: float = GAP, cap: float = CAP) -> DataFrame:
    """Batch form: events with key, seq and t (seconds) get `flush`, their batch's number within the key, from 0.

    A batch always ends at a pause longer than the gap, so a key's events are cut there into pieces, and only pieces that last longer than
    the cap are gone through in order, each in one task. Events are dealt by ranges of (key, t, seq), however many a key has;
    places and numbers come from sums within ranges and over the ranges' totals, a row a range."""
    order = [key, "t", "seq"]
    dealt = cut(events.select(key, "seq", "t").repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), key, "seq", "t"))
    within, ranges = Window.partitionBy("part").orderBy("row"), Window.orderBy("part")
    at = F.struct(F.col(key).alias("k"), "t")
    last = dealt.groupBy("part").agg(F.max_by(at, "row").alias("last")).select("part", F.lag("last").over(ranges).alias("before"))
    rows = dealt.withColumn("own", F.lag(at).over(within)).join(F.broadcast(last), "part").withColumn("p", F.coalesce("own", "before"))
    begins = F.col("p").isNull() | ~F.col("p.k").eqNullSafe(F.col(key)) | (F.col("t") - F.col("p.t") > gap)

    def numbered(df: DataFrame, flag: str, name: str) -> DataFrame:
        """How many rows up to each one have the flag, less one."""
        one = F.col(flag).cast("long")
        totals = df.groupBy("part").agg(F.sum(one).alias("n")).select("part", (F.sum("n").over(ranges) - F.col("n")).alias("offset"))
        return df.withColumn("_sum", F.sum(one).over(within)).join(F.broadcast(totals), "part").withColumn(name, F.col("_sum") + F.col("offset") - 1).drop("_sum", "offset")

    pieces = cut(numbered(rows.select("part", "row", key, "seq", "t", begins.alias("begins")), "begins", "piece"))
    long = pieces.groupBy("piece").agg((F.max("t") - F.min("t")).alias("lasts")).where(F.col("lasts") > cap).select("piece")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        numbers = pd.Series(_flushes(pdf["t"].tolist(), gap, cap), index=pdf.index)
        return pdf.loc[numbers.diff() > 0, ["row"]]

    more = pieces.join(long, "piece", "left_semi").select("piece", "row", "t").groupBy("piece").applyInPandas(split, "row long")
    flagged = pieces.join(more.withColumn("_cut", F.lit(True)), "row", "left").withColumn("flag", F.col("begins") | F.col("_cut").isNotNull())
    every = numbered(flagged, "flag", "number")
    first = every.groupBy(F.col(key).alias("_key")).agg(F.min("number").alias("base"))
    return every.join(first, F.col(key).eqNullSafe(F.col("_key"))).select(key, "seq", "t", (F.col("number") - F.col("base")).alias("flush"))


def debounced(events: DataFrame, *, key: str = "root", gap: float = GAP, cap: float = CAP) -> DataFrame:
    """Streaming form: events (root, path, action, seq, t seconds, in arrival order) come out as (root, flush, path, action, seq), last of
    each path, once their batch has ended; the state holds the open batch's last event of each path only."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, first, before, held = state.get if state.exists else (0, 0.0, 0.0, "{}")
        import json

        open_ = json.loads(held)
        out = []

        def close() -> None:
            nonlocal number, open_
            out.extend((k[0], number, p, a, s) for p, (a, s) in open_.items())
            number, open_ = number + 1, {}

        if state.hasTimedOut:
            close()
        else:
            rows = pd.concat(list(frames)).sort_values(["t", "seq"])
            for t, seq, path, action in rows[["t", "seq", "path", "action"]].itertuples(index=False):
                if open_ and (t - before > gap or t - first > cap):
                    close()
                if not open_:
                    first = t
                open_[path], before = (action, int(seq)), t
        state.update((number, first, before, json.dumps(open_)))
        if open_:
            state.setTimeoutDuration(max(1, int(min(gap, cap) * 1000)))
        if out:
            yield pd.DataFrame(out, columns=["root", "flush", "path", "action", "seq"])

    return events.groupBy(key).applyInPandasWithState(run, "root string, flush long, path string, action string, seq long", "number long, first double, last double, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def source(spark: SparkSession, folder: str, *, most_files: int = 100, kind: str = "json", schema: str = "path string, action string, seq long") -> DataFrame:
    """A stream of the events in files that arrive in a folder, at most so many files a batch; what is more waits its turn."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(kind).load(folder)


def merged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Events of several sources as one stream, such as those that programs inject."""
    for more in others:
        first = first.unionByName(more.select(*first.columns))
    return first


def roots_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root, change): roots (root) that are watched no longer, `stop`, and those that are now, `start`."""
    a, b = old.select("root").distinct(), new.select("root").distinct()
    return a.join(b, "root", "left_anti").withColumn("change", F.lit("stop")).unionByName(b.join(a, "root", "left_anti").withColumn("change", F.lit("start")))


class Watch:
    """Streams of the watched roots. A root that comes back goes on from its own checkpoint."""

    def __init__(self, spark: SparkSession, start: Callable[[str, str], StreamingQuery], checkpoints: str) -> None:
        self.spark, self.start, self.checkpoints = spark, start, checkpoints.rstrip("/")
        self.running: dict[str, StreamingQuery] = {}

    def update(self, roots: list[str]) -> dict[str, str]:
        """Stops the streams of roots that are not among roots, starts those that are new: what was done, by root."""
        of = lambda names: self.spark.createDataFrame([(r,) for r in names], "root string")
        done = {r["root"]: r["change"] for r in roots_changed(of(list(self.running)), of(roots)).collect()}
        for root, what in sorted(done.items()):
            if what == "stop":
                self.running.pop(root).stop()
            else:
                self.running[root] = self.start(root, f"{self.checkpoints}/{hashlib.sha256(root.encode()).hexdigest()[:16]}")
        return done


def apply_to(events: DataFrame, change: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, *, excludes: list[str], extensions: list[str], every: str | None = None) -> StreamingQuery:
    """Runs change(removed paths, paths to index, number of the batch) for each micro-batch that has any, on the last event of each path. A batch
    may run again, under its number, after a restart. With `every` the trigger bounds the delay; without, what there is is worked off
    and the query ends."""

    def batch(df: DataFrame, number: int) -> None:
        last = last_of_each(relevant(df, excludes, extensions)).persist()
        try:
            if not last.isEmpty():
                change(last.where("action = 'Remove'").select("path"), last.where("action <> 'Remove'").select("path"), number)
        finally:
            last.unpersist()

    w = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
