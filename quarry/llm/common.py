"""What the operators share: the shared folder, cutting lineage, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.lineage import shared_folder

#: Rows and bytes of an Arrow batch given to Python: long texts must not fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Keys that may be broadcast as hot: a hot key has more rows than all rows by this, and some at least.
MOST_HOT, LEAST_HOT = 1000, 100
#: Bitmaps of 4 KB that may be broadcast to pick rows by: 64 MB, 500 million rows.
MOST_MAPS = 16_384

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's Python stages: lowers the session's own bounds where they are above, and leaves
    them so, as plans run after the operators have returned."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        size = int(re.sub(r"[bB]$", "", now)) if now and re.fullmatch(r"-?\d+[bB]?", now) else 0
        if not 0 < size <= most:
            spark.conf.set(name, str(most))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: the folder's owner removes what is left
            return


def new_path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/quarry/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that a lost executor costs no recomputation of what
    lies before. The folder goes with the session."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path  # type: ignore[attr-defined]
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what cut() wrote for these frames."""
    for df in frames:
        if path := getattr(df, "_quarry_path", None):
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def pick(rows: DataFrame, ids: DataFrame, key: str = "rid") -> DataFrame:
    """The rows whose key (a long, 0 or more, as monotonically_increasing_id() gives it) is among ids. Wide rows don't move: ids
    become bitmaps of 32,768 numbers each, which are broadcast if they take no more than MOST_MAPS of them; beyond that it is a
    semi-join."""
    ids = ids.select(key).withColumn("bucket", F.bitmap_bucket_number(key))
    # dealt by bucket before they are set in bitmaps, so that no task has all buckets
    maps = cut(ids.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits")))
    if maps.count() > MOST_MAPS:
        release(maps)
        return rows.join(ids.select(key).distinct(), key, "left_semi")
    at = F.bitmap_bit_position(key).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bucketed = rows.withColumn("_bucket", F.bitmap_bucket_number(key))
    there = bucketed.join(F.broadcast(maps), F.col("_bucket") == F.col("bucket")).where(F.getbit(byte, at % 8) == 1)
    return there.select(*rows.columns)


@contextmanager
def only_result(spark: SparkSession) -> Iterator[None]:
    """Of what cut() writes within, the last alone is kept, which must be the result."""
    known = {path for _, path in _written}
    yield
    gone = [path for _, path in _written if path not in known][:-1]
    for path in gone:
        _delete(spark, path)
    _written[:] = [x for x in _written if x[1] not in gone]


def join_hot(rows: DataFrame, keyed: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row a key and in `weight` the number of rows with it; total: at least the sum of
    those. Keys that hold more than a thousandth of all rows, so fewer than a thousand of them, are broadcast and their rows
    stay where they are; the others are shuffled by key. No task gets more than about a thousandth for one key."""
    least = max(total // MOST_HOT, LEAST_HOT)
    # both sides are read more than once: they are to be cut()
    hot = keyed.where(F.col(weight) > least)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keyed.where(F.col(weight) <= least), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    links: columns a, b of one orderable type. Returns (node, root), root being the smallest node of the component; nodes
    without links are absent. Each step is cut(), so lineage stays short. Minima are combined before they are shuffled, and the
    rows of a star with a large part of all edges stay where they are (join_hot). Self-links and links with a null
    end are ignored.
    """
    edges = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, settled = cut(edges.where("u <> v").distinct()), False
    n = edges.count()
    for _ in range(rounds):
        if not n:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("rows")))
        # large star: each neighbour larger than u is linked to the least of u's neighbourhood
        large = cut(join_hot(both.where("v > u"), least, "u", "rows", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        release(least)
        # small star: each neighbour not above u, and u, are linked to the least of them
        down = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")))
        small = join_hot(large, down, "u", "rows", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionAll(down.select("u", F.col("m").alias("v"))).distinct())
        release(large, down)
        # it ended when every node hangs on one root that is itself nobody's leaf
        n = new.count()
        settled = n == new.select("u").distinct().count() and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        release(edges)
        edges = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = cut(hung.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root")))
    release(edges)
    return out
