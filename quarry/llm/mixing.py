"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document of quality weight w gets the key -ln(u) / w, u being uniform and drawn from a hash of its id; ascending keys are
a weighted sample without replacement. A source's budget is first met by complete epochs (every document once for each);
the remainder takes documents in order of their keys until the prefix sum of their sizes reaches what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Weights of the sources in order of their names, repeating; share of all words that the mix has; most epochs of a source.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Slices of a source's keys. Prefix sums run over slices and then within the one slice that the budget ends in.
SLICES = 4096


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds target: the share of all sizes by weight, stopped at most times
    the source's size, the excess reshared by weight among the others until none is above.

    The fill level is found in closed form: with r = most * size / weight ascending, the sources up to some point are full
    and the others get level * weight; the level is the first at which the next r is not reached. Null sources come last;
    if nothing is left to fill, every source has its most."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    whole = Window.partitionBy()
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    t = (
        t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("full", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("at", F.row_number().over(by))
        .withColumn("rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    )
    # the first source, by r, whose level stays below its r sets the level for all after it
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("at", "level"))).over(whole)["level"])
    return t.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text, source, and the columns to keep, of other names than the result's. quality: (doc_id, weight > 0), a row a document at most; documents without have weight 1.

    Returns the kept columns, doc_id, source, size, source_size, target, times and taken: times is how often the mix has the
    document, and taken size times that. A source's taken words differ from its target by less than half its largest fractional document. Null texts
    have size 0 and nothing taken; null sources are one source, last; repeated rows count each for themselves, with
    ties of keys broken by size; rows that share a doc_id, or have none, have keys of their own unless their texts are equal; an
    empty table gives an empty result; other columns are not read. Reruns agree, as u comes from a hash of doc_id, text and seed. The sizes are cut(), so texts are read once. Shuffles carry sums of (source, slice) only;
    rows of the one slice that a budget ends in are ordered, one small window a source."""
    names = [*keep, "doc_id", "source", "size", "key", "slice"]
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(seed))
    rows = docs.select(*keep, "doc_id", "source", n_words(F.col("text")).alias("size"), h.alias("_h"))
    if quality is not None:
        rows = rows.join(quality.where("weight > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    u = (F.shiftrightunsigned("_h", 11).cast("double") + 0.5) / float(1 << 53)
    # 1 - exp(-key) is uniform for weight 1: slices of it are about even whatever the weights' mix
    rows = rows.withColumn("key", -F.ln(u) / F.coalesce("weight", F.lit(1.0))).withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int"))
    rows = cut(rows.select(*names))

    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    sources = slices.groupBy("source").agg(F.sum("n").alias("source_size"))
    goal = targets(sources, weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = cut(goal)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ends = slices.withColumn("before", before).join(goal.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
    # one slice a source: the first whose words pass what is left
    ends = cut(ends.where("before + n > left and before <= left and n > 0").groupBy("source").agg(F.min(F.struct("slice", "before")).alias("e")).select(F.col("source").alias("s"), F.col("e.slice").alias("end"), F.col("e.before").alias("before")))
    goal = goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "left", "end", "before")
    at = rows.join(_small(goal), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    whole = at.where("end is null or slice <> end").withColumn("more", F.when(F.col("end").isNull(), F.col("left") > 0).otherwise(F.col("slice") < F.col("end")).cast("long"))
    w = Window.partitionBy("source").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = at.where("slice = end").withColumn("through", F.col("before") + F.sum("size").over(w))
    part = part.withColumn("more", (F.col("through") - F.col("size") / 2 <= F.col("left")).cast("long")).drop("through")
    out = whole.unionByName(part)
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("more")).otherwise(0)
    return out.select(*keep, "doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def _small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Broadcasts a table of a row a source if there are few enough of them, a count that is checked here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
