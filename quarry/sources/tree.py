"""Paths from a parent-pointer table, as file tables of volumes have it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import cut

#: Hops to the root at most.
MOST_HOPS = 50


def folder_paths(nodes: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """nodes: id, parent_id, name. (id, path, depth) of the nodes that reach a root, which is its own parent; orphans and what is
    deeper than `most` hops drop out. Parts that are empty or hold a colon are left out of paths.

    Goes down level by level by joins, each level being cut from those above; the loop ends with the deepest."""
    part = F.when((F.col("name") != "") & ~F.col("name").contains(":"), F.col("name"))
    own = nodes.select("id", "parent_id", part.alias("part"))
    level = own.where("id = parent_id").select("id", F.lit("").alias("path"), F.lit(0).alias("depth"))
    out, below = level, own.where("id <> parent_id")
    for _ in range(most):
        up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("up"), F.col("depth").alias("above"))
        level = below.join(up, "parent_id").select("id", F.concat("up", F.coalesce(F.concat(F.lit("/"), "part"), F.lit(""))).alias("path"), (F.col("above") + 1).alias("depth"))
        level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
