"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import by_shuffle, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) of every node with an edge; edges: columns a and b. comp is the least node reachable.

    Each step is two shuffles and is written to the shared folder, so the lineage stays short. The
    number of steps grows with the logarithm of the nodes. Labels never reach the driver. Self loops
    and repeated edges are harmless; nulls are ignored.
    """
    links = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), name)
    while True:
        both = links.union(links.select("u", "v").toDF("v", "u"))  # v sees its neighbour u
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.join(by_shuffle(least), "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(by_shuffle(low), "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        new = materialize(small, name)
        # done when every node has one neighbour below it, and that has none
        ends = new.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("head")).union(new.select("u", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("below").alias("b"), F.max("head").alias("h")).where("b > 1 or b + h > 1").isEmpty():
            break
        links = new
    return new.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(new.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
