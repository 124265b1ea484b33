"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.llm.shared import discard, keep_at


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(``v``, ``root``) for every vertex of (``a``, ``b``) that is not the least of its component, the root.

    A round first points the larger end of every link at the least neighbour of its smaller end, then all smaller neighbours
    of a vertex at the least of them. Minima are aggregations combined before the shuffle, and every step is a small table of
    its own, so no neighbourhood is gathered and lost tasks cost one step. Rounds end when every vertex points at one other
    and none of these points on.
    """
    spark = links.sparkSession
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = keep_at(ordered, tasks)
    while True:
        old = [path]

        def step(df):
            table, own = keep_at(df, tasks)
            old.append(own)
            return table

        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = step(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")))
        large = step(current.join(least, "b").select("a", F.col("m").alias("b")))
        low, low_path = keep_at(large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("high")), tasks)
        if low.where("m < high").isEmpty() and low.join(low.select(F.col("m").alias("a")), "a", "left_semi").isEmpty():
            result = low.select(F.col("a").alias("v"), F.col("m").alias("root"))
        else:
            result = None
            ends = low.select("a", "m")
            moved = large.join(ends, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            current, path = keep_at(moved.unionByName(ends.select("a", F.col("m").alias("b"))).distinct(), tasks)
            old.append(low_path)
        for done in old:
            discard(spark, done)
        if result is not None:
            return result
