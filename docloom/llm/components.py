"""Connected components of a graph given by its edges, on DataFrames.

Alternating large-star and small-star steps (Kiveris et al., 2014): every node hangs its larger
neighbours, then its smaller ones, on the least node it knows, until nothing changes.  The steps
take about the logarithm of the number of nodes.  Each is a map-side combined minimum per node and
a join, whose skewed keys adaptive execution splits; no group is gathered in one task.  A round is
one table in the shared folder, written in as many files as its edges ask for; the table of the
round before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Edges that one task writes.
EDGES_A_TASK = 250_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long): root is the least of its component."""
    work = Tables(edges.sparkSession, "components")
    e = work.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "round0")
    tasks = 1 + e.count() // EDGES_A_TASK
    seen = None
    for k in range(max_rounds):
        e = e.coalesce(tasks)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u hang on the least of u's neighbourhood
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours hang on the least of them
        small = e.join(low, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = work.keep(e.coalesce(tasks), f"round{k + 1}")
        work.remove(f"round{k}")
        state = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    hung = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return hung.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
