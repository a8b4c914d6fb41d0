"""Connected components by star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (src, dst): the smallest node that can be reached.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest
    of all, so that long chains halve; each is written. The driver learns only whether all
    nodes have one edge left, to a node without any, which is then the smallest.
    """
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    left = written(edges.where("src != dst").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    while True:
        down = left.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        roots = left.select(F.col("v").alias("u")).distinct()
        if down.where("n > 1").select("u").union(down.join(roots, "u", "left_semi").select("u")).isEmpty():
            return left.select(F.col("u").alias("node"), F.col("v").alias("component")).union(left.select("v", "v").distinct())
        both = left.union(left.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        left = written(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
