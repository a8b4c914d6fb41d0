"""Topology embedding: singular values of each site's monthly flow matrix against the mean matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import rounded
from folio.functions.components import components
from folio.functions.ranks import running
from folio.functions.tables import written

GROUP = ["site", "period"]


def embed(matrix: DataFrame, k: int = 15) -> DataFrame:
    """(site, period, vector, explained, rank) of sparse cells (site, period, source, dest, volume).

    Cells are shares of their matrix's total, less the mean of that cell over all
    matrices; the vector is the k largest singular values, padded by zeros; explained is
    their part of the squared sum. The matrices are dealt to as many lots as there are
    partitions and the mean's cells go once to each lot, not to each matrix; a task holds
    the accounts of one matrix and of the mean.
    """
    total = F.sum("volume").over(Window.partitionBy(*GROUP))
    cells = written(matrix.select(*GROUP, "source", "dest", (F.col("volume").cast("double") / total.cast("double")).alias("share")), "shares")
    n = cells.select(*GROUP).distinct().agg(F.count("*").alias("n"))
    lots = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row: the number of matrices
    mean = cells.groupBy("source", "dest").agg(F.sum("share").alias("sum")).crossJoin(F.broadcast(n)).select("source", "dest", (F.col("sum") / F.col("n")).alias("share"))
    mean = mean.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    dealt = cells.withColumn("lot", F.pmod(F.xxhash64(*GROUP), F.lit(lots)).cast("int"))
    met = dealt.unionByName(mean, allowMissingColumns=True).withColumn("kind", F.col("site").isNotNull() | F.col("period").isNotNull())
    columns = ["lot", "kind", *GROUP, "source", "dest", "share"]
    met = met.select(*columns).repartition(lots, "lot").sortWithinPartitions("lot", "kind", *GROUP)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot, base, held = None, [], []
        for pdf in batches:
            for key, part in pdf.groupby(["lot", "kind", *GROUP], sort=False, dropna=False):
                if key[0] != lot:
                    yield from _singular(base, held, k)
                    lot, base, held = key[0], [], []
                if not key[1]:
                    base.append(part)
                elif held and tuple(held[0][GROUP].iloc[0]) != tuple(key[2:]):
                    yield from _singular(base, held, k)
                    held = [part]
                else:
                    held.append(part)
        yield from _singular(base, held, k)

    return met.mapInPandas(run, "site string, period string, vector array<double>, explained double, rank int")


def _singular(base: list[pd.DataFrame], held: list[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The row of one matrix: the singular values of its cells less those of the mean, over the accounts of both."""
    if not held:
        return
    mean, own = pd.concat(base), pd.concat(held)
    both = pd.concat([mean, own])
    row, rows = pd.factorize(both["source"])
    col, cols = pd.factorize(both["dest"])
    dense = np.zeros((len(rows), len(cols)))
    m = len(mean)
    dense[row[:m], col[:m]] = -mean["share"].to_numpy()
    dense[row[m:], col[m:]] += own["share"].to_numpy()
    s = np.linalg.svd(dense, compute_uv=False)
    top = np.zeros(k)
    top[: min(k, len(s))] = s[:k]
    whole = float((s**2).sum())
    out = [own["site"].iloc[0], own["period"].iloc[0], top.round(8).tolist(), round(float((top**2).sum()) / whole, 6) if whole else 0.0, int((s > 1e-10).sum())]
    yield pd.DataFrame([out], columns=[*GROUP, "vector", "explained", "rank"])


def embedding_stats(e: DataFrame) -> DataFrame:
    """Distance of each embedding to its site's previous month and to the mean of all (Euclidean), and the cosine to the former."""
    w = Window.partitionBy("site").orderBy("period")
    flat = e.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    centre = F.broadcast(flat.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    j = e.crossJoin(centre).withColumn("before", F.lag("vector").over(w))
    cosine = F.try_divide(dot("vector", "before"), F.sqrt(dot("vector", "vector") * dot("before", "before")))
    return j.select(*GROUP, rounded(gap("vector", "centre"), 6).alias("to_mean"), rounded(gap("vector", "before"), 6).alias("to_previous"), rounded(cosine, 6).alias("cosine_previous"))


def standardized(e: DataFrame) -> DataFrame:
    """e with z, the vector with each place brought to mean 0 and deviation 1 (a constant one to 0)."""
    at = e.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = F.broadcast(at.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m", "s"))), lambda x: F.struct(x["m"], x["s"])).alias("scale")))
    z = F.zip_with("vector", "scale", lambda v, k: F.when(k["s"] > 1e-12, (v - k["m"]) / k["s"]).otherwise(0.0))
    return e.crossJoin(scale).withColumn("z", z).drop("scale")


def _apart(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


#: Places of the vector that make the grid in which points meet.
GRID = 3


def clusters(e: DataFrame, eps: float = 0.5) -> DataFrame:
    """(site, period, z, cluster, nearest): groups linked by steps of at most eps between standardized vectors, -1 for one alone.

    That is what density clusters are when two points make a dense place. Equal vectors are
    one point. Points lie in boxes so small that all of a box are linked, which is one
    node, and meet those of the neighbouring cells of a grid of side eps over the GRID places that part
    them most; of the pairs within eps one edge for two boxes goes on. Clusters are numbered
    by their first site and period; nearest is the distance to the nearest point within eps,
    null where there is none.
    """
    rows = written(standardized(e).select(*GROUP, "z"), "vectors")
    size = rows.agg(F.max(F.size("z"))).first()[0] or 0
    side = eps / max(1, size) ** 0.5 * (1 - 1e-9)
    box = F.transform("z", lambda v: F.floor(v / side))
    points = rows.groupBy("z").agg(F.count("*").alias("n")).withColumn("box", box)
    # as many counts as places; the vector's length is fixed
    spread = points.agg(*[F.count_distinct(F.floor(F.get("z", F.lit(i)) / eps)).alias(str(i)) for i in range(size)]).first() if size else ()
    places = sorted(range(size), key=lambda i: (-spread[i], i))[:GRID]
    cell = F.array(*[F.floor(F.get("z", F.lit(i)) / eps) for i in places]) if places else F.array(F.lit(0).cast("long"))
    points = written(points.withColumn("cell", cell), "points")
    around = F.array(F.array().cast("array<bigint>"))
    for i in range(len(places)):
        around = _wider(around, i)
    around = around if places else F.array(F.col("cell"))
    a = points.select(F.col("z").alias("za"), F.col("box").alias("a"), F.explode(around).alias("cell"))
    b = points.select(F.col("z").alias("zb"), F.col("box").alias("b"), "cell")
    met = written(a.join(b, "cell").where("za != zb").withColumn("d", _apart("za", "zb")).where(F.col("d") <= eps).select("za", "a", "b", "d"), "links")
    near = met.groupBy("za").agg(F.min("d").alias("d"))
    near = points.join(near, points["z"] == near["za"], "left").select("z", "box", F.when(F.col("n") > 1, 0.0).otherwise(F.col("d")).alias("nearest"))
    joined = components(met.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    named = near.join(joined, near["box"] == joined["node"], "left").select("z", "nearest", F.coalesce("component", "box").alias("low"))
    every = written(rows.join(named, "z"), "named")
    first = every.where("nearest IS NOT NULL").groupBy("low").agg(F.min(F.struct(*GROUP)).alias("first"))
    numbers = running(first.withColumn("one", F.lit(1)), [], ["first"], "one").select("low", F.col("before").alias("cluster"))
    return every.join(numbers, "low", "left").select(*GROUP, "z", F.coalesce(F.when(F.col("nearest").isNotNull(), F.col("cluster")), F.lit(-1)).cast("int").alias("cluster"), rounded(F.col("nearest"), 6).alias("nearest"))


def _wider(cells: Column, i: int) -> Column:
    """Cells with one place more: each with that of the point's cell, the one below, and the one above."""
    steps = F.array(*[F.get("cell", F.lit(i)) + d for d in (-1, 0, 1)])
    return F.flatten(F.transform(cells, lambda c: F.transform(steps, lambda x: F.array_append(c, x))))


def cluster_members(c: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Distance of each point to its cluster's mean (one alone: to the mean of all), and whether it is an outlier: alone, or over threshold deviations farther than the mean distance."""
    flat = c.select("cluster", F.posexplode("z").alias("i", "v"))
    line = lambda g: F.transform(F.array_sort(g), lambda x: x["m"])
    own = flat.groupBy("cluster", "i").agg(F.avg("v").alias("m")).groupBy("cluster").agg(line(F.collect_list(F.struct("i", "m"))).alias("own"))
    every = F.broadcast(flat.groupBy("i").agg(F.avg("v").alias("m")).agg(line(F.collect_list(F.struct("i", "m"))).alias("every")))
    j = c.join(own, "cluster").crossJoin(every).withColumn("distance", F.when(F.col("cluster") < 0, _apart("z", "every")).otherwise(_apart("z", "own")))
    w = Window.partitionBy("cluster")
    far = F.coalesce(F.try_divide(F.col("distance") - F.avg("distance").over(w), F.nullif(F.round(F.stddev_pop("distance").over(w), 12), F.lit(0.0))) > threshold, F.lit(False))
    return j.select(*GROUP, "cluster", "nearest", rounded(F.col("distance"), 6).alias("distance"), ((F.col("cluster") < 0) | far).alias("is_outlier"))


def cluster_info(m: DataFrame, top: int = 3) -> DataFrame:
    """Members, radius, and the most frequent sites and months of each cluster."""
    m = m.where("cluster >= 0")

    def most(col: str) -> DataFrame:
        n = m.groupBy("cluster", col).agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), col))).where(F.col("rn") <= top)
        return n.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", col))), lambda x: x[col]), ",").alias(f"{col}s"))

    sizes = m.groupBy("cluster").agg(F.count("*").alias("members"), F.max("distance").alias("radius"), F.count_if("is_outlier").alias("outliers"))
    return sizes.join(most("site"), "cluster").join(most("period"), "cluster")


def cluster_jumps(m: DataFrame) -> DataFrame:
    """Changes of cluster between a site's months."""
    w = Window.partitionBy("site").orderBy("period")
    j = m.select("site", F.lag("period").over(w).alias("from_period"), F.col("period").alias("to_period"), F.lag("cluster").over(w).alias("from_cluster"), F.col("cluster").alias("to_cluster"))
    return j.where("from_cluster != to_cluster").withColumn("kind", F.when(F.col("to_cluster") < 0, "outlier").otherwise("cluster_change"))
