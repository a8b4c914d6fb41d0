"""Sharding by extendible hashing (built-in functions only).

Rows fall into buckets by the leading bits of a hash. All start in one bucket; only
buckets above the byte limit split, on one more bit, until each fits. The directory
names, for each prefix in use, the bucket, whose own depth may be smaller, that holds
it; it has levels of some bits each, so that rows find their shard by an equality join
a level and no level lists prefixes that no row has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import fresh, materialize

BITS = 60
LEVELS = 12


def hash_of(key: Column) -> Column:
    """60 bits: the first 15 hex digits of the MD5 of the key as text; null as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: int | Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directories(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(depth, directory)]: the directory by levels, each (cell, depth, bytes, rows, oversized).

    sizes: (h, n_bytes). LEVELS bits are looked at a time: a level has an entry for each
    prefix (cell) of that many bits that rows have, with the bucket that holds it; cells
    of buckets that are still too large have their entries in the next level, whose rows
    alone go on. So no directory has more entries than there are distinct hashes. A
    bucket of all bits holds equal hashes only; it can't split and is marked oversized.
    """
    found, depth, open_ = [], 0, sizes
    while True:
        top = min(BITS, depth + LEVELS)
        cells = open_.groupBy(prefix(F.col("h"), top).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        every = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(depth + 1 if found else 0), F.lit(top))).alias("depth"))
        every = materialize(every.withColumn("prefix", F.expr(f"shiftright(cell, {top} - depth)")), "cells")
        level = materialize(every.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), "levels")
        # a bucket is the first prefix on a row's way that fits; the way starts at the level's first depth
        fits = level.where((F.col("bytes") <= limit) | (F.col("depth") == BITS)).withColumn("oversized", F.col("bytes") > limit)
        way = every.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
        entry = way.groupBy("cell").agg(F.min_by(F.struct("depth", "bytes", "rows", "oversized"), "depth").alias("e")).select("cell", "e.*")
        found.append((top, materialize(entry, "directory")))
        over = level.where((F.col("depth") == top) & (F.col("bytes") > limit)).select(F.col("prefix").alias("cell"))
        if top == BITS or over.isEmpty():
            return found
        depth = top
        open_ = open_.withColumn("cell", prefix(F.col("h"), top)).join(over, "cell", "left_semi").drop("cell")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes, shard_rows, oversized) for every row.

    n_bytes is the text's length in UTF-8, 0 for null. shard is the bucket's hash
    prefix in binary digits, empty while one shard holds all. Null ids hash as the
    empty text. All rows of an id with a row above the limit, and rows of one id that
    are together above it, have a shard of their own, named by all bits and marked
    oversized. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hash_of(F.col(id_col)).alias("h"))
    rows = materialize(rows, "sizes")
    large = rows.where(F.col("n_bytes") > limit)
    parts, open_ = [], rows
    if not large.isEmpty():
        own = materialize(large.groupBy("h").agg(F.lit(True).alias("oversized")), "large")
        alone = materialize(rows.join(own, "h"), "alone")
        sums = alone.groupBy("h").agg(F.lit(BITS).alias("depth"), F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        parts.append(alone.join(sums, "h"))
        open_ = rows.join(own, "h", "left_anti")
    levels = directories(open_.select("h", "n_bytes"), limit)
    for top, entries in levels:
        met = open_.withColumn("cell", prefix(F.col("h"), top)).join(entries, "cell", "left").drop("cell")
        parts.append(met.where("depth IS NOT NULL"))
        open_ = met.where("depth IS NULL").select("id", "n_bytes", "h")
    found = reduce(DataFrame.unionByName, parts)
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(prefix(F.col("h"), F.col("depth")).cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return found.select(
        F.col("id").alias(id_col), "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "oversized"
    )


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs as Parquet, a folder for each shard (column __shard, or a longer name where docs has such), its rows in the order of ids."""
    ident, name = fresh(docs, "id", "shard")
    of = shard(docs, limit, id_col, text_col).select(F.col(id_col).alias(ident), F.concat(F.lit("s"), "shard").alias(name)).distinct()
    joined = docs.join(of, docs[id_col].eqNullSafe(of[ident])).drop(ident)
    joined.repartition(name).sortWithinPartitions(name, id_col).write.partitionBy(name).parquet(path)
