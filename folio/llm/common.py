"""Shared helpers: shared-folder tables, byte blobs, components, row selection."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which the whole cluster shares.

    Only where the setting is absent (tests, notebooks) a local folder is chosen.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_writes(spark: SparkSession) -> Iterator[None]:
    """Within this block, a finished write drops its own shuffle files, and Python gets rows by 1000 at most, as whole texts are large."""
    before = {k: spark.conf.get(k, None) for k in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    if before[BATCH] is None:
        spark.conf.set(BATCH, "1000")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    with small_writes(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(docs: DataFrame, *cols: str, text: str | None = None) -> DataFrame:
    """Only the named columns, the text with null as empty; other columns can't clash."""
    return docs.select(*[F.col(f"`{c}`") for c in cols], *([F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")] if text else []))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, with a prefix that no column of docs has."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return [prefix + n for n in names]


def text_id(text: Column) -> Column:
    """SHA-256 of a text, with null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose id and text are in kept (id, text_sha256), null ids included, one row for each."""
    sha, kept_id, kept_sha, n = fresh(docs, "sha", "kept", "kept_sha", "n")
    rows = docs.withColumn(sha, text_id(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha))
    joined = rows.join(kept.select(F.col(f"`{id_col}`").alias(kept_id), F.col("text_sha256").alias(kept_sha)), same)
    first = Window.partitionBy(f"`{id_col}`", sha).orderBy(F.lit(0))
    return joined.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (src, dst). Returns (node, component) with the smallest node of each
    component, for every node that has an edge to another one. Each step is a
    grouped minimum and a join, written to the shared folder; the driver sees only
    whether some node still has two edges to smaller nodes, or one to a node that has such
    an edge itself. Self links and nulls are ignored, repeats are harmless.
    """
    pairs = materialize(
        edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        lower = materialize(pairs.groupBy("u").agg(F.count("*").alias("n")), "lower")
        if lower.where("n > 1").isEmpty() and pairs.join(lower.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            discard(lower)
            roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that joins are between plain exchanges and a hub's rows can be split
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, pairs = pairs, materialize(small.where("u != v").distinct(), "edges")
        discard(before, lower, low, large, least)
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
