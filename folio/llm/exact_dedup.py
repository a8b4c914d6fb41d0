"""Exact dedup by content-defined chunk recipes (built-in functions only).

A text is cut where its content says so: after a sentence end (in scripts without blanks
too) or line break that follows at least 1024 characters of the chunk; where there is none
up to 3072, after a blank or punctuation mark; at 4096 characters otherwise. A
chunk's identifier is its SHA-256; identifiers are verified by grouping all chunks
by (identifier, content), which moves each distinct chunk once. Documents are then
compared by their ordered identifier lists (recipes), never by moving their texts.
If two contents ever share an identifier, recipes of contents are compared instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import keep_rows, materialize, plain

CHUNK = r"(?s).{1024,3071}?(?:[.!?]\s|[\n。！？।؟]|\z)|.{1024,4095}?(?:[\s\p{P}]|\z)|.{1,4096}"


def sha256_bytes(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def _chunks(text: Column) -> Column:
    """Chunks as bytes; text that isn't valid UTF-8 is one chunk of raw bytes."""
    cut = F.transform(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), lambda c: c.cast("binary"))
    return F.when(F.is_valid_utf8(text), cut).otherwise(F.array(text.cast("binary")))


def chunk_table(docs: DataFrame, text_col: str = "text", identify: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """(chunk_id, chunk): each distinct chunk of all texts once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.explode(_chunks(text)).alias("chunk")).select(identify(F.col("chunk")).alias("chunk_id"), "chunk").distinct()


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """(id, recipe, text_sha256) per row: the ordered list of verified chunk identifiers."""
    rows = plain(docs, id_col, text=text_col)

    def made(how: Callable[[Column], Column]) -> DataFrame:
        return rows.select(
            F.col(f"`{id_col}`").alias(id_col), F.transform(_chunks(F.col("text")), how).alias("recipe"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
        )

    found = materialize(made(identify), "recipes")
    clash = chunk_table(rows, "text", identify).groupBy("chunk_id").count().where("count > 1")
    return found if clash.isEmpty() else materialize(made(lambda c: c), "recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal
    texts the largest id stays. Null ids are allowed and rank below all others. Of
    rows repeated with id and text, each is returned and counted, one is kept. An
    empty table gives an empty result; other columns are ignored. A group of copies
    of any size is only ever counted and joined, in parts.
    """
    members = recipes(docs, id_col, text_col, identify).groupBy("recipe", id_col, "text_sha256").agg(F.count("*").alias("copies"))
    # written, so that the join is between two plain exchanges and a hot recipe's rows can be split
    groups = materialize(members.groupBy("recipe").agg(F.max(id_col).alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return (
        members.join(groups, "recipe")
        .select(id_col, "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns."""
    return keep_rows(docs, exact_dedup(docs, id_col, text_col).where("kept"), id_col, text_col)
