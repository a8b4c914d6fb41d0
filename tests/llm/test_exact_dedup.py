import hashlib

import pytest
from pyspark.sql import functions as F

from folio.llm import exact_dedup as op

LONG = "Une phrase assez longue pour remplir. " * 400
ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, LONG + "x"), (8, "a b "), (9, "é" * 9000), (9, "é" * 9000), (10, "é" * 9000)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


@pytest.mark.parametrize("identify", [op.sha256_bytes, lambda c: F.substring(op.sha256_bytes(c), 1, 1)])
def test_groups_equal_texts(spark, identify):
    """Also with an identifier of one byte, which many contents share."""
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in ROWS], "doc_id long, text string, recipe string, chunk int")
    got = op.exact_dedup(df, identify=identify).collect()
    assert len(got) == len(ROWS)
    groups = expected(ROWS)
    for g in got:
        members = next(v for v in groups.values() if g["doc_id"] in v)
        assert (g["keep_id"], g["group_size"]) == (max(members), len(members))
    texts = dict(ROWS)
    assert all(g["text_sha256"] == hashlib.sha256((texts[g["doc_id"]] or "").encode()).hexdigest() for g in got)
    kept = sorted(g["doc_id"] for g in got if g["kept"])
    assert kept == sorted(max(v) for v in groups.values())


def test_chunks_restore_texts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    chunks = {bytes(r["chunk_id"]): bytes(r["chunk"]) for r in op.chunk_table(df).collect()}
    for r in op.recipes(df).collect():
        text = b"".join(chunks[bytes(i)] for i in r["recipe"]).decode()
        assert text == (dict(ROWS)[r["doc_id"]] or "")
    assert all(len(c.decode()) <= 4096 for c in chunks.values())


def test_invalid_utf8_is_told_apart(spark):
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.unhex(F.lit("61ff"))).otherwise(F.unhex(F.lit("61fe"))).cast("string").alias("text"))
    assert {r["group_size"] for r in op.exact_dedup(df).collect()} == {1}


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.exact_dedup(empty).count() == 0
    got = op.exact_dedup(spark.createDataFrame([(None, "x"), (3, "x"), (None, "y")], "doc_id long, text string")).collect()
    assert sorted((str(r["keep_id"]), r["kept"]) for r in got) == [("3", False), ("3", True), ("None", True)]


def test_drop_keeps_one_row_and_all_columns(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, source string")
    got = op.drop_exact_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 4, 6, 7, 8, 10]


def test_cuts_follow_the_content_in_every_script(spark):
    """Words put in front change the first chunks only: texts without Latin sentence ends are cut alike behind them."""
    import random

    r = random.Random(5)
    cjk = "".join(r.choice("日本語文章検索処理大規模学習") if r.random() > 0.03 else "。" for _ in range(20_000))
    bare = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5_000))
    prose = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) + ("." if r.random() < 0.08 else "") for _ in range(5_000))
    for text in (cjk, bare, prose):
        rows = spark.createDataFrame([(1, text), (2, "xyz " + text)], "doc_id long, text string")
        one, two = (set(map(bytes, x["recipe"])) for x in op.recipes(rows).orderBy("doc_id").collect())
        assert len(one) >= 6 and len(one & two) >= 0.6 * len(one)


def test_very_long_and_clashing_columns(spark):
    long = "word. " * 300_000
    rows = [(1, long, "a", 1), (2, long, "b", 2), (3, long + "x", "c", 3), (4, "é" * 9_000, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, recipe string, __n int")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in op.exact_dedup(df).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}
    kept = op.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
