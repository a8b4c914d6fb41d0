import random

import duckdb

from folio.llm import queries
from folio.llm import sharding as op


def corpus():
    r = random.Random(8)
    return [(i, "é" * r.choice([0, 5, 50, 300])) for i in range(500)]


def test_only_large_buckets_split(spark):
    rows = corpus() + [(900, "z" * 5000), (901, None), (None, "n")] + [(902, "w" * 900)] * 3
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, depth int")
    got = op.shard(df, 2000).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]) if not shards[a][0]["oversized"] and not shards[b][0]["oversized"])
    for name, members in shards.items():
        total = sum(m["n_bytes"] for m in members)
        assert {(m["shard_bytes"], m["shard_rows"], m["depth"]) for m in members} == {(total, len(members), len(name))}
        assert (total > 2000) == members[0]["oversized"]
        if members[0]["oversized"]:
            assert len({m["doc_id"] for m in members}) == 1
    usual = [n for n in names if not shards[n][0]["oversized"]]
    small = [r for r in got if r["n_bytes"] <= 2000]
    for n in usual:
        if n:
            assert sum(r["n_bytes"] for r in small if int_prefix(r, got).startswith(n[:-1])) > 2000


def int_prefix(r, got):
    import hashlib

    key = "" if r["doc_id"] is None else str(r["doc_id"])
    return format(int(hashlib.md5(key.encode()).hexdigest()[:15], 16), "060b")


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", corpus())
    for limit in (100_000_000, 5000, 700):
        df = op.shard(spark.createDataFrame(corpus(), "doc_id long, text string"), limit)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.op8_sql(limit)})").fetchall()
        assert sorted(want) == sorted(map(tuple, df.collect()))


def test_levels_beyond_the_first_pass(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = sorted(map(tuple, op.shard(df, 700).collect()))
    monkeypatch.setattr(op, "LEVELS", 3)
    assert sorted(map(tuple, op.shard(df, 700).collect())) == want


def test_writing_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    op.write_shards(df, f"{tmp_path}/out", 5000)
    assert spark.read.parquet(f"{tmp_path}/out").drop("__shard").exceptAll(df).count() == 0
    assert op.shard(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0


def test_shards_of_one_row_have_long_prefixes(spark):
    """Rows above half the limit each get a shard, so that prefixes are as long as hashes make them."""
    rows = spark.range(100_000).selectExpr("id AS doc_id", "repeat('x', 60) AS text")
    got = op.shard(rows, 100)
    assert got.where("shard_rows != 1 OR shard_bytes != 60 OR oversized").count() == 0
    assert got.select("shard").distinct().count() == 100_000 and got.agg({"depth": "max"}).first()[0] > 24


def test_a_text_of_over_a_megabyte_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "é" * 700_000, "c", 1), (2, "a", "c", 2), (1, "b", "c", 3)], "doc_id long, text string, cell string, h int")
    got = sorted(map(tuple, op.shard(df, 1000).collect()))
    assert [(r[0], r[1], r[4], r[5], r[6]) for r in got] == [(1, 1, 1_400_001, 2, True), (1, 1_400_000, 1_400_001, 2, True), (2, 1, 1, 1, False)]
