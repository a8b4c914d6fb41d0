import random

import corpus_pipeline as p
from folio.llm.queries import QUERIES

WORDS = {k: [f"{k}{i}" for i in range(400)] for k in ("en", "fr")}


def corpus():
    r = random.Random(6)
    base = []
    for i in range(60):
        k = r.choice(["en", "fr"])
        base.append((i, " ".join(r.choice(WORDS[k]) for _ in range(r.randint(150, 300))), k, f"src{i % 4}", 0))
    rows = list(base)
    rows += [(100 + i, base[i][1], base[i][2], "src0", 0) for i in range(10)]  # exact copies
    for i in range(10, 20):  # near copies: one word of 150 or more
        w = base[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((100 + i, " ".join(w), base[i][2], "src1", 0))
    return rows + [(900, "123 456", "en", "src2", 0), (901, None, None, None, None)]


def test_stages_against_plain_versions(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    want = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert kept["language"] == sorted(want)
    largest = {}
    for i, t, *_ in rows:
        if i in want:
            largest[t] = max(i, largest.get(t, i))
    assert kept["exact"] == sorted(largest.values())
    assert kept["near"] == sorted(i for i in largest.values() if not 110 <= i < 120)
    assert set(kept["mix"]) <= set(kept["near"]) and max(kept["mix"].count(i) for i in kept["mix"]) <= 2
    packed = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert set(tokens) == set(kept["mix"])
    assert sum(r["length"] for r in packed) == sum(tokens[i] for i in kept["mix"])
    again = p.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, packed))


def test_registered():
    import __spark_entry__

    assert [n for n, _ in p.STAGES] == ["language", "exact", "near", "mix", "pack"]
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
