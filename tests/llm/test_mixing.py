import random
from collections import Counter

import numpy as np

from folio.llm import mixing as op
from folio.llm.queries import op4_mixing


def corpus():
    r = random.Random(2)
    rows = []
    for i in range(300):
        source = r.choice(["a", "a", "a", "b", "é", None])
        rows.append((i, source, " ".join("x" for _ in range(r.choice([0, 1, 30, 200, 900])))))
    return rows + [(300, "b", None), (301, "tiny", "one two"), (None, "a", "no id but words " * 30)]


def brute_targets(sizes, weights, share=1.5):
    """Share the excess over twice the size again and again."""
    got, pool, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while pool > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            got[i] += pool * weights[i] / total
        pool = 0.0
        for i in list(open_):
            if got[i] >= 2 * sizes[i]:
                pool += got[i] - 2 * sizes[i]
                got[i] = 2.0 * sizes[i]
                open_.discard(i)
    return got


def test_targets_are_what_resharing_gives():
    r = random.Random(1)
    for _ in range(50):
        sizes = [r.choice([0, 1, 10, 100, 1000]) for _ in range(r.randint(1, 9))]
        weights = [op.WEIGHTS[i % 3] for i in range(len(sizes))]
        assert np.allclose(op.targets(sizes, weights), brute_targets(sizes, weights), atol=1e-6)


def test_tree_splits_quotas_exactly():
    quotas = np.array([1000, 37, 0, 4321])
    leaves = [op.leaf(quotas, 7, s, 3) for s in range(7)]
    assert np.array_equal(sum(c for _, c in leaves), quotas)
    at = np.zeros(4, np.int64)
    for first, count in leaves:
        assert np.array_equal(first, at)
        at += count
    total = int(quotas.sum())
    assert [int(c.sum()) for _, c in leaves] == [(i + 1) * total // 7 - i * total // 7 for i in range(7)]


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1000, 4097):
        i = np.arange(n)
        assert sorted(op.permuted(i, np.full(n, n), np.full(n, 12345, np.uint64))) == list(range(n))


def test_mix_meets_targets_and_takes_disjoint_spans(spark):
    df = spark.createDataFrame([(i, t, s, 0) for i, s, t in corpus()], "doc_id long, text string, source string, block int")
    sizes, taken, sources = op.mix_by_weight(df)
    rows = taken.collect()
    got = Counter()
    for r in rows:
        got[r["source"]] += r["words"]
    for source, size, target in sources:
        assert abs(got[source] - target) <= 1 + size / 900, (source, got[source], target)
    spans = Counter()
    for r in rows:
        for w in range(r["first_word"], r["first_word"] + r["words"]):
            spans[r["doc_id"], r["pass"], w] += 1
    assert max(spans.values()) == 1
    size_of = {r["doc_id"]: r["size"] for r in sizes.collect()}
    per_doc = Counter()
    for r in rows:
        per_doc[r["doc_id"]] += r["words"]
    assert all(n <= 2 * size_of[d] for d, n in per_doc.items())
    again = op.mix_by_weight(df.repartition(3))[1].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_query_and_documents(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_mixing(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
    assert sum(r["taken"] for r in got if r["doc_id"] is None) > 0
    sizes = {i: len((t or "").split()) for i, _, t in rows}
    assert all(r["size"] == sizes[r["doc_id"]] for r in got)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = op.mixed_documents(df)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == df.columns and max(copies.values()) <= 2
    words = Counter()
    for i, s, t in rows:
        words[s] += copies[i] * len((t or "").split())
    for source, size, target in op.weighed(op.sized(df)):
        assert abs(words[source] - target) <= max(900 * 3, 0.2 * target)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    sizes, taken, sources = op.mix_by_weight(df)
    assert (sizes.count(), taken.count(), sources) == (0, 0, [])
    assert op.mixed_documents(df).count() == 0


def test_repeated_and_null_ids_share_what_is_taken_of_their_text(spark, tmp_path):
    """Documents without an id, and ids with several texts, are rows of their own."""
    r = random.Random(9)
    rows = [(None, "a", "w " * r.choice([100, 300, 900]) + f"n{i % 40}") for i in range(120)] + [(7, s, f"t{i} " * 250) for i in range(30) for s in ("a", "b")]
    rows += [(i, "c", "x y z " * 400) for i in range(100, 130)]
    spark.createDataFrame([(i, t, s, "e") for i, s, t in rows], "doc_id long, text string, source string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_size, of = Counter(), {}
    for i, s, t in rows:
        by_size[s] += len(t.split())
    for x in got:
        assert x["taken"] <= 2 * x["size"]
        of.setdefault((x["source_size"], x["target"]), []).append(x["taken"])
    assert sorted(of) == sorted((w, t) for _, w, t in op.weighed(op.sized(spark.read.parquet(f"{tmp_path}/documents.parquet"))))
    assert all(abs(sum(taken) - target) <= 1 + size / 900 for (size, target), taken in of.items())
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = op.mixed_documents(df)
    assert mixed.columns == df.columns
    copies, there = Counter(map(tuple, mixed.collect())), Counter((i, t, s, "e") for i, s, t in rows)
    assert set(copies) <= set(there) and all(n <= 2 * there[x] for x, n in copies.items())
    words = Counter()
    for (_, t, s, _), n in copies.items():
        words[s] += n * len(t.split())
    for s, size, target in op.weighed(op.sized(df)):
        assert abs(words[s] - target) <= 3 * 1200
