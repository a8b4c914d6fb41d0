import math
from collections import Counter

import numpy as np
import pytest

from folio.llm import negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, q string, tile int"


def brute(rows, every=100, k=5):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256.0 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), i, other) for i, (other, w) in kept.items() if i != a)
        for p, pos, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(a, pos, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return Counter(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in op.hard_negatives(df, **kw).collect())


def cloud(seed, n, width, labels, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    v = centres[r.integers(6, size=n)] + spread * r.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(int(i), [float(x) for x in v[i].astype(np.float32)], int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("seed", "width", "labels", "spread"), [(1, 8, 3, 0.3), (2, 64, 10, 3.0), (3, 2, 2, 0.05)])
def test_matches_brute_force(spark, monkeypatch, seed, width, labels, spread):
    monkeypatch.setattr(op, "TILE", 150)
    rows = cloud(seed, 900, width, labels, spread)
    rows += [(1000 + i, rows[i][1], (rows[i][2] + 1) % labels) for i in range(300)]  # ties
    assert got(spark, rows) == brute(rows)


def test_rows_that_take_no_part_and_odd_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(4, 300, 4, 3, 1.0)
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2100, [nan, 1.0, 1.0, 1.0], 1), (2200, [inf, 1.0, 1.0, 1.0], 1), (2300, [None, 1.0, 1.0, 1.0], 1), (2400, rows[5][1], None)]
    rows += [(2500, [0.5, 0.5], 1), (2600, [], 2), (200, rows[7][1], 0), (300, [1.0] * 4, 77), (-700, [0.1] * 4, -1), (3000, [1e4, 1e4, -1e4, 3.0], 1)]
    rows += [rows[1], rows[1]]
    assert got(spark, rows) == brute(rows)


def test_one_vector_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 60)
    rows = cloud(5, 400, 6, 4, 0.5)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, label) for i, v, label in rows]
    assert got(spark, rows) == brute(rows)


def test_large_numbers(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=3) * (2**20)], i % 3) for i in range(150)]
    assert got(spark, rows, anchor_every=10) == brute(rows, 10)


def test_empty_and_single(spark):
    assert got(spark, []) == got(spark, [(100, [1.0], 1)]) == Counter()


def test_tree_prunes_and_holds_every_row():
    r = np.random.default_rng(7)
    v = np.concatenate([r.integers(0, 50, (4000, 3)) + 1000 * r.integers(0, 5, (4000, 1)), r.integers(0, 50, (96, 3))]).astype(np.int64)
    tree = op.Tree(v, np.zeros(len(v), np.int64), np.arange(len(v)), leaf=16, fan=4)
    assert sorted(tree.ids.tolist()) == list(range(len(v)))
    low, high, _, _ = tree.levels[0]
    assert ((high - low).max(axis=1) < 1100).mean() > 0.95
    opened = []
    block = op.Block(np.array([-1]), np.array([0]), np.array([[1, 1, 1]]), np.array([[-(2**62)]]), np.array([[2**62]]), True, 5)
    take = block.take
    block.take = lambda who, *rest: (opened.append(1), take(who, *rest))
    _, _, row, score = block.search(tree)
    assert score.tolist() == sorted(v.sum(axis=1).tolist(), reverse=True)[:5]
    assert len(opened) < len(low) / 10
