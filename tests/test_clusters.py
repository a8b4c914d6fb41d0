import random

import numpy as np
import pytest

from folio.functions.components import components
from folio.operators import embedding


def linked(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    n = 120
    edges = {"random": [(r.randrange(n), r.randrange(n)) for _ in range(90)], "chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)] + [(3, 3)], "none": []}[shape]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    want = linked(n, edges)
    assert got == {i: want[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


@pytest.mark.parametrize(("seed", "width", "eps"), [(1, 4, 0.8), (2, 6, 0.7), (3, 1, 0.03), (4, 2, 0.2)])
def test_clusters_are_those_of_plain_density_clustering(spark, seed, width, eps):
    """The first place is constant; some vectors are equal, some lie on the edges of cells."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(90, width)) + 3 * r.integers(0, 3, size=(90, 1))
    x[:, 0] = 7.0 if width > 1 else x[:, 0]
    x[40:60] = x[:20]
    x[60:70] = np.round(x[60:70])
    rows = [(f"S{i % 7}", f"2024-{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)]
    got = {(c["site"], c["period"]): c for c in embedding.clusters(spark.createDataFrame(rows, "site string, period string, vector array<double>"), eps).collect()}
    assert len(got) == len(rows)
    sd = x.std(axis=0)
    z = np.where(sd > 1e-12, (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), 0)
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    np.fill_diagonal(d, np.inf)
    root = linked(len(x), list(zip(*np.nonzero(d <= eps))))
    names = {}
    for i in sorted(range(len(x)), key=lambda i: rows[i][:2]):
        if (d[i] <= eps).any():
            names.setdefault(root[i], len(names))
    for i, row in enumerate(rows):
        c = got[row[:2]]
        near = d[i].min()
        assert c["cluster"] == (names[root[i]] if near <= eps else -1)
        assert c["nearest"] == (pytest.approx(near, abs=1e-6) if near <= eps else None)
    assert len(names) > 1


def test_singular_values_are_those_of_numpy(spark):
    r = np.random.default_rng(5)
    cells = {(s, p): r.integers(0, 20, size=(6, 5)) * (r.random((6, 5)) < 0.4) for s in "AB" for p in ("2024-01", "2024-02", "2024-03")}
    rows = [(s, p, f"a{i}", f"b{j}", int(v)) for (s, p), m in cells.items() for (i, j), v in np.ndenumerate(m) if v]
    plan = embedding.embed(spark.createDataFrame(rows, "site string, period string, source string, dest string, volume int"), 4)
    shares = {k: m / m.sum() for k, m in cells.items() if m.sum()}
    mean = sum(shares.values()) / len(shares)
    for e in plan.collect():
        s = np.linalg.svd(shares[e["site"], e["period"]] - mean, compute_uv=False)
        assert e["vector"] == pytest.approx(s[:4].tolist(), abs=1e-7)
        assert e["explained"] == pytest.approx((s[:4] ** 2).sum() / (s**2).sum(), abs=1e-6)
        assert e["rank"] == (s > 1e-10).sum()
    assert plan.count() == len(shares)
