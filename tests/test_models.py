"""Outlier models against plain versions."""

import datetime
import random
from decimal import Decimal

import numpy as np
import pytest

from folio.operators import models
from folio.sources import canonical


def grown(r, x, depth=0, nodes=None):
    """A random tree over rows x as a table (column or -1, at, left, right, size)."""
    nodes = [] if nodes is None else nodes
    i, open_ = len(nodes), np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
    nodes.append([-1, 0.0, -1, -1, len(x)])
    if len(x) > 1 and depth < 8 and len(open_):
        c = int(r.choice(open_))
        at = r.uniform(x[:, c].min(), x[:, c].max())
        left = x[:, c] < at
        nodes[i][:2] = [c, at]
        nodes[i][2] = len(nodes)
        grown(r, x[left], depth + 1, nodes)
        nodes[i][3] = len(nodes)
        grown(r, x[~left], depth + 1, nodes)
    return nodes


@pytest.mark.parametrize("rows", [1, 40, 256])
def test_depths_are_those_of_walked_trees(rows):
    r = np.random.default_rng(rows)
    make = lambda n: np.stack([r.normal(size=n), r.integers(0, 5, n), r.uniform(size=n) < 0.1, r.exponential(size=n)], axis=1).astype(float)
    forest = [np.array(grown(r, make(rows)), float) for _ in range(20)]
    x = make(500)
    x[0, 0], x[1, 3], x[2] = np.nan, np.inf, -np.inf
    cuts = [t[0, 1] for t in forest if t[0, 0] == 0]
    x[3 : 3 + len(cuts), 0] = cuts

    def walked(t, row):
        i, d = 0, 0
        while t[i, 0] >= 0:
            i, d = int(t[i, 2] if row[int(t[i, 0])] < t[i, 1] else t[i, 3]), d + 1
        return d + models.usual_depth(t[i : i + 1, 4])[0]

    assert np.allclose(models.forest_depths(forest, 4)(x), [np.mean([walked(t, row) for t in forest]) for row in x], rtol=0, atol=1e-12)


def test_forest_does_not_walk_row_by_row():
    """Over 20 000 rows, 100 trees: walking took over a second here."""
    import time

    r = np.random.default_rng(3)
    make = lambda n: np.concatenate([r.normal(size=(n, 3)), r.integers(0, 7, (n, 8))], axis=1)
    depths, x = models.forest_depths([np.array(grown(r, make(256)), float) for _ in range(100)], 11), make(20_000)
    began = time.process_time()
    assert depths(x).shape == (20_000,)
    assert time.process_time() - began < 1


def test_reconstruction_is_that_of_the_main_components(spark):
    r = random.Random(5)
    rows = [(datetime.date(2024, r.randint(1, 12), r.randint(1, 28)), r.choice(["601000", "706000"]), r.choice(["ACH", "OD"]), f"V{i}", "x", Decimal(str(round(r.uniform(1, 9000), 2))), Decimal(0), "S0", None) for i in range(200)]
    df = canonical.derive(spark.createDataFrame(rows, "date date, account string, journal string, voucher string, label string, debit decimal(18,2), credit decimal(18,2), site string, third_party string"))
    got = models.reconstruction_errors(df).orderBy("voucher").toPandas()
    x = got[list(models.MODEL_COLUMNS)].to_numpy(float)
    std = x.std(axis=0, ddof=1)
    z = np.where(std > 0, (x - x.mean(axis=0)) / np.where(std > 0, std, 1), 0)
    main = np.linalg.svd(np.cov(z.T))[0][:, :4]
    assert np.allclose(got["error"], ((z - z @ main @ main.T) ** 2).sum(axis=1), atol=1e-4)
    assert np.allclose(np.abs(np.stack(got["latent"])), np.abs(z @ main), atol=1e-6)
    assert models.reconstruction_errors(df.limit(0)).count() == 0
