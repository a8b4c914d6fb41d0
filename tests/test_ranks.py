import math
import random
from statistics import fmean, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import ranks
from folio.operators import robust


def test_running_sums_within_keys_of_any_size(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else r.choice("abc") if i % 7 else None, i, r.randint(0, 5)) for i in range(900)]
    got = {(x["k"], x["i"]): (x["before"], x["whole"]) for x in ranks.running(spark.createDataFrame(rows, "k string, i int, n int").repartition(5), ["k"], ["i"], "n").collect()}
    for k in {x[0] for x in rows}:
        mine, seen = sorted((i, n) for key, i, n in rows if key == k), 0
        for i, n in mine:
            assert got[k, i] == (seen, sum(n for _, n in mine))
            seen += n


def test_quantiles_are_those_of_numpy(spark):
    r = random.Random(2)
    rows = [(r.choice("ab") if i % 4 else "hot", r.choice([None, 7.5, r.gauss(0, 9), r.randint(-3, 3)])) for i in range(2000)]
    rows = [(k, None if v is None else float(v)) for k, v in rows] + [("one", 4.0), ("none", None)]
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {x["k"]: x["q"] for x in ranks.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), shares).collect()}
    assert set(got) == {"a", "b", "hot", "one"}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([v for key, v in rows if key == k and v is not None], shares).tolist())
    assert ranks.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], F.col("v"), [0.5]).count() == 0


def test_no_rank_is_made_by_one_task(spark):
    f = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"))
    for made in (robust.ecod_outliers(f, "k", ["a"], 1.1), robust.bh_adjust(f.withColumnRenamed("a", "p_value"), key="k"), ranks.quantiles(f, [], F.col("a"), [0.5])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in "".join(line for line in plan.splitlines() if "Window" in line)
        windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
        assert all("windowspecdefinition(__range" in line or "windowspecdefinition(k" in line for line in windows)


@pytest.mark.parametrize("ps", [[0.01, 0.02, 0.02, 0.5, 1.0, 1.0], [1.0] * 40, [0.04]])
def test_benjamini_hochberg(spark, ps):
    got = robust.bh_adjust(spark.createDataFrame(list(enumerate(ps)), "family int, p_value double")).orderBy("rank").collect()
    want = sorted((p, i) for i, p in enumerate(ps))
    least, adjusted = 1.0, []
    for k in range(len(want), 0, -1):
        least = min(least, want[k - 1][0] * len(want) / k)
        adjusted.append(round(least, 6))
    assert [(r["family"], r["rank"]) for r in got] == [(i, k) for k, (_, i) in enumerate(want, 1)]
    assert [r["p_adjusted"] for r in got] == pytest.approx(adjusted[::-1])


def test_outliers_against_all_other_rows(spark):
    r = random.Random(3)
    data = [(i, float(r.randint(0, 6)), r.gauss(0, 1) if i else 50.0, None if i % 9 == 0 else float(i % 5)) for i in range(60)]
    got = {x["k"]: x["p"] for x in robust.ecod_outliers(spark.createDataFrame(data, "k int, a double, b double, c double"), "k", ["a", "b", "c"], 0.08).collect()}
    want = {}
    for i, *x in data:
        others = [[v or 0.0 for v in row[1:]] for row in data if row[0] != i]
        p = min(max(2 * min(sum(o[f] <= (x[f] or 0.0) for o in others), sum(o[f] >= (x[f] or 0.0) for o in others)) / len(others), 1 / (len(others) + 1)) for f in range(3))
        if p < 0.08:
            want[i] = round(p, 6)
    assert got == pytest.approx(want)
    assert 0 in got
    assert robust.ecod_outliers(spark.createDataFrame(data[:2], "k int, a double, b double, c double"), "k", ["a"]).count() == 0


def profile(series, m):
    def distance(a, b):
        flat = [max(x) == min(x) for x in (a, b)]
        if any(flat):
            return 0.0 if all(flat) else math.sqrt(m)
        za, zb = ([(v - fmean(x)) / pstdev(x) for v in x] for x in (a, b))
        return math.dist(za, zb)

    parts = [series[i : i + m] for i in range(len(series) - m + 1)]
    return [min((round(distance(a, b), 4), j) for j, b in enumerate(parts) if abs(i - j) > math.ceil(m / 4)) if any(abs(i - j) > math.ceil(m / 4) for j in range(len(parts))) else None for i, a in enumerate(parts)]


@pytest.mark.parametrize("m", [3, 5])
def test_matrix_profile(spark, m):
    r = random.Random(4)
    series = {"601": [1000, 1005, 998, 1002, 2500, 1001, 999, 1003, 997, 1004, 1000, 1002], "602": [5] * 9, "603": [r.randint(0, 3) for _ in range(30)], "604": [1, 2, 3], "605": [1, 2, 3, 9], "606": [7, 7, 7, 7, 1, 2, 7, 7, 7, 8]}
    rows = [(f, 2000 + i // 12, i % 12 + 1, f"{2000 + i // 12}-{i % 12 + 1:02d}", float(v)) for f, s in series.items() for i, v in enumerate(s)]
    got = robust.matrix_profile(spark.createDataFrame(rows, "prefix_3 string, year int, month int, period string, amount double"), None, m).collect()
    for f, s in series.items():
        mine = sorted((x for x in got if x["family"] == f), key=lambda x: x["start"])
        if len(s) <= m:
            assert not mine
            continue
        want = profile(s, m)
        starts = sorted(x[3] for x in rows if x[0] == f)
        assert [(x["distance"], x["nearest"]) for x in mine] == [(None, None) if w is None else (pytest.approx(w[0], abs=2e-4), starts[w[1]]) for w in want]
        known = [x["distance"] for x in mine if x["distance"] is not None]
        found = [x["start"] for x in mine if x["is_discord"]]
        assert found == ([next(x["start"] for x in mine if x["distance"] == max(known))] if known else [])


def test_a_cluster_needs_a_shared_folder():
    from unittest import mock

    from folio.functions.tables import shared_path

    session = mock.Mock()
    session.sparkContext.getConf.return_value.get.return_value = None
    session.conf.get.return_value = None
    session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_path(session, "t")
