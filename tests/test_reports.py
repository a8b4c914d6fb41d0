import json

import pytest

from folio.operators import reports

ROWS = [
    ("A", "2024-12", "i1", "601", "PROCESSUS", "L2-VAR", 90.0, 5000.0, "PASSED"), ("A", "2024-12", "i2", "613", "CRISTALLIN", "L2-DISCORD", 70.0, 15000.0, "PASSED"), ("A", "2024-12", "i3", "601", "PROCESSUS", "L2-VAR", 60.0, 100.0, "LOW_PERTINENCE"),
    ("A", "2025-01", "i4", "641", "CUT_OFF", "L2-CONC", 95.0, 1000.0, "PASSED"), ("B \"x\"", "2024-12", "i5", "706", "PONCTUEL", "L2-VAR", 40.0, 0.0, "PASSED"), ("C", "2024-12", "i6", "706", "PONCTUEL", "L2-VAR", 40.0, 9.0, "BELOW_MATERIALITY"),
] + [("D", "2024-12", f"d{i}", "601", "CUT_OFF", "L2-VAR", 99.0, 10_000.0, "PASSED") for i in range(12)]


@pytest.fixture(scope="module")
def documents(spark):
    q = spark.createDataFrame(ROWS, "entity string, period string, id string, family string, universe string, test string, pertinence double, amount double, filter_reason string")
    return reports.report_documents(q)


def test_each_group_has_its_report(documents):
    found = {(r["entity"], r["period"]): json.loads(r["document"]) for r in documents.collect()}
    assert set(found) == {("A", "2024-12"), ("A", "2025-01"), ("B \"x\"", "2024-12"), ("D", "2024-12")}
    a = found["A", "2024-12"]
    assert (a["anomalies"], a["amount"], a["families"], len(a["universes"]), {t["id"] for t in a["top"]}) == (2, 20000.0, 2, 10, {"i1", "i2"})
    assert a["score"] == pytest.approx(100 - a["impact"], abs=0.01)
    assert a["impact"] == pytest.approx(sum(t["impact"] for t in a["top"]), abs=0.02)
    assert [t["rank"] for t in a["top"]] == [1, 2] and a["top"][0]["impact"] >= a["top"][1]["impact"]
    d = found["D", "2024-12"]
    assert (d["level"], d["score"], len(d["top"]), d["weak"]) == ("CRITIQUE", 0.0, 5, [{"universe": "CUT_OFF", "score": 0.0, "anomalies": 12}])
    assert d["recommendations"] == [
        reports.URGENT, reports.SUPERVISE, "Revoir les procédures de cut-off: 12 anomalie(s) détectée(s) pour une matérialité de 120,000€.", "Priorité: Analyser l'anomalie [601] L2-VAR, montant: 10,000€.",
    ]
    assert found["A", "2025-01"]["recommendations"][-1] == reports.KEEP


def test_documents_are_written_by_group(spark, documents, tmp_path):
    reports.write_documents(documents, str(tmp_path))
    back = {(r["entity"], r["period"]): r["value"] for r in spark.read.text(str(tmp_path)).collect()}
    assert back == {(r["entity"], r["period"]): r["document"] for r in documents.collect()}
    assert (tmp_path / "entity=A" / "period=2025-01").is_dir()


def test_figures_are_those_of_sql_at_any_size(spark):
    import duckdb
    from pyspark.sql import functions as F

    xs = [3898169485239411.5, 3898169114620359.5, 3898169114620360.5, 3898169485239411.0, -123456789012345.67, 254.886, 0.0, 123456789012.34]
    got = [str(r[0]) for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(reports.figure(F.col("x"))).collect()]
    assert got == [duckdb.execute("SELECT CAST(CAST(round(?::DOUBLE, 2) AS DECIMAL(18,2)) AS VARCHAR)", [x]).fetchone()[0] for x in xs]


def test_figures_round_as_sql_does(spark):
    import duckdb
    from pyspark.sql import functions as F

    xs = [1.005, 70.475, 60.885, 60.88499999999999, -1.005, 2.675, 127644689667403.27, 127644689667403.28, -8.5, *[k / 10_000 for k in range(25, 150_000, 137)], *[k * 1e9 + k / 1e4 for k in range(25, 150_000, 137)]]
    got = [str(r[0]) for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(reports.figure_of_product(F.col("x"))).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT CAST(CAST(round(?::DOUBLE, 2) AS DECIMAL(18,2)) AS VARCHAR)", [x]).fetchone()[0] for x in xs]


def test_sums_go_in_their_order(spark):
    """Six impacts that sum up to 60.885 or just below it, and amounts whose last digit hangs on the order."""
    rows = [("i%d" % i, p, impact, amount) for i, (p, impact, amount) in enumerate([(0.0, 10.8, 1e16), (0.0, 10.8, 1.0), (0.0, 10.8, 1.0), (0.2, 9.495, 1.0), (0.2, 9.495, 1.0), (0.1, 9.495, 1.0)])]
    for seed in range(3):
        i = spark.createDataFrame([("k", "f", *r) for r in rows], "key string, family string, id string, p double, impact double, amount double").repartition(3 + seed)
        got = reports.sums_in_order(i, ["key"], ("p", "id")).first().asDict()
        up = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
        impact = amount = 0.0
        for _, _, x, a in up:
            impact, amount = impact + x, amount + a
        assert got == {"key": "k", "anomalies": 6, "impact": impact, "amount": amount, "families": 1}
    assert impact == 60.88499999999999 and amount == 1e16 + 4
