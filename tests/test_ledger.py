"""Operators against DuckDB on a small fixture, and known answers by hand."""

import datetime
import math
import os
import random

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from folio.operators import classify, crystallinity, graph, passage, robust, runrate
from folio.plans.registry import ORACLES, QUERIES
from folio.sources import canonical

DAY = datetime.date


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Order lines in two years, with repeated keys and round prices."""
    folder = tmp_path_factory.mktemp("tables")
    r = random.Random(7)
    lines = []
    for _ in range(1500):
        ship = datetime.datetime(r.choice([1999, 2000]), r.randint(1, 12), r.randint(1, 28))
        lines.append((r.randint(1, 300), r.randint(0, 47), r.randint(0, 29), r.randint(1, 7), round(r.uniform(900, 105000), 2) if r.random() < 0.9 else 20000.0, r.choice("RAN"), ship))
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_returnflag VARCHAR, l_shipdate TIMESTAMP)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?, ?)", lines)
    con.execute("CREATE TABLE part AS SELECT range AS p_partkey, ['large gizmo', 'rappel taxe', 'prime assurance'][range % 3 + 1] || ' ' || range AS p_name FROM range(48)")
    con.execute("CREATE TABLE supplier AS SELECT range AS s_suppkey, 'Supplier#' || range AS s_name FROM range(30)")
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return con, str(folder)


def plain(rows):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{float(x):.3f}" if not isinstance(x, (bool, str)) and hasattr(x, "__float__") else str(x)

    return sorted(tuple(cell(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, tables, name):
    con, folder = tables
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall()
    assert plain(df.select(*[f"`{c}`" for c in cols]).collect()) == plain(want)


def ledger(spark, rows):
    """rows: (date, account, journal, voucher, label, debit, credit)."""
    schema = "date date, account string, journal string, voucher string, label string, debit decimal(18,2), credit decimal(18,2), site string, third_party string"
    from decimal import Decimal

    return canonical.derive(spark.createDataFrame([(*r[:5], Decimal(str(r[5])), Decimal(str(r[6])), "S0", None) for r in rows], schema))


def test_known_december(spark):
    """A purchase account of 10 000 a month, a refund in December only, a tax charge in December only."""
    rows = [(DAY(2024, m, 15), "601000", "ACH", f"A{m}", "ACHAT", 10000, 0) for m in range(1, 13)]
    rows += [(DAY(2024, 12, 31), "631000", "OD", "O1", "DEGREVEMENT TS 2022", 0, 230000), (DAY(2024, 12, 31), "695000", "OD", "O2", "IS", 240000, 0)]
    p = {r["account"]: r for r in runrate.provisions(ledger(spark, rows), 2024).collect()}
    assert set(p) == {"631000", "695000"}
    assert float(p["631000"]["total"]) == -230000 and float(p["695000"]["total"]) == 240000
    assert p["695000"]["impact"] == pytest.approx(-220000)
    n = runrate.normalized_december(ledger(spark, rows), 2024).first()
    assert n["gross_charges"] == 20000 and n["normalized_charges"] == pytest.approx(20000 + (230000 - 230000 / 12) - 220000, abs=0.01)


def test_outlier_month(spark):
    rows = [(DAY(2024, m, 1), "622600", "ACH", f"A{m}", "HONORAIRES", 50000 if m == 6 else 10000 + m, 0) for m in range(1, 13)]
    found = robust.mad(ledger(spark, rows), 2024).first()
    assert found["is_anomaly"] and found["months"] == "2024-06"


def test_entry_types(spark):
    rows = [
        (DAY(2024, 3, 1), "601000", "ACH", "V1", "FACTURE", 10, 0), (DAY(2024, 3, 1), "408000", "ACH", "V1", "FACTURE", 0, 10), (DAY(2024, 3, 2), "602000", "ACH", "V2", "Régul mars", 5, 0),
        (DAY(2024, 3, 3), "603000", "OD", "V3", "divers", 5, 0), (DAY(2024, 3, 4), "604000", "ACH", "V4", "AMENDE", 5, 0), (DAY(2024, 3, 5), "605000", "ACH", None, "x", 5, 0),
    ]
    got = {r["account"]: (r["entry_type"], r["counterpart"]) for r in classify.classify_entries(ledger(spark, rows)).collect()}
    assert got["601000"] == ("REGUL", "408000") and got["602000"] == ("REGUL", None)
    assert (got["603000"][0], got["604000"][0], got["605000"][0]) == ("ESTIMATIF", "ONE_SHOT", "RUN_RATE")


def test_journals_by_keyword(spark):
    df = spark.createDataFrame([(j,) for j in ("OD", "sal", "VTE1", "HA", "XYZ", "BANQUE2")], "journal string")
    got = {r["journal"]: r["journal_type"] for r in classify.classify_journal(df).collect()}
    assert got == {"OD": "od", "sal": "paie", "VTE1": "vente", "HA": "achat", "XYZ": "autre", "BANQUE2": "banque"}


def test_amounts_and_dates_as_printed(spark):
    df = spark.createDataFrame([("1 234,56 €", "31/12/2024"), ("1.234,56", "2024-12-31"), ("1,234.56", "31-12-2024"), ("abc", "32/01/2024"), (None, None), ("-5", "1/2/24")], "a string, d string")
    got = df.select(canonical.parse_amount(df.a).cast("double").alias("a"), canonical.parse_date(df.d).alias("d")).collect()
    assert [r["a"] for r in got] == [1234.56, 1234.56, 1234.56, 0.0, 0.0, -5.0]
    assert [r["d"] for r in got] == [DAY(2024, 12, 31)] * 3 + [None, None, DAY(2024, 2, 1)]


def test_flow_counts_lines_like_the_product(spark):
    rows = [(DAY(2024, 1, 1), "601000", "ACH", "V", "a", 60, 0), (DAY(2024, 1, 1), "602000", "ACH", "V", "a", 40, 0), (DAY(2024, 1, 1), "401000", "ACH", "V", "a", 0, 70), (DAY(2024, 1, 1), "401000", "ACH", "V", "b", 0, 30)]
    got = {(r["source"], r["dest"]): (float(r["volume"]), r["entries"]) for r in graph.flow(ledger(spark, rows)).collect()}
    assert got == {("601000", "401000"): (60 * 2 + 70 + 30, 4), ("602000", "401000"): (40 * 2 + 70 + 30, 4)}


def test_subscription_balances(spark):
    rows = [(DAY(2024, m, 1), "488100", "OD", f"V{m}", "ABT CFE", 5000, 0) for m in range(1, 12)] + [(DAY(2024, 12, 31), "488100", "OD", "V12", "ABT CFE", 0, 55000)]
    got = passage.subscriptions(ledger(spark, rows), 2024).first()
    assert got["is_valid"] and got["monthly_provision"] == 5000 and got["entries"] == 12


def test_empty_ledger(spark):
    empty = ledger(spark, [])
    assert runrate.provisions(empty, 2024).count() == 0 and crystallinity.icc(empty).count() == 0
    assert canonical.summary(empty).first()["rows"] == 0 and passage.passage_monthly(empty, 2024).count() == 12


def test_every_module_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['folio.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'run04_normalized_december' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
