"""What moves: lines once to their vouchers, and no ledger is written for a query that reads it once."""

import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folio.operators import crystallinity, graph, universe
from folio.sources import projection
from folio.sources.canonical import derive
from __spark_entry__ import queries

SCHEMA = "date date, account string, journal string, voucher string, label string, site string, third_party string, debit decimal(18,2), credit decimal(18,2)"
SF = "/root/testdata/sf0.001"


def lines(spark, rows):
    """rows: (voucher, account, site, debit, credit)."""
    return derive(spark.createDataFrame([(date(2000, 1, 3), a, "OD", v, "x", s, None, d if d is None else Decimal(d), c if c is None else Decimal(c)) for v, a, s, d, c in rows], SCHEMA))


def moved_by_voucher(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning\(voucher", plan))


ROWS = [("v", "601000", "S1", "10", "0"), ("v", "401000", "S1", "0", "4"), ("v", "401000", "S2", "0", "3"), ("v", "401000", "S2", "0", "3"), ("v", "512000", "S1", None, None), (None, "601000", "S1", "5", "0"), ("w", "601000", "S1", "1", "0")]


@pytest.mark.parametrize("f", [graph.arcs, graph.flow, graph.counterparties, crystallinity.cp_concentration, universe.counterparties])
def test_lines_move_once_to_their_voucher(spark, f):
    assert moved_by_voucher(f(lines(spark, ROWS))) == 1


def test_flow_and_counterparties(spark):
    df = lines(spark, ROWS)
    assert {tuple(r) for r in graph.flow(df).select("site", "source", "dest", "volume", "entries").collect()} == {
        ("S1", "601000", "401000", Decimal("34.00"), 4), ("S2", "601000", "401000", Decimal("6.00"), 2)}
    assert {tuple(r) for r in graph.counterparties(df).collect()} == {("601", "401000", 3), ("401", "601000", 3)}
    assert {(r["account"], r["site"]): r["counterparties"] for r in universe.counterparties(df).collect()} == {("601000", "S1"): 1, ("401000", "S1"): 1, ("401000", "S2"): 1}


def test_large_amounts_are_exact(spark):
    big = "9999999999999999.99"
    rows = [("v", "601000", "S1", big, "0")] * 40 + [("v", "401000", "S1", "0", big)] * 40
    (r,) = graph.flow(lines(spark, rows)).collect()
    assert r["volume"] == Decimal(big) * 3200 and r["entries"] == 3200


def test_a_query_that_reads_once_writes_no_ledger(spark, monkeypatch):
    monkeypatch.setattr(projection, "STORED", {})
    for name in ("gra05_stability", "emb01_matrix", "src06_summary", "top01_proximity", "lab01_entities"):
        assert queries()[name](spark, SF).count()
    assert not projection.STORED
    queries()["icc06_index"](spark, SF).count()
    assert len(projection.STORED) == 1


def test_periods(spark):
    df = derive(spark.createDataFrame([(d, "6", "OD", "v", "x", "S", None, Decimal(1), Decimal(0)) for d in (date(2000, 1, 3), date(1999, 12, 31), date(987, 2, 1), None)], SCHEMA))
    assert [r["period"] for r in df.collect()] == ["2000-01", "1999-12", "0987-02", None]


def test_labels_are_parsed_once_each(spark):
    from folio.operators import entities

    df = lines(spark, ROWS).withColumn("label", F.when(F.col("site") == "S1", "FACTURE FA-2000-853 TOTAL 12,50 EUR"))
    found = entities.entities(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Python lies above the shuffle of distinct labels
    assert 0 <= plan.index("MapInPandas") < plan.index("Exchange hashpartitioning(label") and "ArrowEvalPython" not in plan
    got = {r["label"]: [(e["kind"], e["normalized"], e["first"]) for e in r["entities"]] for r in found.collect()}
    assert got[None] == [] and ("REFERENCE", "FA-2000-853", 8) in got["FACTURE FA-2000-853 TOTAL 12,50 EUR"]
