"""What the line models move and write: no line is shuffled, and only what is wanted of it is written."""

import datetime
from decimal import Decimal

import numpy as np
import pytest

from folio.operators import models, risk
from folio.sources.canonical import derive


@pytest.fixture(scope="module")
def led(spark, tmp_path_factory):
    r = np.random.default_rng(5)
    rows = [
        (datetime.date(2024, 1 + i % 12, 1 + i % 28), ["601000", "613000", "706000"][i % 3], ["ACH", "OD"][i % 7 == 0], f"V{i}", f"{['FACTURE', 'REGUL', 'LOYER'][i % 3]} {i % 40}", Decimal(f"{r.lognormal(5, 2):.2f}"), Decimal("0.00"), "S", None)
        for i in range(3000)
    ]
    path = str(tmp_path_factory.mktemp("ledger") / "t")
    derive(spark.createDataFrame(rows, "date date, account string, journal string, voucher string, label string, debit decimal(18,2), credit decimal(18,2), site string, third_party string")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def tables(monkeypatch):
    """Columns of the tables that are written, by name."""
    seen = {}

    def noted(df, name):
        seen[name] = df.columns
        return keep(df, name)

    keep = models.written
    for module in (models, risk):
        monkeypatch.setattr(module, "written", noted)
    return seen


def test_lines_do_not_move_to_their_accounts_and_days(spark, led):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = models.features(led)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_risk_writes_lines_once(led, tables):
    rows = risk.line_risk(led)
    assert not {"errors", "scores"} & set(tables)
    assert tables["parts"] == ["date", "account", "voucher", "label", "amount", "benford", "isolation", "reconstruction", "nlp"]
    bare = risk.line_risk(led, ())
    assert tables["parts"] == ["benford", "isolation", "reconstruction", "nlp"]
    assert risk.risk_summary(bare, risk.MODELS).first() == risk.risk_summary(rows, risk.MODELS).first()
    got, errors, scores = (df.orderBy("voucher").toPandas() for df in (rows, models.reconstruction_errors(led), models.isolation(led)))
    scaled = lambda x: (x - x.min()) / (x.max() - x.min()) * 100
    assert np.allclose(got["isolation"], scaled(scores["score"]), atol=1e-3) and np.allclose(got["reconstruction"], scaled(errors["error"]), atol=1e-3)
    assert set(got["nlp"]) == {0.0, 100.0}


def test_first_outliers_need_few_whole_lines(spark, led, tables):
    """Only lines that may be among the first are written with other columns than the score, in batches of 100 and in one."""
    every = models.isolation(led, trees=20, sample=64, keep=models.MODEL_COLUMNS)
    want = models.isolation_top(led, every, 5).orderBy("rank").collect()
    for batch in ("100", "10000"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            some = models.isolation(led, trees=20, sample=64, keep=models.MODEL_COLUMNS, most=5)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert models.isolation_top(led, some, 5).orderBy("rank").collect() == want
        assert some.count() == 3000 and some.where("voucher IS NOT NULL").count() < 1500
        assert sorted(r["score"] for r in some.collect()) == sorted(r["score"] for r in every.collect())
        assert some.where("is_outlier").count() == every.where("is_outlier").count()


def test_reconstruction_writes_what_it_returns(led, tables):
    got = models.reconstruction(led)
    assert tables["errors"] == ["date", "account", "voucher", "label", "amount", "error"]
    assert got.count() == 3000


def test_lines_do_not_move_to_their_percentiles(spark, led, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        views = models.latent_views(models.reconstruction_errors(led).select("voucher", "error", "latent"))
        plan = views._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tables["errors"] == ["voucher", "error", "latent"]
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    errors = np.array([r["error"] for r in views.select("error").collect()])
    assert len(errors) == 3000 and all(abs(r["percentile"] - (errors <= r["error"]).mean() * 100) < 1e-3 for r in views.collect()[:50])


def test_lines_move_to_percentiles_that_are_too_many(led, monkeypatch):
    few = {r["voucher"]: r["percentile"] for r in models.latent_views(models.reconstruction_errors(led).select("voucher", "error")).collect()}
    monkeypatch.setattr(models, "SENT", 10)
    assert {r["voucher"]: r["percentile"] for r in models.latent_views(models.reconstruction_errors(led).select("voucher", "error")).collect()} == few
