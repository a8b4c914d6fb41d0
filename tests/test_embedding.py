import math

import numpy as np
import pytest

from folio.operators import embedding, models, risk


def test_two_matrices_by_hand(spark):
    """Shares (1, 0) and (0, 1) on the diagonal: centred cells are half and minus half."""
    df = spark.createDataFrame([("S", "2024-01", "a", "x", 10), ("S", "2024-02", "b", "y", 5)], "site string, period string, source string, dest string, volume int")
    e = embedding.embed(df, k=3)
    rows = {r["period"]: r for r in e.collect()}
    assert rows["2024-01"]["vector"] == pytest.approx([0.5, 0.5, 0.0]) and rows["2024-01"]["rank"] == 2
    stats = {r["period"]: r for r in embedding.embedding_stats(e).collect()}
    assert stats["2024-02"]["to_previous"] == 0 and stats["2024-02"]["cosine_previous"] == pytest.approx(1) and stats["2024-01"]["to_previous"] is None


def test_features_of_a_line_and_the_outlier(spark):
    import datetime
    from decimal import Decimal

    from folio.sources.canonical import derive

    r = np.random.default_rng(3)
    rows = [(datetime.date(2024, 1 + i % 12, 1 + i % 28), "601000", "ACH", f"V{i}", "x", Decimal(f"{r.uniform(90, 110):.2f}"), Decimal("0.00"), "S", None) for i in range(400)]
    rows.append((datetime.date(2024, 12, 29), "601000", "OD", "ODD", "x", Decimal("90000.00"), Decimal("0.00"), "S", None))
    led = derive(spark.createDataFrame(rows, "date date, account string, journal string, voucher string, label string, debit decimal(18,2), credit decimal(18,2), site string, third_party string"))
    f = models.features(led).where("voucher = 'ODD'").first()
    assert (f["weekday"], f["weekend"], f["year_end"], f["first_digit"], f["round_10000"], f["is_od"]) == (6, 1, 1, 9, 1, 1)
    assert f["log_amount"] == pytest.approx(math.log1p(90000))
    assert models.weak_labels(led).where("voucher = 'ODD'").first()["weak_label"] == 1
    top = models.isolation(led, trees=20, sample=64).orderBy("score", ascending=False).first()
    assert top["voucher"] == "ODD" and top["is_outlier"]
    errors = {r["voucher"]: r for r in models.reconstruction(led).collect()}
    # it is a component of its own, which rebuilds it
    assert not errors["ODD"]["is_outlier"] and 10 <= sum(r["is_outlier"] for r in errors.values()) <= 21
    parts = risk.line_risk(led)
    odd = parts.where("voucher = 'ODD'").first()
    assert odd["isolation"] > 90 and odd["benford"] == parts.agg({"benford": "max"}).first()[0]
    view = risk.risk_views(parts, risk.MODELS, top=3).collect()
    assert view[0]["risk"] == parts.agg({"risk": "max"}).first()[0] and len(view) == 3
    for v in view:
        why = sorted((m for m in risk.MODELS if v[m] > 60), key=lambda m: (-v[m], m))
        assert v["explanation"] == ",".join(why)
    summary = risk.risk_summary(parts, risk.MODELS).first()
    levels = [r["level"] for r in parts.collect()]
    for level in set(levels):
        shown = risk.risk_views(parts, risk.MODELS, level=level, top=len(levels)).collect()
        assert {r["level"] for r in shown} == {level} and len(shown) == levels.count(level)
    assert summary["lines"] == 401 and summary["minimal"] == levels.count("MINIMAL") and summary["corr_isolation"] > 0


def test_reconstruction_error_is_that_of_the_components(spark):
    """Against NumPy: what is left of standardized rows outside the first components."""
    r = np.random.default_rng(1)
    from pyspark.sql import functions as F

    from folio.operators.models import MODEL_COLUMNS

    x = r.normal(size=(60, len(MODEL_COLUMNS))) @ r.normal(size=(len(MODEL_COLUMNS),) * 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    vectors = np.linalg.svd(z, full_matrices=False)[2][:4]
    want = ((z - z @ vectors.T @ vectors) ** 2).sum(axis=1)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["id", *MODEL_COLUMNS])
    from unittest import mock

    with mock.patch.object(models, "features", lambda d: d):
        got = {row["id"]: row["error"] for row in models.reconstruction_errors(df.select("id", *[F.col(c) for c in MODEL_COLUMNS])).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(want.tolist(), abs=2e-4)


def test_mahalanobis_against_numpy(spark):
    from folio.operators import crystallinity

    r = np.random.default_rng(2)
    axes = ["amount_score", "label_score", "time_score", "purity", "cp_hhi"]
    x = r.normal(size=(12, 5))
    df = spark.createDataFrame([(f"60{i}", "S", "601", *map(float, row)) for i, row in enumerate(x)], ["account", "site", "family", *axes])
    d = x - x.mean(axis=0)
    inverse = np.linalg.inv(np.cov(x, rowvar=False) + 1e-6 * np.eye(5))
    want = {f"60{i}": math.sqrt(row @ inverse @ row) for i, row in enumerate(d)}
    got = {row["account"]: row["distance"] for row in crystallinity.mahalanobis(df).collect()}
    assert got == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_clusters_are_what_steps_within_eps_link(spark):
    """Against a plain search, with one point alone; jumps follow from it."""
    r = np.random.default_rng(5)
    points = np.concatenate([r.normal(0, 0.3, (12, 2)), r.normal(5, 0.3, (12, 2)), [[20.0, -20.0]]])
    rows = [(f"S{i % 3}", f"2024-{i // 3 + 1:02d}", list(map(float, p))) for i, p in enumerate(points)]
    e = spark.createDataFrame(rows, "site string, period string, vector array<double>")
    z = (points - points.mean(axis=0)) / points.std(axis=0)
    gap = np.linalg.norm(z[:, None] - z[None], axis=2)
    label = list(range(len(z)))
    for _ in z:
        label = [min(label[j] for j in range(len(z)) if gap[i, j] <= 0.2) for i in range(len(z))]
    got = {(x["site"], x["period"]): x for x in embedding.clusters(e, eps=0.2).collect()}
    same = lambda i, j: got[rows[i][:2]]["cluster"] == got[rows[j][:2]]["cluster"]
    for i in range(len(z)):
        lone = label.count(label[i]) == 1
        assert (got[rows[i][:2]]["cluster"] == -1) == lone
        assert all(same(i, j) == (label[i] == label[j]) for j in range(len(z)) if not lone and label.count(label[j]) > 1)
        near = min(gap[i, j] for j in range(len(z)) if j != i)
        assert got[rows[i][:2]]["nearest"] == (None if lone else pytest.approx(near, abs=1e-6))
    members = embedding.cluster_members(embedding.clusters(e, eps=0.2))
    assert members.where("cluster = -1 AND NOT is_outlier").count() == 0
    info = embedding.cluster_info(members).collect()
    assert sum(x["members"] for x in info) == sum(label.count(k) > 1 for k in label)
    jumps = embedding.cluster_jumps(members).collect()
    assert jumps and all(x["from_cluster"] != x["to_cluster"] and x["from_period"] < x["to_period"] for x in jumps)


def test_risk_is_weighed_over_the_models_that_ran(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 3.0), (2, 10.0, 5.0, 1.0)], "id int, benford double, isolation double, nlp double")
    rows = {r["id"]: r for r in risk.combined(df, ["benford", "isolation", "nlp"]).collect()}
    assert rows[1]["risk"] == pytest.approx((0.15 * 0 + 0.2 * 50 + 0.2 * 100) / 0.55, abs=1e-3) and rows[1]["top_factor"] == "nlp"
    assert rows[2]["risk"] == pytest.approx((0.15 * 100 + 0.2 * 50) / 0.55, abs=1e-3) and rows[2]["level"] == "MODERE" and rows[2]["top_factor"] == "benford"
