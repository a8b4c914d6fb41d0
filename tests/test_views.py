import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import crystallinity, entities, models, robust
from folio.sources.canonical import derive


@pytest.fixture(scope="module")
def led(spark):
    r = np.random.default_rng(3)
    rows = [(datetime.date(2024, 1 + i % 12, 1 + i % 28), ["601000", "613000"][i % 2], ["ACH", "VTE"][i % 3 == 0], f"V{i}", "LOYER MARS" if i % 2 else f"FACTURE {i}", Decimal(f"{r.uniform(90, 110):.2f}"), Decimal("0.00"), "S", None) for i in range(300)]
    rows += [(datetime.date(2024, 12, 29), "601000", "OD", "ODD", "x", Decimal("90000.00"), Decimal("0.00"), "S", None), (datetime.date(2024, 12, 30), "681000", None, "P", "PROVISION", Decimal("50.50"), Decimal("0.00"), "S", None)]
    return derive(spark.createDataFrame(rows, "date date, account string, journal string, voucher string, label string, debit decimal(18,2), credit decimal(18,2), site string, third_party string")).cache()


def test_outliers_come_with_their_farthest_features(led):
    top = models.isolation_top(led, models.isolation(led, trees=20, sample=64, keep=models.MODEL_COLUMNS), 5).orderBy("rank").collect()
    assert top[0]["voucher"] == "ODD" and [r["rank"] for r in top] == list(range(1, len(top) + 1))
    f = models.features(led).toPandas()
    x = f[list(models.MODEL_COLUMNS)].astype(float)
    z = ((x - x.mean()) / x.std()).loc[f["voucher"] == "ODD"].iloc[0].fillna(0)
    want = sorted(z.index, key=lambda c: (-round(abs(z[c]), 6), c))[:3]
    assert [p.split("=")[0] for p in top[0]["influence"].split(", ")] == want
    assert float(top[0]["influence"].split(", ")[0].split("=")[1]) == pytest.approx(z[want[0]], abs=0.006)


def test_percentiles_of_errors_and_latent_vectors(led):
    rows = models.latent_views(models.reconstruction_errors(led, 3)).collect()
    errors = np.array([r["error"] for r in rows])
    assert len(rows) == 302
    for r in rows[:40]:
        assert r["percentile"] == pytest.approx((errors <= r["error"]).mean() * 100, abs=1e-3)
        assert len(r["latent"]) == 3


def test_decimals_and_places_of_journals(led):
    f = models.features(led)
    assert {r["voucher"]: r["decimals"] for r in f.where("voucher IN ('ODD', 'P')").collect()} == {"ODD": 0, "P": 1}
    assert {tuple(r) for r in models.journal_index(led).collect()} == {("ACH", 0), ("OD", 1), ("VTE", 2)}


def test_anomalies_take_the_commonest_label_of_their_family(spark, led):
    q = spark.createDataFrame([("a", "613"), ("b", "601"), ("c", "999")], "id string, family string")
    got = {r["id"]: (r["label"], r["intent"]) for r in entities.attach_to_anomalies(q, led).collect()}
    assert got["a"][0] == "LOYER MARS" and got["b"][0] == "FACTURE 0" and got["c"] == (None, None)
    labels = entities.label_features(led).where("label = 'LOYER MARS'").first()
    assert got["a"][1] == labels["intent"]
    assert entities.attach_labels(led).where("label = 'LOYER MARS'").select("label_hash").distinct().count() == 1


def test_advice_names_columns_and_accounts(led):
    said = {(r["kind"], r["rank"]): r["text"] for r in robust.profile_advice(led.withColumn("credit", F.when(F.col("voucher") > "V2", F.col("credit"))), 2024).collect()}
    share = led.where("voucher <= 'V2'").count() / led.count() * 100
    assert said["warning", 4] == f"Colonne critique 'credit' a {share:.1f}% de valeurs manquantes"
    heavy = robust.profile_accounts(led, 2024).where("december_pct > 80").count()
    assert said["recommendation", 7] == f"{heavy} comptes avec >80% de mouvement en décembre"


def test_family_scores_need_three_couples(spark):
    rows = [(f"60{i}", "S", "60", "X", v, 0.5, 0.2) for i, v in enumerate([0.9, 0.9, 0.9, 0.9, 0.1])] + [("701", "S", "70", "Y", 0.5, 0.5, 0.2), ("702", "S", "70", "Y", 0.1, 0.5, 0.2)]
    rows += [(f"80{i}", None, "80", "Y", 0.5 + i / 1000, 0.5, 0.2) for i in range(3)]
    i = spark.createDataFrame(rows, "account string, site string, family string, universe string, icc double, expected double, threshold double")
    z = {r["account"]: (r["z"], r["alert"]) for r in crystallinity.family_z(i).collect()}
    assert z["604"] == (-2.0, True) and z["600"] == (0.5, False) and z["701"] == (None, False) and z["800"] == (0.0, False)
    stats = {r["universe"]: r for r in crystallinity.icc_stats(i).collect()}
    assert (stats["ALL"]["couples"], stats["ALL"]["crystalline"], stats["ALL"]["amorphous"], stats["ALL"]["surprising"]) == (10, 4, 2, 6)
    assert stats["Y"]["median"] == pytest.approx(0.5) and stats["X"]["median"] == pytest.approx(0.9)
    assert {tuple(r) for r in crystallinity.heat_map(i).collect()} == {("S", "60", 0.1), ("S", "70", 0.1)}
    top = crystallinity.icc_top(i, 1)
    assert {(r["view"], r["account"], r["value"]) for r in top.collect()} == {("amorphous", "604", 0.1), ("crystalline", "600", 0.9), ("surprising", "600", 0.4)}
