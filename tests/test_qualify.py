"""Qualification, score, universes and labels: known answers by hand."""

import math

import pytest

from folio.operators import entities, qualify, questions, signals, universe
from folio.sources import readers

SIGNAL = "id string, family string, universe string, test string, period string, metric double, threshold double, delta double, p_value double, method string, p_adjusted double, raw_score double"


def judged(spark, rows, **context):
    """rows of SIGNAL with a context: all false but what is given."""
    names = [c for _, c in qualify.EXCLUSIONS] + [c for _, c, _ in qualify.INCLUSIONS]
    from pyspark.sql import functions as F

    s = spark.createDataFrame(rows, SIGNAL).withColumns({n: F.lit(context.get(n, False)) for n in names})
    return s.withColumn("calibration", F.lit(context.get("calibration", 0)))


def test_pertinence_by_hand(spark):
    rows = [("a", "601", "CUT_OFF", "L2-VAR", "2024-12", 1.0, 1.0, 1.0, 0.004, "conformal", 0.004, 50.0), ("b", "602", "COMPOSITE", "L2-CONC", "2024-03", 1.0, 1.0, 1.0, None, "rule_based", None, 30.0), ("c", "603", "COMPOSITE", "L2-VAR", "2024-03", 1.0, 1.0, 1.0, 0.5, "conformal", 0.5, 10.0)]
    from pyspark.sql import functions as F

    c = qualify.inclusions(judged(spark, rows, year_end=True, calibration=14)).withColumns({"amount": F.lit(15000.0), "limit": F.lit(5000.0)})
    got = {r["id"]: r for r in qualify.pertinence(c).collect()}
    material = 70 + 20 * (3 - 2) / 3
    # p below 0.005 gives 90; boost 10; CUT_OFF, December, conformal and a long calibration give 25
    want = 0.35 * 90 + 0.30 * material + 0.25 * ((90 + material) / 2 + 10) + 0.10 * 25
    assert got["a"]["pertinence"] == pytest.approx(want, abs=1e-3) and got["a"]["level"] == "CRITICAL"
    assert got["b"]["statistical"] == 30 and got["b"]["context"] == 5
    assert got["c"]["statistical"] == pytest.approx(100 * (0.5 - math.log10(0.51) * 0.2), abs=1e-3)


def test_rules_are_limited_to_those_that_a_family_lists(spark):
    row = ("a", "601", "COMPOSITE", "L2-VAR", "2024-03", 1000.0, 1.0, 1.0, 0.1, "conformal", 0.1, 1.0)
    c = judged(spark, [row, ("b", "602", *row[2:]), ("c", "603", *row[2:])], is_round=True, zero_balance=True)
    listed = spark.createDataFrame([("601", ["Solde zero", "?"]), ("602", ["unknown"])], "family string, rules array<string>")
    got = {r["id"]: (r["rules_checked"], r["rules_matched"]) for r in qualify.exclusions(c, listed).collect()}
    every = [rule for rule, _ in qualify.EXCLUSIONS]
    assert got == {"a": (["EXC-ZERO"], ["EXC-ZERO"]), "b": (every, ["EXC-ROUND", "EXC-ZERO"]), "c": (every, ["EXC-ROUND", "EXC-ZERO"])}


def test_score_without_anomalies_and_with_one(spark):
    schema = "id string, family string, universe string, test string, pertinence double, amount double, filter_reason string"
    none = qualify.impact(spark.createDataFrame([], schema))
    assert qualify.score(none).first()["score"] == 100 and qualify.score(none).first()["level"] == "EXCELLENT"
    assert {r["score"] for r in qualify.universe_scores(none).collect()} == {100.0}
    one = qualify.impact(spark.createDataFrame([("a", "601", "PONCTUEL", "L2-VAR", 50.0, 1000.0, "PASSED"), ("b", "602", "PONCTUEL", "L2-VAR", 90.0, 1.0, "LOW_PERTINENCE")], schema))
    factor = min(2.0, 1 + 3 * math.log10(2))
    assert one.first()["impact"] == pytest.approx(min(15, 7.5 * 1.4 * factor), abs=1e-3)
    assert qualify.score(one).first()["score"] == pytest.approx(100 - 15, abs=1e-3) and qualify.score(one).first()["level"] == "BON"


def test_periods_of_dated_and_undated_ledgers(spark):
    rows = [("601", "2024-01-05", "J", "l")] * 3 + [("601", "2024-02-05", "J", "l"), ("602", "bad", "J", "l"), ("602", None, "J", "l")]
    df = spark.createDataFrame([(a, d, 1.0, j, x) for a, d, j, x in rows], "account string, date string, amount double, journal string, label string")
    assert sorted((r["family"], r["period"]) for r in qualify.prepare_signals(df).collect()) == [("601", "2024-01")] * 3 + [("601", "2024-02"), ("602", "2024-01"), ("602", "2024-01")]
    bad = df.where("account = '602' OR date = '2024-02-05'")
    assert {r["period"] for r in qualify.prepare_signals(bad).collect()} == {"AGG"}


def test_masks_and_names(spark):
    df = spark.createDataFrame([("M. Dupont loyer 12345",), ("REGUL TVA 01/02/24",), ("loyer mai",), ("",), (None,)], "label string")
    got = [r[0] for r in df.select(universe.mask_label(df.label)).collect()]
    # a mask of over four letters is a word in capitals itself
    assert got == ["[ENTITE] LOYER [ENTITE]", "REGUL TVA [DATE]", "LOYER MAI", "", ""]
    assert [r[0] for r in df.limit(3).select(universe.names_in(df.label)).collect()] == [2, 0, 0]


def test_universe_rules_in_order(spark):
    base = dict(family="600", asset_ratio=0.0, regularity=0.0, cv=1.0, mirror_ratio=0.0, entropy=5.0, journals=1, entropy_drop=0.0, name_ratio=0.0, labels=1, counterparties=0, entropy_masked=0.0)
    cases = [
        (dict(family="681", asset_ratio=0.4, mirror_ratio=0.9), "INVENTAIRE", 0.95), (dict(family="681", regularity=0.9, cv=0.05), "INVENTAIRE", 0.9), (dict(mirror_ratio=0.31), "VENTILATION", 0.91),
        (dict(family="791"), "VENTILATION", 0.85), (dict(entropy=1.0, cv=0.1, regularity=0.8), "CRISTALLIN", 0.95), (dict(family="626", cv=0.2), "CRISTALLIN", 0.85), (dict(entropy_drop=2.1), "NOMINATIF", 0.92),
        (dict(family="641", labels=6), "NOMINATIF", 0.9), (dict(journals=3, counterparties=4, entropy_masked=3.1), "COMPOSITE", 0.85), (dict(family="471", counterparties=4), "COMPOSITE", 0.7), ({}, "NON_CLASSE", 0.3),
    ]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _, _ in cases], list(base))
    assert [(r["universe"], r["confidence"]) for r in universe.universe(df).collect()] == [(u, pytest.approx(x, abs=1e-4)) for _, u, x in cases]


def test_entities_of_labels():
    found = lambda t, kind: [(e[1], e[2]) for e in entities.found_in(t) if e[0] == kind]
    assert found("Paiement 1 234,56 €", "MONTANT") == [("1 234,56 €", "1234.56")]
    assert found("FACTURE FA-2024-001 du 01/02/2024", "REFERENCE") == [("FA-2024-001", "FA-2024-001")]
    assert ("01/02/2024", "01/02/2024") in found("FACTURE FA-2024-001 du 01/02/2024", "DATE")
    assert found("Loyer janvier 2024", "DATE") == [("janvier 2024", "2024-01")]
    assert found("Achat DUPONT SARL", "TIERS")[0][1].endswith("SARL")
    assert found("AGENCE LYON", "LIEU")[0][1].startswith("LYON")
    assert list(entities.found_in("")) == []


def test_features_of_labels(spark):
    df = spark.createDataFrame([("Invoice payment from the 1 234,56 € FA-2024-001",), ("loyer",), (None,), ("",)], "label string")
    got = {r["label"]: r for r in entities.label_features(df).collect()}
    first = got["Invoice payment from the 1 234,56 € FA-2024-001"]
    assert (first["label_amount"], first["reference"], first["language"]) == (1234.56, "FA-2024-001", "EN")
    assert got["loyer"]["party"] is None and got["loyer"]["language"] == "FR" and len(got["loyer"]["label_hash"]) == 12
    assert len(got) == 4 and got[""]["useful_length"] == 0


def test_questions_have_priorities_by_amount(spark):
    a = spark.createDataFrame([("601000", "z-score", None, None, 200000.0, 3, 12.4, 0.0), ("602000", "montant rond", None, None, 10.0, None, None, 0.0), ("603000", None, "OD", None, 7000.0, 1, None, 0.0)], "account string, nature string, source string, journal string, amount double, month int, pct double, variation double")
    p = spark.createDataFrame([("681000", 60000.0), ("691000", -6000.0)], "account string, gap double")
    got = {r["account"]: r for r in questions.questions(a, p).collect()}
    assert [(got[k]["kind"], got[k]["priority"]) for k in sorted(got)] == [("zscore_eleve", 1), ("montant_rond", 3), ("journal_od", 2), ("provision_excessive", 1), ("provision_insuffisante", 2)]
    assert "mars" in got["601000"]["question"] and "60,000€" in got["681000"]["question"]
    s = questions.resolution_summary(questions.questions(a, p)).first()
    assert (s["points"], s["priority_1"], s["priority_2"], s["priority_3"]) == (5, 2, 2, 1)


def test_signals_of_a_universe_test(spark):
    m = spark.createDataFrame([("601", "2024-03", "S1", 5.0, ["marge"], True, False, True, False, False), ("999", "2024-03", None, 1.0, [], True, False, False, False, False)],
        "family string, period string, site string, metric double, keywords array<string>, is_round boolean, same_12 boolean, repeated_label boolean, zero_balance boolean, reversed_in_time boolean")
    ref = spark.createDataFrame([("601", 0.72, ["Marge forte", "x"], ["montant_rond", "solde_zero"])], "family string, cv double, signal_if array<string>, no_signal_if array<string>")
    got = {r["family"]: r for r in signals.make_signals(m, ref, "T").collect()}
    assert (got["601"]["id"], got["601"]["threshold"], got["601"]["delta"], got["601"]["excluded_by"], got["601"]["supported_by"]) == ("T_601_202403_S1", 2.94, 2.06, "montant_rond", "Marge forte")
    assert (got["999"]["id"], got["999"]["threshold"], got["999"]["delta"]) == ("T_999_202403", 3.5, 0.0)


@pytest.mark.parametrize(("encoding", "found"), [("utf-8", "UTF-8"), ("latin-1", "ISO-8859-1"), ("cp1252", "windows-1252")])
def test_encodings_are_told_by_the_data(spark, tmp_path, encoding, found):
    """Headers are ASCII; only one late label has an accent, or a sign that latin-1 lacks."""
    sign = "€" if encoding == "cp1252" else "é"
    text = "\n".join(["date;compte;debit;credit;libelle", *[f"2024-01-{i % 28 + 1:02d};601000;1;0;x" for i in range(300)], f"2024-01-01;601000;1;0;Et{sign}"])
    (tmp_path / "gl.csv").write_bytes(text.encode(encoding))
    assert readers.encoding_of(spark, str(tmp_path / "gl.csv")) == found
    assert readers.load(spark, str(tmp_path / "gl.csv")).where(f"label = 'Et{sign}'").count() == 1


def test_layouts_whatever_the_case_and_size():
    assert readers.layout_of(["date", "N° DE COMPTE", "intitulé du compte", "code journal", "n° de pièce", "LIBELLÉ", "débit", "crédit", "code analytique"]) == "ebp"
    assert readers.map_headers(["DATE", "compte", "Debit", "CREDIT"])["debit"] == "Debit"
    assert readers.layout_of(["x", "y"]) == "generic"
