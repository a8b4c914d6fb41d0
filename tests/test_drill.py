import datetime
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import drill, questions


@pytest.fixture(scope="module")
def led(spark):
    r, rows = random.Random(1), []
    for i in range(400):
        account = r.choice(["601000", "601100", "613200", "641000", "706000", "401000"])
        day, amount = datetime.date(2000 - (i % 5 == 0), r.randint(1, 12), r.randint(1, 28)), r.randint(-5000, 90_000)
        rows.append((day, account, f"V{i // 3}", f"label {i % 7}", float(max(amount, 0)), float(max(-amount, 0)), r.choice([None, "A", "B", "C"])))
    df = spark.createDataFrame(rows, "date date, account string, voucher string, label string, debit double, credit double, third_party string")
    money = {c: F.col(c).cast("decimal(18,2)") for c in ("debit", "credit")}
    df = df.withColumns(money).withColumns({"amount": F.col("debit") - F.col("credit"), "year": F.year("date"), "month": F.month("date"), "period": F.date_format("date", "yyyy-MM")})
    return df.withColumns({"class": F.substring("account", 1, 1), "prefix_2": F.substring("account", 1, 2), "prefix_3": F.substring("account", 1, 3)}).cache()


def plain(rows):
    return [tuple(float(x) if not isinstance(x, (str, bool, type(None))) else x for x in r) for r in rows]


def test_answers_equal_the_single_views(spark, led):
    asked = [("Q1", "detail_view", "613200", 2000), ("Q2", "trend_analysis", "601000", 2000), ("Q3", "comparison", None, 2000), ("Q4", "counterparty", "601", 2000), ("Q5", "breakdown", "641000", 2000)]
    asked += [("Q6", "trend_analysis", "601", 1999), ("Q7", "detail_view", "601", 2000), ("Q8", "detail_view", None, 2000), ("Q9", "detail_view", "999", 2000), ("R1", "counterparty", None, 2000), ("R2", "trend_analysis", None, 2000)]
    asked += [("R3", "breakdown", None, 2000), ("R4", "breakdown", "706", 1999), ("R5", "detail_view", "613200", 2000), ("R6", "unknown", "601", 2000)]
    got = {}
    for x in drill.answers(led, spark.createDataFrame(asked, "question string, drill string, account string, year int"), lines=20, parties=2).orderBy("question", "row").collect():
        got.setdefault(x["question"], []).append(tuple(x)[2:])
    line = lambda x: f"{x['date']}|{x['voucher']}|{x['label']}"

    def detail(prefix):
        rows = drill.detail(led, prefix, 20).collect()
        rows = sorted(rows, key=lambda x: (-abs(x["amount"]), x["date"], x["voucher"], x["account"], x["label"]))
        return [(n, x["account"], line(x), float(x["amount"]), float(x["all_debit"]), float(x["all_credit"]), float(x["all_lines"])) for n, x in enumerate(rows, 1)]

    def trend(df, prefix, year):
        rows = sorted(drill.trend(df, prefix, year).collect(), key=lambda x: x["period"])
        return [(n, x["period"], str(x["largest"]).lower(), float(x["net"]), float(x["lines"]), x["mean"], x["std"]) for n, x in enumerate(rows, 1)]

    def breakdown(class_, year):
        rows = sorted(drill.breakdown(led, year, class_).collect(), key=lambda x: (-x["volume"], x["account"]))
        return [(n, x["account"], x["prefix_2"], float(x["volume"]), x["share_pct"], None, None) for n, x in enumerate(rows, 1)]

    parties = lambda rows: [(n, x["third_party"], None, float(x["volume"]), float(x["lines"]), None, None) for n, x in enumerate(rows, 1)]
    half = sorted(drill.half_year(led, 2000).collect(), key=lambda x: x["account"])
    nothing = [(0, None, None, None, None, None, None)]
    assert got["Q1"] == got["R5"] == detail("613200")
    assert got["Q7"] == detail("601")
    assert got["Q2"] == trend(led, "601000", 2000) and got["Q6"] == trend(led, "601", 1999)
    assert got["Q3"] == [(n, x["account"], None, float(x["s1"]), float(x["s2"]), float(x["variation"]), x["variation_pct"]) for n, x in enumerate(half, 1)]
    assert got["Q4"] == parties(drill.counterparties(led, "601", 2).collect())
    assert got["R1"] == parties(drill.counterparties(led, "", 2).collect())
    assert got["R2"] == trend(led, "", 2000)
    assert got["Q5"] == got["R3"] == breakdown("6", 2000) and got["R4"] == breakdown("7", 1999)
    assert got["Q8"] == got["Q9"] == got["R6"] == nothing


def test_the_first_questions_are_executed(spark, led):
    found = spark.createDataFrame(
        [("year_end_spike", "613200", 2_500_000.0, 12.34, "HIGH", 1234.0), ("duplicate_amount", "99.00", 99.0, 6.0, "MEDIUM", None), ("purchases_to_sales", None, 90_000.0, 0.95, "HIGH", 95_000.0)],
        "pattern string, subject string, amount double, value double, severity string, whole double",
    )
    got = questions.execute(led, found, 2000, 3).select("question", "drill").distinct().orderBy("question").collect()
    assert [tuple(x) for x in got] == [("Q001", "detail_view"), ("Q002", "trend_analysis"), ("Q003", "trend_analysis")]
    said = {(x["pattern"], x["place"]): x["question"] for x in questions.drill_texts(found).collect()}
    assert said["year_end_spike", 0] == (
        "Le compte 613200 (Services extérieurs (sous-traitance, locations)) concentre 2.5M€ en décembre (12.3x la moyenne de 1K€). "
        "S'agit-il d'un charge constatée d'avance, provision, ou facture non parvenue régularisée ?"
    )
    assert said["purchases_to_sales", 0].startswith("Marge brute de seulement 5.0% (achats 90K€ / ventes 95K€).")
    assert said["duplicate_amount", 1] == "Identifier les contreparties des 6 écritures de 99€ : même tiers ou dispersé ?"
    assert len(said) == 7


def test_contexts_of_questions(spark):
    facts = spark.createDataFrame(
        [("613200", "zscore_eleve", 3, -1234.4, 900.0, -2.25, "Locations", None), ("681000", "provision_excessive", 12, 50_000.0, None, None, None, None), ("606", "libelle_suspect", None, 1.0, None, None, "x", "y" * 60)],
        "account string, kind string, month int, amount double, mean double, zscore double, account_label string, entry_label string",
    )
    got = {x["kind"]: x for x in questions.question_contexts(facts).collect()}
    assert got["zscore_eleve"]["context"] in {f"Le compte 613200 (Locations) a un z-score de {z} en mars: 1,234€ vs moyenne de 900€." for z in ("-2.3", "-2.2")}
    assert got["provision_excessive"]["context"].endswith("50,000€ vs run rate de 0€.") and len(got["provision_excessive"]["documents"]) == 4
    assert f"'{'y' * 50}'" in got["libelle_suspect"]["context"]
    assert {k for k, _, _ in questions.CONTEXTS} == {k for k, _, _ in questions.KINDS}
