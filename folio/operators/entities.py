"""Entities in labels (amounts, dates, references, third parties, places) and the features that follow from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import rounded
from folio.operators import labels as l

ENTITIES = "array<struct<kind:string,value:string,normalized:string,first:int,last:int,confidence:double>>"
# Patterns by kind of entity, in order; the first group is what is normalized.
MONTH_NAMES = "JANVIER|FEVRIER|MARS|AVRIL|MAI|JUIN|JUILLET|AOUT|SEPTEMBRE|OCTOBRE|NOVEMBRE|DECEMBRE|JAN|FEV|MAR|AVR|JUI|JUL|AOU|SEP|OCT|NOV|DEC"
I = re.IGNORECASE  # noqa: E741
PATTERNS = {
    "REFERENCE": [
        re.compile(r"\b(FA[C]?[-/]?\d{4}[-/]?\d{3,6})\b", I), re.compile(r"\b(BC[-/]?\d{4,8})\b", I), re.compile(r"\b(AV[-/]?\d{4}[-/]?\d{3,6})\b", I),
        re.compile(r"\b(?:PIECE|PCE|N°|NO|NUM)[\s:]*(\d{4,10})\b", I), re.compile(r"\b([A-Z]{2,4}[-/]\d{4}[-/]\d{3,6})\b"), re.compile(r"\b(?:REF|REFERENCE)[\s:]*([A-Z0-9\-]{4,15})\b", I),
    ],
    "MONTANT": [
        re.compile(r"(\d{1,3}(?:\s?\d{3})*(?:[,\.]\d{2})?)\s*(?:€|EUR|EUROS?)", I), re.compile(r"(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:€|EUR|EUROS?)", I),
        re.compile(r"(?:MONTANT|MT|TOTAL)[\s:]*(\d+(?:[,\.]\d{2})?)", I),
    ],
    "DATE": [
        re.compile(r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\b"), re.compile(rf"\b((?:{MONTH_NAMES})\.?\s*\d{{2,4}})\b", I), re.compile(r"\b([QT][1-4]\s*\d{2,4})\b", I),
        re.compile(r"\b(?:EXERCICE|EX|ANNEE)\s*(\d{4})\b", I), re.compile(r"\b(\d{1,2}/\d{4})\b"),
    ],
    "TIERS": [
        re.compile(r"\b([A-Z][A-Z0-9\s]{2,30}(?:SARL|SAS|SA|EURL|SCI|SASU|SCOP|GIE|SNC))\b", I), re.compile(r"(?:DE|POUR|CHEZ|CLIENT|FOURNISSEUR)[\s:]+([A-Z][A-Z0-9\s&\'-]{2,30})", I),
        re.compile(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"),
    ],
    "LIEU": [re.compile(r"(?:AGENCE|SITE|MAGASIN|DEPOT)[\s:]+([A-Z][A-Z0-9\s]{2,20})", I), re.compile(r"\b(PARIS|LYON|MARSEILLE|TOULOUSE|BORDEAUX|LILLE|NANTES|STRASBOURG)\b", I)],
}
CONFIDENCE = {"REFERENCE": 0.85, "MONTANT": 0.9, "DATE": 0.85, "TIERS": 0.7, "LIEU": 0.75}
UNREADABLE_AMOUNT = 0.6
NO_PARTY = (
    "JANVIER", "FEVRIER", "MARS", "AVRIL", "MAI", "JUIN", "JUILLET", "AOUT", "SEPTEMBRE", "OCTOBRE", "NOVEMBRE", "DECEMBRE", "TOTAL", "MONTANT",
    "SOLDE", "FACTURE", "AVOIR", "REGLEMENT", "VIREMENT", "CHEQUE", "PAIEMENT", "ENCAISSEMENT",
)
MONTHS = {
    "JANVIER": 1, "JAN": 1, "FEVRIER": 2, "FEV": 2, "MARS": 3, "MAR": 3, "AVRIL": 4, "AVR": 4, "MAI": 5, "JUIN": 6, "JUI": 6, "JUILLET": 7, "JUL": 7, "AOUT": 8, "AOU": 8,
    "SEPTEMBRE": 9, "SEP": 9, "OCTOBRE": 10, "OCT": 10, "NOVEMBRE": 11, "NOV": 11, "DECEMBRE": 12, "DEC": 12,
}
FRENCH = (
    "de", "la", "le", "du", "des", "pour", "sur", "avec", "facture", "avoir",
)
ENGLISH = (
    "the", "of", "for", "with", "invoice", "payment", "from",
)


def amount_of(text: str) -> float | None:
    bare = text.replace(" ", "").replace(" ", "")
    bare = bare.replace(",", "" if "." in bare else ".")
    try:
        return float(bare)
    except ValueError:
        return None


def period_of(text: str) -> str:
    """Year and month where a month's name and four digits are there, else the text in capitals."""
    up = text.upper().strip()
    year = re.search(r"\d{4}", up)
    month = next((n for name, n in MONTHS.items() if name in up), None)
    return f"{year[0]}-{month:02d}" if year and month else up


def found_in(text: str) -> Iterator[tuple[str, str, str, int, int, float]]:
    """(kind, value, normalized, first, last, confidence) of each match, kind by kind; of overlapping ones of a kind the first and surest is kept."""
    for kind, patterns in PATTERNS.items():
        every = []
        for pattern in patterns:
            for m in pattern.finditer(text):
                group, sure = m[1], CONFIDENCE[kind]
                if kind == "MONTANT":
                    n = amount_of(group)
                    value, plain, sure = m[0], group if n is None else str(n), sure if n else UNREADABLE_AMOUNT
                elif kind == "DATE":
                    value, plain = m[0], period_of(group)
                elif kind == "REFERENCE":
                    value, plain = group, group.upper().replace(" ", "")
                else:
                    value, plain = group, group.strip().upper()
                if kind != "TIERS" or (len(group) >= 3 and plain not in NO_PARTY):
                    every.append((kind, value, plain, m.start(), m.end(), sure))
        end = -1
        for e in sorted(every, key=lambda e: (e[3], -e[5])):
            if e[3] >= end:
                yield e
                end = e[4]


def entities(df: DataFrame) -> DataFrame:
    """(label, entities): found once per distinct label, in the order of their places; none in an empty label."""

    names = ("kind", "value", "normalized", "first", "last", "confidence")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(entities=[[dict(zip(names, e)) for e in sorted(found_in(t or ""), key=lambda e: e[3])] for t in pdf["label"]])

    # no function of a column: the planner would merge that into the aggregate and call it for each line
    return df.select("label").distinct().mapInPandas(find, f"label string, entities {ENTITIES}")


def label_features(df: DataFrame) -> DataFrame:
    """One row of features per distinct label: best entity of each kind, intent, operation, recurrence, language, confidence, hash."""
    e = entities(df)
    of = lambda kind: F.filter("entities", lambda x: x["kind"] == kind)
    # the surest one, the first of equals
    best = lambda kind: F.get(F.array_sort(F.transform(of(kind), lambda x, i: F.struct((-x["confidence"]).alias("sure"), i.alias("i"), x.alias("e")))), F.lit(0))["e"]
    j = e.join(l.intent(df).withColumnRenamed("confidence", "intent_confidence"), "label", "left").join(l.operation(df).withColumnRenamed("confidence", "operation_confidence"), "label", "left")
    j = j.join(l.recurring(df).select("label", "recurring"), "label", "left")
    plain = F.regexp_replace(F.upper(F.trim("label")), r"\s+", " ")
    words = F.split(F.lower("label"), r"\s+")
    common = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
    mean = F.aggregate("entities", F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size("entities")
    return j.select(
        "label", best("TIERS")["normalized"].alias("party"), best("REFERENCE")["normalized"].alias("reference"), F.replace(best("MONTANT")["normalized"], F.lit(","), F.lit(".")).try_cast("double").alias("label_amount"),
        best("DATE")["value"].alias("date_text"), best("DATE")["normalized"].alias("period_ref"), F.get(of("LIEU"), F.lit(0))["normalized"].alias("place"), "intent", "operation", F.coalesce("recurring", F.lit(False)).alias("recurring"),
        F.length(F.trim("label")).alias("useful_length"), F.when(common(ENGLISH) > common(FRENCH), "EN").otherwise("FR").alias("language"),
        rounded(F.when(F.size("entities") > 0, mean).when(F.col("intent") != "STANDARD", 0.5).otherwise(0.3)).alias("label_confidence"), F.left(F.md5(plain), F.lit(12)).alias("label_hash"),
    )


def attach_labels(df: DataFrame) -> DataFrame:
    """Ledger lines with the features of their label, parsed once per distinct label."""
    return df.join(label_features(df), "label", "left")


def attach_to_anomalies(q: DataFrame, df: DataFrame) -> DataFrame:
    """Anomalies with the features of the commonest label of their family, the first in order of equals."""
    n = df.where("label IS NOT NULL").groupBy(F.col("prefix_3").alias("family"), "label").agg(F.count("*").alias("n"))
    first = n.withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "label"))).where("rn = 1").select("family", "label")
    return q.join(first.join(label_features(first), "label"), "family", "left")
