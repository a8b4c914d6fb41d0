"""Labels: suspicious keywords, coherence with the account, duplicates, intent."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import contains_any, first_of, matches_any, number, rounded, total
from folio.functions.tables import written

# Fixed values. A word begins at B: before it stands no letter, digit or underscore.
B, E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"

# Category, weight, patterns in normalized labels.
KEYWORDS = [
    ("error", 30, [f"{B}err(eur|or){E}", f"{B}mistake{E}", f"{B}wrong{E}", f"{B}faux{E}", f"{B}faute{E}"]),
    ("correction", 15, [f"{B}correct(ion|if)?{E}", f"{B}rectif", f"{B}modif", f"{B}amend", f"{B}fix{E}", f"{B}repair"]),
    ("adjustment", 15, [f"{B}ajust", f"{B}adjust", f"{B}regul", f"{B}régul", f"{B}redress", f"{B}reclass"]),
    ("override", 25, [f"{B}override{E}", f"{B}bypass{E}", f"{B}force{E}", f"{B}manuel", f"{B}manual{E}", f"{B}except"]),
    ("reversal", 20, [f"{B}revers", f"{B}extourne", f"{B}contre.?pass", f"{B}annul", f"{B}cancel", f"{B}storn"]),
    ("provision", 10, [f"{B}provision", f"{B}dotation", f"{B}reprise", f"{B}dep[ré]c", f"{B}amort"]),
    ("accrual", 10, [f"{B}fnp{E}", f"{B}fae{E}", f"{B}cca{E}", f"{B}pca{E}", f"{B}charge.?[àa].?payer", f"{B}produit.?[àa].?recevoir", f"{B}accru", f"{B}defer"]),
    ("suspicious_person", 20, [f"{B}ceo{E}", f"{B}cfo{E}", f"{B}dg{E}", f"{B}daf{E}", f"{B}direc", f"{B}chief{E}", f"{B}president"]),
    ("urgent", 15, [f"{B}urgent", f"{B}asap{E}", f"{B}vite{E}", f"{B}rapide", f"{B}immediat", f"{B}exception"]),
    ("round_description", 10, [f"{B}arrondi", f"{B}round", f"{B}solde", f"{B}apure", f"{B}écart", f"{B}diff[ée]rence"]),
]
# Words expected in labels of an account class.
EXPECTED = {
    "6": ["achat", "fourniture", "service", "charge", "frais", "honoraire"],
    "7": ["vente", "prestation", "produit", "chiffre", "revenu", "factur"],
    "4": ["client", "fournisseur", "tva", "social", "fiscal", "tiers"],
    "5": ["banque", "caisse", "virement", "cheque", "prelevement", "encaiss"],
}
# Intent | pattern in upper-case labels | weight.
INTENTS = [
    ("REGULARISATION", f"{B}REGUL", 1.0), ("REGULARISATION", f"{B}CORRECTION", 0.9), ("REGULARISATION", f"{B}CORRECTIF", 0.9), ("REGULARISATION", f"{B}AJUSTEMENT", 0.8),
    ("REGULARISATION", f"{B}RECTIFICATIF", 0.9), ("REGULARISATION", rf"{B}MISE\s*A\s*JOUR", 0.7), ("EXTOURNE", f"{B}EXTOURNE", 1.0), ("EXTOURNE", f"{B}ANNULATION", 0.95), ("EXTOURNE", f"{B}ANNULE", 0.9),
    ("EXTOURNE", f"{B}CONTREPASSATION", 1.0), ("EXTOURNE", f"{B}STORNO", 1.0), ("EXTOURNE", f"{B}ANNUL{E}", 0.85), ("PROVISION", f"{B}PROVISION", 1.0), ("PROVISION", f"{B}DOTATION", 0.9),
    ("PROVISION", rf"{B}REPRISE\s*(?:DE\s*)?PROVISION", 1.0), ("PROVISION", f"{B}DAP{E}", 0.85), ("PROVISION", f"{B}PROV{E}", 0.8), ("CLOTURE", f"{B}CLOTURE", 1.0), ("CLOTURE", f"{B}CLOT{E}", 0.8),
    ("CLOTURE", rf"{B}FIN\s*D[E']?\s*EXERCICE", 1.0), ("CLOTURE", rf"{B}AFFECTATION\s*RESULTAT", 0.95), ("CLOTURE", rf"{B}A\s*NOUVEAU", 0.9), ("CLOTURE", f"{B}OUVERTURE", 0.85), ("INTERCO", f"{B}INTERCO", 1.0),
    ("INTERCO", f"{B}INTER[- ]?COMPAGNIE", 1.0), ("INTERCO", f"{B}INTRA[- ]?GROUPE", 1.0), ("INTERCO", f"{B}GROUPE{E}(.*[^A-Z])?FACTURE", 0.8), ("INTERCO", f"{B}REFACTURATION", 0.85), ("INTERCO", rf"{B}MANAGEMENT\s*FEES?", 0.9),
    ("MANUEL", f"{B}MANUEL", 0.9), ("MANUEL", rf"{B}ECRITURE\s*MANUELLE", 1.0), ("MANUEL", rf"{B}SAISIE\s*MANUELLE", 1.0), ("AUTOMATIQUE", f"{B}AUTOMATIQUE", 0.9), ("AUTOMATIQUE", f"{B}AUTO{E}", 0.7),
    ("AUTOMATIQUE", f"{B}INTERFACE", 0.8), ("AUTOMATIQUE", f"{B}IMPORT", 0.75), ("AUTOMATIQUE", f"{B}BATCH", 0.8),
]

# Type of operation | pattern in upper-case labels | weight.
OPERATIONS = [
    ("ACHAT", f"{B}ACHAT", 1.0), ("ACHAT", f"{B}FOURNISSEUR", 0.9), ("ACHAT", rf"{B}FACTURE\s*(?:FOURNISSEUR|FOURN|FRN)", 1.0), ("ACHAT", rf"{B}FA\s*FRN", 0.95), ("ACHAT", f"{B}APPRO", 0.8), ("ACHAT", f"{B}COMMANDE", 0.7),
    ("VENTE", f"{B}VENTE", 1.0), ("VENTE", f"{B}CLIENT", 0.9), ("VENTE", rf"{B}FACTURE\s*(?:CLIENT|CLI)", 1.0), ("VENTE", rf"{B}FA\s*CLI", 0.95), ("VENTE", f"{B}CA{E}", 0.7), ("VENTE", rf"{B}CHIFFRE\s*D['E]?\s*AFFAIRE", 0.95),
    ("PROVISION", f"{B}PROVISION", 1.0), ("PROVISION", f"{B}DOTATION", 0.95), ("PROVISION", f"{B}REPRISE", 0.85), ("PROVISION", f"{B}DAP{E}", 0.9), ("PROVISION", f"{B}DEPRECIATION", 0.9),
    ("DOTATION", f"{B}DOTATION", 1.0), ("DOTATION", f"{B}AMORTISSEMENT", 0.95), ("DOTATION", f"{B}DAP{E}", 0.9), ("DOTATION", f"{B}DAMO", 0.9), ("REPRISE", f"{B}REPRISE", 1.0), ("REPRISE", f"{B}RAP{E}", 0.85),
    ("SALAIRE", f"{B}SALAIRE", 1.0), ("SALAIRE", f"{B}PAIE{E}", 0.95), ("SALAIRE", f"{B}PAYE{E}", 0.95), ("SALAIRE", f"{B}REMUNERATION", 0.9), ("SALAIRE", rf"{B}CHARGES?\s*SOCIALES?", 0.85), ("SALAIRE", f"{B}URSSAF", 0.9), ("SALAIRE", f"{B}COTISATION", 0.8),
    ("CHARGE_FIXE", f"{B}LOYER", 1.0), ("CHARGE_FIXE", f"{B}ABONNEMENT", 0.95), ("CHARGE_FIXE", f"{B}ASSURANCE", 0.85), ("CHARGE_FIXE", f"{B}LEASING", 0.9), ("CHARGE_FIXE", f"{B}LOCATION", 0.85), ("CHARGE_FIXE", f"{B}MAINTENANCE", 0.8), ("CHARGE_FIXE", f"{B}ENTRETIEN", 0.75),
    ("INVESTISSEMENT", f"{B}INVESTISSEMENT", 1.0), ("INVESTISSEMENT", f"{B}IMMOBILISATION", 0.95), ("INVESTISSEMENT", f"{B}IMMO{E}", 0.8), ("INVESTISSEMENT", f"{B}ACQUISITION", 0.85), ("INVESTISSEMENT", f"{B}CAPEX", 0.9),
    ("CESSION", f"{B}CESSION", 1.0), ("CESSION", rf"{B}SORTIE\s*D['E]?\s*IMMO", 0.95), ("CESSION", rf"{B}VENTE\s*D['E]?\s*IMMO", 0.95), ("CESSION", f"{B}PLUS[- ]?VALUE", 0.85), ("CESSION", f"{B}MOINS[- ]?VALUE", 0.85),
    ("REGULARISATION", f"{B}REGULARISATION", 1.0), ("REGULARISATION", f"{B}REGUL{E}", 0.9), ("REGULARISATION", f"{B}AJUSTEMENT", 0.85), ("EXTOURNE", f"{B}EXTOURNE", 1.0), ("EXTOURNE", f"{B}CONTREPASSATION", 1.0), ("EXTOURNE", f"{B}ANNULATION", 0.9),
    ("VIREMENT", f"{B}VIREMENT", 1.0), ("VIREMENT", f"{B}TRANSFERT", 0.85), ("VIREMENT", f"{B}VIR{E}", 0.8),
]
# Pattern of recurring operations in upper-case labels | weight.
RECURRING = [
    (f"{B}MENSUEL", 1.0), (f"{B}LOYER", 0.9), (f"{B}ABONNEMENT", 0.9), (rf"{B}PRELEVEMENT\s*AUTO", 0.85),
    (f"{B}JANVIER|FEVRIER|MARS|AVRIL|MAI|JUIN|JUILLET|AOUT|SEPTEMBRE|OCTOBRE|NOVEMBRE|DECEMBRE", 0.7), (rf"{B}MOIS\s*DE", 0.75), (f"{B}CONTRAT", 0.7), (f"{B}REDEVANCE", 0.85),
]


def normalized(label: Column) -> Column:
    """Lower case; letters (French accents included), digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-zàâäéèêëïîôùûüç0-9\s]", " "), r"\s+", " "))


def keyword_score(df: DataFrame) -> DataFrame:
    """(label, categories, keyword_score): once per distinct label; weights of the categories found, 100 at most."""
    text = normalized(F.col("label"))
    labels = df.select("label").distinct().withColumn("t", text)
    found = labels.withColumns({c: matches_any(F.col("t"), ps) for c, _, ps in KEYWORDS})
    score = reduce(lambda a, b: a + b, [F.when(F.col(c), w).otherwise(0) for c, w, _ in KEYWORDS])
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c, _, _ in KEYWORDS])), ",")
    return found.select("label", names.alias("categories"), F.least(score, F.lit(100)).alias("keyword_score"))


def keyword_stats(df: DataFrame) -> DataFrame:
    """Lines per category and their share in per cent."""
    rows = df.groupBy("label").agg(F.count("*").alias("n")).join(keyword_score(df), "label", "left")
    every = df.agg(F.count("*").alias("all"))
    flat = rows.select("n", F.explode(F.split("categories", ",")).alias("category")).where("category != ''")
    return flat.groupBy("category").agg(F.sum("n").alias("lines")).crossJoin(every).select("category", "lines", rounded(F.col("lines") / F.col("all") * 100).alias("pct"))


def coherence(df: DataFrame) -> DataFrame:
    """(account, label, coherent): whether the label has a word expected for the account's class; other classes always."""
    text, head = normalized(F.col("label")), F.substring("account", 1, 1)
    pairs = df.select("account", "label").distinct()
    ok = first_of([(head == c, contains_any(text, ws)) for c, ws in EXPECTED.items()], True)
    return pairs.withColumn("coherent", ok)


def nlp_risk(df: DataFrame, least: float = 30.0) -> DataFrame:
    """Account and label pairs with a risk of at least least: half of the keyword score, 20 when
    incoherent, 10 when the label is over two deviations longer than the mean."""
    size = F.length("label")
    stats = df.agg(F.avg(size).alias("mean"), F.stddev_samp(size).alias("std"))
    rows = coherence(df).join(keyword_score(df), "label", "left").crossJoin(F.broadcast(stats))
    long_ = (size - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0) > 2
    risk = F.least(0.5 * F.col("keyword_score") + F.when(F.col("coherent"), 0).otherwise(20) + F.when(long_, 10).otherwise(0), F.lit(100.0))
    return rows.select("account", "label", "keyword_score", "coherent", rounded(risk).alias("risk")).where(F.col("risk") >= least)


def duplicate_labels(df: DataFrame, least: int = 5, amount: float = 1000) -> DataFrame:
    """Normalized labels with many lines and a net of at least amount."""
    g = df.groupBy("label").agg(F.count("*").alias("n"), F.sum("amount").alias("a")).withColumn("norm", normalized(F.col("label")))
    sums = g.groupBy("norm").agg(F.min("label").alias("example"), F.sum("n").alias("lines"), total(F.col("a")).alias("net"))
    return sums.where((F.col("lines") >= least) & (F.abs("net") >= amount)).withColumn("mean", rounded(number(F.col("net")) / F.col("lines"), 6))


def _heaviest(df: DataFrame, table: list, name: str, default: str) -> DataFrame:
    up = F.upper(F.col("label"))
    best: dict[str, Column] = {}
    for kind, pattern, weight in table:
        hit = F.when(up.rlike(pattern), weight).otherwise(0.0)
        best[kind] = F.greatest(best[kind], hit) if kind in best else hit
    labels = df.select("label").distinct().withColumns({f"i_{k}": v for k, v in best.items()})
    top = F.greatest(*[F.col(f"i_{k}") for k in best])
    found = first_of([(F.col(f"i_{k}") == top, k) for k in best])
    return labels.select("label", F.when(top >= 0.5, found).otherwise(default).alias(name), rounded(F.when(top >= 0.5, top).otherwise(0.5)).alias("confidence"))


def intent(df: DataFrame) -> DataFrame:
    """(label, intent, confidence): the intent of the heaviest pattern found (the first in order on ties); STANDARD below 0.5."""
    return _heaviest(df, INTENTS, "intent", "STANDARD")


def operation(df: DataFrame) -> DataFrame:
    """(label, operation, confidence): likewise for the type of operation; INCONNU below 0.5."""
    return _heaviest(df, OPERATIONS, "operation", "INCONNU")


def recurring(df: DataFrame) -> DataFrame:
    """(label, recurring, weight): mean weight of the patterns found at 0.7 or more, or two of them."""
    up = F.upper(F.col("label"))
    hits = [up.rlike(p) for p, _ in RECURRING]
    n = reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
    mean = F.coalesce(F.try_divide(reduce(lambda a, b: a + b, [F.when(h, w).otherwise(0.0) for h, (_, w) in zip(hits, RECURRING)]), n), F.lit(0.0))
    return df.select("label").distinct().select("label", ((mean >= 0.7) | (n >= 2)).alias("recurring"), rounded(mean).alias("weight"))


def piece_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each piece of k characters of the texts."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    n = max(0, len(chars) - k + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ chars[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = left[:n] >= k
    return row[:n][whole], h[whole]


#: Bits of the table that tells pieces no name is looked up by, whatever the number of names.
TABLE_BITS = 24


def known_parties(df: DataFrame, n: int = 8) -> DataFrame:
    """(label, third_party): third parties of the ledger whose name is contained in a label, upper case.

    Each name is looked up by the piece of n characters that fewest names have (shorter
    names by themselves) among the label's pieces, then compared whole, so labels and names
    meet in an equality join, also where most names begin alike. Of a label only those pieces
    move whose hash is in a bit table of all names' pieces.
    """
    up = F.col("up")
    parties = df.where("third_party != ''").select("third_party").distinct().withColumn("up", F.upper("third_party"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(up) - n + 1, F.lit(1))), lambda i: F.substring(up, i, F.lit(n))))
    of = parties.select("third_party", "up", F.explode(pieces).alias("piece"))
    count = of.groupBy("piece").agg(F.count("*").alias("names"))
    rarest = of.join(count, "piece").groupBy("third_party", "up").agg(F.min_by("piece", F.struct("names", "piece")).alias("piece"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [piece_hashes([t], len(t))[1][0] for t in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(["third_party", "up"]).columns, pa.array(np.array(h, np.uint64).view(np.int64))], ["third_party", "up", "h"])

    names = written(rarest.mapInArrow(hashed, "third_party string, up string, h long"), "names")
    place = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    # 2 MB at most
    words = names.select(F.shiftright(place, 5).alias("w"), F.pmod(place, F.lit(32)).cast("int").alias("b")).distinct().groupBy("w").agg(F.sum(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    table = np.zeros(1 << TABLE_BITS - 5, np.int64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    # at most n lengths
    sizes = sorted(r[0] for r in parties.select(F.least(F.length("up"), F.lit(n))).distinct().collect())
    shared = df.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            for k in sizes:
                row, h = piece_hashes(texts, k)
                at = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                met = (shared.value[at >> 5] >> (at & 31)) & 1 > 0
                pairs = np.unique(np.stack([row[met], h[met].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("label").take(pa.array(pairs[0])), pa.array(pairs[1])], ["label", "h"])

    labels = df.select("label").where("label IS NOT NULL").distinct().select("label", F.upper("label").alias("t"))
    # a label has a hash once for each length and a name has one, so no pair comes twice
    return labels.mapInArrow(cut, "label string, h long").join(names, "h").where(F.upper("label").contains(up)).select("label", "third_party")
