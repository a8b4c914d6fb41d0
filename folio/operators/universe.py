"""Semantic universe of (account, site) couples: masked labels, features, and the rules that classify them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import first_of, number, ratio, rounded
from folio.functions.tables import written
from folio.operators.crystallinity import ASSET_PATTERNS, COUPLE, UNIVERSE_ROWS, _entropy, regularity
from folio.operators.graph import opposed, sides

# Words of bookkeeping that are no names.
VOCABULARY = (
    "LOYER", "SALAIRE", "FACTURE", "AVOIR", "REGUL", "REGULARISATION", "PROVISION", "AMORTISSEMENT", "DOTATION", "REPRISE", "VIREMENT", "PRELEVEMENT",
    "CHEQUE", "CARTE", "CB", "ABONNEMENT", "ASSURANCE", "HONORAIRES", "COTISATION", "ACHAT", "VENTE", "PRESTATION", "SERVICE", "JANVIER", "FEVRIER",
    "MARS", "AVRIL", "MAI", "JUIN", "JUILLET", "AOUT", "SEPTEMBRE", "OCTOBRE", "NOVEMBRE", "DECEMBRE", "JAN", "FEV", "MAR", "AVR", "JUI", "JUL",
    "AOU", "SEP", "OCT", "NOV", "DEC", "REF", "NUM", "FAC", "BL", "OD", "AN", "EX", "URSSAF", "RSI", "CPAM", "CAF", "MSA", "TRESOR", "IMPOT", "TVA",
    "SOLDE", "REPORT", "EXTOURNE", "CONTREPASSATION", "ABT", "CCA", "PCA",
)
# Pattern in an upper-case label | mask, in this order.
MASKS = [
    (r"\b(M\.|MME|MR|MRS|FAM\.?|FAMILLE)\s+[A-Z][A-Za-zÀ-ÿ\-]+", "[NOM_PROPRE]"), (r"\b[A-Z][a-zà-ÿ]+(?:\s+[A-Z][a-zà-ÿ]+)*\b", "[NOM_PROPRE]"),
    (r"\b\d{4,}\b", "[REF_NUM]"), (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[DATE]"),
]
ENTITY, ENTITY_OVER, NAME_OVER = "[ENTITE]", 4, 3
UNIVERSES = [row[0] for row in UNIVERSE_ROWS]
LOW_CONFIDENCE, LEAST_ENTRIES = 0.5, 3


def words_of(label: Column) -> Column:
    return F.filter(F.split(F.upper(label), r"\s+"), lambda w: w != "")


def bare(word: Column) -> Column:
    """A word without all but letters, digits and underscores."""
    return F.regexp_replace(word, r"[^\p{L}\p{N}_]", "")


def mask_label(label: Column) -> Column:
    """The label in upper case; names, numbers, dates and unknown words in capitals become masks."""
    text = F.upper(label)
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(mask))
    unknown = lambda w: (F.length(bare(w)) > ENTITY_OVER) & (bare(w) != F.lower(bare(w))) & ~bare(w).isin(*VOCABULARY)
    masked = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.when(unknown(w), ENTITY).otherwise(w))
    return F.when(F.coalesce(label, F.lit("")) == "", "").otherwise(F.array_join(masked, " "))


def names_in(label: Column) -> Column:
    """Words that may be names: over 3 characters and not of the vocabulary, in labels with a capitalised word."""
    hit = lambda w: (F.length(bare(w)) > NAME_OVER) & ~bare(w).isin(*VOCABULARY)
    return F.when(label.rlike("[A-Z][a-z]"), F.size(F.filter(words_of(label), hit))).otherwise(0)


def label_counts(df: DataFrame) -> DataFrame:
    """(account, site, label, n, masked, names, words, asset): each label of a couple once."""
    counts = df.where("label IS NOT NULL AND label != ''").groupBy(*COUPLE, "label").agg(F.count("*").alias("n"))
    label = F.col("label")
    return counts.select("*", mask_label(label).alias("masked"), names_in(label).alias("names"), F.size(words_of(label)).alias("words"), F.upper(label).rlike("|".join(ASSET_PATTERNS)).cast("int").alias("asset"))


def entropies(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Entropy of labels as they are and masked, and the distinct labels, by couple. counts: label_counts() of df, if there already."""
    c = label_counts(df) if counts is None else counts
    raw = _entropy(c, COUPLE).select(*COUPLE, rounded(F.col("h")).alias("entropy"), F.col("k").alias("labels"))
    masked = _entropy(c.groupBy(*COUPLE, "masked").agg(F.sum("n").alias("n")), COUPLE).select(*COUPLE, rounded(F.col("h")).alias("entropy_masked"))
    return raw.join(masked, COUPLE)


def ratios(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Shares of name-like words and of labels that refer to assets, and of amounts met twice or more, by couple. counts: label_counts() of df, if there already."""
    c = (label_counts(df) if counts is None else counts).groupBy(*COUPLE).agg(F.sum(F.col("names") * F.col("n")).alias("names"), F.sum(F.col("words") * F.col("n")).alias("words"), F.sum(F.col("asset") * F.col("n")).alias("assets"), F.sum("n").alias("labelled"))
    m = df.groupBy(*COUPLE, F.abs("amount").alias("v")).agg(F.count("*").alias("n"))
    m = m.groupBy(*COUPLE).agg(F.sum("n").alias("lines"), F.sum(F.when((F.col("n") >= 2) & (F.col("v") > 0), F.col("n")).otherwise(0)).alias("twice"))
    return m.join(c, COUPLE, "left").select(
        *COUPLE, rounded(ratio(F.col("names"), F.col("words"))).alias("name_ratio"), rounded(ratio(F.col("assets"), F.col("labelled"))).alias("asset_ratio"),
        rounded(F.when(F.col("lines") >= 2, F.col("twice") / F.col("lines")).otherwise(0.0)).alias("mirror_ratio"),
    )


def counterparties(df: DataFrame) -> DataFrame:
    """Number of distinct opposite accounts in the vouchers of a couple's lines."""
    return opposed(sides(df, "site")).groupBy(*COUPLE, "other").agg(F.lit(1).alias("one")).groupBy(*COUPLE).agg(F.count("*").alias("counterparties"))


def couple_features(df: DataFrame) -> DataFrame:
    """One row of features per couple."""
    a = F.abs(number(F.col("amount")))
    # masked once
    labels = written(label_counts(df), "labels")
    base = df.groupBy(*COUPLE, "journal").agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("v"))
    base = base.groupBy(*COUPLE).agg(F.sum("n").alias("entries"), F.sum("v").cast("double").alias("volume"), F.count("journal").alias("journals"))
    spread = df.groupBy(*COUPLE).agg(F.avg(a).alias("mean"), F.stddev_pop(a).alias("sd"))
    j = base.join(spread, COUPLE).join(regularity(df), COUPLE).join(ratios(df, labels), COUPLE).join(entropies(df, labels), COUPLE, "left").join(counterparties(df), COUPLE, "left")
    zero = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return j.select(
        *COUPLE, F.substring("account", 1, 1).alias("class"), F.substring("account", 1, 3).alias("family"), "entries", rounded(F.col("volume"), 2).alias("volume"), zero("entropy", 0.0).alias("entropy"),
        zero("entropy_masked", 0.0).alias("entropy_masked"), rounded(zero("entropy", 0.0) - zero("entropy_masked", 0.0)).alias("entropy_drop"), "journals", zero("counterparties", 0).alias("counterparties"),
        zero("labels", 0).alias("labels"), rounded(ratio(F.col("sd"), F.col("mean"))).alias("cv"), rounded(F.col("mean"), 2).alias("mean"), "months", "regularity", "mirror_ratio", "name_ratio", "asset_ratio",
    )


# Universe | confidence as SQL | rule | condition as SQL over couple_features, the first that holds counts.
RULES = [
    ("INVENTAIRE", "least(0.95, 0.7 + asset_ratio)", "asset references", "family IN ('681', '686', '687', '281', '291', '391') AND asset_ratio > 0.3"),
    ("INVENTAIRE", "0.9", "regular allowances", "family IN ('681', '686', '687') AND regularity > 0.85 AND cv < 0.1"),
    ("VENTILATION", "least(0.95, 0.6 + mirror_ratio)", "mirror entries", "mirror_ratio > 0.3"),
    ("VENTILATION", "0.85", "transfer of charges", "family = '791'"),
    ("CRISTALLIN", "0.95", "stable amounts and labels", "entropy < 2.0 AND cv < 0.15 AND regularity > 0.75"),
    ("CRISTALLIN", "0.9", "regular rent", "family = '613' AND cv < 0.2 AND regularity > 0.7"),
    ("CRISTALLIN", "0.85", "regular subscription", "family = '626' AND cv < 0.25 AND journals <= 2"),
    ("NOMINATIF", "least(0.95, 0.5 + entropy_drop / 5)", "entropy falls without names", "entropy_drop > 2.0"),
    ("NOMINATIF", "least(0.9, 0.5 + name_ratio)", "names in labels", "name_ratio > 0.35"),
    ("NOMINATIF", "0.85", "invoices by customer", "family IN ('706', '707') AND labels > 20 AND regularity > 0.5"),
    ("NOMINATIF", "0.9", "payroll by employee", "family = '641' AND labels > 5"),
    ("COMPOSITE", "0.85", "many sources", "journals >= 3 AND counterparties >= 4 AND entropy_masked > 3.0"),
    ("COMPOSITE", "0.75", "residual entropy", "entropy_masked > 3.5 AND cv > 0.5 AND journals >= 2"),
    ("COMPOSITE", "0.7", "suspense account", "family IN ('471', '618') AND (entropy_masked > 2.5 OR counterparties > 3)"),
]
UNCLASSIFIED = ("NON_CLASSE", "0.3", "no clear profile")


def universe(features: DataFrame) -> DataFrame:
    """features with universe, confidence and reason (the rule that decided)."""
    pick = lambda i, default: first_of([(F.expr(rule[3]), F.expr(rule[1]).cast("double") if i == 1 else rule[i]) for rule in RULES], default)
    return features.withColumns({"universe": pick(0, UNCLASSIFIED[0]), "confidence": rounded(pick(1, float(UNCLASSIFIED[1]))), "reason": pick(2, UNCLASSIFIED[2])})


def classify_couples(df: DataFrame, least: int = LEAST_ENTRIES) -> DataFrame:
    """Couples with least entries or more and their universe."""
    return universe(couple_features(df).where(F.col("entries") >= least))


def universe_summary(couples: DataFrame) -> DataFrame:
    """Couples, entries, volume, their shares and the mean confidence of each universe, empty ones included."""
    dim = couples.sparkSession.createDataFrame([(u,) for u in UNIVERSES], "universe string")
    g = couples.groupBy("universe").agg(F.count("*").alias("couples"), F.sum("entries").alias("entries"), F.sum("volume").alias("volume"), F.avg("confidence").alias("confidence"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("unsure"))
    all_ = couples.agg(F.count("*").alias("c"), F.sum("entries").alias("e"), F.sum("volume").alias("v"))
    j = dim.join(g, "universe", "left").crossJoin(all_)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "universe", zero("couples").alias("couples"), rounded(ratio(zero("couples"), F.col("c"))).alias("couples_share"), zero("entries").alias("entries"), rounded(ratio(zero("entries"), F.col("e"))).alias("entries_share"),
        rounded(zero("volume"), 2).alias("volume"), rounded(ratio(zero("volume"), F.col("v"))).alias("volume_share"), rounded(zero("confidence")).alias("confidence"), zero("unsure").alias("unsure"),
    )


def unsure(couples: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    """Couples whose universe is doubtful."""
    return couples.where(F.col("confidence") < below)
