"""Audit questions: from anomalies and provisions, from drill-down patterns, and the sheet that resolves them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import first_of, number, rounded
from folio.functions.tables import written
from folio.operators import detect, drill

# Kind of question | base priority | question; {0} account, {1} amount, {2} month, {3} per cent.
KINDS = [
    ("provision_excessive", 1, "Quelle est la justification du niveau de provision de {1}€ sur le compte {0} ?"),
    ("variation_inexpliquee", 1, "Comment expliquez-vous la variation de {1}€ ({3}%) sur le compte {0} ?"),
    ("concentration", 2, "Pourquoi {3}% des charges du compte {0} sont-elles concentrées sur le mois de {2} ?"),
    ("journal_od", 2, "Quelle est la nature de l'écriture OD de {1}€ sur le compte {0} ?"),
    ("libelle_suspect", 2, "Pouvez-vous clarifier l'écriture de {1}€ sur le compte {0} ?"),
    ("provision_insuffisante", 2, "Le compte {0} semble sous-provisionné. Y a-t-il un risque non couvert ?"),
    ("zscore_eleve", 2, "Le mois de {2} présente un écart statistique significatif sur le compte {0}. Quelle en est la raison ?"),
    ("montant_rond", 3, "Le montant rond de {1}€ sur le compte {0} correspond-il à une estimation ou un calcul réel ?"),
    ("benford_anomaly", 3, "La distribution des montants du compte {0} présente des anomalies. Les montants sont-ils naturels ?"),
    ("pattern_regul", 3, "L'écriture de régularisation de {1}€ est-elle justifiée ?"),
]
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
LARGE, SMALL = 100_000, 5_000
OPEN = "À traiter"


def question_kind(nature: Column, source: Column, journal: Column, variation: Column) -> Column:
    """Kind of question for an anomaly, by words in its nature and source, the first that fits."""
    n, s = F.lower(F.coalesce(nature, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    return first_of(
        [
            (n.contains("concentration") | s.contains("concentration"), "concentration"), (s.contains("zscore") | n.contains("z-score"), "zscore_eleve"), (s.contains("benford"), "benford_anomaly"),
            (s.contains("od") | (F.upper(F.coalesce(journal, F.lit(""))) == "OD"), "journal_od"), (s.contains("libelle") | s.contains("keyword"), "libelle_suspect"), (n.contains("rond"), "montant_rond"),
            (n.contains("regul") | s.contains("pattern"), "pattern_regul"), (F.coalesce(variation, F.lit(0)) != 0, "variation_inexpliquee"),
        ],
        "concentration",
    )


def _worded(rows: DataFrame) -> DataFrame:
    """rows (account, kind, amount, month, pct) with priority and question."""
    dim = F.broadcast(rows.sparkSession.createDataFrame(KINDS, "kind string, base int, template string"))
    size = F.abs("amount")
    priority = F.when(size > LARGE, F.greatest(F.lit(1), F.col("base") - 1)).when(size < SMALL, F.least(F.lit(3), F.col("base") + 1)).otherwise(F.col("base"))
    month = F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), F.col("month") - 1), F.lit(""))
    text = F.col("template")
    for i, value in enumerate((F.col("account"), F.format_string("%,d", F.round(size).cast("long")), month, F.coalesce(F.round("pct").cast("long"), F.lit(0)).cast("string"))):
        text = F.replace(text, F.lit(f"{{{i}}}"), value)
    return rows.join(dim, "kind").select("account", "kind", "amount", "month", priority.alias("priority"), text.alias("question"))


def questions(anomalies: DataFrame, provisions: DataFrame) -> DataFrame:
    """One question per anomaly and provision: id, kind, account, amount, month, priority, text; by priority, then amount.

    anomalies: (account, nature, source, journal, amount, month, pct, variation). provisions:
    (account, gap): what December has above the run rate, or below it.
    """
    kind = question_kind(F.col("nature"), F.col("source"), F.col("journal"), F.col("variation"))
    a = anomalies.select("account", kind.alias("kind"), number(F.col("amount")).alias("amount"), F.col("month").cast("int").alias("month"), number(F.col("pct")).alias("pct"))
    gap = number(F.col("gap"))
    p = provisions.select("account", F.when(gap > 0, "provision_excessive").otherwise("provision_insuffisante").alias("kind"), gap.alias("amount"), F.lit(12).alias("month"), F.lit(None).cast("double").alias("pct"))
    # numbered within an account, so that no window holds all questions
    order = Window.partitionBy("account").orderBy("priority", F.desc(F.abs("amount")), "kind", F.coalesce("month", F.lit(0)), "question")
    q = _worded(a.unionByName(p)).withColumn("n", F.row_number().over(order))
    code = F.concat_ws("-", F.upper(F.left("kind", F.lit(3))), F.col("account"), F.lpad(F.col("n").cast("string"), 3, "0"))
    return q.select(code.alias("id"), "kind", "account", "amount", "month", "priority", "question")


# Kind of question | context | documents expected. {a} account, {l} its label, {m} amount, {t} month, {g} mean, {r} run rate,
# {x} expected, {v} variation, {b} before, {n} now, {z} z-score, {e} label of the entry, {p} pattern.
CONTEXTS = [
    ("concentration", "Le compte {a} ({l}) présente une concentration anormale: {m}€ sur {t} vs {g}€/mois en moyenne.", ["Justification économique de cette concentration", "Factures ou pièces justificatives", "Confirmation que ce n'est pas une provision annuelle non lissée"]),
    ("provision_excessive", "Le compte {a} ({l}) présente une dotation significativement supérieure au run rate: {m}€ vs run rate de {r}€.", ["Base de calcul de la provision", "Risque ou charge sous-jacent", "Date de reprise prévue", "Historique des mouvements sur ce compte"]),
    ("provision_insuffisante", "Le compte {a} ({l}) montre un niveau de provision inférieur à l'historique: {m}€ vs {x}€ attendu.", ["Confirmation de l'absence de risque additionnel", "Explication de la baisse de provisionnement", "Éléments justifiant le nouveau niveau"]),
    ("variation_inexpliquee", "Le compte {a} ({l}) varie de {b}€ (N-1) à {n}€ (N), soit {v}€.", ["Événement business justifiant cette variation", "Changement de méthode comptable", "Reclassement depuis/vers un autre compte", "Détail des principales écritures"]),
    ("montant_rond", "Une écriture de {m}€ (montant rond) a été passée sur le compte {a} ({l}) en {t}.", ["Base de calcul du montant", "Pièce justificative ou méthode d'estimation", "Confirmation qu'il ne s'agit pas d'un ajustement arbitraire"]),
    ("journal_od", "Une écriture sur journal OD de {m}€ a été passée sur {a} ({l}). Libellé: '{e}'.", ["Nature et justification de l'écriture", "Validation hiérarchique", "Pièce justificative", "Impact sur le run rate"]),
    ("libelle_suspect", "Le libellé '{e}' contient des termes nécessitant clarification (erreur, correction, ajustement, etc.).", ["Explication de l'opération", "Raison de la correction/ajustement", "Validation de la régularisation"]),
    ("zscore_eleve", "Le compte {a} ({l}) a un z-score de {z} en {t}: {m}€ vs moyenne de {g}€.", ["Événement exceptionnel justifiant cet écart", "Détail des principales écritures du mois", "Confirmation du caractère non récurrent"]),
    ("benford_anomaly", "L'analyse Benford révèle une sur-représentation de certains chiffres sur le compte {a}. Cela peut indiquer des montants estimés ou fabriqués.", ["Origine des montants (factures réelles vs estimations)", "Explication de la distribution observée", "Pièces justificatives pour les montants significatifs"]),
    ("pattern_regul", "Une écriture identifiée comme régularisation ({p}) a été passée sur {a} ({l}).", ["Nature de la régularisation", "Base de calcul", "Validation du cut-off"]),
]
#: Columns of the facts about a question, by their marks: amounts, then texts.
FACT_AMOUNTS = {"m": "amount", "g": "mean", "r": "run_rate", "x": "expected", "b": "before", "n": "now"}
FACT_TEXTS = {"l": "account_label", "e": "entry_label", "p": "pattern"}
LONGEST_LABEL = 50


def question_contexts(facts: DataFrame) -> DataFrame:
    """(account, kind, month, context, documents) of each row of facts about a question.

    facts: (account, kind, month) and any of amount, mean, run_rate, expected, variation, before,
    now, zscore, account_label, entry_label, pattern; what is missing or null counts as 0 or
    empty. The amount is shown without its sign, the entry's label up to 50 characters.
    """
    dim = F.broadcast(facts.sparkSession.createDataFrame(CONTEXTS, "kind string, template string, documents array<string>"))
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in facts.columns else F.lit(default)
    figure = lambda c: F.format_string("%,d", F.round(number(has(c, 0.0))).cast("long"))
    month = F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), F.col("month") - 1), F.lit(""))
    said = {"a": F.coalesce("account", F.lit("")), "t": month, **{m: figure(c) for m, c in FACT_AMOUNTS.items()}, **{m: F.left(has(c, ""), F.lit(LONGEST_LABEL)) if m == "e" else has(c, "") for m, c in FACT_TEXTS.items()}}
    said["m"] = F.format_string("%,d", F.round(F.abs(number(has("amount", 0.0)))).cast("long"))
    said["v"] = F.format_string("%+,d", F.round(number(has("variation", 0.0))).cast("long"))
    said["z"] = F.format_string("%+.1f", rounded(number(has("zscore", 0.0)), 1))
    text = F.col("template")
    for mark, value in said.items():
        text = F.replace(text, F.lit(f"{{{mark}}}"), value)
    return facts.join(dim, "kind").select("account", "kind", "month", text.alias("context"), "documents")


def resolution_sheet(q: DataFrame) -> DataFrame:
    """One open point per question."""
    return q.withColumn("status", F.lit(OPEN))


def resolution_summary(q: DataFrame) -> DataFrame:
    """One row: points by priority, and the amount that they concern."""
    return q.agg(F.count("*").alias("points"), *[F.count_if(F.col("priority") == i).alias(f"priority_{i}") for i in (1, 2, 3)], rounded(F.coalesce(F.sum(F.abs("amount")), F.lit(0.0)), 2).alias("amount"))


# Pattern | place of the question | kind of drill-down.
DRILLS = [
    ("year_end_spike", 0, "detail_view"), ("year_end_spike", 1, "trend_analysis"), ("year_end_spike", 2, "counterparty"), ("concentration", 0, "breakdown"), ("concentration", 1, "trend_analysis"),
    ("concentration", 2, "comparison"), ("social_to_salaries", 0, "breakdown"), ("social_to_salaries", 1, "detail_view"), ("purchases_to_sales", 0, "trend_analysis"), ("purchases_to_sales", 1, "breakdown"),
    ("round_number", 0, "detail_view"), ("round_number", 1, "breakdown"), ("duplicate_amount", 0, "detail_view"), ("duplicate_amount", 1, "counterparty"),
]
BASE = {"CRITICAL": 1, "HIGH": 3, "MEDIUM": 5, "LOW": 7}
LOW_SOCIAL = 0.40


def patterns(df: DataFrame, year: int) -> DataFrame:
    """(pattern, subject, amount, value, severity, whole) of all patterns found: spikes, concentrations, ratios, round and repeated amounts.

    whole is what the amount is held against: the mean of other months, the class's volume, a ratio's denominator.
    """
    no, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    spikes = detect.year_end_spikes(df, year).select(
        F.lit("year_end_spike").alias("pattern"), F.col("account").alias("subject"), number(F.col("december")).alias("amount"), number(F.col("ratio")).alias("value"), "severity", number(F.col("monthly_mean")).alias("whole")
    )
    dense = detect.class_concentration(df, year).where("found").select(F.lit("concentration"), "account", number(F.col("volume")), number(F.col("pct")), "severity", number(F.col("class_volume")))
    odd = detect.ratio_anomalies(df, year).where("found").select("ratio", no, number(F.col("numerator")), number(F.col("value")), F.lit("HIGH"), number(F.col("denominator")))
    round_ = detect.round_numbers(df, year).select(F.lit("round_number"), F.col("value").cast("string"), number(F.col("value") * F.col("lines")), number(F.col("lines")), F.lit("MEDIUM"), none)
    twice = detect.duplicate_amounts(df, year).select(F.lit("duplicate_amount"), F.col("value").cast("string"), number(F.col("value")), number(F.col("lines")), F.lit("MEDIUM"), none)
    return reduce(DataFrame.union, [spikes, dense, odd, round_, twice])


def drill_questions(found: DataFrame, most: int | None = None) -> DataFrame:
    """Questions of each pattern with the kind of drill-down that answers it and a priority from 1 to 10; the first most."""
    dim = F.broadcast(found.sparkSession.createDataFrame(DRILLS, "pattern string, place int, drill string"))
    base = first_of([(F.col("severity") == s, b) for s, b in BASE.items()], 5)
    asked = found.join(dim, "pattern").where(~((F.col("pattern") == "social_to_salaries") & (F.col("place") == 1) & (F.col("value") >= LOW_SOCIAL)))
    q = asked.select("pattern", "subject", "drill", "place", rounded(F.col("amount"), 2).alias("amount"), rounded(F.col("value")).alias("value"), "severity", F.least(F.lit(10), base + F.col("place")).alias("priority"))
    return q.orderBy("priority", F.desc("amount"), "pattern", "subject", "place").limit(most) if most else q


#: Patterns whose subject is an account.
OF_ACCOUNTS = ("year_end_spike", "concentration")


def execute(df: DataFrame, found: DataFrame, year: int, most: int = 5) -> DataFrame:
    """drill.answers() to the first most questions of the patterns, numbered Q001 and so on in their order."""
    order = Window.orderBy("priority", F.desc("amount"), "pattern", "subject", "place")
    # no more rows than most
    first = drill_questions(found, most).withColumn("n", F.row_number().over(order))
    asked = first.select(F.format_string("Q%03d", "n").alias("question"), "drill", F.when(F.col("pattern").isin(*OF_ACCOUNTS), F.col("subject")).alias("account"), F.lit(year).alias("year"))
    return drill.answers(df, written(asked, "asked"))


# Two-digit prefix | kind of account.
ACCOUNT_KINDS = [
    ("60", "Achats (marchandises, MP, approvisionnements)"), ("61", "Services extérieurs (sous-traitance, locations)"), ("62", "Autres services (honoraires, publicité, transports)"), ("63", "Impôts et taxes"),
    ("64", "Charges de personnel (salaires, charges sociales)"), ("65", "Autres charges de gestion courante"), ("66", "Charges financières (intérêts)"), ("67", "Charges exceptionnelles"),
    ("68", "Dotations aux amortissements et provisions"), ("69", "Participation et impôts sur bénéfices"), ("70", "Ventes et prestations de services"), ("71", "Production stockée (variation)"),
    ("72", "Production immobilisée"), ("74", "Subventions d'exploitation"), ("75", "Autres produits de gestion courante"), ("76", "Produits financiers"), ("77", "Produits exceptionnels"),
    ("78", "Reprises sur amortissements et provisions"), ("79", "Transferts de charges"), ("40", "Fournisseurs et comptes rattachés"), ("41", "Clients et comptes rattachés"), ("42", "Personnel et comptes rattachés"),
    ("43", "Sécurité sociale et organismes sociaux"), ("44", "État et autres collectivités"), ("46", "Débiteurs/créditeurs divers"), ("47", "Comptes transitoires (CCA, PCA, FAE, FNP)"),
    ("48", "Comptes de régularisation (charges/produits constatés d'avance)"), ("49", "Dépréciations des comptes de tiers"),
]
# Prefix | what a December spike of its accounts may be; the longest prefix counts.
SPIKE_READINGS = [
    ("68", "dotation aux provisions ou amortissement exceptionnel"), ("7", "produit à recevoir régularisé, rattrapage de facturation, ou extourne"),
    ("6", "charge constatée d'avance, provision, ou facture non parvenue régularisée"), ("4", "régularisation de compte tiers, lettrage, ou écriture de clôture"),
    ("", "écriture de régularisation ou opération exceptionnelle"),
]
# Pattern | place | question; {a} account, {n} its kind, {m} amount, {v} value, {w} whole, {i} reading, {c} class.
DRILL_TEXTS = [
    ("year_end_spike", 0, "Le compte {a} ({n}) concentre {m} en décembre ({v}x la moyenne de {w}). S'agit-il d'un {i} ?"),
    ("year_end_spike", 1, "Voir l'évolution mensuelle du compte {a} pour identifier si ce pic de {m} est récurrent ou exceptionnel"),
    ("year_end_spike", 2, "Identifier le(s) tiers/contreparties de ces {m} en décembre sur {a} (journal OD, fournisseur spécifique ?)"),
    ("concentration", 0, "Le compte {a} ({n}) représente {v}% des {c} ({m} sur {w}). Décomposer par tiers/nature pour comprendre cette concentration."),
    ("concentration", 1, "Cette concentration de {v}% sur {a} est-elle stable dans le temps ou récente ?"),
    ("concentration", 2, "Comparer la répartition des {c} avec N-1 : le compte {a} était-il déjà aussi dominant ?"),
    ("social_to_salaries", 0, "Ratio charges sociales/salaires de {v}% (normal: 40-60%). Décomposer les comptes 64x ({w}) et 645-647 ({m}) pour identifier l'écart."),
    ("social_to_salaries", 1, "Le ratio bas suggère des provisions manquantes ou des indemnités exonérées. Vérifier les comptes 645 (URSSAF), 647 (autres organismes) et les provisions 438."),
    ("purchases_to_sales", 0, "Marge brute de seulement {v}% (achats {m} / ventes {w}). Évolution mensuelle pour identifier si c'est structurel ou ponctuel."),
    ("purchases_to_sales", 1, "Décomposer les achats (601-607) par fournisseur : hausse des prix d'achat ou nouveaux fournisseurs ?"),
    ("round_number", 0, "{v} écritures avec montants très ronds (multiples de 10K€, total {m}). Lister pour vérifier s'il s'agit d'estimations, provisions, ou erreurs."),
    ("round_number", 1, "Quels journaux contiennent ces {v} montants ronds ? (OD = probable estimation, ACH/VTE = suspect)"),
    ("duplicate_amount", 0, "Montant {m} répété {v} fois. Lister ces écritures pour vérifier : abonnement récurrent, double saisie, ou fraude potentielle ?"),
    ("duplicate_amount", 1, "Identifier les contreparties des {v} écritures de {m} : même tiers ou dispersé ?"),
]
CLASS_NAMES = {"6": "charges", "7": "produits"}


def short_amount(x: Column) -> Column:
    """An amount in millions with one decimal, in thousands, or in euros."""
    part = lambda by, places, form: F.format_string(form, rounded(x / by, places))
    return F.when(x.isNull(), "N/A").when(F.abs(x) >= 1e6, part(1e6, 1, "%,.1fM€")).when(F.abs(x) >= 1e3, part(1e3, 0, "%,.0fK€")).otherwise(part(1.0, 0, "%,.0f€"))


def drill_texts(found: DataFrame) -> DataFrame:
    """(pattern, subject, place, drill, question): the wording of each drill-down question of the patterns."""
    spark = found.sparkSession
    texts = F.broadcast(spark.createDataFrame(DRILL_TEXTS, "pattern string, place int, template string"))
    kinds = F.broadcast(spark.createDataFrame(ACCOUNT_KINDS, "kind_of string, kind_name string"))
    kept = found.join(F.broadcast(spark.createDataFrame(DRILLS, "pattern string, place int, drill string")), "pattern").join(texts, ["pattern", "place"])
    kept = kept.where(~((F.col("pattern") == "social_to_salaries") & (F.col("place") == 1) & (F.col("value") >= LOW_SOCIAL)))
    account = F.when(F.col("pattern").isin(*OF_ACCOUNTS), F.col("subject"))
    j = kept.withColumn("account", account).join(kinds, F.substring("account", 1, 2) == F.col("kind_of"), "left")
    reading = first_of([(F.coalesce(F.col("account"), F.lit("")).startswith(p), F.lit(text)) for p, text in SPIKE_READINGS], "")
    value = first_of(
        [
            (F.col("pattern") == "year_end_spike", F.format_string("%.1f", rounded(F.col("value"), 1))), (F.col("pattern") == "social_to_salaries", F.format_string("%.1f", rounded(F.col("value") * 100, 1))),
            (F.col("pattern") == "purchases_to_sales", F.format_string("%.1f", rounded((1 - F.col("value")) * 100, 1))),
        ],
        F.format_string("%.0f", rounded(F.col("value"), 0)),
    )
    class_name = first_of([(F.substring("account", 1, 1) == c, name) for c, name in CLASS_NAMES.items()], "")
    text = F.col("template")
    said = {"a": F.coalesce("account", F.lit("")), "n": F.coalesce("kind_name", F.lit("")), "m": short_amount(F.col("amount")), "v": value, "w": short_amount(F.col("whole")), "i": reading, "c": class_name}
    for name, column in said.items():
        text = F.replace(text, F.lit("{" + name + "}"), column)
    return j.select("pattern", "subject", "place", "drill", text.alias("question"))
