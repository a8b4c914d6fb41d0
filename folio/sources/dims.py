"""Dimensions: fixed values of the French chart of accounts and of the detectors' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Prefix, label, category, frequency, behavior.
CHART_ROWS = [
    ("601", "Achats stockés - Matières premières", "achats", "variable", "regulier"),
    ("602", "Achats stockés - Autres approvisionnements", "achats", "variable", "regulier"),
    ("604", "Achats d'études et prestations", "achats", "variable", "regulier"),
    ("606", "Achats non stockés", "achats", "mensuelle", "regulier"),
    ("607", "Achats de marchandises", "achats", "variable", "regulier"),
    ("611", "Sous-traitance générale", "services", "variable", "regulier"),
    ("612", "Redevances de crédit-bail", "services", "mensuelle", "regulier"),
    ("613", "Locations", "services", "mensuelle", "regulier"),
    ("614", "Charges locatives", "services", "trimestrielle", "saisonnier"),
    ("615", "Entretien et réparations", "services", "variable", "regulier"),
    ("616", "Primes d'assurance", "services", "annuelle", "ponctuel"),
    ("617", "Études et recherches", "services", "variable", "regulier"),
    ("618", "Divers services extérieurs", "services", "variable", "regulier"),
    ("621", "Personnel extérieur", "services", "mensuelle", "regulier"),
    ("622", "Rémunérations d'intermédiaires", "services", "variable", "regulier"),
    ("623", "Publicité, publications", "services", "variable", "regulier"),
    ("624", "Transports de biens et collectifs", "services", "mensuelle", "regulier"),
    ("625", "Déplacements, missions", "services", "mensuelle", "regulier"),
    ("626", "Frais postaux et télécoms", "services", "mensuelle", "regulier"),
    ("627", "Services bancaires", "services", "mensuelle", "regulier"),
    ("628", "Divers autres services", "services", "variable", "regulier"),
    ("631", "Impôts, taxes sur rémunérations", "taxes", "annuelle", "regularisation"),
    ("633", "Impôts, taxes sur rémunérations", "taxes", "mensuelle", "regulier"),
    ("635", "Autres impôts, taxes", "taxes", "annuelle", "ponctuel"),
    ("637", "Autres impôts, taxes", "taxes", "variable", "regulier"),
    ("641", "Rémunérations du personnel", "personnel", "mensuelle", "regulier"),
    ("644", "Rémunération du travail de l'exploitant", "personnel", "mensuelle", "regulier"),
    ("645", "Charges de sécurité sociale", "personnel", "mensuelle", "regulier"),
    ("647", "Autres charges sociales", "personnel", "mensuelle", "regulier"),
    ("648", "Autres charges de personnel", "personnel", "variable", "regulier"),
    ("651", "Redevances pour concessions", "autres", "variable", "regulier"),
    ("654", "Pertes sur créances irrécouvrables", "autres", "exceptionnelle", "ponctuel"),
    ("658", "Charges diverses de gestion", "autres", "variable", "regulier"),
    ("661", "Charges d'intérêts", "financier", "mensuelle", "regulier"),
    ("664", "Pertes sur créances liées", "financier", "exceptionnelle", "ponctuel"),
    ("665", "Escomptes accordés", "financier", "variable", "regulier"),
    ("666", "Pertes de change", "financier", "variable", "regulier"),
    ("668", "Autres charges financières", "financier", "variable", "regulier"),
    ("671", "Charges exceptionnelles sur opérations de gestion", "exceptionnel", "exceptionnelle", "ponctuel"),
    ("675", "Valeurs comptables des éléments d'actif cédés", "exceptionnel", "exceptionnelle", "ponctuel"),
    ("678", "Autres charges exceptionnelles", "exceptionnel", "exceptionnelle", "ponctuel"),
    ("681", "Dotations aux amort. et prov. - exploitation", "dotations", "mensuelle", "provision"),
    ("686", "Dotations aux amort. et prov. - financier", "dotations", "annuelle", "provision"),
    ("687", "Dotations aux amort. et prov. - exceptionnel", "dotations", "exceptionnelle", "provision"),
    ("695", "Impôts sur les bénéfices", "is", "annuelle", "regularisation"),
    ("696", "Suppléments d'IS", "is", "annuelle", "regularisation"),
    ("698", "Intégration fiscale", "is", "annuelle", "regularisation"),
    ("699", "Produits - Report IS", "is", "annuelle", "regularisation"),
    ("701", "Ventes de produits finis", "ventes", "variable", "regulier"),
    ("706", "Prestations de services", "ventes", "variable", "regulier"),
    ("707", "Ventes de marchandises", "ventes", "variable", "regulier"),
    ("708", "Produits des activités annexes", "ventes", "variable", "regulier"),
    ("709", "RRR accordés", "ventes", "variable", "regulier"),
    ("713", "Variation des stocks", "stocks", "annuelle", "regularisation"),
    ("721", "Production immobilisée - Immob. incorporelles", "production", "variable", "ponctuel"),
    ("722", "Production immobilisée - Immob. corporelles", "production", "variable", "ponctuel"),
    ("741", "Subventions d'exploitation", "subventions", "variable", "ponctuel"),
    ("747", "Quote-part subventions virées au résultat", "subventions", "annuelle", "regularisation"),
    ("751", "Redevances pour concessions", "autres", "variable", "regulier"),
    ("758", "Produits divers de gestion courante", "autres", "variable", "regulier"),
    ("761", "Produits de participations", "financier", "annuelle", "ponctuel"),
    ("764", "Revenus des VMP", "financier", "variable", "regulier"),
    ("765", "Escomptes obtenus", "financier", "variable", "regulier"),
    ("766", "Gains de change", "financier", "variable", "regulier"),
    ("768", "Autres produits financiers", "financier", "variable", "regulier"),
    ("771", "Produits exceptionnels sur opérations de gestion", "exceptionnel", "exceptionnelle", "ponctuel"),
    ("775", "Produits des cessions d'éléments d'actif", "exceptionnel", "exceptionnelle", "ponctuel"),
    ("778", "Autres produits exceptionnels", "exceptionnel", "exceptionnelle", "ponctuel"),
    ("781", "Reprises sur amort. et prov. - exploitation", "reprises", "annuelle", "provision"),
    ("786", "Reprises sur prov. - financier", "reprises", "annuelle", "provision"),
    ("787", "Reprises sur prov. - exceptionnel", "reprises", "exceptionnelle", "provision"),
    ("201", "Frais d'établissement", "immob_incorp", "exceptionnelle", "ponctuel"),
    ("203", "Frais de R&D", "immob_incorp", "variable", "ponctuel"),
    ("205", "Concessions et droits", "immob_incorp", "exceptionnelle", "ponctuel"),
    ("206", "Droit au bail", "immob_incorp", "exceptionnelle", "ponctuel"),
    ("207", "Fonds commercial", "immob_incorp", "exceptionnelle", "ponctuel"),
    ("208", "Autres immob. incorporelles", "immob_incorp", "exceptionnelle", "ponctuel"),
    ("211", "Terrains", "immob_corp", "exceptionnelle", "ponctuel"),
    ("212", "Agencements de terrains", "immob_corp", "exceptionnelle", "ponctuel"),
    ("213", "Constructions", "immob_corp", "exceptionnelle", "ponctuel"),
    ("214", "Constructions sur sol d'autrui", "immob_corp", "exceptionnelle", "ponctuel"),
    ("215", "Installations techniques", "immob_corp", "exceptionnelle", "ponctuel"),
    ("218", "Autres immob. corporelles", "immob_corp", "exceptionnelle", "ponctuel"),
    ("231", "Immob. corporelles en cours", "immob_encours", "variable", "ponctuel"),
    ("232", "Immob. incorporelles en cours", "immob_encours", "variable", "ponctuel"),
    ("237", "Avances et acomptes immob.", "immob_encours", "variable", "ponctuel"),
    ("261", "Titres de participation", "immob_fin", "exceptionnelle", "ponctuel"),
    ("267", "Créances rattachées à participations", "immob_fin", "variable", "ponctuel"),
    ("271", "Titres immobilisés", "immob_fin", "exceptionnelle", "ponctuel"),
    ("272", "Titres immobilisés - droits de créance", "immob_fin", "variable", "ponctuel"),
    ("274", "Prêts", "immob_fin", "variable", "ponctuel"),
    ("275", "Dépôts et cautionnements", "immob_fin", "exceptionnelle", "ponctuel"),
    ("280", "Amort. immob. incorporelles", "amortissement", "annuelle", "provision"),
    ("281", "Amort. immob. corporelles", "amortissement", "annuelle", "provision"),
    ("282", "Amort. immob. mises en concession", "amortissement", "annuelle", "provision"),
    ("290", "Dépréc. immob. incorporelles", "depreciation", "annuelle", "provision"),
    ("291", "Dépréc. immob. corporelles", "depreciation", "annuelle", "provision"),
    ("293", "Dépréc. immob. en cours", "depreciation", "annuelle", "provision"),
    ("296", "Dépréc. participations", "depreciation", "annuelle", "provision"),
    ("297", "Dépréc. autres immob. fin.", "depreciation", "annuelle", "provision"),
    ("401", "Fournisseurs", "fournisseurs", "mensuelle", "regulier"),
    ("403", "Fournisseurs - Effets à payer", "fournisseurs", "variable", "regulier"),
    ("404", "Fournisseurs d'immobilisations", "fournisseurs", "exceptionnelle", "ponctuel"),
    ("408", "Fournisseurs - Factures non parvenues", "regularisation", "annuelle", "regularisation"),
    ("409", "Fournisseurs débiteurs", "fournisseurs", "variable", "regulier"),
    ("411", "Clients", "clients", "mensuelle", "regulier"),
    ("413", "Clients - Effets à recevoir", "clients", "variable", "regulier"),
    ("416", "Clients douteux", "clients", "annuelle", "provision"),
    ("418", "Clients - Produits non encore facturés", "regularisation", "annuelle", "regularisation"),
    ("419", "Clients créditeurs", "clients", "variable", "regulier"),
    ("421", "Personnel - Rémunérations dues", "personnel", "mensuelle", "regulier"),
    ("422", "Comités d'entreprise", "personnel", "mensuelle", "regulier"),
    ("425", "Personnel - Avances et acomptes", "personnel", "mensuelle", "regulier"),
    ("427", "Personnel - Oppositions", "personnel", "mensuelle", "regulier"),
    ("428", "Personnel - Charges à payer", "regularisation", "annuelle", "regularisation"),
    ("429", "Déficits et débets", "personnel", "exceptionnelle", "ponctuel"),
    ("431", "Sécurité sociale", "social", "mensuelle", "regulier"),
    ("437", "Autres organismes sociaux", "social", "mensuelle", "regulier"),
    ("438", "Organismes sociaux - Charges à payer", "regularisation", "annuelle", "regularisation"),
    ("441", "État - Subventions à recevoir", "etat", "variable", "ponctuel"),
    ("442", "État - Impôts et taxes recouvrables", "etat", "variable", "regulier"),
    ("443", "Opérations particulières avec l'État", "etat", "variable", "regulier"),
    ("444", "État - IS", "etat", "annuelle", "regularisation"),
    ("445", "État - Taxes sur le CA", "etat", "mensuelle", "regulier"),
    ("447", "Autres impôts, taxes", "etat", "variable", "regulier"),
    ("448", "État - Charges à payer", "regularisation", "annuelle", "regularisation"),
    ("449", "Quotas d'émission", "etat", "annuelle", "ponctuel"),
    ("486", "Charges constatées d'avance", "regularisation", "annuelle", "regularisation"),
    ("487", "Produits constatés d'avance", "regularisation", "annuelle", "regularisation"),
    ("488", "Comptes de répartition périodique", "regularisation", "mensuelle", "regulier"),
    ("491", "Provisions pour dépréc. clients", "depreciation", "annuelle", "provision"),
    ("495", "Provisions pour dépréc. groupe", "depreciation", "annuelle", "provision"),
    ("496", "Provisions pour dépréc. débiteurs", "depreciation", "annuelle", "provision"),
]

# Balance-sheet prefixes that mark a provision, and their names.
PROVISION_COUNTERPARTS = {
    "486": "Charges constatées d'avance (CCA)",
    "487": "Produits constatés d'avance (PCA)",
    "408": "Fournisseurs - Factures non parvenues (FNP)",
    "418": "Clients - Factures à établir (FAE)",
    "428": "Personnel - Charges à payer",
    "438": "Organismes sociaux - Charges à payer",
    "448": "État - Charges à payer",
    "488": "Comptes de régularisation",
    "491": "Dépréciation comptes clients",
    "158": "Autres provisions pour charges",
    "151": "Provisions pour risques",
    "695": "Impôt sur les bénéfices",
    "681": "Dotations aux amortissements",
    "686": "Dotations aux provisions financières",
    "687": "Dotations aux provisions exceptionnelles",
}
ADJUSTING_JOURNALS = ("OD", "AN", "RAN", "CLO", "EXT", "BILAN", "EXTOURNE")
TYPICAL_ACCRUALS = ("631", "695", "696", "713", "747")
SEASONS = {"saisonnier": "1,4,7,10", "annuelle": "12"}

# Patterns searched in lower-cased labels.
ACCRUAL_PATTERNS = ("regul", "régul", "extourne", "contre.?passation", "annul", "reprise", "provision", "fnp", "fae", "cca", "pca", "à.?nouveau", "a.?nouveau")
ONE_SHOT_PATTERNS = ("exceptionnel", "cession", "amende", "pénalité", "contentieux", "litige", "rappel", "arriéré", "dégrèvement", "remboursement")

# Class, nature, label; then two-digit prefix, type, label, behavior.
CLASS_ROWS = [
    ("1", "passif", "Capitaux propres"),
    ("2", "actif", "Immobilisations"),
    ("3", "actif", "Stocks"),
    ("4", "special", "Tiers"),
    ("5", "actif", "Financier"),
    ("6", "charge", "Charges"),
    ("7", "produit", "Produits"),
    ("8", "special", "Comptes spéciaux"),
]
PREFIX_ROWS = [
    ("60", "exploitation", "Achats", "mensuel"),
    ("61", "exploitation", "Services extérieurs", "mensuel"),
    ("62", "exploitation", "Autres services extérieurs", "mensuel"),
    ("63", "exploitation", "Impôts et taxes", "abt"),
    ("64", "exploitation", "Charges de personnel", "mensuel"),
    ("65", "exploitation", "Autres charges de gestion", "variable"),
    ("66", "financier", "Charges financières", "mensuel"),
    ("67", "exceptionnel", "Charges exceptionnelles", "variable"),
    ("68", "exploitation", "Dotations aux amort. et prov.", "mensuel"),
    ("69", "impot", "Impôts sur les bénéfices", "annuel"),
    ("70", "exploitation", "Ventes", "mensuel"),
    ("71", "exploitation", "Production stockée", "variable"),
    ("72", "exploitation", "Production immobilisée", "variable"),
    ("74", "exploitation", "Subventions d'exploitation", "variable"),
    ("75", "exploitation", "Autres produits de gestion", "variable"),
    ("76", "financier", "Produits financiers", "variable"),
    ("77", "exceptionnel", "Produits exceptionnels", "variable"),
    ("78", "exploitation", "Reprises sur amort. et prov.", "variable"),
    ("79", "exploitation", "Transferts de charges", "variable"),
]
PROVISION_PREFIXES = ("681", "686", "687")
REVERSAL_PREFIXES = ("781", "786", "787")
DEPRECIATION_PREFIXES = ("6811", "6812")

# Provision prefix | reversal prefix | type.
COUPLES = [
    ("6811", "7811", "amortissement"),
    ("6812", "7812", "amortissement"),
    ("6816", "7816", "depreciation"),
    ("6817", "7817", "depreciation"),
    ("6815", "7815", "risques_exploitation"),
    ("686", "786", "risques_financiers"),
    ("687", "787", "risques_exceptionnels"),
]

# Journal type, keywords, in order of precedence.
JOURNAL_KEYWORDS = [
    ("od", ["OD", "DIV", "DIVERS", "OPERATIONS", "OP", "AJUST", "REG", "REGUL", "REGULARISATION", "SITUATION", "SIT", "CLO", "CLOTURE", "EXTOURNE", "EXT"]),
    ("paie", ["SAL", "SALAIRE", "SALAIRES", "PAI", "PAIE", "PAYE", "SOCIAL", "SOC", "RH"]),
    ("vente", ["VTE", "VENTE", "VENTES", "FAC", "FACT", "FACTURATION", "CLI", "CLIENT", "CLIENTS", "CA"]),
    ("achat", ["ACH", "ACHAT", "ACHATS", "FRN", "FOURNISSEUR", "FOURNISSEURS", "FOURN", "HAF"]),
    ("banque", ["BQ", "BNQ", "BANQUE", "BANK", "BP", "CE", "CCP", "TRESORERIE", "TRES"]),
    ("caisse", ["CAI", "CAISSE", "CASH", "ESP", "ESPECES"]),
    ("anouveaux", ["AN", "ANOUV", "ANOUVEAUX", "A-NOUVEAUX", "OUV", "OUVERTURE", "RAN", "REPORT"]),
]
KEYWORD_ROWS = [(word, kind, rank) for rank, (word, kind) in enumerate((w, k) for k, ws in JOURNAL_KEYWORDS for w in ws)]

# Account prefix | type of counterparty, the first that fits counts.
COUNTERPARTY_TYPES = [
    ("401", "FOURNISSEUR"),
    ("411", "CLIENT"),
    ("421", "PERSONNEL"),
    ("431", "ORGANISMES"),
    ("437", "ORGANISMES"),
    ("43", "ORGANISMES"),
    ("44", "ETAT"),
    ("471", "ATTENTE"),
    ("486", "ETALEMENT"),
    ("487", "ETALEMENT"),
    ("488", "PROVISION"),
    ("512", "BANQUE"),
    ("530", "CAISSE"),
    ("531", "CAISSE"),
    ("79", "TRANSFERT"),
]

# Three-digit prefix | kind of accrual.
ACCRUAL_ACCOUNTS = {"486": "CCA", "487": "PCA", "408": "FNP", "401": "FNP", "428": "INVENTAIRE", "438": "INVENTAIRE", "448": "INVENTAIRE", "468": "INVENTAIRE"}


def chart(spark: SparkSession) -> DataFrame:
    """(prefix, chart_label, category, frequency, behavior)."""
    return spark.createDataFrame(CHART_ROWS, "prefix string, chart_label string, category string, frequency string, behavior string")
