"""Reading ledger exports: delimiter and encoding, header mapping, canonical columns."""

from __future__ import annotations

import csv
import re
import unicodedata
from difflib import SequenceMatcher
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.canonical import canonicalize

REQUIRED = ("date", "account", "debit", "credit")
DELIMITERS = (";", ",", "\t")
#: Control characters of ISO-8859-1, and what windows-1252 prints in their place.
PRINTED = [(chr(b), bytes([b]).decode("windows-1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
C1 = ("".join(a for a, _ in PRINTED), "".join(b for _, b in PRINTED))

# Layout -> canonical column -> headers of exports.
LAYOUTS = {
    "sage": {
        "date": ["Date", "Date écriture", "Date pièce"], "account": ["N° Compte", "Compte", "N° compte général", "Compte général"], "account_label": ["Intitulé compte", "Libellé compte", "Intitulé"],
        "journal": ["Code journal", "Journal", "Code jal"], "voucher": ["N° Pièce", "Pièce", "N° document"], "label": ["Libellé écriture", "Libellé", "Référence"],
        "debit": ["Débit", "Montant débit", "Debit"], "credit": ["Crédit", "Montant crédit", "Credit"],
        "axis_1": ["Section analytique", "Axe 1", "Centre analytique", "N° Section"], "axis_2": ["Axe 2", "Section 2"], "axis_3": ["Axe 3", "Section 3"],
    },
    "cegid": {
        "date": ["DATE", "DATECPT", "DATE_PIECE"], "account": ["COMPTE", "NUMCPT", "COMPTE_GENERAL"], "account_label": ["LIB_COMPTE", "LIBCPT", "LIBELLE_COMPTE"],
        "journal": ["JOURNAL", "CODEJAL", "CODE_JOURNAL"], "voucher": ["PIECE", "NUMPIECE", "NUM_PIECE"], "label": ["LIBELLE", "LIBECRITURE", "LIB_ECRITURE"],
        "debit": ["DEBIT", "MTDEBIT", "MONTANT_DEBIT"], "credit": ["CREDIT", "MTCREDIT", "MONTANT_CREDIT"],
        "axis_1": ["AXE1", "SECTION1", "ANALYTIQUE1", "CODE_ANA1"], "axis_2": ["AXE2", "SECTION2", "ANALYTIQUE2", "CODE_ANA2"], "axis_3": ["AXE3", "SECTION3", "ANALYTIQUE3", "CODE_ANA3"],
    },
    "quadratus": {
        "date": ["Date", "DateEcriture"], "account": ["Compte", "NumeroCompte"], "account_label": ["LibelleCompte"], "journal": ["Journal", "CodeJournal"], "voucher": ["Piece", "NumeroPiece"],
        "label": ["Libelle", "LibelleEcriture"], "debit": ["Debit", "MontantDebit"], "credit": ["Credit", "MontantCredit"], "axis_1": ["Analytique", "SectionAnalytique"],
    },
    "ebp": {
        "date": ["Date"], "account": ["N° de compte", "Numéro de compte"], "account_label": ["Intitulé du compte"], "journal": ["Code journal"], "voucher": ["N° de pièce"], "label": ["Libellé"],
        "debit": ["Débit"], "credit": ["Crédit"], "axis_1": ["Code analytique", "Analytique"],
    },
    "generic": {
        "date": ["date", "Date", "DATE"], "account": ["compte", "Compte", "COMPTE", "account", "Account"], "account_label": ["libelle_compte", "LibelleCompte", "account_name"],
        "journal": ["journal", "Journal", "JOURNAL"], "voucher": ["piece", "Piece", "PIECE", "reference"], "label": ["libelle", "Libelle", "LIBELLE", "description"],
        "debit": ["debit", "Debit", "DEBIT"], "credit": ["credit", "Credit", "CREDIT"], "axis_1": ["analytique", "axe_1", "cost_center", "centre_cout"], "axis_2": ["axe_2", "projet", "project"], "axis_3": ["axe_3"],
    },
}


def bare(name: str) -> str:
    """A header without accents, case, blanks and punctuation."""
    flat = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return "".join(c for c in flat if c.isalnum())


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 where every line is that; else windows-1252 where some line has a character that only it prints; else ISO-8859-1.

    All lines are looked at, up to the first that decides.
    """
    lines = spark.read.text(path)
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return "UTF-8"
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    controls = latin.rlike("[\\x{80}-\\x{9F}]") & ~latin.rlike("[\\x{81}\\x{8D}\\x{8F}\\x{90}\\x{9D}]")
    return "ISO-8859-1" if lines.where(controls).isEmpty() else "windows-1252"


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """The file in its encoding (encoding_of), by the first delimiter that gives more than one column; all columns as text."""
    encoding = encoding_of(spark, path)
    printed = encoding == "windows-1252"
    for delimiter in DELIMITERS:
        df = spark.read.csv(path, sep=delimiter, encoding="ISO-8859-1" if printed else encoding, header=True, inferSchema=False)
        if len(df.columns) > 1:
            # the reader doesn't know windows-1252, which differs from ISO-8859-1 in these characters only
            return df.select(*[F.translate(f"`{c}`", *C1).alias(c.translate(str.maketrans(*C1))) for c in df.columns]) if printed else df
    raise ValueError(f"{path} has no delimiter among {DELIMITERS}")


def layout_of(columns: list[str]) -> str:
    """The layout with the largest part of its headers found, whatever their case; required columns weigh 2, the first wins ties."""
    have = {c.lower() for c in columns}
    weight = lambda c: 2 if c in REQUIRED else 1
    part = {name: sum(weight(c) for c, hs in fields.items() if have & {h.lower() for h in hs}) / sum(map(weight, fields)) for name, fields in LAYOUTS.items()}
    return max(part, key=part.get) if any(part.values()) else "generic"


def map_headers(columns: list[str]) -> dict[str, str]:
    """canonical column -> header. Headers of the layout first, whatever their case, then
    similar names; an error with suggestions when a required column is missing. Only names
    are looked at."""
    found: dict[str, str] = {}
    of = {c.lower(): c for c in reversed(columns)}
    for layout in dict.fromkeys((layout_of(columns), "generic")):
        if layout == "generic" and sum(c in found for c in REQUIRED) == len(REQUIRED):
            break
        for target, headers in LAYOUTS[layout].items():
            if target not in found and (hit := next((of[h.lower()] for h in headers if h.lower() in of and of[h.lower()] not in found.values()), None)):
                found[target] = hit
    known = {t: {bare(h) for fields in LAYOUTS.values() for h in fields.get(t, [])} for t in LAYOUTS["generic"]}
    for target, names in known.items():
        if target in found:
            continue
        scores = {c: max(SequenceMatcher(None, bare(c), n).ratio() + (0.3 if n in bare(c) or bare(c) in n else 0) for n in names) for c in columns if c not in found.values() and bare(c)}
        if scores and max(scores.values()) > 0.6:
            found[target] = max(scores, key=scores.get)
    if missing := [c for c in REQUIRED if c not in found]:
        raise ValueError(f"no column for {missing}; unmapped headers: {[c for c in columns if c not in found.values()]}")
    return found


def sniff(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, encoding, header): of each file under the paths its encoding, as encoding_of(), and first line, in one pass over all.

    Lines are counted in parts of files; a file's first line is that of its first part. Files
    without lines are left out.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    printed = latin.rlike("[\\x{80}-\\x{9F}]") & ~latin.rlike("[\\x{81}\\x{8D}\\x{8F}\\x{90}\\x{9D}]")
    first = F.min_by(F.col("value").cast("binary"), F.struct("start", "n"))
    files = lines.groupBy("file").agg(F.every(F.is_valid_utf8("value")).alias("utf8"), F.some(~F.is_valid_utf8("value") & printed).alias("windows"), first.alias("line"))
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("windows"), "windows-1252").otherwise("ISO-8859-1")
    header = F.when(F.col("utf8"), F.decode("line", "UTF-8")).otherwise(F.decode("line", "ISO-8859-1"))
    return files.select("file", encoding.alias("encoding"), F.regexp_replace(header, "[\\r\ufeff]", "").alias("header"))


def load_many(spark: SparkSession, paths: list[str], labels: list[str] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """The canonical ledger of all files under the paths, each in its own encoding and layout, with `source`, the label of its path.

    A path is a file or a folder. Files are looked at in one pass and grouped by encoding and
    header; each group is read at once by the first delimiter that parts its header, and the
    groups are put together. The list of files and their headers goes to the driver, as any
    reader's list of files does; lines don't. A file below several of the paths takes the label of
    the longest; without labels, the label is the path. A header without the required columns is
    an error that names a file.
    """
    labels = labels or paths
    if len(labels) != len(paths):
        raise ValueError("there must be a label for each path")
    groups = sniff(spark, paths).groupBy("encoding", "header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("encoding", "header").collect()
    bare_path = lambda p: unquote(re.sub("^[a-z0-9]+:/*", "/", p)).rstrip("/")
    roots = sorted(((bare_path(p), label) for p, label in zip(paths, labels)), key=lambda x: -len(x[0]))
    named, out = [], []
    for group in groups:
        printed = group["encoding"] == "windows-1252"
        header = group["header"].translate(str.maketrans(*C1)) if printed else group["header"]
        delimiter = next((d for d in DELIMITERS if len(next(csv.reader([header], delimiter=d), [])) > 1), None)
        if delimiter is None:
            raise ValueError(f"{group['files'][0]} has no delimiter among {DELIMITERS}")
        read = spark.read.csv([unquote(f) for f in group["files"]], sep=delimiter, encoding="ISO-8859-1" if printed else group["encoding"], header=True, inferSchema=False)
        file = F.col("_metadata.file_path").alias("__file")
        columns = [F.translate(f"`{c}`", *C1).alias(c.translate(str.maketrans(*C1))) if printed else F.col(f"`{c}`") for c in read.columns]
        try:
            of = mapping or map_headers([c.translate(str.maketrans(*C1)) if printed else c for c in read.columns])
        except ValueError as e:
            raise ValueError(f"{group['files'][0]}: {e}") from e
        rows = read.select(*columns, file)
        out.append(to_canonical(rows, of, "__file"))
        named += [(f, next((label for root, label in roots if bare_path(f) == root or bare_path(f).startswith(root + "/")), None)) for f in group["files"]]
    if not out:
        raise ValueError(f"no lines under {paths}")
    sources = spark.createDataFrame(named, "__file string, source string")
    return reduce(DataFrame.unionByName, out).join(sources, "__file").drop("__file")


def to_canonical(df: DataFrame, mapping: dict[str, str] | None = None, *kept: str) -> DataFrame:
    """Any export as the canonical ledger, by one projection of the whole table; kept columns stay as they are."""
    mapping = mapping or map_headers(df.columns)
    return canonicalize(df.select(*[F.col(f"`{src}`").alias(name) for name, src in mapping.items()], *kept), *kept)


def load(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    return to_canonical(read_delimited(spark, path), mapping)
