import datetime

import pytest

from folio.operators import reports
from folio.sources import readers

HEADER = "Date écriture;N° Compte;Code journal;N° Pièce;Libellé écriture;Débit;Crédit;Section analytique"
LINES = ["31/12/2024;601000 ;ach;P1;Achat;100.50;0;S1", "bad;401000;ACH;P1;Achat;0;100.50;", "01/02/2024;706000;VTE;P2;Été;x;7;S2"]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_an_export_becomes_the_canonical_ledger(spark, tmp_path, encoding):
    (tmp_path / "gl.csv").write_bytes("\n".join([HEADER, *LINES]).encode(encoding))
    rows = readers.load(spark, str(tmp_path / "gl.csv")).orderBy("account").collect()
    assert [r["account"] for r in rows] == ["401000", "601000", "706000"]
    assert (rows[0]["date"], rows[1]["date"], rows[1]["period"]) == (None, datetime.date(2024, 12, 31), "2024-12")
    assert (float(rows[1]["amount"]), float(rows[2]["pnl_amount"]), rows[0]["axis_1"], rows[1]["axis_1"]) == (100.5, 7.0, None, "S1")
    assert rows[2]["label"] == "Été"


def test_headers_are_mapped_by_layout_then_by_likeness():
    assert readers.layout_of(["DATECPT", "NUMCPT", "CODEJAL", "MTDEBIT", "MTCREDIT"]) == "cegid"
    assert readers.map_headers(["date", "Numero compte", "debits", "montant credit", "memo"]) | {"label": ""} == {"date": "date", "account": "Numero compte", "debit": "debits", "credit": "montant credit", "label": ""}
    with pytest.raises(ValueError, match="debit"):
        readers.map_headers(["date", "compte", "xyz"])


def test_tables_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    reports.write_tables({"one": df}, str(tmp_path), "csv")
    assert spark.read.csv(f"{tmp_path}/one", header=True).collect()[0]["s"] == "a"


def test_a_folder_of_mixed_exports_equals_the_single_loads(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "c").mkdir()
    files = {
        "a b/one.csv": ("\n".join([HEADER, *LINES]), "utf-8"), "a b/two.csv": ("\n".join([HEADER, *LINES[1:]]), "latin-1"), "a b/three.csv": ("\r\n".join([HEADER, "01/03/2024;607000;ACH;P9;Œuvre – 5€;1;0;S9"]), "windows-1252"),
        "c/four.txt": ("DATECPT,NUMCPT,CODEJAL,PIECE,LIBELLE,MTDEBIT,MTCREDIT\n2024-05-06,512000,BQ,P3,Été,5,0", "utf-8"), "c/five.csv": ("date\tcompte\tjournal\tlibelle\tdebit\tcredit\n07/08/2024\t641000\tOD\tPaie\t9\t0", "latin-1"), "c/empty.csv": ("", "utf-8"),
    }
    for name, (text, encoding) in files.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    many = readers.load_many(spark, [str(tmp_path / "a b"), str(tmp_path / "c"), str(tmp_path / "c" / "five.csv")], ["A", "C", "five"])
    label = lambda name: "A" if name.startswith("a") else "five" if "five" in name else "C"
    columns = [c for c in many.columns if c != "source"]
    want = [(label(name), *map(str, r)) for name, (text, _) in files.items() if text for r in readers.load(spark, str(tmp_path / name)).select(columns).collect()]
    assert sorted((r["source"], *map(str, tuple(r)[:-1])) for r in many.select(*columns, "source").collect()) == sorted(want)
    assert {r["label"] for r in many.collect()} >= {"Œuvre – 5€", "Été", "Achat", "Paie"}


def test_files_that_cannot_be_loaded_are_named(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date;compte\n1;2")
    with pytest.raises(ValueError, match="x.csv"):
        readers.load_many(spark, [str(tmp_path / "x.csv")])
    with pytest.raises(ValueError, match="label for each"):
        readers.load_many(spark, ["a", "b"], ["one"])
