"""Known names in labels: all that are contained, and only few pieces of a label move."""

import pytest

from folio.operators import labels


def test_names_of_all_lengths_are_found(spark):
    names = ["Supplier#000000001", "Supplier#000000010", "été sarl", "ab", "x", "😀 & fils", "Ab", None, ""]
    texts = ["", "AB", "paid supplier#000000010 ab", "facture ÉTÉ SARL", "x😀 & fils", "supplier#00000001", "zzz", None]
    df = spark.createDataFrame([(t, n) for t in texts for n in names], "label string, third_party string")
    got = labels.known_parties(df).collect()
    want = {(t, n) for t in texts if t is not None for n in names if n and n.upper() in t.upper()}
    assert len(got) == len(want) and {(r["label"], r["third_party"]) for r in got} == want


def test_pieces_without_a_name_stay(spark):
    df = spark.createDataFrame([(f"a long label without any name {i}", "Supplier#000000001") for i in range(50)], "label string, third_party string")
    plan = labels.known_parties(df)._jdf.queryExecution().toString()
    assert "Generate" not in plan.split("== Physical Plan ==")[1]
    assert labels.known_parties(df).count() == 0


@pytest.mark.parametrize("k", [1, 3, 8])
def test_hashes_tell_pieces(k):
    texts = ["", "ab", "abcabcabcab", "😀abcdefgh"]
    row, h = labels.piece_hashes(texts, k)
    pieces = [(i, t[j : j + k]) for i, t in enumerate(texts) for j in range(len(t) - k + 1)]
    assert row.tolist() == [i for i, _ in pieces]
    assert len(set(h.tolist())) == len({p for _, p in pieces}) and len(set(zip(h.tolist(), [p for _, p in pieces]))) == len({p for _, p in pieces})
