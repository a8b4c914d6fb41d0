import hashlib
import random

import numpy as np
import pytest

from folio.llm import repeats as op


def brute(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(r.randint(15, 80)) for _ in range(6)]
    docs = []
    for d in range(80):
        parts = [prose(r.randint(0, 60)) for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            if r.random() < 0.5:
                i = r.randrange(len(p))
                p = p[:i] + r.choice("xyz ") + p[i + r.randint(0, 2) :]
            parts.insert(r.randint(0, len(parts)), p[r.randint(0, 60) if r.random() < 0.3 else 0 :])
        docs.append((d, " ".join(parts)))
    a, b = docs[5][1], docs[6][1]
    docs += [(100, a), (101, None), (102, ""), (103, "a" * 700), (104, "ab" * 300), (105, "a" * 350 + "b" + "a" * 300), (106, a + "\0" * 130)]
    return docs + [(107, "\0" * 260 + a), (108, "q" * 99), (109, b[10:]), (110, b[:-7]), (111, "z" * 100), (112, "yz" + "z" * 100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "b") for d, t in docs], "doc_id long, text string, bucket string")
    got = {r[0]: tuple(r)[1:] for r in op.remove_repeats(df).collect()}
    assert got == brute(docs)


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 700)
    r = random.Random(3)
    text = "".join(r.choice("ab \n") for _ in range(5000))
    data = np.frombuffer((text + text[1000:1400]).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    cut = np.concatenate(list(op.batch_anchors(np.array([7]), offsets, data)))
    monkeypatch.setattr(op, "PIECE", 1 << 20)
    whole = np.concatenate(list(op.batch_anchors(np.array([7]), offsets, data)))
    assert np.array_equal(np.sort(cut), np.sort(whole))


def test_groups_have_all_occurrences():
    """A passage in three places and a longer one in two of them: both repeats are reported whole."""
    base, more = "0123456789" * 12, "abcdefghij" * 4
    group = np.zeros(3, op.CONTEXT)
    for i, (before, after) in enumerate([("p", more), ("q", more), ("r", "zzzz")]):
        text = (before * op.SPAN + base[: op.GRAM] + after + base)[: op.WIDTH].encode()
        group[i]["bytes"], group[i]["left"], group[i]["size"], group[i]["doc"] = np.frombuffer(text, np.uint8), op.SPAN, op.WIDTH, i
    group["bytes"][:, : op.SPAN] = ord("p")
    found = {(int(left), int(right), tuple(sorted(members))) for left, right, members in op.repeat_groups(group)}
    assert (50, 50, (0, 1, 2)) in found
    assert (50, 100, (0, 1)) in found


def test_empty_table_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.remove_repeats(empty).count() == 0
    text = "".join(random.Random(4).choices("abcdefgh", k=300))
    rows = op.remove_repeats(spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string"), with_kept=True).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in rows) == [(1, 0), (1, 0), (99, 300)]


def test_grams_with_many_surroundings_are_parted(spark):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in op.remove_repeats(df, hot=2).collect()}
    assert got == brute(docs)


def test_hot_grams_are_known_across_blobs(spark):
    """One passage with other neighbours in each of many texts, parted and not, gives equal results."""
    r = random.Random(6)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = text(260)
    docs = [(d, text(r.randint(20, 150)) + passage[r.randint(0, 40) :] + text(60)) for d in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    want = brute(docs)
    assert {x[0]: tuple(x)[1:] for x in op.remove_repeats(df, hot=50).collect()} == want
    assert {x[0]: tuple(x)[1:] for x in op.remove_repeats(df).collect()} == want


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark):
    r = random.Random(7)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = text(200)
    docs = [(1, text(50) + passage), (None, text(300)), (None, passage + text(120)), (7, text(300)), (7, passage), (2**63 - 1, text(90) + passage), (7, text(40)), (None, None), (-5, text(150))]
    docs += [(None, text(30) + passage) for _ in range(20)]
    rows = op.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    order = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest()))
    want = brute([(i, t) for i, (_, t) in enumerate(order)])
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr((d, *want[i])) for i, (d, _) in enumerate(order))


def test_ids_of_other_types(spark):
    text = "".join(random.Random(8).choices("abcdefgh", k=250))
    rows = op.remove_repeats(spark.createDataFrame([("b", text), ("a", "xy" + text)], "doc_id string, text string")).collect()
    assert sorted((x["doc_id"], x["n_removed"]) for x in rows) == [("a", 0), ("b", 250)]
