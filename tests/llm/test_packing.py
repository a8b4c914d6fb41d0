import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import packing as op
from folio.llm import vocabularies

TEXTS = [None, "", "a", "Les régularisations de décembre <|endoftext|> et 123.45 €\n\n  x", "mot " * 5000, "日本語 тест 🙂" * 40, "a" * 3000, "don't we'll 'S  \t\n"] + [f"document {i} " * (i * 7 % 90 + 1) for i in range(80)]


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer():
    encode = vocabularies.byte_level(public_tokenizers.path("byte_bpe_50k.tiktoken"), op.END_OF_TEXT)
    r = random.Random(1)
    texts = [t for t in TEXTS if t is not None] + ["".join(chr(r.choice([32, 10, 39, 97, 233, 0x4E00, 0x1F600, 48, 33, 178, 0x301, 95])) for _ in range(60)) for _ in range(200)]
    assert [[*encode(t), 1] for t in texts] == ids_of(texts)


@given(st.lists(st.tuples(st.integers(1, 100), st.integers(1, 3), st.integers(0, 50)), max_size=80))
@settings(max_examples=80, deadline=None)
def test_bins_stay_within_all_limits(rows):
    demand, limits = np.array(rows, np.int64).reshape(-1, 3), np.array([100, 6, 80])
    at = op.fill(demand, limits)
    for b in set(at.tolist()):
        assert (demand[at == b].sum(axis=0) <= limits).all()
    assert len(at) == len(rows)


def test_a_piece_over_the_limit_is_refused():
    with pytest.raises(ValueError):
        op.fill(np.array([[101, 1, 1]]), np.array([100, 6, 80]))


def test_documents_are_packed_whole(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = op.pack_documents(df).collect()
    ids = dict(zip(range(len(TEXTS)), ids_of(TEXTS)))
    covered = {}
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {d: len(x) * (2 if d == 7 else 1) for d, x in ids.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and len(parts) <= 256
    assert len(sequences) <= 1.1 * sum(covered.values()) / 2048 + 1


def test_limits_of_instruction_data(spark):
    rows = [(i, 0, 10 + i % 40, (i % 5) * 2, 0, 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long")
    got = op.pack(df, capacity=128, max_segments=4, max_loss=12, group_size=64).collect()
    sums = {}
    for r in got:
        s = sums.setdefault(r["sequence_id"], [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r["length"], s[1] + 1, s[2] + r["loss"]
    assert len(got) == 400 and all(a <= 128 and b <= 4 and c <= 12 for a, b, c in sums.values())


def test_empty_table(spark):
    assert op.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_fill(demand, limits):
    """The rule of fill() piece by piece: the bin opens with the largest piece left, then the largest dot product that fits."""
    left, at, bin_no = sorted(range(len(demand)), key=lambda i: ([-x for x in demand[i]], i)), {}, 0
    while left:
        room, take = list(limits), left[0]
        while take is not None:
            at[take] = bin_no
            left.remove(take)
            room = [a - b for a, b in zip(room, demand[take])]
            fits = [i for i in left if all(d <= a for d, a in zip(demand[i], room))]
            score = lambda i: sum(d / m * (a / m) for d, a, m in zip(demand[i], room, limits))
            best = max(map(score, fits), default=None)
            take = next((i for i in fits if score(i) >= best - 1e-12), None)
        bin_no += 1
    return [at[i] for i in range(len(demand))]


@given(st.lists(st.tuples(st.integers(1, 64), st.just(1), st.integers(0, 32)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_choice_is_the_largest_dot_product(rows):
    limits = (64, 8, 32)  # powers of two, so that products are exact
    got = op.fill(np.array(rows, np.int64).reshape(-1, 3), np.array(limits))
    want = plain_fill(rows, limits)
    kinds = lambda at: sorted(sorted(rows[i] for i in range(len(rows)) if at[i] == b) for b in set(at))
    assert kinds(got.tolist()) == kinds(want)


def test_equal_pieces_are_dealt_apart(spark):
    """Many rows without an id and with one text don't meet in one group."""
    df = spark.createDataFrame([(None, "same words")] * 3000, "doc_id long, text string")
    got = op.pack(op.pieces(df), group_size=256).collect()
    assert len(got) == 3000
    sizes = {}
    for r in got:
        sizes[r["sequence_id"] >> 24] = sizes.get(r["sequence_id"] >> 24, 0) + 1
    assert max(sizes.values()) < 600 and len(sizes) == 12


def test_a_text_of_over_a_megabyte(spark):
    text = "one long line of words " * 60_000
    got = op.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    n = len(ids_of([text])[0])
    assert sum(r["length"] for r in got) == n == got[0]["doc_tokens"] and max(r["length"] for r in got) == 2048


def test_long_runs_of_white_space(spark):
    """Texts that are all blanks, newlines or both, of ten million characters, give the pieces of the other library's ids."""
    texts = [" " * 10_000_000, "\n" * 2_000_000 + "x", "a" + " \n" * 1_500_000 + "<|endoftext|>" + "\t" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = op.pack_documents(docs).select("doc_id", "start", "ids_crc32", "doc_tokens").collect()
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = np.array([*other.encode(text, add_special_tokens=False).ids, 1], "<u4")
        mine = {r["start"]: (r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == i}
        assert mine == {a: (zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)}
