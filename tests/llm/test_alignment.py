import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folio.llm import alignment as op
from folio.llm import vocabularies


def brute(docs):
    byte_level = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    table = vocabularies.byte_table(public.path("byte_bpe_50k.json"))
    found = []
    for d, t in docs:
        if not t:
            found.append((d, [], [], []))
            continue
        a = byte_level.encode(" " + t, add_special_tokens=False).ids
        b = model.encode(t)
        spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
        whole = b" " + t.encode()
        if b"".join(table[i] for i in a) != whole or b"".join(spelled) != whole:
            found.append((d, [], [], []))
            continue
        groups, at_a, at_b, i, j, now = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(table[a[i]])
                now[0].append(a[i])
                i += 1
            else:
                at_b += len(spelled[j])
                now[1].append(b[j])
                j += 1
            if at_a == at_b:
                groups.append(now)
                now = ([], [])
        found.append((d, a, b, groups))
    pairs = Counter((g[0][-1], g[1][-1]) for f in found for g in f[3])
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for d, a, b, groups in found:
        counts = [(pairs[g[0][-1], g[1][-1]], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), len(groups), sum(n == most[b] for n, b in counts), sum(n for n, _ in counts), sha))
    return Counter(out)


def got(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, block long, pairs string").repartition(3)
    return Counter(tuple(r) for r in op.align(df).collect())


@pytest.fixture(scope="module")
def docs():
    r = random.Random(1)
    words = ["the", "of", "Straße", "中文字", "naïve", "x", "<|endoftext|>", "</s>", "12345", "don't", "😀", "\x00", "ﬁ", "á"]
    made = [(d, "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\t", ""]) for _ in range(r.randint(0, 60)))) for d in range(200)]
    made += [(300, None), (None, ""), (None, "a b"), (301, "▁ a"), (302, " "), (303, "\n" * 5), (304, made[3][1]), (304, made[3][1]), (305, "a" * 5000)]
    return made


def test_matches_brute_force(spark, docs):
    assert got(spark, docs) == brute(docs)


def test_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(op, "LOT", 50)
    batches = list(op.lots_of(op.pa.array([t for _, t in docs], op.pa.string())))
    assert len(batches) > 40
    assert batches[0][0] == 0 and batches[-1][1] == len(docs) and all(x[1] == y[0] for x, y in zip(batches, batches[1:]))
    aligner = op.Aligner()
    whole = aligner.lot([t for _, t in docs])
    parts = [aligner.lot([t for _, t in docs[a:b]]) for a, b in batches]
    assert whole["sha"] == [s for p in parts for s in p["sha"]]
    assert whole["counts"].sum() == sum(int(p["counts"].sum()) for p in parts)


def test_long_texts(spark):
    r = random.Random(2)
    prose = " ".join(r.choices(["alpha", "beta", "gammą", "1", ",", "　"], k=400_000))
    texts = [(1, prose), (2, "\n" * 300_000 + "x"), (3, "z" * 300_000)]
    assert got(spark, texts) == brute(texts)


def test_pointers_reach_the_terminal_of_each_group():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 300))
        ends = lambda p: np.append(np.flatnonzero(r.random(n) < p) + 1, n + 1)
        a, b = ends(0.4), ends(0.3)
        group_a, group_b = op.groups_of(a, b)
        cuts = np.intersect1d(a, b)
        assert np.array_equal(group_a, np.searchsorted(cuts, a))
        assert np.array_equal(group_b, np.searchsorted(cuts, b))


@pytest.mark.parametrize("text", ["\n" * 1_200_000 + "x", "a" + " " * 1_200_000, " \t" * 600_000 + "y 　" * 1000 + "!", "　" * 5000 + "a" + "\x1f" * 3000])
def test_long_runs_of_white_space_have_the_ids_of_the_other_library(text):
    other = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = vocabularies.byte_level(public.path("byte_bpe_50k.tiktoken"))(text)
    assert ids == other.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert got(spark, []) == Counter()
