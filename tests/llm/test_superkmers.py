import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from folio.llm import superkmers as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def corpus(seed, window):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcé中") for _ in range(r.randint(1, 5))) for _ in range(200)]
    prose = lambda n: r.choices(vocabulary, k=n)
    passages = [prose(r.randint(window - 2, 3 * window)) for _ in range(5)]
    docs = []
    for d in range(90):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += prose(r.randint(0, 2 * window))
            if r.random() < 0.5:
                p = list(r.choice(passages))
                if r.random() < 0.4:
                    p[r.randrange(len(p))] = "changed"
                parts += p[r.randint(0, 3) :]
        docs.append((d, "".join(w + r.choice([" ", "\n", "\t ", "\x0b", "  "]) for w in parts)))
    a = docs[7][1]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "a " * 700), (204, "a b " * 300), (205, "x " * (window - 1)), (206, "x " * window)]
    docs += [(207, a), (None, a), (None, a + " more"), (None, None), (208, a), (208, a), (208, a + " other"), (209, "\x1c \x85 \xa0 " * window)]
    return docs + [(210, "y " * (window + 1)), (2**62, "\0 " * 90)]


def got(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, key string").repartition(3)
    return Counter(tuple(r) for r in op.drop_windows(df, **kw).collect())


@pytest.mark.parametrize(("seed", "window", "gram", "bucket"), [(1, 35, 8, 2048), (2, 10, 3, 2), (3, 12, 1, 5)])
def test_matches_brute_force(spark, seed, window, gram, bucket):
    docs = corpus(seed, window)
    assert got(spark, docs, window=window, gram=gram, bucket=bucket) == brute(docs, window)


def test_a_passage_in_a_third_of_all_texts_is_parted(spark):
    r = random.Random(4)
    prose = lambda n: "".join(f"w{r.randrange(10**6)} " for _ in range(n))
    passage = prose(50)
    docs = [(d, prose(r.randint(0, 40)) + (passage if d % 3 == 0 else "") + prose(30)) for d in range(600)]
    docs += [(1000, passage)] * 40
    assert got(spark, docs, bucket=8) == brute(docs, 35)


def test_long_text_and_small_lots(spark, monkeypatch):
    r = random.Random(5)
    text = " ".join(r.choices([f"v{i}" for i in range(3000)], k=60_000))
    cut = text[1000:9000]
    docs = [(1, text + " " + cut), (2, "z" * 200_000 + " " + cut), (3, "q " * 50_000)]
    assert got(spark, docs) == brute(docs, 35)
    data = np.frombuffer((text + "  end").encode(), np.uint8)
    whole = op.word_hashes(data, np.array([len(data)]))[0]
    monkeypatch.setattr(op, "LOT", 5000)
    assert np.array_equal(whole, op.word_hashes(data, np.array([len(data)]))[0])


def test_equal_hashes_are_compared_as_strings(monkeypatch):
    monkeypatch.setattr(op, "stirred", lambda h: h * np.uint64(0))
    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    number = op.alike(data, np.array([0, 4, 8]), np.array([4, 8, 12]), np.zeros(3, np.int64))
    assert number[0] == number[2] != number[1]


def test_empty_table(spark):
    assert op.drop_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_words(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("a", text + " tail"), ("b", "head\n" + text)], "doc_id string, text string")
    assert {tuple(r) for r in op.drop_windows(df, with_kept=True).select("doc_id", "n_removed", "kept").collect()} == {("a", 40, "tail"), ("b", 40, "head")}
