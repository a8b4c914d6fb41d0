import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import golay
from folio.llm import simhash as op


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, near):
    """Smallest member reachable, by brute force over all pairs."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


@given(st.integers(0, (1 << 23) - 1), st.lists(st.integers(0, 22), max_size=2))
@settings(max_examples=200, deadline=None)
def test_words_within_two_bits_share_a_key(word, flips):
    other = word
    for f in flips:
        other ^= 1 << f
    keys, used = golay.keys(np.array([word, other]))
    assert set(keys[0][used[0]]) & set(keys[1][used[1]])
    assert used.sum(axis=1).tolist() <= [6, 6]


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2), st.lists(st.integers(0, 63), max_size=5))
@settings(max_examples=200, deadline=None)
def test_keys_cover_the_errors_they_promise(fp, two, five):
    def shared(plans, flips):
        other = fp
        for f in flips:
            other ^= 1 << f
        a, b = [{int(k) for _, ks in op.segment_keys(np.array([x], np.uint64), plans) for k in ks} for x in (fp, other)]
        return a & b

    assert shared(op.EXACT_2, two)
    assert shared(op.PAIRS_5, five)


def corpus():
    r = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(20, 400))) for _ in range(25)]
    rows = []
    for i in range(120):
        t = r.choice(base)
        for _ in range(r.randint(0, 2)):
            w = t.split()
            w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        rows.append((i, t))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "oNE"), (205, "a b"), (206, base[0].upper()), (206, base[0].upper())]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = op.simhash_groups(df).collect()
    assert len(got) == len(rows)
    fp = {i: fingerprint(t) for i, t in rows}
    low = groups(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fp[i]:016x}", low[i]) for i in fp}


@pytest.mark.parametrize("flips", [(63,), (63, 5), (0, 40), (22, 46)])
def test_each_bit_counts_as_one(spark, flips):
    """The top bit too, where signed numbers would mislead."""
    fp = 0x123456789ABCDEF0
    other = fp
    for f in flips:
        other ^= 1 << f
    signed = [x - (1 << 64) if x >> 63 else x for x in (fp, other)]
    nodes = spark.createDataFrame([(x, [x], [x]) for x in signed], "node long, fps array<long>, proof array<long>")
    assert op.links(nodes, op.EXACT_2, 2).distinct().count() == 1
    assert op.links(nodes, op.EXACT_2, len(flips) - 1).count() == 0


def test_spark_hash_is_the_same_function(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("un deux trois"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"un deux trois", 42)


def test_large_run_emits_a_spanning_star():
    r = np.random.default_rng(1)
    proof = (np.uint64(0xABCDEF) ^ (np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)))[:, None]
    edges = sum(len(near) for _, near in op._stars(np.arange(3000), proof, 2))
    assert edges == 2999


def jaccard(a, b):
    s = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_are_dropped_and_others_stay(spark):
    r = random.Random(9)
    words = ["m%d" % i for i in range(2000)]
    base = [[r.choice(words) for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for c in range(2):
            x = list(w)
            for _ in range(3):
                x[r.randrange(300)] = r.choice(words)
            rows.append((100 + 2 * i + c, " ".join(x)))
    rows += [(500, ""), (501, "short text"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "fr") for i, t in rows], "doc_id long, text string, lang string")
    kept = op.drop_near_copies(df)
    assert kept.columns == df.columns
    ids = {x["doc_id"] for x in kept.collect()}
    assert set(range(40)) | {500, 501, None} <= ids
    texts = dict(rows)
    planted = [i for i in texts if i and 100 <= i < 500 and jaccard(texts[i], texts[(i - 100) // 2]) >= 0.8]
    assert len(planted) > 70 and len(set(planted) & ids) <= 0.03 * len(planted)


@pytest.mark.parametrize("f", [op.simhash_groups, op.drop_near_copies])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0
