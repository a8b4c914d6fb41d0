import random

from folio.llm import simhash as op
from tests.llm.test_simhash import groups


def edited(r, words, kind, n):
    """A copy with n words changed one by one, or a block of n words added or removed."""
    x = list(words)
    if kind == "scattered":
        for at in r.sample(range(len(x)), n):
            x[at] = f"n{r.randrange(9**9)}"
        return x
    at = r.randrange(len(x) - n)
    return x[:at] + [f"n{r.randrange(9**9)}" for _ in range(n)] + x[at:] if kind == "added" else x[:at] + x[at + n :]


def test_equals_brute_force_at_the_threshold(spark):
    r = random.Random(3)
    common = [f"line{i}" for i in range(12)]
    rows = []
    for _ in range(40):
        words = common + [f"m{r.randrange(3000)}" for _ in range(r.randint(5, 200))]
        rows.append(words)
        for kind, share in (("scattered", 0.022), ("scattered", 0.04), ("added", 0.1), ("added", 0.19), ("added", 0.3), ("removed", 0.1), ("removed", 0.3)):
            rows.append(edited(r, words, kind, max(1, int(share * len(words)))))
    rows = list(enumerate(" ".join(w) for w in r.sample(rows, len(rows))))
    texts = dict(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    near = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) > 60
    low = groups(sorted(texts), lambda a, b: (min(a, b), max(a, b)) in near)
    kept = op.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i in texts if low[i] == i)


def test_chains_are_followed(spark):
    """Each text is like the next one only."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[15 * i : 15 * i + 150])) for i in range(16)]
    sets = op.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5, "doc_id", "text")
    got = {r["node"]: r["component"] for r in op.near_copies(sets, 0.8).collect()}
    assert len(got) == 16 and len(set(got.values())) == 1


def test_a_large_group_of_edited_copies(spark):
    """150 copies of one text, each edited by itself, so that many pairs are not similar but by way of others; recall over similar pairs."""
    r = random.Random(11)
    base = [f"b{r.randrange(10**6)}" for _ in range(160)]
    rows = [(0, base)] + [(i, edited(r, base, r.choice(["scattered", "added", "removed"]), r.randint(1, 5))) for i in range(1, 150)]
    rows += [(1000 + i, base[:40] + [f"u{r.randrange(10**6)}" for _ in range(200)]) for i in range(60)]  # one passage in texts of their own
    texts = {i: " ".join(w) for i, w in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    near = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    low = groups(sorted(texts), lambda a, b: (min(a, b), max(a, b)) in near)
    kept = {x["doc_id"] for x in op.drop_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {1000 + i for i in range(60)} <= kept
    want = {i for i in texts if low[i] == i}
    assert want <= kept and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_no_similar_pair_is_missed_where_many_texts_share_keys(spark):
    """250 texts, each an edited copy of an earlier one with few words to choose from; 3 that have to go stayed when only hubs of large keys met the others."""
    r = random.Random(1)
    docs = [[f"b{k}" for k in range(160)]]
    for _ in range(249):
        words = list(r.choice(docs))
        for at in r.sample(range(160), r.randint(2, 5)):
            words[at] = f"v{at}x{r.randrange(3)}"
        docs.append(words)
    texts = {i: " ".join(w) for i, w in enumerate(r.sample(docs, len(docs)))}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(156)} for i, t in texts.items()}
    near = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    low = groups(sorted(texts), lambda a, b: (min(a, b), max(a, b)) in near)
    kept = op.drop_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == [i for i in sorted(texts) if low[i] == i]


def test_keys_are_parted_into_blocks(spark, monkeypatch):
    """All pairs of a key that fit meet once, also when its rows are dealt into blocks; sizes that can't be similar don't."""
    monkeypatch.setattr(op, "MEET", 3)
    rows = [(key, node, 20 if node < 12 else 100, 0, 1, node % 5) for key in (7, 8, 9, 10) for node in range(14)]
    left = op.open_runs(spark.createDataFrame(rows, "key long, node long, size int, pos int, degree long, component long"))
    assert {r["blocks"] for r in left.collect()} == {5}
    got = [tuple(x) for x in op.rest_pairs(left, 0.8).collect()]
    want = {(a, b) for a in range(14) for b in range(a + 1, 14) if a % 5 != b % 5 and (a < 12) == (b < 12)}
    assert len(got) == len(want) and set(got) == want
