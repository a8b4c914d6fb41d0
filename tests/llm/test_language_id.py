import random

from folio.llm import language_id as op

WORDS = {"en": "the of and to in is that for with this house water".split(), "fr": "le la les des et est dans pour avec cette maison eau".split(), "de": "der die das und ist nicht mit für dieses haus wasser".split()}


def corpus(n=240):
    r = random.Random(3)
    return [(i, " ".join(r.choice(WORDS[k]) for _ in range(r.randint(3, 40))), k) for i in range(n) for k in [r.choice(list(WORDS))]]


def model(spark, rows):
    return op.fit(op.learned_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")))


def test_held_out_accuracy_and_columns(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, k, 0.5) for i, t, k in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in op.identify(df, model(spark, rows)).collect()}
    lang = {i: k for i, _, k in rows}
    assert sum(got[i]["lang_pred"] == lang[i] for i in lang) >= 0.98 * len(lang)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_prediction_ignores_labels_and_learns_from_the_right_rows(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    assert {r["doc_id"] for r in op.learned_rows(df).collect()} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    m = model(spark, rows)
    other = spark.createDataFrame([(i, t, "xx") for i, t, _ in rows], "doc_id long, text string, lang string")
    assert op.identify(df, m).exceptAll(op.identify(other, m)).count() == 0


def test_backoff_goes_from_long_to_short_grams(spark):
    m = model(spark, corpus())
    assert op.score_word(m, "maison") is m.words["maison"]
    unseen = op.score_word(m, "maisons")
    assert m.langs[int(unseen.argmax())] == "fr"
    assert op.score_word(m, "日") is None


def test_undetermined_texts_empty_tables_and_clean_documents(spark):
    rows = corpus() + [(900, None, None), (901, "", "en"), (902, "123 !? _", "fr"), (903, "日本語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in op.identify(df, model(spark, rows)).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903]["lang_pred"] in WORDS and got[903]["score"] < 0.5
    kept = op.drop_unidentified(df)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and not ids & {900, 901, 902, 903}
    assert len(ids) >= 0.99 * (len(rows) - 4)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op.identify(empty, op.fit(empty)).count() == 0
    assert op.Scorer(op.fit(empty)).predict("some text") == ("und", 0.0)


def test_numerals_are_no_letters_and_marks_part_words():
    assert op.letters("½ ² ① ४ 12_3") == []
    assert op.letters("m² Été-x½y") == ["m", "été", "x", "y"]
    assert all(op.letters(chr(c)) == [] for c in range(0x2000) if not chr(c).lower().isalpha() and not chr(c).isalpha())


def test_rare_languages_are_learned_and_no_labels_reject_nothing_with_letters(spark):
    rows = [(i, t, k) for i, t, k in corpus(400)] + [(1000 + i, "talo vesi kissa on ja", "fi") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = op.fit(op.learned_rows(df), max_docs=100)
    assert m.langs == ["de", "en", "fi", "fr"] and op.Scorer(m).predict("kissa on talo")[0] == "fi"
    bare = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (None, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in op.drop_unidentified(bare).collect()] == [1]


def test_score_is_that_of_a_plain_version(spark):
    """Words by their log frequency, others by the longest n-grams of which any is known; all texts, long ones too."""
    import math

    rows = corpus()
    m = model(spark, rows)
    texts = [t for _, t, _ in rows[:30]] + ["maisons hauses waters zzz", "the " * 300_000 + "eau", "x"]

    def word(w):
        if w in m.words:
            return list(m.words[w])
        for n in (5, 4, 3, 2, 1):
            framed = w if n == 1 else "<" + w + ">"
            known = [m.grams[framed[i : i + n]] for i in range(len(framed) - n + 1) if framed[i : i + n] in m.grams]
            if known:
                return [sum(g[k] for g in known) / len(known) for k in range(len(m.langs))]
        return [0.0] * len(m.langs)

    scorer = op.Scorer(m)
    for t in texts:
        total = [0.0] * len(m.langs)
        for w in t.lower().split():
            total = [a + b for a, b in zip(total, word(w))]
        p = [math.exp(x - max(total)) for x in total]
        lang, score = scorer.predict(t)
        assert lang == m.langs[max(range(len(p)), key=lambda k: (total[k], -k))] and abs(score - max(p) / sum(p)) < 2e-6


def test_tasks_hold_the_model_in_matrices():
    """An array for each token takes several times as much of every worker; scores are the same."""
    import pickle
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(1)
    plain = op.Model(["de", "en", "fr"], {f"word{i}": r.random(3) for i in range(3000)}, {f"{i:05}": r.random(3) for i in range(10_000)})

    def held(model):
        data = pickle.dumps(model)
        tracemalloc.start()
        got = pickle.loads(data)
        size = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        return got, size

    got, size = held(op.Scorer(plain).model)
    assert size < 0.75 * held(plain)[1]
    assert list(got.words) == list(plain.words) and list(got.grams) == list(plain.grams)
    for w in ["word7", "a00012b", "00001" * 3, "none"]:
        assert np.array_equal(op.score_word(got, w), op.score_word(plain, w)) or op.score_word(plain, w) is None is op.score_word(got, w)
    assert op.Scorer(got).predict("word7 word8 word9") == op.Scorer(plain).predict("word7 word8 word9")


def test_who_reads_the_kept_rows_runs_no_python(spark):
    """A plain write of a lazy result gave Python 10 000 whole texts at once; copies of a rejected text go under all ids."""
    rows = corpus() + [(i, t, None) for i in (None, 900, 901, 901) for t in (None, "", "12 34")]
    kept = op.drop_unidentified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    assert sorted(map(tuple, kept.collect())) == sorted(corpus())
