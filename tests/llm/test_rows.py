import pytest

from folio.llm.exact_dedup import drop_exact_copies
from folio.llm.language_id import drop_unidentified
from folio.llm.mixing import mixed_documents
from folio.llm.simhash import drop_near_copies

SCHEMA = "doc_id long, text string, lang string"


def text(k):
    return " ".join(f"word{'abcdefghij'[k]}{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated ids with different texts, copies of some under other ids."""
    rows = [(None, text(i)) for i in range(4)] + [(7, text(i)) for i in range(4, 8)] + [(8, text(0)), (9, text(4)), (None, "123 456"), (7, "99"), (None, None)]
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_language_judges_each_row(docs):
    want = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] and "word" in r["text"]]
    assert kept(drop_unidentified(docs)) == sorted(want, key=str)


def test_exact_keeps_one_row_of_each_text(docs):
    want = [(8, text(0)), (9, text(4)), (None, "123 456"), (7, "99"), (None, None)] + [(None, text(i)) for i in (1, 2, 3)] + [(7, text(i)) for i in (5, 6, 7)]
    assert kept(drop_exact_copies(docs)) == sorted(want, key=str)


def test_near_drops_the_copy_alone(spark):
    rows = [(None, text(i)) for i in range(3)] + [(7, text(i)) for i in range(3, 6)] + [(8, text(0) + " more"), (6, text(3) + " more"), (7, text(5) + " more")]
    got = kept(drop_near_copies(spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)))
    # of rows 7 that are alike one stays; (None, 0) goes for 8, (7, 3) for 6
    assert [x for x in got if x[1] not in (text(5), text(5) + " more")] == sorted([(None, text(1)), (None, text(2)), (7, text(4)), (8, text(0) + " more"), (6, text(3) + " more")], key=str)
    assert len(got) == 6


@pytest.mark.parametrize("stage", [drop_unidentified, drop_exact_copies, drop_near_copies, mixed_documents])
def test_columns_of_any_name_are_kept_as_they_are(spark, stage):
    """Other columns may have the names that stages use for themselves; rows keep their values."""
    names = ["shard", "__id", "__n", "__i", "at", "__sha", "__r1", "rank", "node", "key", "source"]
    rows = [(i, text(i % 8), "en", *[f"{c}{i}" for c in names[:-1]], "s") for i in range(16)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    got = stage(df)
    assert got.columns == df.columns and set(map(tuple, got.collect())) <= set(rows)
