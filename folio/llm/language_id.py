"""Language identification by words first, backing off to shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import fresh, materialize, plain, text_id

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Log frequencies by language (rows of equal length, in the order of langs)."""

    langs: list[str]
    words: Mapping[str, np.ndarray]
    grams: Mapping[str, np.ndarray]

    def packed(self) -> Model:
        """The same model with its rows in two matrices, as tasks hold it."""
        return self if isinstance(self.words, Rows) else Model(self.langs, Rows(self.words, len(self.langs)), Rows(self.grams, len(self.langs)))


class Rows(Mapping):
    """Rows by token in one matrix: an array for each would take several times as much of every worker."""

    def __init__(self, rows: Mapping[str, np.ndarray], width: int) -> None:
        self.at = {token: i for i, token in enumerate(rows)}
        self.table = np.array(list(rows.values()), np.float64).reshape(len(rows), width)

    def __getitem__(self, token: str) -> np.ndarray:
        return self.table[self.at[token]]

    def __contains__(self, token: object) -> bool:
        return token in self.at

    def __iter__(self) -> Iterator[str]:
        return iter(self.at)

    def __len__(self) -> int:
        return len(self.at)


def letters(text: str) -> list[str]:
    """Runs of letters (str.isalpha) in lower case."""
    runs = LETTERS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    # the pattern also takes numerals that aren't decimal digits, such as fractions
    return "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()


def word_grams(word: str, n: int) -> list[str]:
    framed = f"<{word}>" if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 5_000, max_words: int = 30_000, max_grams: int = 100_000) -> Model:
    """Fit on about max_docs rows (all, when fewer), chosen by a hash of id and text; null labels left out.

    Each language has an equal part of max_docs, so rare ones are learned too. Words and
    n-grams are counted by Spark; the most frequent max_words words and max_grams
    n-grams, ties in code point order, form the model, so its size is bounded. Every
    label that a row with letters in the sample has is learned. No labelled rows give a
    model without languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    of = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]) if sizes else F.create_map(F.lit(""), F.lit(1))
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.try_element_at(of, F.col("lang"))) < -(-max_docs // max(1, len(sizes))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found.update((lang, word) for word in letters(text))
            yield _counts(found)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                for order in ORDERS:
                    for g in word_grams(word, order):
                        found[lang, g] += n
            yield _counts(found)

    schema = "lang string, token string, n long"
    counted = sample.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "token").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "words")
    grams_of = counted.mapInArrow(split, schema)
    top = []
    for kind, rows, most in (("w", counted, max_words), ("g", grams_of, max_grams)):
        by = rows.groupBy("token", "lang").agg(F.sum("n").alias("n")).groupBy("token").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        top += [(kind, r["token"], r["by"]) for r in by.orderBy(F.desc("total"), "token").limit(most).collect()]
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    total: Counter = Counter()
    size: Counter = Counter()
    order = lambda kind, token: kind if kind == "w" else len(token)
    for kind, token, by in top:
        size[order(kind, token)] += 1
        for lang, n in by.items():
            total[order(kind, token), lang] += n
    words: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    for kind, token, by in top:
        k = order(kind, token)
        row = [math.log((by.get(lang, 0) + 0.5) / (total[k, lang] + 0.5 * size[k])) for lang in langs]
        (words if kind == "w" else grams)[token] = np.array(row)
    return Model(langs, words, grams)


def _counts(found: Counter) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "token", "n"])


def score_word(model: Model, word: str) -> np.ndarray | None:
    """Log frequencies of a known word; else the mean over its n-grams of the longest
    order of which any is known; None when not even a letter is known."""
    if (known := model.words.get(word)) is not None:
        return known
    for n in ORDERS:
        if found := [model.grams[g] for g in word_grams(word, n) if g in model.grams]:
            return np.mean(found, axis=0)
    return None


class Scorer:
    """Predictions with the scores of words met so far in one matrix, a row for each."""

    def __init__(self, model: Model, most: int = 150_000) -> None:
        self.model, self.most = model.packed(), most
        self._reset()

    def _reset(self) -> None:
        known = self.model.words.table
        self.row = self.model.words.at.copy()
        self.table = np.zeros((len(known) + 4096, len(self.model.langs)))
        self.table[: len(known)] = known

    def _add(self, word: str) -> int:
        if len(self.row) == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        i = self.row[word] = len(self.row)
        score = score_word(self.model, word)
        if score is not None:
            self.table[i] = score
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(letters(text or ""))
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.row) > self.most:
            self._reset()
        get = self.row.get
        at = [i if (i := get(w)) is not None else self._add(w) for w in words]
        total = np.fromiter(words.values(), np.float64, len(words)) @ self.table[at]
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.langs[best], round(float(p[best] / p.sum()), 6)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row, from the whole text alone.

    `und` with score 0 for a null text, a text without letters, or a model without
    languages. score is the posterior of the predicted language under equal priors;
    ties go to the first language in code point order. Repeated rows get equal
    results; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            made = [scorer.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [id_col, "lang_pred", "score"])

    rows = plain(docs, id_col, text=text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def learned_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text isn't 1 modulo 3."""
    return docs.where((F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3) != 1)


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of docs whose language is identified with a score of at least least, all columns.

    Rejected are texts without letters and texts whose words speak for no language.
    Each row is judged by its own text, whatever its id. Where no row has a label, no
    language is known and only texts without letters are rejected. Only the hashes of
    rejected texts come back from Python; they are written, which gives it few texts at a
    time whoever reads the rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(learned_rows(docs)).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        # by slices, as a batch of whole texts is large
        for b in chain.from_iterable((whole.slice(i, 512) for i in range(0, len(whole), 512)) for whole in batches):
            texts = b.column(1).to_pylist()
            if scorer.model.langs:
                kept = [lang != UNKNOWN and score >= least for lang, score in map(scorer.predict, texts)]
            else:
                kept = [bool(letters(t)) for t in texts]
            yield b.select([0]).filter(pa.array([not k for k in kept], pa.bool_()))

    (sha,) = fresh(docs, "rejected")
    rows = plain(docs, text="text").select(text_id(F.col("text")).alias(sha), "text")
    rejected = materialize(rows.mapInArrow(run, f"{sha} string").distinct(), "rejected")
    return docs.join(rejected, text_id(docs["text"]) == rejected[sha], "left_anti")
