"""Language ID by words first, then shorter and shorter character n-grams.

Training counts words of each language over labelled texts and keeps a bounded model: the ``MAX_WORDS`` most frequent
words and the ``MAX_GRAMS`` most frequent n-grams, each with its log frequency in every language. A known word is scored
by those; an unseen word by the n-grams of the greatest length of which the model knows one, down to single letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm.common import cache_of, sampled

#: The classifier is fitted on a sample of about so many labelled documents, chosen by a hash of doc_id.
MAX_DOCS = 5_000
MAX_WORDS, MAX_GRAMS, LONGEST = 50_000, 50_000, 5
#: Words beyond this count as so many in the score, so that the score of a long text isn't always 1.
SCORE_WORDS = 20
#: Words and their scores that a worker keeps; emptied when full.
CACHE_WORDS = 300_000
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(found: list[str]) -> bool:
    return any(c.isalpha() for word in found for c in word)


@dataclass
class Model:
    """Log frequencies in each language (columns) of the known words and n-grams (rows)."""

    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray

    def score(self, word: str) -> np.ndarray:
        """A known word's log frequencies; else the mean of those of the longest n-grams known, zeros if no letter is."""
        at = self.words.get(word)
        if at is not None:
            return self.word_rows[at]
        marked, get = f"<{word}>", self.grams.get
        for n in range(min(LONGEST, len(marked)), 0, -1):
            known = [at for i in range(len(marked) - n + 1) if (at := get(marked[i : i + n])) is not None]
            if known:
                return np.add.reduce(self.gram_rows.take(known, axis=0)) / len(known)
        return np.zeros(len(self.languages))


class Scores(dict):
    """Word -> row of a table of scores, filled on first sight."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.rows = np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.model.score(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not has_letter(found) or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self) > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
        total = self.rows[at].sum(axis=0) * min(1.0, SCORE_WORDS / len(found))
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.languages[best], float(odds[best] / odds.sum())


def scores_of(key: tuple, model: Model) -> Scores:
    """The worker's scores, with the words that its earlier tasks have met; those of one model are kept at a time."""
    kept = cache_of("langid")
    if key not in kept:
        kept.clear()
        kept[key] = Scores(model)
    return kept[key]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def emit(counts: Counter) -> pa.RecordBatch:
    """The counts as a batch (lang, item, n); they start anew."""
    out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "item", "n"])
    counts.clear()
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word, n in Counter(words(text)).items():
                counts[lang, word] += n
            if len(counts) > CACHE_WORDS:
                yield emit(counts)
    yield emit(counts)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character n-grams of counted words, 1 to LONGEST long, with marks at the ends of a word."""
    counts: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for lang, word, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n"))):
            marked = f"<{word}>"
            for n in range(1, min(LONGEST, len(marked)) + 1):
                for i in range(len(marked) - n + 1):
                    counts[lang, marked[i : i + n]] += times
            if len(counts) > CACHE_WORDS:
                yield emit(counts)
    yield emit(counts)


COUNTS = "lang string, item string, n long"


def merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "item").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[pa.Table, dict[str, int]]:
    """The items of the highest count with their counts by language (item, lang, n), and the totals of the languages.

    The items come as Arrow columns: as many Row objects would stay with the driver's memory.
    """
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    items = counts.groupBy("item").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    best = items.orderBy(F.desc("all"), "item").limit(most).select("item", F.explode("by").alias("x"))
    return best.select("item", "x.lang", "x.n").toArrow(), totals


def log_frequencies(rows: pa.Table, languages: list[str], totals: dict[str, int], smooth: float) -> tuple[dict[str, int], np.ndarray]:
    """Rows of a table for each item, and the table."""
    names = sorted(pc.unique(rows["item"]).to_pylist())
    counts = np.zeros((len(names), len(languages)))
    at = [pc.index_in(rows[c], value_set=pa.array(known, pa.string())).to_numpy() for c, known in (("item", names), ("lang", languages))]
    counts[at[0], at[1]] = rows["n"].to_numpy()  # each pair comes once
    total = np.array([totals.get(lang, 0) for lang in languages], dtype=float) + smooth * len(names)
    return {item: i for i, item in enumerate(names)}, np.log((counts + smooth) / np.maximum(total, 1e-9))


def train(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model from the columns doc_id, text and lang; rows with a null in text or lang teach nothing.

    No such row gives a model without languages, which predicts ``und``.
    """
    usable = labelled.filter("text is not null and lang is not null").select("doc_id", "lang", "text")
    n = usable.count()
    usable = sampled(usable, "doc_id", "langid", max_docs, n)
    counted = merged(usable.select("lang", "text").mapInArrow(count_words, COUNTS)).persist()
    grams = merged(counted.mapInArrow(count_grams, COUNTS)).persist()
    try:
        known, totals = most_frequent(counted, MAX_WORDS)
        known_grams, gram_totals = most_frequent(grams, MAX_GRAMS)
    finally:
        counted.unpersist()
        grams.unpersist()
    languages = sorted(totals)
    if n and not languages and usable.isEmpty():
        raise ValueError("the sample of labelled documents is empty")
    return Model(languages, *log_frequencies(known, languages, totals, 0.5), *log_frequencies(known_grams, languages, gram_totals, 0.5))


def sharing(spark: SparkSession, model: Model) -> tuple[Broadcast, tuple]:
    """The model for the tasks, bounded by MAX_WORDS and MAX_GRAMS, and the key under which workers keep its scores."""
    shared = spark.sparkContext.broadcast(model)
    return shared, (spark.sparkContext.applicationId, shared._jbroadcast.id())


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone; ``und`` and 0 for a text that is null or has no letter.

    Languages with equal scores: the first in alphabetical order. Repeated rows each have a row.
    """
    shared, key = sharing(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scores_of(key, shared.value)
        for batch in batches:
            found = [scores.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the documents outside the held-out quarter, applied to all."""
    model = train(documents.filter(~held_out()))
    return predict(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is recognised with a score of ``least`` or more, all columns; duplicates of a row stay.

    Each row is judged by its own text, whatever its doc_id.
    """
    shared, key = sharing(documents.sparkSession, train(documents.filter(~held_out())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scores_of(key, shared.value)
        for batch in batches:
            found = [scores.predict(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
