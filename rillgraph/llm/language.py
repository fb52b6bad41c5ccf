"""Language identification (operator 6).

Word-first backoff. A word the model knows scores by its log frequency in each
language. A word it doesn't know is scored by its character n-grams, the
longest length of which any n-gram is known, from ``max_gram`` down to one.
A document's score for a language is the mean over its words; the prediction
is the best language, its ``score`` the softmax share at ``sharpness`` words'
worth of evidence.

Defined results. A null text, or one without letters, is `und` with score 0.
With an empty training set all documents are `und`. Ties go to the language
that sorts first. Rows without a language, and empty texts, teach nothing.
Repeated rows are judged one by one; only the named columns are looked at.

Scale: the training sample is bounded by ``max_train`` documents (expected
number, chosen by a hash of their ids), and the model with it: it holds every word and
n-gram that the sample has ``min_count`` times, a broadcast of some tens of MB.
Prediction is one pass over the text without a shuffle; a word is scored once a batch.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled documents of the fit at most, and the longest n-grams.
MAX_TRAIN, MAX_GRAM = 20_000, 4
#: A word seen so many times in the sample counts as known.
MIN_COUNT = 2
#: Memory of unseen words that one task keeps.
MEMO = 100_000

UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model(NamedTuple):
    """Log frequencies by language for words and for n-grams of each length; it travels as a plain tuple."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: list[dict[str, int]]
    gram_logs: list[np.ndarray]


def unseen(model: tuple, word: str) -> np.ndarray:
    """Backoff: the longest n-grams of which any is known."""
    langs, _, _, grams, gram_logs = model
    for n in range(len(grams), 0, -1):
        known, logs = grams[n - 1], gram_logs[n - 1]
        if found := [i for g in grams_of(word, n) if (i := known.get(g)) is not None]:
            return logs[found].mean(axis=0)
    return np.zeros(len(langs), np.float32)


def predict(model: tuple, texts: list[str | None], memo: dict[str, np.ndarray], sharpness: float) -> list[tuple[str, float]]:
    """Language and score of each text. Each distinct word is looked up once; texts take sums over its rows."""
    langs, known, word_logs, _, _ = model
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    listed = [np.fromiter(map(number.__getitem__, words_of(t)), np.int64) for t in texts]
    out = [(UNDETERMINED, 0.0)] * len(texts)
    some = [i for i, words in enumerate(listed) if len(words)]
    if not some or not langs:
        return out
    at = np.fromiter((known.get(w, -1) for w in number), np.int64, len(number))
    rows = np.empty((len(number), len(langs)), np.float32)
    rows[at >= 0] = word_logs[at[at >= 0]]
    for k, w in [(k, w) for k, (w, i) in enumerate(zip(number, at.tolist(), strict=True)) if i < 0]:
        if (v := memo.get(w)) is None:
            if len(memo) >= MEMO:
                memo.clear()
            v = memo[w] = unseen(model, w)
        rows[k] = v
    for i in some:
        words = listed[i]
        s = rows[words].sum(axis=0, dtype=np.float64) / len(words) * min(len(words), sharpness)
        e = np.exp(s - s.max())
        best = int(s.argmax())
        out[i] = langs[best], float(e[best] / e.sum())
    return out


def _logs(keys: list[str], counts: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Add-half log frequencies (keys by languages), centred over languages."""
    if not keys:
        return {}, np.empty((0, counts.shape[1]), np.float32)
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(keys)))
    return {k: i for i, k in enumerate(keys)}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, *, max_train: int = MAX_TRAIN, max_gram: int = MAX_GRAM, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled documents; Spark counts, the driver gets bounded tables."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.count()
    sample = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    if n > max_train:
        sample = sample.where(F.pmod("h", F.lit(1 << 32)) < int((1 << 32) * max_train / n))
    found = arrow_map(sample.select("lang", "text"), _count_words, "lang string, word string, n long")
    counts = found.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    try:
        langs = sorted(r[0] for r in counts.select("lang").distinct().toLocalIterator())
        tables = [_logs(*_known(counts.withColumnRenamed("word", "key"), langs, min_count))]
        for n in range(1, max_gram + 1):
            padded = F.concat(F.lit(" "), "word", F.lit(" ")) if n > 1 else F.col("word")
            size = F.length(padded) - n + 1
            grams = (
                counts.withColumn("padded", padded)
                .where(size > 0)
                .select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.col("padded").substr(i, F.lit(n)))).alias("key"))
                .groupBy("lang", "key")
                .agg(F.sum("n").alias("n"))
            )
            tables.append(_logs(*_known(grams, langs, min_count)))
    finally:
        counts.unpersist()
    return Model(langs, tables[0][0], tables[0][1], [t[0] for t in tables[1:]], [t[1] for t in tables[1:]])


def _known(counts: DataFrame, langs: list[str], min_count: int) -> tuple[list[str], np.ndarray]:
    """Keys seen often enough, in order, and their counts by language; as many as the sample has."""
    by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)]
    found = counts.groupBy("key").agg(F.sum("n").alias("all"), *by_lang).where(F.col("all") >= min_count).drop("all").toArrow().sort_by("key")
    columns = [found.column(f"c{i}").to_numpy() for i in range(len(langs))]
    return found.column("key").to_pylist(), np.column_stack(columns).astype(np.float64) if columns else np.empty((0, 0))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in words_of(text):
                key = (lang, w)
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])


def identify(docs: DataFrame, model: Model, *, sharpness: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for batch in batches:
            found = predict(shared.value, batch.column(1).to_pylist(), memo, sharpness)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[batch.schema.field(0).name, "lang_pred", "score"])

    return arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, *, min_score: float = 0.0, sharpness: float = 20.0, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with a language and at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for batch in batches:
            found = predict(shared.value, batch.column(batch.schema.get_field_index(text_col)).to_pylist(), memo, sharpness)
            yield batch.filter(pa.array([f[0] != UNDETERMINED and f[1] >= min_score for f in found], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
