"""Quality scores by Bradley-Terry ranking of preference pairs.

Each labelled good document is preferred to some labelled bad ones; the weights
maximise the likelihood of these preferences under a logistic law of the difference
of features. A document's score follows from the weighted sum of its own features,
shifted so that the threshold stands at the quantile of the labelled scores that
parts off the share of bad documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, text_or_empty

FEATURES = ("upper", "symbols", "bars", "marks", "digits", "spaces", "lines", "repeats", "distinct", "lines_distinct", "word_length", "long_words", "words_log")
THRESHOLD = 0.7
_UPPER, _LETTERS = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_LETTERS[65:91] = _LETTERS[97:123] = 1
_DIGITS = np.zeros(256)
_DIGITS[48:58] = 1


def _chars(s: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(s.encode())] = 1
    return out


_SYMBOLS, _BARS, _MARKS, _SPACES, _LINES = map(_chars, ("#$%&*+/<=>@\\^_`{}~[]", "|", "!?", " \t\r\n", "\n"))


def features(text: str) -> list[float]:
    """Shape of a text: shares of kinds of characters, repetition, lengths. Empty texts have zeros."""
    raw = text.encode()
    words = raw.lower().split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(kinds @ _UPPER) / max(1.0, float(kinds @ _LETTERS)),
        min(1.0, float(kinds @ _SYMBOLS) / n),
        min(1.0, float(kinds @ _BARS) / n),
        min(1.0, float(kinds @ _MARKS) / n),
        float(kinds @ _DIGITS) / size,
        float(kinds @ _SPACES) / size,
        min(1.0, float(kinds @ _LINES) / n),
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n**0.9,
        len(set(lines)) / len(lines),
        min(40.0, float(lengths.mean())) / 10,
        float((lengths > 20).mean()),
        float(np.log1p(n)) / 10,
    ]


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x): the features of each row's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(rows, pa.list_(pa.float64()))], ["i", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(run, "i long, x array<double>").withColumnRenamed("i", id_col)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    cut: float
    width: float

    def raw(self):
        """A Column: the weighted sum of column x."""
        return sum((F.col("x")[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self):
        """A Column: the score of column x, THRESHOLD at the cut."""
        raw = self.raw()
        at = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return 1 / (1 + F.exp(-((raw - self.cut) / self.width + at)))


def fit(good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float = 1e-3, rounds: int = 30) -> Model:
    """Weights from ``pairs`` preferences of good over bad rows, by Newton's method."""
    if not len(good) or not len(bad):
        return Model((0.0,) * len(FEATURES), -1.0, 1.0)  # nothing to compare: every score is above the threshold
    both = np.concatenate([good, bad])
    scale = np.maximum(both.std(axis=0), 1e-6)
    rng = np.random.default_rng(7)
    d = (good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), d.T @ (1 - p) / len(d) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    w = w / scale
    raw = np.sort(both @ w)
    k = len(bad)
    cut_at = (raw[k - 1] + raw[min(k, len(raw) - 1)]) / 2
    return Model(tuple(map(float, w)), float(cut_at), float(max(1e-9, raw.std())) / 4)


def train(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = 20_000, pairs: int = 40_000) -> Model:
    """Fit weights on at most ``most`` labelled rows of each label (a fixed sample by hash), and the cut on all, never on held-out ones."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_l"), F.col("quality").cast("int").alias("q"))
    joined = cut(x.join(known, F.col(id_col) == F.col("_l")).select("x", "q", F.xxhash64(id_col).alias("h")))
    sides = []
    for label in (1, 0):
        rows = joined.where(F.col("q") == label).orderBy("h").limit(most).select("x").collect()
        sides.append(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)))
    model = fit(*sides, pairs)
    counts = {r["q"]: r["count"] for r in joined.groupBy("q").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if max(good, bad) <= most or not good or not bad:
        return model  # fitted on all of them
    # The share of bad rows and the scores that set the cut are those of all labelled rows.
    raw = cut(joined.where(F.col("q").isin(0, 1)).select(model.raw().alias("raw")))
    low, high = _ranked(raw, bad - 1), _ranked(raw, min(bad, good + bad - 1))
    return Model(model.weights, (low + high) / 2, max(1e-9, raw.agg(F.stddev_pop("raw")).first()[0]) / 4)


def _ranked(rows: DataFrame, k: int, bins: int = 1000, few: int = 1000) -> float:
    """The value of rank ``k`` (from 0) of column raw, exactly: by counts in ever narrower bins."""
    while True:
        low, high, n = rows.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
        if n <= few or not low < high:
            return sorted(r["raw"] for r in rows.limit(few).collect())[k] if n <= few else low
        at = F.least(F.lit(bins - 1), F.floor((F.col("raw") - low) / (high - low) * bins))
        counts = {r["b"]: r["count"] for r in rows.groupBy(at.alias("b")).count().collect()}
        for b in sorted(counts):
            if k < counts[b]:
                break
            k -= counts[b]
        rows = rows.where(at == b)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col``, held_out, score, predicted (1 from THRESHOLD on).

    Null and empty texts have a score too. Repeated rows get equal scores. A null id is
    not held out and has no label. Without labels of both kinds every score is above
    the threshold. An empty table gives no rows; only the text decides a score.
    """
    x = cut(with_features(docs, id_col, text_col))
    score = train(x, labels, id_col).score()
    return x.select(id_col, held_out(id_col).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model, fitted on the labels of these very rows, scores at THRESHOLD or more.

    Features are computed a second time beside the rows, so no text is shuffled or sent twice, and each
    row is judged by its own text whatever its id. Nulls, repeated rows and empty tables
    as in ``score_documents``; all columns are kept, the text as a string.
    """
    model = train(cut(with_features(docs, id_col, text_col)), labels, id_col)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string")).select(F.struct(*docs.columns).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column("own").field(text_col)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(found, pa.list_(pa.float64()))], ["own", "x"])

    scored = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, x array<double>")
    return scored.where(model.score() >= THRESHOLD).select(*[F.col("own")[c].alias(c) for c in docs.columns])


def op8_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; nulls, repeated rows and empty tables as in ``score_documents``."""
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
