"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Method: a text's features are its hashed words and byte 4-grams, each family scaled to unit sum, and
a few ratios. One weight vector is shared by all grades; ordered thresholds cut its score, so that
P(grade > j) = logistic(score - threshold_j). The result is the expected grade and the probability of
each tail, by which texts are selected. Trained by full-batch Adam on about `TRAIN_DOCS` rated texts a
grade, of at most `TRAIN_CHARS` characters, taken by a hash of the id; a grade that is drawn in part
counts as much as all of it, so that a rare grade is learned from and stays rare.

Cases: a null text has the features of an empty one; grades are 0, 1, ... and null grades are not
learned from; a text with several grades counts as the lowest; with fewer than two grades among the
rated rows every text gets that grade (0 without any); a grade between others that nobody gave has
equal thresholds around it; repeated rows score alike; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import arrow_map, schema_with, slices
from tallybrook.llm.textarrays import gram_buckets, joined, ranges, segment_sums, span_hashes, word_spans

TRAIN_DOCS = 1250  # a grade
TRAIN_CHARS = 10_000
BITS = 15
RATIOS = 6
SYMBOLS = np.frombuffer(b"#*$%&|<>!", np.uint8)


def _symbol(buffer: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    table[SYMBOLS] = True
    return table[buffer]


class Features:
    """Buckets of all words and 4-grams of a batch, and the ratios of each text."""

    def __init__(self, texts: list[str | None]):
        buffer, starts, ends = joined(texts)
        begin, end, self.word_first = word_spans(buffer, starts)
        hashes = span_hashes(buffer, begin, end)
        self.words = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        self.word_count = np.diff(self.word_first)
        self.gram_count = np.maximum(ends - starts - 1, 0)  # from the space before to the one behind
        self.gram_first = np.cumsum(self.gram_count) - self.gram_count
        self.grams = gram_buckets(buffer, 4, BITS)[ranges(starts - 1, self.gram_count)]
        doc = np.repeat(np.arange(len(texts)), self.word_count)
        size, n = np.maximum(ends - starts, 1), np.maximum(self.word_count, 1)
        upper, marks = np.cumsum(np.append(0, (buffer >= 65) & (buffer <= 90))), np.cumsum(np.append(0, _symbol(buffer)))
        pairs = np.sort(doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = pairs[1:] != pairs[:-1]
        distinct = np.bincount((pairs[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(texts))
        self.ratios = np.stack(
            [np.ones(len(texts)), np.log1p(self.word_count) / 8, distinct / n, (upper[ends] - upper[starts]) / size, (marks[ends] - marks[starts]) / size, np.minimum(size / n, 50) / 10], axis=1
        )

    def __len__(self) -> int:
        return len(self.word_count)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        word, gram = weights[: 1 << BITS], weights[1 << BITS : 2 << BITS]
        by_word = segment_sums(word[self.words], self.word_first[:-1], self.word_count) / np.maximum(self.word_count, 1)
        by_gram = segment_sums(gram[self.grams], self.gram_first, self.gram_count) / np.maximum(self.gram_count, 1)
        return by_word + by_gram + self.ratios @ weights[2 << BITS :]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the non-zero features, for training."""
        parts = []
        for buckets, first, count, shift in ((self.words, self.word_first[:-1], self.word_count, 0), (self.grams, self.gram_first, self.gram_count, 1 << BITS)):
            for doc in range(len(self)):
                some, n = np.unique(buckets[first[doc] : first[doc] + count[doc]], return_counts=True)
                parts.append((np.full(len(some), doc), some + shift, n / max(count[doc], 1)))
        parts += [(np.arange(len(self)), np.full(len(self), (2 << BITS) + k), self.ratios[:, k]) for k in range(RATIOS)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one less than the grades
    only: float = 0.0  # the grade of every text, where there are no thresholds

    def tails(self, features: Features) -> np.ndarray:
        """P(grade > j) for each text and threshold j."""
        return _logistic(features.scores(self.weights)[:, None] - self.thresholds)


def loss_and_slopes(scores: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood of `grades`, each counted `counts` times, and its slope in each
    text's distance to each threshold."""
    n, levels = len(scores), len(thresholds)
    tails = _logistic(scores[:, None] - thresholds)
    # likelihood of the observed grade: the difference of two neighbouring tails
    padded = np.concatenate([np.ones((n, 1)), tails, np.zeros((n, 1))], axis=1)
    likely = np.maximum(padded[np.arange(n), grades] - padded[np.arange(n), grades + 1], 1e-9)
    d_tail = np.zeros((n, levels + 2))
    d_tail[np.arange(n), grades] += 1 / likely
    d_tail[np.arange(n), grades + 1] -= 1 / likely
    part = counts / counts.sum()
    return float(-(part * np.log(likely)).sum()), -d_tail[:, 1:-1] * tails * (1 - tails) * part[:, None]


def train(texts: list[str], grades: np.ndarray, counts: np.ndarray | None = None, steps: int = 250, rate: float = 0.1, decay: float = 1e-5) -> OrdinalModel:
    """Fit to `texts`; `counts` says how many texts each stands for."""
    grades = np.asarray(grades, int)
    counts = np.ones(len(grades)) if counts is None else np.asarray(counts, float)
    weights = np.zeros((2 << BITS) + RATIOS)
    if len(set(grades.tolist())) < 2:
        return OrdinalModel(weights, np.zeros(0), float(grades[0]) if len(grades) else 0.0)
    row, column, value = Features(texts).counted()
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], column[order], value[order] * 1.0
    levels = int(grades.max())
    share = np.clip([np.average(grades > j, weights=counts) for j in range(levels)], 1e-3, 1 - 1e-3)
    first = -np.log(share[0] / (1 - share[0]))
    gaps = np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2))
    parameters = [weights, np.array([first]), gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for step in range(1, steps + 1):
        thresholds = parameters[1] + np.append(0, np.cumsum(np.exp(parameters[2])))
        scores = np.bincount(row, weights[column] * value, len(texts))
        _, d_linear = loss_and_slopes(scores, thresholds, grades, counts)
        d_threshold = -d_linear.sum(axis=0)
        gradients = [
            np.bincount(column, value * d_linear.sum(axis=1)[row], len(weights)) + decay * weights,
            np.array([d_threshold.sum()]),
            np.array([d_threshold[k + 1 :].sum() for k in range(levels - 1)]) * np.exp(parameters[2]),
        ]
        for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(weights, parameters[1] + np.append(0, np.cumsum(np.exp(parameters[2]))))


def fit(docs: DataFrame, ratings: DataFrame, id_column: str = "doc_id", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> OrdinalModel:
    """Train on a bounded sample of rated texts; `ratings` has the id and `grade`."""
    known = ratings.where("grade is not null").groupBy(id_column).agg(F.min("grade").alias("grade"))
    shares = known.groupBy(F.col("grade").alias("__grade")).agg(F.least(F.lit(1.0), train_docs / F.count("*")).alias("share"))
    drawn = known.join(F.broadcast(shares), F.col("grade") == F.col("__grade")).drop("__grade")  # a row a grade
    draw = F.pmod(F.xxhash64(id_column, F.lit("rated")), F.lit(1 << 30))
    chosen = F.broadcast(drawn.where(draw < F.col("share") * (1 << 30)))  # about train_docs rows a grade
    rows = docs.where(F.length("text") <= train_chars).select(id_column, "text").join(chosen, id_column)
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text")  # one of an id that repeats
    rows = rows.groupBy(id_column).agg(text.alias("text"), F.first("grade").alias("grade"), F.first("share").alias("share")).toPandas()
    rows = rows.sort_values([id_column, "text"])
    return train(rows["text"].tolist(), rows["grade"].to_numpy(), 1 / rows["share"].to_numpy(float))


def rate(docs: DataFrame, model: OrdinalModel, keep: list[str | Column]) -> DataFrame:
    """The columns `keep` of `docs` with `expected_grade` and `tails`; `docs` needs `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB
    kept = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        width = len(model.thresholds)
        for batch in slices(batches, "__text", 4 << 20):
            tails = model.tails(Features(batch.column("__text").to_pylist()))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(model.only + tails.sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(tails.ravel()))],
                names=[*(n for n in batch.schema.names if n != "__text"), "expected_grade", "tails"],
            )

    return arrow_map(kept, run, schema_with(kept, "expected_grade double, tails array<double>"))
