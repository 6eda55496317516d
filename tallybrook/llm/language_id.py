"""Language identification with spans for mixed text.

Method: a word's script, by code point ranges, narrows the languages it may have; byte trigrams give
a log probability per language and word; a Viterbi pass with a penalty for each switch labels the
words. Runs of equal labels are the spans; the language with most letters is the text's.

Training counts the trigrams of about `TRAIN_DOCS` labelled texts a language, all where it has fewer,
taken by a hash of the id, so the model's size and cost do not depend on the corpus.

Cases: a null text, or one without letters, is `und` with score 0 and no spans; with no labelled
rows every text is `und`; ties fall to the language that sorts first; words without letters follow
their neighbours; null labels are not learned from; repeated rows count as often as they stand;
further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import arrow_map, schema_with, slices
from tallybrook.llm.textarrays import gram_buckets, joined, ranges, segment_sums, word_spans

TRAIN_DOCS = 20_000  # of a language
BITS = 16
PENALTY = 8.0  # nats for a switch of language
MIN_SHARE = 0.02  # of a language's letters, for a script to be its own
# First code points of script ranges and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"),
    (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS], np.uint8)


@lru_cache(1 << 16)
def _is_letter(code: int) -> bool:
    return unicodedata.category(chr(code))[0] == "L"


def letters(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where letters begin in UTF-8, and the script of each."""
    lead = buffer >= 0xC2
    at = np.flatnonzero(((buffer | 0x20) - np.uint8(97) < 26) | lead)
    codes = np.full(len(at), 97, np.int64)
    wide = np.flatnonzero(lead[at])
    b = [buffer[np.minimum(at[wide] + k, len(buffer) - 1)].astype(np.int64) for k in range(4)]
    two, three = (b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
    four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
    codes[wide] = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
    kinds, place = np.unique(codes[wide], return_inverse=True)
    keep = np.ones(len(at), bool)
    keep[wide] = np.array([_is_letter(int(c)) for c in kinds], bool)[place]
    return at[keep], _SCRIPT[np.searchsorted(_FIRST, codes[keep], "right") - 1]


class Words:
    """Words of a batch: spans, letters, scripts, and the trigrams of each."""

    def __init__(self, texts: list[str | None]):
        self.buffer, starts, _ = joined([t and t.lower() for t in texts])
        self.begin, self.end, self.first = word_spans(self.buffer, starts)
        self.count = np.diff(self.first)
        at, script = letters(self.buffer)
        low, high = np.searchsorted(at, self.begin), np.searchsorted(at, self.end)
        self.letters = high - low
        self.script = np.zeros(len(low), np.uint8)
        self.script[high > low] = script[low[high > low]]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Trigram buckets word by word, from the space before to the space behind, and their number."""
        count = np.where(self.letters > 0, self.end - self.begin, 0)
        return gram_buckets(self.buffer, 3, BITS)[ranges(self.begin - 1, count)], count


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts and letters per script (as buckets below 0) by language, summed over a task."""
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        words = Words(batch.column("text").to_pylist())
        grams, count = words.grams()
        per_word = np.repeat(np.arange(len(words.count)), words.count)
        names, code = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        for k, name in enumerate(names):
            own = code[per_word] == k
            total = totals.setdefault(str(name), np.zeros(len(NAMES) + (1 << BITS)))
            total[: len(NAMES)] += np.bincount(words.script[own], words.letters[own], len(NAMES))
            total[len(NAMES) :] += np.bincount(grams[np.repeat(own, count)], minlength=1 << BITS)
    for name, total in totals.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([name] * len(some), pa.string()), "bucket": pa.array(some - len(NAMES)), "n": pa.array(total[some].astype(np.int64))}
        )


def fit(labelled: DataFrame, id_column: str = "doc_id", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities by trigram bucket and language, and which scripts each has."""
    rows = labelled.where("lang is not null and text is not null").select(F.col(id_column).alias("id"), "text", "lang")
    shares = rows.groupBy(F.col("lang").alias("__lang")).agg(F.least(F.lit(1.0), train_docs / F.count("*")).alias("share"))
    drawn = rows.join(F.broadcast(shares), F.col("lang") == F.col("__lang"))  # a row a language
    drawn = drawn.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counts = arrow_map(drawn.select("text", "lang"), _counted, "lang string, bucket bigint, n bigint")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2^16 rows a language
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(NAMES) + (1 << BITS), len(langs)))
    table[found["bucket"].to_numpy(int) + len(NAMES), found["lang"].map({n: k for k, n in enumerate(langs)}).to_numpy(int)] = found["n"]
    scripts, grams = table[: len(NAMES)], table[len(NAMES) :] + 0.5
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    return langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), shares >= MIN_SHARE


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each row of `scores`, for sequences that begin at `first` (with the end)."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, ordered = first[:-1][order], count[order]
    live = np.searchsorted(-ordered, -np.arange(1, (ordered[0] if len(ordered) else 0) + 1), "right")
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.uint8)  # the label to come from, after a switch
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for t, n in enumerate(live):
        at = begin[:n] + t
        if t:
            top = value[:n].argmax(axis=1)
            jump = np.take_along_axis(value[:n], top[:, None], 1) - np.float32(penalty)
            best[at], stay[at] = top, value[:n] >= jump
            np.maximum(value[:n], jump, out=value[:n])
        value[:n] += scores[at]
    labels = np.zeros(len(scores), np.uint8)
    state = value.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        state[:n] = np.where(stay[at, state[:n]], state[:n], best[at])
    return labels


def label_words(words: Words, table: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    grams, count = words.grams()
    scores = segment_sums(table[grams], np.cumsum(count) - count, count)
    allowed = scripts[words.script] & (words.letters > 0)[:, None]
    scores[~allowed & allowed.any(axis=1)[:, None]] = -1e4
    scores -= scores.max(axis=1, keepdims=True, initial=-1e9) if len(scores) else 0
    return viterbi(scores, words.first)


SPANS = "array<struct<first_word: int, words: int, lang: string>>"


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str | Column]) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred, score and spans; `docs` needs `text`."""
    langs, table, scripts = model
    shared = docs.sparkSession.sparkContext.broadcast((table, scripts))  # 256 KB a language
    names = pa.array([*langs, "und"], pa.string())
    kept = docs.select(*keep, F.col("text").alias("__text"))
    span_type = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scripts = shared.value
        for batch in slices(batches, "__text"):
            words = Words(batch.column("__text").to_pylist())
            labels = label_words(words, table, scripts) if langs else np.zeros(len(words.begin), np.uint8)
            doc = np.repeat(np.arange(batch.num_rows), words.count)
            width = len(langs) + 1
            sums = np.bincount(doc * width + labels, words.letters, batch.num_rows * width).reshape(-1, width)
            total = sums.sum(axis=1)
            top = np.where((total > 0) & (len(langs) > 0), sums.argmax(axis=1), len(langs))
            score = np.where(top < len(langs), sums[np.arange(len(top)), top] / np.maximum(total, 1), 0.0)
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])
            fresh &= top[doc] < len(langs)
            at = np.flatnonzero(fresh)
            stop = np.minimum(np.append(at[1:], len(doc)), words.first[1:][doc[at]]) if len(at) else at
            parts = pa.StructArray.from_arrays(
                [pa.array((at - words.first[doc[at]]).astype(np.int32)), pa.array((stop - at).astype(np.int32)), names.take(pa.array(labels[at]))],
                fields=list(span_type.value_type),
            )
            offsets = np.searchsorted(doc[at], np.arange(batch.num_rows + 1)).astype(np.int32)
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, names.take(pa.array(top)), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), parts, type=span_type)],
                names=[*(n for n in batch.schema.names if n != "__text"), "lang_pred", "score", "spans"],
            )

    return arrow_map(kept, label, schema_with(kept, f"lang_pred string, score double, spans {SPANS}"))
