"""Language-model scores from an Elias-Fano n-gram trie, trained on the corpus itself.

The model is a bigram with a Dirichlet prior: p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), where p(w)
is the word's smoothed share. The logarithm of this product falls into a term that depends on how
often v w and w occur, and one that depends on how often v does. So one shuffle by word serves for
counting and for scoring: it brings each word's occurrences, with the word before and the text, to
the shard that counts the word; the shard builds its trie, asks it for each distinct pair, adds up
both terms for each text, and drops it. No model is collected, broadcast or kept whole.

Words that occur often are spread over the shards by the word before, and pairs that do are spread by
the text; their counts come from a pass of their own. Often means half a shard's share of the tokens,
or a 500th if that is less. Which words and pairs these are is judged on a sample; it decides where
they are counted only. A pair that a text repeats is shuffled once for the text, with its count.

Words are identified by 64-bit hashes, and by 32-bit ones as the word before. Probabilities of pairs
are quantised to a byte. p(w) uses the bound of one new word per token instead of the number of
distinct words, which is known only when all shards are done.

Cases: a null text is an empty one and consists of its end; a null id is in no training fold and is
scored as held out; repeated rows count as often as they stand, and each gets the same scores; with
no training text, counts are 0 and scores finite; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import arrow_map, ship_package, slices, staged
from tallybrook.llm.elias_fano import LevelFile, Trie
from tallybrook.llm.textarrays import joined, mixed, span_hashes, word_spans

MU = 20.0
ADD = 0.1
SHARD_TOKENS = 2_000_000
SAMPLE_DOCS = 2000
FREQUENT = 500  # a word or pair with a 500th of the sampled tokens is spread, with many shards also rarer ones
END, START = mixed(np.array([0xE0D, 0xB05], np.uint64))
ROWS = "shard int, kind int, slice bigint, words binary, place binary, before binary, counts binary, train binary, times binary"
PARTS = "kind int, slice bigint, words binary, place binary, before binary, counts binary, train binary"


class Tokens:
    """The words and ends of a batch of texts as hashes, each with its text and the word before."""

    def __init__(self, texts: list[str | None]):
        self.buffer, self.starts, self.ends = joined([(t or "").encode().lower().decode() for t in texts])
        begin, end, first = word_spans(self.buffer, self.starts)
        self.count = np.diff(first) + 1
        last = np.cumsum(self.count) - 1
        self.token = np.empty(len(begin) + len(texts), np.uint64)
        is_end = np.zeros(len(self.token), bool)
        is_end[last] = True
        self.token[is_end], self.token[~is_end] = END, span_hashes(self.buffer, begin, end)
        before = np.append(START, self.token[:-1]).astype(np.uint64) if len(self.token) else self.token
        before[last[:-1] + 1] = START
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.before = (before >> np.uint64(32)).astype(np.uint32)


def _pair_ids(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(token + mixed(before.astype(np.uint64)))


def _tally(words: np.ndarray | None = None, pairs: np.ndarray | None = None):
    """Counts of each slice of texts: kind 0 of all tokens, 1 by word, 2 by pair; of these only `words`
    and `pairs`, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = Tokens(batch.column("text").to_pylist())
            pair = _pair_ids(tokens.token, tokens.before)
            key, n, kind = [np.zeros(1, np.uint64)], [np.array([len(pair)])], [np.zeros(1, np.int32)]
            for k, (ids, wanted) in enumerate([(tokens.token, words), (pair, pairs)], 1):
                found, times = np.unique(ids if wanted is None else ids[np.isin(ids, wanted)], return_counts=True)
                key.append(found)
                n.append(times)
                kind.append(np.full(len(found), k, np.int32))
            arrays = [pa.array(np.concatenate(kind)), pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(n))]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "n"])

    return run


def _tallied(docs: DataFrame, words: np.ndarray | None = None, pairs: np.ndarray | None = None) -> DataFrame:
    return arrow_map(docs.select("text"), _tally(words, pairs), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs that are spread, by a sample of about SAMPLE_DOCS texts: at most FREQUENT of
    each, or two of each for every shard."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = staged(_tallied(sample), "lm-sample")
    total = found.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    shards = math.ceil(total / share / SHARD_TOKENS)
    rows = found.where((F.col("kind") > 0) & (F.col("n") >= max(total / max(FREQUENT, 2 * shards), 2))).collect()
    words, pairs = (np.array(sorted(r["key"] for r in rows if r["kind"] == k), np.int64).view(np.uint64) for k in (1, 2))
    return words, pairs


def exact_counts(train: DataFrame, words: np.ndarray, pairs: np.ndarray) -> tuple[int, dict[int, int], dict[int, int]]:
    """Tokens in all training texts, ends included, and the counts of `words`, of ends and of `pairs`."""
    words = np.union1d(words, np.array([END], np.uint64))
    rows = _tallied(train, words, pairs).collect()  # a row per word and pair that is spread
    counts = [{r["key"] % (1 << 64): r["n"] for r in rows if r["kind"] == k} for k in (0, 1, 2)]
    return sum(counts[0].values()), dict.fromkeys(words.tolist(), 0) | counts[1], dict.fromkeys(pairs.tolist(), 0) | counts[2]


def _scatter(shards: int, spread: np.ndarray, hot: np.ndarray):
    """Cut each slice of texts into one row per shard, and a header row with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = Tokens(batch.column("text").to_pylist())
            buffer, starts, ends, count = tokens.buffer, tokens.starts, tokens.ends, tokens.count
            texts = len(count)
            ids, train = batch.column("id"), batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
            with np.errstate(over="ignore"):
                contents = mixed(span_hashes(buffer, starts, ends) + np.arange(texts, dtype=np.uint64))
                name = int((contents + mixed(ids.fill_null(-1).to_numpy().astype(np.uint64))).sum().view(np.int64)) if texts else 0
            token, before, doc, times = _once_a_text(tokens)
            key = token.copy()
            often = np.flatnonzero(np.isin(token, spread))
            pair = _pair_ids(token[often], before[often])
            with np.errstate(over="ignore"):
                key[often] = np.where(np.isin(pair, hot), mixed(pair + contents[doc[often]]), pair)
            shard = (mixed(key) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(int(np.uint64(name & 0xFFFFFFFF)) % shards, 0, name, ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), b"", count.astype(np.uint32).tobytes(), train.tobytes(), b"")]
            for s in range(shards):
                own = order[bounds[s] : bounds[s + 1]]
                if len(own):
                    distinct, place = np.unique(token[own], return_inverse=True)
                    place = place.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
                    counts = np.bincount(doc[own], minlength=texts).astype(np.uint32)
                    rows.append((s, 1, name, distinct.tobytes(), place.tobytes(), before[own].tobytes(), counts.tobytes(), train.tobytes(), times[own].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return run


_NAMES = ["shard", "kind", "slice", "words", "place", "before", "counts", "train", "times"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]


def _once_a_text(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, word before and text of each pair of a text, text by text, and how often it is there."""
    token, before, doc = tokens.token, tokens.before, tokens.doc
    with np.errstate(over="ignore"):
        order = np.argsort(_pair_ids(token, before) + mixed(doc.astype(np.uint64)))
    same = np.ones(max(len(order) - 1, 0), bool)
    for values in (token, before, doc):
        values = values[order]
        same &= values[1:] == values[:-1]
    first = np.flatnonzero(np.append(True, ~same)[: len(order)])
    times = np.zeros(len(order), np.int64)
    times[order[first]] = np.diff(np.append(first, len(order)))
    at = np.flatnonzero(times)
    return token[at], before[at], doc[at], times[at].astype(np.min_scalar_type(int(times.max(initial=0))))


def _score_shard(total: int, given: dict[int, int], given_pairs: dict[int, int], mu: float):
    """Count one shard, build its trie, and add up the terms of each text."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(0, r.slice, r.words, r.place, b"", r.counts, r.train) for r in rows[rows["kind"] == 0].itertuples()]
        own = rows[rows["kind"] == 1].sort_values(["slice", "words"])
        if len(own):
            token, before, train, times, cell, cells = [], [], [], [], [], []
            for number, r in enumerate(own.itertuples()):
                distinct = np.frombuffer(r.words, np.uint64)
                token.append(distinct[np.frombuffer(r.place, np.uint16 if len(distinct) <= 1 << 16 else np.uint32)])
                before.append(np.frombuffer(r.before, np.uint32))
                times.append(np.frombuffer(r.times, f"u{len(r.times) // len(before[-1])}"))
                counts = np.frombuffer(r.counts, np.uint32)
                some = np.flatnonzero(counts)
                cell.append(np.repeat(np.arange(len(some)) + sum(len(c) for c in cells), counts[some]))
                train.append(np.frombuffer(r.train, np.uint8)[np.repeat(np.arange(len(counts)), counts)])
                cells.append(some)
            known, base, score, distinct = _terms(np.concatenate(token), np.concatenate(before), np.concatenate(train) > 0, times := np.concatenate(times), total, given, given_pairs, mu)
            cell = np.concatenate(cell)
            sums = [np.bincount(cell, x * times) for x in (known, base, score)]
            at = 0
            for r, some in zip(own.itertuples(), cells, strict=True):
                part = slice(at, at + len(some))
                out.append((1, r.slice, some.astype(np.uint32).tobytes(), sums[1][part].tobytes(), sums[2][part].tobytes(), sums[0][part].astype(np.uint32).tobytes(), b""))
                at += len(some)
            out.append((2, -1, np.array([distinct], np.int64).tobytes(), b"", b"", b"", b""))
        return pd.DataFrame(out, columns=["kind", "slice", "words", "place", "before", "counts", "train"])

    return run


def _terms(
    token: np.ndarray, before: np.ndarray, train: np.ndarray, times: np.ndarray, total: int, given: dict[int, int], given_pairs: dict[int, int], mu: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each pair of a text, which is there `times` times: known, its base term, its model term; and
    the distinct training words that are this shard's own. Terms leave out the logarithm of the base's
    denominator."""
    vocabulary, word = np.unique(token, return_inverse=True)
    count = np.bincount(word[train], times[train], len(vocabulary)).astype(np.int64)
    spread = np.isin(vocabulary, np.array(list(given), np.uint64))
    distinct = int(((count > 0) & ~spread).sum())
    count[spread] = [given[w] for w in vocabulary[spread].tolist()]
    prior = mu * (count + ADD) / (total + ADD * (total + 1))
    pairs, pair = np.unique((word.astype(np.uint64) << np.uint64(32)) | before, return_inverse=True)
    seen_times = np.bincount(pair[train], times[train], len(pairs)).astype(np.int64)
    owner = (pairs >> np.uint64(32)).astype(np.int64)
    child = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    often = np.flatnonzero(spread[owner])
    ids = _pair_ids(vocabulary[owner[often]], child[often])
    hot = np.isin(ids, np.array(list(given_pairs), np.uint64))
    seen_times[often[hot]] = [given_pairs[i] for i in ids[hot].tolist()]
    trained = seen_times > 0
    known_words = np.unique(owner[trained])
    with LevelFile() as file:
        trie = Trie.build(file, vocabulary[known_words], np.searchsorted(known_words, owner[trained]), child[trained], np.log10(seen_times[trained] + prior[owner[trained]]))
        seen, value = trie.open().find(vocabulary[owner], child)
        del trie
    numerator = np.log10(prior[owner])
    numerator[seen] = value
    context = np.where(vocabulary == END, 0.0, np.log10(count + mu))
    return (count > 0)[word], np.log10(count + ADD)[word], numerator[pair] - context[word], distinct


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """Add up the parts of one slice of texts."""
    if rows["kind"].iloc[0] == 2:
        distinct = sum(int(np.frombuffer(b, np.int64)[0]) for b in rows["words"])
        return pd.DataFrame({"doc_id": [None], "held_out": [None], "n_tokens": [distinct], "n_known": [-1], "base": [0.0], "score": [0.0]})
    heads, parts = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    head, size = heads.iloc[0], len(heads)
    tokens = np.frombuffer(head["counts"], np.uint32).astype(np.int64)
    known, base, score = np.zeros(len(tokens), np.int64), np.zeros(len(tokens)), np.zeros(len(tokens))
    for r in parts.sort_values(["words", "place", "before"]).itertuples():
        at = np.frombuffer(r.words, np.uint32)
        base[at] += np.frombuffer(r.place)
        score[at] += np.frombuffer(r.before)
        known[at] += np.frombuffer(r.counts, np.uint32)
    ids = pd.array(np.frombuffer(head["words"], np.int64), dtype="Int64")
    ids[~np.frombuffer(head["place"], bool)] = pd.NA
    held = np.frombuffer(head["train"], np.uint8) == 0
    one = pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": tokens, "n_known": known // size, "base": base / size, "score": score / size})
    return pd.concat([one] * size)  # equal slices share their name, and their sums


def score_documents(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", mu: float = MU) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words, pairs = frequent(docs)
    total, given, given_pairs = exact_counts(docs.where("train"), words, pairs)
    shards = max(1, math.ceil(total / SHARD_TOKENS))
    ship_package(docs.sparkSession)
    spread = np.array(sorted(given), np.uint64)
    rows = arrow_map(docs, _scatter(shards, spread, pairs), ROWS)
    parts = rows.groupBy("shard").applyInPandas(_score_shard(total, given, given_pairs, mu), PARTS)
    sums = parts.groupBy("slice").applyInPandas(_gather, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    sums = staged(sums, "lm-scores")
    distinct = (sums.where("n_known < 0").agg(F.sum("n_tokens")).first()[0] or 0) + sum(n > 0 and w != int(END) for w, n in given.items()) + (given[int(END)] > 0)
    denominator = math.log10(total + ADD * (distinct + 1))
    begin = math.log10(given[int(END)] + mu)
    return sums.where("n_known >= 0").select(
        F.col("doc_id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * denominator).alias("base_score"), (F.col("score") - begin).alias("score"),
    )
