"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Method: a word is the sum of information from a hashed word embedding and from hashed character
4- and 5-grams. A GRU reads windows of `WINDOW` words in both directions; attention pools its states
into one logit. Windows start every `STRIDE` words, so they overlap and cover the whole text; the
text's score is its highest window, calibrated on texts. Trained in numpy on about `TRAIN_DOCS`
labelled texts a class, of at most `TRAIN_CHARS` characters, taken by a hash of the id: where a
text's label teaches its highest window: by leaning of words and n-grams at first, then by the
network itself.

Cases: a null text, or one without words, scores the rate of label 1 among the labels (0 without
labels), which is below 0.5 or cut there; with labels of one class only, every text scores so; rows
with null labels are not learned from; a text with several labels counts as the largest; repeated
rows score alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import arrow_map, schema_with, slices
from tallybrook.llm.textarrays import IS_SPACE, gram_buckets, joined, ranges, segment_sums, span_hashes, word_spans

TRAIN_DOCS = 1200
TRAIN_CHARS = 10_000
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 8
WORD_BITS, GRAM_BITS = 14, 16
BLOCK = 1024  # windows computed at a time
SLICE_BYTES = 512 << 10  # of texts that a task holds as arrays at a time


class Words:
    """The words of a batch of texts, each distinct word once."""

    def __init__(self, texts: list[str | None]):
        buffer, starts, _ = joined([t and t.lower() for t in texts])
        buffer = np.where(IS_SPACE[buffer], np.uint8(32), buffer)
        begin, end, self.first = word_spans(buffer, starts)
        self.count = np.diff(self.first)
        hashes, at, self.word = np.unique(span_hashes(buffer, begin, end), return_index=True, return_inverse=True)
        self.bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        begin, size = begin[at] - 1, end[at] - begin[at] + 2
        four, five = np.maximum(size - 3, 0), np.maximum(size - 4, 0)
        grams = [(gram_buckets(buffer, n, GRAM_BITS)[ranges(begin, k)], k) for n, k in ((4, four), (5, five))]
        owner = np.concatenate([np.repeat(np.arange(len(at)), k) for _, k in grams])
        order = np.argsort(owner, kind="stable")
        self.grams, self.gram_count = np.concatenate([g for g, _ in grams])[order], four + five

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and text of every window."""
        per_doc = np.where(self.count > 0, np.maximum(-(-(self.count - WINDOW) // STRIDE), 0) + 1, 0)
        doc = np.repeat(np.arange(len(self.count)), per_doc)
        start = ranges(np.zeros(len(per_doc), np.int64), per_doc) * STRIDE
        return self.first[doc] + start, np.minimum(self.count[doc] - start, WINDOW), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    words: np.ndarray  # [2^WORD_BITS, EMBED]
    grams: np.ndarray  # [2^GRAM_BITS, EMBED]
    into: np.ndarray  # [2 * EMBED, 6 * HIDDEN], both directions
    bias: np.ndarray  # [6 * HIDDEN]
    state: np.ndarray  # [2, 3 * HIDDEN, HIDDEN]
    attend: np.ndarray  # [2, HIDDEN]
    pool: np.ndarray  # [2, HIDDEN]
    offset: np.ndarray  # [1]
    calibration: tuple[float, float] = (1.0, 0.0)
    base_rate: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        scaled = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            scaled(0.05, 1 << WORD_BITS, EMBED), scaled(0.05, 1 << GRAM_BITS, EMBED), scaled(0.4, 2 * EMBED, 6 * HIDDEN),
            np.zeros(6 * HIDDEN, np.float32), scaled(0.3, 2, 3 * HIDDEN, HIDDEN), scaled(0.3, 2, HIDDEN), scaled(0.3, 2, HIDDEN), np.zeros(1, np.float32),
        )

    def inputs(self, words: Words, chosen: np.ndarray | None = None) -> np.ndarray:
        """Embeddings of distinct words: the word's own, and its grams' summed and scaled."""
        firsts = np.cumsum(words.gram_count) - words.gram_count
        count, grams, bucket = words.gram_count, words.grams, words.bucket
        if chosen is not None:
            grams, count, bucket = grams[ranges(firsts[chosen], count[chosen])], count[chosen], bucket[chosen]
            firsts = np.cumsum(count) - count
        summed = segment_sums(self.grams[grams], firsts, count) / np.sqrt(np.maximum(count, 1))[:, None].astype(np.float32)
        return np.concatenate([self.words[bucket], summed], axis=1)

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows. gates: [steps, 6 * HIDDEN, windows]; mask: [steps, windows] or None."""
        steps, _, n = gates.shape
        gates = gates.reshape(steps, 2, 3 * HIDDEN, n)
        state = np.zeros((2, HIDDEN, n), np.float32)
        attention, value = np.zeros((2, steps, n), np.float32), np.zeros((2, steps, n), np.float32)
        for t in range(steps):
            places = (t, steps - 1 - t)
            gate = np.stack([gates[places[0], 0], gates[places[1], 1]])
            inner = self.state @ state
            zr = _sigmoid(gate[:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gate[:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
            after = new + z * (state - new)
            on = None
            if mask is not None:
                on = np.stack([mask[places[0]], mask[places[1]]])[:, None]
                after = np.where(on, after, state)
            if keep is not None:
                keep.append((z, r, new, inner[:, 2 * HIDDEN :], state, after, on))
            state = after
            for d in (0, 1):
                attention[d, places[d]] = self.attend[d] @ state[d]
                value[d, places[d]] = self.pool[d] @ state[d]
        e, p = attention.sum(axis=0), value.sum(axis=0)
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        logit = (a * p).sum(axis=0) + self.offset[0]
        if keep is not None:
            keep.append((a, p, logit))
        return logit

    def logits(self, words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of the given windows of `words`."""
        gates = (self.inputs(words) @ self.into + self.bias).astype(np.float32)
        out = np.zeros(len(start), np.float32)
        full = size == WINDOW
        for group in (np.flatnonzero(full), np.flatnonzero(~full)):
            for k in range(0, len(group), BLOCK):
                own = group[k : k + BLOCK]
                place = start[own] + np.arange(WINDOW)[:, None]
                mask = None
                if not full[own[0]]:
                    mask = np.arange(WINDOW)[:, None] < size[own]
                    place = np.where(mask, place, start[own])
                block = np.ascontiguousarray(gates[words.word[place]].transpose(0, 2, 1))
                out[own] = self.forward(block, mask)
        return out

    def doc_logits(self, words: Words) -> np.ndarray:
        """The highest window of each text; nan without words."""
        start, size, doc = words.windows()
        out = np.full(len(words.count), np.nan)
        logits = self.logits(words, start, size)
        some = np.flatnonzero(words.count > 0)
        if len(some):
            out[some] = np.maximum.reduceat(logits, np.searchsorted(doc, some))
        return out

    def scores(self, words: Words) -> np.ndarray:
        a, c = self.calibration
        return np.nan_to_num(_sigmoid(a * self.doc_logits(words) + c), nan=self.base_rate)


class _Trainer:
    """Adagrad over minibatches of windows."""

    def __init__(self, net: Network, rate: float = 0.1):
        self.net, self.rate = net, rate
        self.sums = {n: np.full_like(getattr(net, n), 1e-2) for n in ("words", "grams", "into", "bias", "state", "attend", "pool", "offset")}

    def _apply(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        gradient = np.clip(gradient, -5, 5)
        self.sums[name][rows] += gradient * gradient
        getattr(self.net, name)[rows] -= self.rate * gradient / np.sqrt(self.sums[name][rows])

    def _scatter(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        some, place = np.unique(rows, return_inverse=True)
        summed = np.stack([np.bincount(place, gradient[:, k], len(some)) for k in range(gradient.shape[1])], axis=1)
        self._apply(name, summed.astype(np.float32), some)

    def step(self, words: Words, start: np.ndarray, size: np.ndarray, label: np.ndarray) -> None:
        net, n = self.net, len(start)
        mask = np.arange(WINDOW)[:, None] < size
        place = np.where(mask, start + np.arange(WINDOW)[:, None], start)
        chosen, where = np.unique(words.word[place], return_inverse=True)
        where = where.reshape(place.shape)
        inputs = net.inputs(words, chosen)
        gates = (inputs @ net.into + net.bias).astype(np.float32)
        kept: list = []
        net.forward(np.ascontiguousarray(gates[where].transpose(0, 2, 1)), mask, kept)
        a, p, logit = kept.pop()
        d_logit = (_sigmoid(logit) - label).astype(np.float32) / n
        d_p = a * d_logit
        d_e = a * (p - (a * p).sum(axis=0)) * d_logit
        d_gates = np.zeros((WINDOW, 2, 3 * HIDDEN, n), np.float32)
        d_state = np.zeros((2, HIDDEN, n), np.float32)
        d_matrix, d_attend, d_pool = np.zeros_like(net.state), np.zeros_like(net.attend), np.zeros_like(net.pool)
        for t in range(WINDOW - 1, -1, -1):
            places = (t, WINDOW - 1 - t)
            z, r, new, inner, before, after, on = kept[t]
            for d in (0, 1):
                d_state[d] += np.outer(net.attend[d], d_e[places[d]]) + np.outer(net.pool[d], d_p[places[d]])
                d_attend[d] += after[d] @ d_e[places[d]]
                d_pool[d] += after[d] @ d_p[places[d]]
            d_on = np.where(on, d_state, 0)
            d_new = d_on * (1 - z) * (1 - new * new)
            d_z = d_on * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
            d_gates[places[0], 0], d_gates[places[1], 1] = d_gate[0], d_gate[1]
            d_matrix += d_inner @ before.transpose(0, 2, 1)
            d_state = np.where(on, d_on * z, d_state) + net.state.transpose(0, 2, 1) @ d_inner
        flat = d_gates.reshape(WINDOW, 6 * HIDDEN, n).transpose(0, 2, 1).reshape(-1, 6 * HIDDEN)
        back = np.argsort(where.ravel(), kind="stable")
        d_words = np.add.reduceat(flat[back], np.searchsorted(where.ravel()[back], np.arange(len(chosen))), axis=0)
        d_inputs = d_words @ net.into.T
        self._apply("into", inputs.T @ d_words)
        self._apply("bias", d_words.sum(axis=0))
        for name, gradient in (("state", d_matrix), ("attend", d_attend), ("pool", d_pool), ("offset", np.array([d_logit.sum()]))):
            self._apply(name, gradient)
        self._scatter("words", words.bucket[chosen], d_inputs[:, :EMBED])
        count = words.gram_count[chosen]
        grams = words.grams[ranges((np.cumsum(words.gram_count) - words.gram_count)[chosen], count)]
        self._scatter("grams", grams, np.repeat(d_inputs[:, EMBED:] / np.sqrt(np.maximum(count, 1))[:, None], count, axis=0))


def _seeded(net: Network, words: Words, labels: np.ndarray) -> np.ndarray:
    """Start the first dimension of the embeddings at how far a bucket's texts lean to label 1, in
    standard errors beyond two; also the evidence of each distinct word."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    firsts = np.cumsum(words.gram_count) - words.gram_count
    texts = {"words": np.zeros((2, 1 << WORD_BITS)), "grams": np.zeros((2, 1 << GRAM_BITS))}  # by label and bucket
    for doc, label in enumerate(labels.astype(int)):
        own = np.unique(words.word[words.first[doc] : words.first[doc + 1]])
        grams = words.grams[ranges(firsts[own], words.gram_count[own])]
        for name, buckets in (("words", words.bucket[own]), ("grams", grams)):
            texts[name][label, np.unique(buckets)] += 1

    def lean(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
        p = (zero + one + 1) / (n0 + n1 + 2)
        z = (one / n1 - zero / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        return (np.sign(z) * np.clip(np.abs(z) - 2, 0, 8)).astype(np.float32)

    by_word, by_gram = lean(*texts["words"]), lean(*texts["grams"])
    net.words[:, 0], net.grams[:, 0] = by_word / 4, by_gram / 4
    return by_word[words.bucket] + segment_sums(by_gram[words.grams], firsts, words.gram_count) / np.sqrt(np.maximum(words.gram_count, 1))


def train(texts: list[str], labels: np.ndarray, base_rate: float, steps: int = 900, batch: int = 96, seed: int = 7) -> Network | None:
    """A network for texts labelled 0 or 1; None if one class is missing."""
    labels = np.asarray(labels, np.float32)
    words = Words(texts)
    usable = words.count > 0
    if not (labels[usable] == 1).any() or not (labels[usable] == 0).any():
        return None
    net, draw = Network.fresh(seed), np.random.default_rng(seed)
    start, size, doc = words.windows()
    evidence = _seeded(net, words, labels)
    place = np.minimum(start[:, None] + np.arange(WINDOW), len(words.word) - 1)
    seen = np.where(np.arange(WINDOW) < size[:, None], evidence[words.word[place]], -1e9).max(axis=1)
    trainer = _Trainer(net)
    first = np.searchsorted(doc, np.arange(len(labels)))
    count = np.bincount(doc, minlength=len(labels))
    sides = [np.flatnonzero(usable & (labels == k)) for k in (0, 1)]
    for k in range(steps):
        if k % (steps // 6) == 0:
            strength = net.logits(words, start, size) if k else seen
            top = np.lexsort((strength, doc))[np.searchsorted(doc, np.arange(len(labels)), "right") - 1]
        docs = np.concatenate([draw.choice(side, batch // 2) for side in sides])
        chosen = first[docs] + (draw.random(batch) * count[docs]).astype(np.int64)
        # texts labelled 1: their highest window; the others: highest and random ones
        chosen = np.where((labels[docs] == 1) | (draw.random(batch) < 0.5), top[docs], chosen)
        trainer.step(words, start[chosen], size[chosen], labels[docs])
    net.base_rate = min(base_rate, 0.49)
    net.calibration = _calibrated(net.doc_logits(words)[usable], labels[usable], base_rate)
    return net


def _calibrated(logits: np.ndarray, labels: np.ndarray, base_rate: float) -> tuple[float, float]:
    """Slope and offset of a logistic regression on texts, weighted to the rate of label 1."""
    rate = labels.mean()
    weight = np.where(labels == 1, base_rate / rate, (1 - base_rate) / (1 - rate))
    scale = max(float(np.abs(logits).max()), 1e-6)
    x = np.stack([logits / scale, np.ones_like(logits)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
        beta += np.linalg.solve(curve, x.T @ (weight * (labels - p)) - 1e-2 * beta)
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic", train_docs: int = TRAIN_DOCS) -> tuple[Network | None, float]:
    """Train on a bounded sample of the labelled rows; also the rate of label 1 among them all."""
    known = labels.where(F.col(label_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = counts.get(1, 0) / max(sum(counts.values()), 1)
    draw = F.pmod(F.xxhash64(id_column, F.lit("sample")), F.lit(1 << 30))
    limit = F.when(F.col("label") == 1, int(min(1.0, train_docs / max(counts.get(1, 0), 1)) * (1 << 30)))
    limit = limit.otherwise(int(min(1.0, train_docs / max(counts.get(0, 0), 1)) * (1 << 30)))
    chosen = F.broadcast(known.where(draw < limit))  # about train_docs rows a class
    rows = docs.where(F.length("text") <= TRAIN_CHARS).select(id_column, "text").join(chosen, id_column)
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text")  # one of an id that repeats
    rows = rows.groupBy(id_column).agg(text.alias("text"), F.first("label").alias("label")).toPandas()
    rows = rows.sort_values([id_column, "text"])
    return train(rows["text"].tolist(), rows["label"].to_numpy(), rate), rate


def score(docs: DataFrame, model: tuple[Network | None, float], keep: list[str | Column], name: str = "score") -> DataFrame:
    """The columns `keep` of `docs` with the score as `name`; `docs` needs `text`."""
    net, rate = model
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 2.5 MB
    kept = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "__text", SLICE_BYTES):
            texts = batch.column("__text").to_pylist()
            values = net.scores(Words(texts)) if net else np.full(len(texts), min(rate, 0.49))
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*(n for n in batch.schema.names if n != "__text"), name])

    return arrow_map(kept, run, schema_with(kept, f"`{name}` double"))
