"""Sampled segmentations: their law, their repeatability, and the way back."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybrook.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def cut(ids, ends):
    return [tuple(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]


def segmentations(vocabulary, text):
    if not text:
        yield (), 1.0
    for n in range(1, len(text) + 1):
        piece = vocabulary.by_text.get(text[:n])
        if piece is not None:
            for rest, weight in segmentations(vocabulary, text[n:]):
                yield (piece, *rest), weight * vocabulary.weights[piece]


@pytest.mark.parametrize("limit", [48, 0])
def test_segmentations_have_their_shares(vocabulary, monkeypatch, limit):
    monkeypatch.setattr(pieces, "LONG", limit)  # 0: all by the slow path
    n = 20_000 if limit else 3_000
    drawn = Counter(cut(*pieces.encode_batch(vocabulary, ["tother"] * n, np.arange(n))))
    weights = dict(segmentations(vocabulary, chr(pieces.SPACE) + "tother"))
    total = sum(weights.values())
    assert set(drawn) <= set(weights) and len(drawn) > 3
    assert max(abs(drawn[s] / n - w / total) for s, w in weights.items()) < (0.015 if limit else 0.04)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("ab ▁\n", max_size=120)), max_size=8), st.integers(0, 2**40))
def test_decoding_is_lossless_and_batches_do_not_matter(texts, seed):
    vocabulary = loaded()
    seeds = np.arange(len(texts)) + seed
    ids, ends = pieces.encode_batch(vocabulary, texts, seeds)
    assert pieces._lossless(vocabulary, texts, ids, ends).all()
    assert cut(ids, ends) == [cut(*pieces.encode_batch(vocabulary, [t], seeds[k : k + 1]))[0] for k, t in enumerate(texts)]


def loaded(cache=[]):  # noqa: B006
    if not cache:
        cache.append(pieces.Vocabulary.load())
    return cache[0]


def test_odd_rows_come_back(spark, odd_docs, no_docs, vocabulary):
    encoded = pieces.encode(odd_docs, F.col("doc_id"), ["doc_id", "source"], vocabulary)
    again = pieces.encode(odd_docs.repartition(7), F.col("doc_id"), ["doc_id", "source"], vocabulary)
    key = lambda r: repr((r["doc_id"], r["pieces"]))
    rows = sorted(encoded.collect(), key=key)
    assert rows == sorted(again.collect(), key=key) and all(r["lossless"] for r in rows)
    assert [r["pieces"] for r in rows if r["doc_id"] in (1, 2)] == [None, []]
    back = pieces.decode(encoded, vocabulary).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(map(tuple, odd_docs.select("doc_id", "text").collect()), key=repr)
    assert pieces.encode(no_docs, F.col("doc_id"), ["doc_id"], vocabulary).count() == 0
