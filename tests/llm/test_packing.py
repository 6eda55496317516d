"""Packing: every id in exactly one piece, no padding, ids as the tokenizer gives them for whole texts."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybrook.llm import packing, word_ids
from tallybrook.llm.queries import op13_packing

RULES = open(public_tokenizers.path(packing.TOKENIZER)).read()
WHOLE = Tokenizer.from_str(RULES)
OWN = word_ids.WordEncoder(RULES)


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


PARTS = st.sampled_from(["a", "B", "é", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "'", "'s", "'re", "Σ", "ς", "7", "<|endoftext|>", "<|", "|>", "😀", "东", "-", "\x00", "İ", "I", "\u0307", "\u0958", ".", ",", "&&", "\u2026", "word", "\u01c5"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=20).map("".join), max_size=6))
def test_words_encoded_once_give_the_ids_of_whole_texts(texts):
    assert [ids.tolist() for ids in OWN.ids(texts)] == [plain_ids(WHOLE, text)[:-1] for text in texts]


def test_long_texts_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(word_ids, "AT_ONCE", 64)
    monkeypatch.setattr(word_ids, "CACHED_PARTS", 10)
    own = word_ids.WordEncoder(RULES)
    text = " ".join(f"word{k % 37} Grüße{k}\n" for k in range(400)) + "x" * 300
    for texts in ([text], [text, None, text[:50], ""]):
        assert [ids.tolist() for ids in own.ids(texts)] == [plain_ids(WHOLE, t)[:-1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 300)), max_size=60), st.sampled_from([(64, 32, 16, 8), (32,), (128, 64), (64, 8)]))
def test_windows_are_full_and_every_token_is_in_one_piece(lengths, windows):
    full, tail = packing.pack_lengths(lengths, windows)
    assert all(sum(p.length for p in s) in windows for s in full)
    assert sum(p.length for p in tail) < max(windows)
    powers = packing._powers(tail)
    assert all((n := sum(p.length for p in s)) & (n - 1) == 0 for s in powers)
    places = defaultdict(list)
    for p in (p for s in full + powers for p in s):
        places[p.row].append((p.start, p.length))
    for row, length in enumerate(lengths):
        end = 0
        for start, n in sorted(places.pop(row)):
            assert start == end and n > 0
            end += n
        assert end == length
    assert not places


def test_documents_stay_whole_where_windows_allow_it():
    # a remainder longer than half its window opens it, shorter ones fill its gap
    full, tail = packing.pack_lengths([50, 14, 30, 2, 64, 8, 8], (64, 32, 16))
    assert not tail or sum(p.length for p in tail) < 64
    assert Counter(p.row for s in full for p in s) == Counter(range(7))


def rebuilt(rows, id_column="doc_id"):
    """Sequences checked; ids by document."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        documents[r[id_column]].append(r)
    for pieces in sequences.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end and r["length"] > 0
            end += r["length"]
        assert end <= 2048 and end & (end - 1) == 0 and {r["window"] for r in pieces} == {end}
    return documents


def test_pieces_join_to_the_ids_of_whole_texts(spark, odd_docs):
    found = packing.pack(odd_docs.where("doc_id <> 8 OR doc_id IS NULL"))
    documents = rebuilt(found.collect())
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert set(documents) == set(texts) - {8}
    for doc_id, pieces in documents.items():
        expected, end = plain_ids(WHOLE, texts[doc_id]), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(expected)
            end += r["length"]
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert ids == expected[r["start"] : end] and len(ids) == r["length"]
        assert end == len(expected)
    assert [r["length"] for r in documents[1]] == [r["length"] for r in documents[2]] == [1]


def test_repeated_rows_are_packed_each(spark, odd_docs):
    text = odd_docs.where("doc_id = 8").first()["text"]
    found = packing.pack(odd_docs.where("doc_id = 8")).collect()
    rebuilt(found)
    assert sum(r["length"] for r in found) == 2 * len(plain_ids(WHOLE, text))


def test_no_documents(spark, no_docs):
    assert packing.with_steps(packing.pack(no_docs)).count() == 0


def test_extra_columns_and_other_names(spark):
    docs = spark.createDataFrame([("k1", "some words", 1), (None, None, 2)], "`a.b` string, `__id` string, sequence_id int")
    found = packing.pack(docs, id_column="a.b", text_column="__id").collect()
    assert Counter(r["a.b"] for r in found).keys() == {"k1", None}


def test_query_over_a_whole_table(spark, sf_dir):
    rows = op13_packing(spark, sf_dir).collect()
    documents = rebuilt(rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(documents) == set(texts)
    for doc_id, pieces in documents.items():
        ids = np.array(plain_ids(WHOLE, texts[doc_id]), "<u4")
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_steps_of_a_window_differ_by_one_sequence(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") * 7919 % 900).cast("int")).alias("text"))
    rows = packing.with_steps(packing.pack(docs.repartition(7)), step_tokens=1 << 14).select("window", "sequence_id", "step").distinct().collect()
    sizes = defaultdict(Counter)
    for r in rows:
        sizes[r["window"]][r["step"]] += 1
    assert sum(len(steps) for steps in sizes.values()) > 20
    for window, steps in sizes.items():
        assert max(steps.values()) - min(steps.values()) <= 1 and max(steps.values()) * window <= 1 << 14
        assert set(steps) == set(range(len(steps)))
