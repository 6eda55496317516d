"""Language identification, toxicity, ordinal regression and the language model."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import elias_fano, language_id, lm_score, quality_model, toxicity
from tallybrook.llm.common import arrow_map, fold, slices
from tallybrook.llm.queries import QUERIES
from tallybrook.llm.textarrays import joined, span_hashes, word_spans


def test_words_and_hashes_of_a_buffer():
    texts = ["one two\tone", None, "", " two ", "\u00a0 x\x1fy"]
    buffer, starts, _ = joined(texts)
    begin, end, first = word_spans(buffer, starts)
    words = [bytes(buffer[a:b]).decode() for a, b in zip(begin, end, strict=True)]
    assert words == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert np.diff(first).tolist() == [3, 0, 0, 1, 2]
    hashes = span_hashes(buffer, begin, end)
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == len(set(words))


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(3)
    first = np.array([0, 0, 1, 6, 12])
    scores = draw.normal(0, 4, (12, 3)).astype(np.float32)
    found = language_id.viterbi(scores, first, 3.0)

    def worth(labels, part):
        return part[np.arange(len(part)), labels].sum() - 3.0 * sum(a != b for a, b in zip(labels, labels[1:], strict=False))

    for a, b in zip(first, first[1:], strict=False):
        part = scores[a:b]
        best = max(worth(p, part) for p in product(range(3), repeat=b - a)) if b > a else 0
        assert worth(tuple(found[a:b]), part) == pytest.approx(best, abs=1e-4) if b > a else True


def test_language_accuracy_on_held_out_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op4_language_id"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"))
    rows = found.join(truth, "doc_id").collect()
    assert all(r["held_out"] == (r["crc"] % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean(held) > 0.97


def test_spans_of_mixed_text_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    english, german = (docs.where(f"lang = '{x}' and n_chars between 600 and 1500").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    mixed = spark.createDataFrame([(english + " " + german, "x"), ("Привет мир", "x")], "text string, score string")
    first, second = sorted(language_id.identify(mixed, model, []).collect(), key=lambda r: -len(r["spans"]))
    spans = first["spans"]
    assert {s["lang"] for s in spans} >= {"en", "de"} and sum(s["words"] for s in spans) == len(english.split()) + len(german.split())
    assert abs(sum(s["words"] for s in spans if s["lang"] == "en") - len(english.split())) < 0.2 * len(english.split())
    assert [s["first_word"] for s in spans] == np.cumsum([0] + [s["words"] for s in spans])[:-1].tolist()
    found = {r["doc_id"]: r for r in language_id.identify(odd_docs, model, ["doc_id"]).collect()}
    assert [(found[k]["lang_pred"], found[k]["score"], found[k]["spans"]) for k in (1, 2, 3)] == [("und", 0.0, [])] * 3
    assert language_id.identify(odd_docs, model, ["doc_id"]).count() == odd_docs.count()
    untrained = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, untrained, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(no_docs, model, ["doc_id"]).count() == 0


def test_gradients_of_the_network():
    texts = ["bad words here " * 15, "good text here with other words", "bad"]
    words = toxicity.Words(texts)
    start, size, doc = words.windows()
    label = np.array([1.0, 0.0, 1.0])[doc]
    draw = np.random.default_rng(1)
    net = toxicity.Network.fresh()
    for name in ("words", "grams", "into", "bias", "state", "attend", "pool", "offset"):
        setattr(net, name, (draw.standard_normal(getattr(net, name).shape) * 0.3).astype(np.float64))

    def loss():
        logit = net.logits(words, start, size).astype(float)
        return float(np.mean(np.log1p(np.exp(logit)) - label * logit))

    gradients = {}
    trainer = toxicity._Trainer(net)
    trainer._apply = lambda name, gradient, rows=slice(None): gradients.setdefault(name, (rows, np.array(gradient)))
    trainer.step(words, start, size, label)
    for name, (rows, gradient) in gradients.items():
        values = getattr(net, name)
        rows = np.arange(len(values)) if isinstance(rows, slice) else rows
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        place = (rows[at[0]], *at[1:])
        before = values[place]
        values[place] = before + 2e-2
        up = loss()
        values[place] = before - 2e-2
        down = loss()
        values[place] = before
        assert gradient[at] == pytest.approx((up - down) / 4e-2, rel=0.05, abs=2e-4), name


def test_windows_overlap_and_cover():
    words = toxicity.Words(["a " * n for n in (0, 1, 31, 32, 33, 48, 49, 500)])
    start, size, doc = words.windows()
    for k, n in enumerate(words.count):
        own = doc == k
        seen = {w for s, z in zip(start[own], size[own], strict=True) for w in range(s - words.first[k], s - words.first[k] + z)}
        assert seen == set(range(n)) and (size[own] <= toxicity.WINDOW).all()


def test_arrow_batches_are_bounded_by_bytes(spark):
    rows = spark.range(0, 8000, 1, 1).select(F.expr("repeat('x', 4096)").alias("text"))  # 32 MB in one task

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    found = arrow_map(rows, sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in found) == 8000 and max(r["size"] for r in found) < 9 << 20


def test_toxicity_holds_little_of_its_texts_as_arrays():
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 50_000, 350)) for _ in range(1000)]
    batch, net, scores = pa.RecordBatch.from_arrays([pa.array(texts)], names=["__text"]), toxicity.Network.fresh(), []
    tracemalloc.start()
    for part in slices(iter([batch]), "__text", toxicity.SLICE_BYTES):
        scores.append(net.scores(toxicity.Words(part.column("__text").to_pylist())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # 105 MB with slices of 2 MB and 4096 windows at a time
    assert np.allclose(np.concatenate(scores), net.scores(toxicity.Words(texts)), atol=1e-6)


def test_toxicity_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("n_chars < 8000 and quality = 1").orderBy("doc_id").select("doc_id", "text", "toxic").collect()
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    chosen = [r for r in learn if r["toxic"]] + [r for r in learn if not r["toxic"]][:600]
    net = toxicity.train([r["text"] for r in chosen], np.array([r["toxic"] for r in chosen]), 0.1, steps=300)
    score = net.scores(toxicity.Words([r["text"] for r in held]))
    truth = np.array([r["toxic"] for r in held]) == 1
    assert np.mean(score[truth][:, None] > score[~truth][None, :]) > 0.95
    assert np.mean(score[~truth] >= 0.5) < 0.02


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in (4, 5, 6, 7, 8)] + [(8, 1, "x"), (None, 1, "x"), (9, None, "x")], "doc_id bigint, toxic int, text string")
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.score(odd_docs, model, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.49}
    assert toxicity.score(no_docs, model, ["doc_id"]).count() == 0
    assert toxicity.fit(odd_docs, labels.limit(0)) == (None, 0.0)
    assert {r["score"] for r in toxicity.score(odd_docs, (None, 0.0), ["doc_id"]).collect()} == {0.0}


def test_ordinal_regression_orders_grades():
    draw = np.random.default_rng(5)
    grades = draw.integers(0, 4, 400)
    texts = [" ".join(draw.choice(["bad", "poor", "fair", "good"], 30, p=np.eye(4)[g] * 0.6 + 0.1)) for g in grades]
    model = quality_model.train(texts[:300], grades[:300])
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(quality_model.Features(texts[300:]))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.abs(tails.sum(axis=1) - grades[300:]).mean() < 0.7
    assert np.corrcoef(tails.sum(axis=1), grades[300:])[0, 1] > 0.8
    assert quality_model.train(["a"], np.array([2])).only == 2.0 and quality_model.train([], np.array([])).only == 0.0


def test_ordinal_slopes_equal_differences():
    draw = np.random.default_rng(6)
    scores, thresholds = draw.normal(0, 2, 20), np.array([-1.0, 0.3, 1.1])
    grades, counts = draw.integers(0, 4, 20), draw.integers(1, 5, 20).astype(float)
    loss, slopes = quality_model.loss_and_slopes(scores, thresholds, grades, counts)
    chance = 1 / (1 + np.exp(thresholds[None, :] - scores[:, None]))
    each = -np.diff(np.concatenate([np.ones((20, 1)), chance, np.zeros((20, 1))], axis=1), axis=1)[np.arange(20), grades]
    assert loss == pytest.approx(-(counts * np.log(each)).sum() / counts.sum())
    for found, move in ((slopes.sum(axis=1), lambda k, e: (scores + e * (np.arange(20) == k), thresholds)), (-slopes.sum(axis=0), lambda k, e: (scores, thresholds + e * (np.arange(3) == k)))):
        for k, slope in enumerate(found):
            up, down = (quality_model.loss_and_slopes(*move(k, e), grades, counts)[0] for e in (1e-6, -1e-6))
            assert slope == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_a_rare_grade_is_learned_from(spark):
    docs = spark.createDataFrame([(k, ("rare find " if k % 500 == 0 else "plain thing " if k % 2 else "dull stuff ") * 20) for k in range(10_000)], "doc_id bigint, text string")
    ratings = docs.select("doc_id", F.when(F.col("doc_id") % 500 == 0, 2).otherwise(F.col("doc_id") % 2).cast("int").alias("grade"))
    model = quality_model.fit(docs, ratings, train_docs=100)
    grade = {r["text"][:4]: r["expected_grade"] for r in quality_model.rate(docs, model, ["doc_id", "text"]).collect()}
    assert grade["rare"] > 1.5 and 0.5 < grade["plai"] < 1.5 and grade["dull"] < 0.5


def test_features_do_not_depend_on_the_batch():
    texts = ["Some Text, here!", "", None, "x" * 9, "again again ### again"]
    weights = np.random.default_rng(2).normal(size=(2 << quality_model.BITS) + quality_model.RATIOS)
    together = quality_model.Features(texts).scores(weights)
    assert together == pytest.approx([quality_model.Features([t]).scores(weights)[0] for t in texts])


def test_quality_on_held_out_texts(spark, odd_docs, no_docs):
    rows = QUERIES["op8_quality_model"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r["selected"] == (r["quality"] == 1) for r in rows if r["held_out"]]
    assert np.mean(held) > 0.95
    ratings = spark.createDataFrame([(4, 0), (5, 2), (8, 1), (9, None)], "doc_id bigint, grade int")
    model = quality_model.fit(odd_docs, ratings)
    assert quality_model.rate(odd_docs, model, ["doc_id"]).count() == odd_docs.count()
    assert quality_model.rate(no_docs, quality_model.fit(no_docs, ratings), ["doc_id"]).count() == 0


@pytest.mark.parametrize("universe", [1 << 8, 1 << 33, 1 << 64])
def test_elias_fano_gives_back_and_finds(universe):
    draw = np.random.default_rng(universe % 97)
    for size in (0, 1, 2, 1000):
        values = np.sort(draw.integers(0, universe, size, dtype=np.uint64, endpoint=False))
        with elias_fano.LevelFile() as file:
            level = elias_fano.EliasFano(file, values, universe).open()
            assert (level.access(np.arange(size)) == values).all()
            asked = np.concatenate([values, draw.integers(0, universe, 500, dtype=np.uint64, endpoint=False)])
            at, equal = level.successor(asked)
            assert (equal == np.isin(asked, values)).all() and (at[equal] == np.searchsorted(values, asked[equal])).all()


def plain_scores(rows, mu):
    lower = {c: c + 32 for c in range(65, 91)}
    tokens = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), "\n"]) for k, t in rows]
    trained = [k is not None and zlib.crc32(str(k).encode()) % 10 != 0 for k, _ in tokens]
    one, two = Counter(), Counter()
    for (_, words), train in zip(tokens, trained, strict=True):
        if train:
            one.update(words)
            two.update(zip(["\t", *words], words, strict=False))
    total, distinct, texts = sum(one.values()), len(one), sum(trained)
    for (k, words), train in zip(tokens, trained, strict=True):
        prior = [mu * (one[w] + 0.1) / (total + 0.1 * (total + 1)) for w in words]
        context = [texts, *(one[w] for w in words)]
        yield (
            k, not train, len(words), sum(one[w] > 0 for w in words), total,
            sum(math.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words),
            sum(math.log10((two[v, w] + p) / (c + mu)) for v, w, p, c in zip(["\t", *words], words, prior, context, strict=False)),
        )


@pytest.mark.parametrize("shard_tokens, sample", [(20_000, 200), (2_000_000, 1)])
def test_language_model_equals_counts(spark, sf_dir, odd_docs, no_docs, monkeypatch, shard_tokens, sample):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(lm_score, "SAMPLE_DOCS", sample)
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        expected = sorted(plain_scores(rows, lm_score.MU), key=lambda r: (str(r[0]), r[5]))
        found = lm_score.score_documents(docs, fold(F.col("doc_id"), 10) != 0).collect()
        found = sorted(map(tuple, found), key=lambda r: (str(r[0]), r[5]))
        assert [f[:5] for f in found] == [e[:5] for e in expected]
        assert [f[5] for f in found] == pytest.approx([e[5] for e in expected], rel=1e-9)
        assert [f[6] for f in found] == pytest.approx([e[6] for e in expected], rel=0.01)
    assert lm_score.score_documents(no_docs, fold(F.col("doc_id"), 10) != 0).count() == 0


@pytest.mark.parametrize("text, copies", [("the " * 30 + "end {0}", 300), ("the the", 3000)])
def test_a_hot_pair_is_spread_over_the_shards(spark, monkeypatch, text, copies):
    """A pair that a text repeats, and one that every text has, at a third of all tokens or more."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 1000)
    score_shard = lm_score._score_shard

    def guarded(*given):
        run = score_shard(*given)

        def checked(rows):
            assert sum(map(len, rows.loc[rows["kind"] == 1, "before"])) // 4 <= 2000
            return run(rows)

        return checked

    monkeypatch.setattr(lm_score, "_score_shard", guarded)
    rows = [(k, text.format(k)) for k in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted(map(tuple, lm_score.score_documents(docs, fold(F.col("doc_id"), 10) != 0).collect()))
    expected = list(plain_scores(rows, lm_score.MU))
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert [f[5] for f in found] == pytest.approx([e[5] for e in expected], rel=1e-9)
    assert [f[6] for f in found] == pytest.approx([e[6] for e in expected], rel=0.01)


def test_training_takes_one_text_an_id(spark, monkeypatch):
    """An id that repeats brings one of its texts to the driver, whatever the order of rows."""
    rows = [(7, f"text number {k}") for k in range(300)] + [(k, f"other text {k}") for k in range(8, 20)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(7, 20)], "doc_id bigint, label int")
    taken = []
    for module, name in ((toxicity, "toxic"), (quality_model, "grade")):
        monkeypatch.setattr(module, "train", lambda texts, *rest: taken.append(texts))
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
            module.fit(docs, labels.withColumnRenamed("label", name))
    assert [len(t) for t in taken] == [13] * 4 and taken[0] == taken[1] == taken[2] == taken[3]


def test_a_rare_language_is_learned_whole(spark):
    """The bound on training texts holds for each language, so a frequent one does not displace a rare one."""
    rows = [(k, "the quick brown fox", "en") for k in range(2000)] + [(5000 + k, f"zyx{chr(97 + k)} wvu", "xx") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    langs, table, _ = language_id.fit(docs, train_docs=40)
    alone, expected, _ = language_id.fit(docs.where("lang = 'xx'"), train_docs=40)
    assert langs == ["en", "xx"] and alone == ["xx"]
    assert table[:, 1] == pytest.approx(expected[:, 0])
