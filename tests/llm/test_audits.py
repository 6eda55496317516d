"""Filter audit and source divergence against plain Python and SQL."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallybrook.llm import filter_audit, source_divergence
from tallybrook.llm.common import staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(rows):
    """The set of failed filters of each (doc_id, text)."""
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    found = []
    for doc_id, text in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        found.append({x for x, fail in fails.items() if fail})
    return found


def plain_audit(docs, good, toxic):
    """docs: (doc_id, text, lang). One document and one order after the other."""
    out = {}
    fails = plain_fails([(i, t) for i, t, _ in docs])
    for part in {lang or "" for *_, lang in docs}:
        own = [(i, f) for (i, _, lang), f in zip(docs, fails) if (lang or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                redundant = sum(x in f for _, f in own) - len(gone)
                out[part, order, step] = [
                    len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                ]
        for (p, order, step), metrics in out.items():
            if p == part:
                metrics.append(shapley[order[step - 1]])
    return out


def test_labels_are_not_broadcast(spark, sf_dir):
    """Each label is there sixteen times, which Spark's estimate leaves out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    facts = filter_audit._facts(docs, "doc_id", "text", "lang")
    plan = filter_audit._labelled(facts, labels, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in METRICS] for r in rows}
    assert len(found) == len(rows)
    return found


def test_filter_audit_equals_one_order_after_the_other(spark, odd_docs):
    extra = [
        (20, "ABC DEF", "en"), (21, "ABC DEF", "de"), (19, "ABC DEF", "en"), (21, "ABC DEF", "de"), (22, "a # b", None), (None, "a # b", ""),
        (23, " ".join(f"w{k}" for k in range(120)), "en"), (24, " ".join(f"W{k % 50}" for k in range(120)), "en"), (25, "a # b", "en"),
    ]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    label_rows = [(5, 1, 0), (6, 0, 1), (8, 1, 1), (8, 0, 0), (21, 1, None), (19, None, 1), (24, 1, 0), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(label_rows, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(1))
    good, toxic = ({i for i, *v in label_rows if i is not None and v[k] == 1} for k in (0, 1))
    expected = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], good, toxic)
    assert audited(spark, docs, labels) == expected
    assert any(m[4] for m in expected.values()) and any(m[5] for m in expected.values())


def test_filter_audit_of_no_documents(spark, no_docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert filter_audit.audit(no_docs, labels.limit(0)).count() == 0


def test_filter_audit_with_many_parts_passes_the_recursion_limit(spark):
    docs = spark.range(3500).select(F.col("id").alias("doc_id"), F.lit("Some text #").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    before = spark.conf.get(filter_audit.ROW_LIMIT)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(docs, labels)
    assert found.count() == 3500 * 600 and spark.conf.get(filter_audit.ROW_LIMIT) == before
    assert found.where("filter_order = 'EDCBA' AND step = 1").agg(F.sum("removed")).first()[0] == 3499


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def plain_divergence(docs, min_docs, top):
    """docs: (text, lang, source); whole texts, term by term."""
    docs = [tuple(v or "" for v in d) for d in docs]
    terms = [TERM.findall(text.translate(LOWER)) for text, *_ in docs]
    rows = set()
    for lang in {d[1] for d in docs}:
        own = [(source, t) for (_, la, source), t in zip(docs, terms) if la == lang]
        n_docs = Counter(term for _, t in own for term in set(t))
        kept = [term for term, n in n_docs.items() if n >= min_docs]
        v = len(kept)

        def probabilities(texts):
            counts = Counter(term for t in texts for term in t)
            size = sum(counts[term] for term in kept)
            return counts, {term: 1 + 10**9 * (counts[term] + 5) // (size + 5 * v) for term in kept}

        p = {source: probabilities([t for s, t in own if s == source]) for source in {s for s, _ in own}}
        _, q = probabilities([t for _, t in own])
        for source, (counts, ps) in p.items():
            apart = [(other, sum(abs(ps[t] - p[other][1][t]) for t in kept)) for other in p if other != source]
            above = [(t, ps[t] - q[t]) for t in kept if counts[t] and ps[t] > q[t]]
            for part, items, limit in (("pair", apart, None), ("term", above, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                rows |= {(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(items, 1)}
    return sorted(rows)


DIVERGENCE = ["lang", "source", "part", "item", "value", "rank"]


def diverging(docs, **bounds):
    return sorted(tuple(r[c] for c in DIVERGENCE) for r in source_divergence.audit(docs, **bounds).collect())


@pytest.mark.parametrize("min_docs, top", [(1, 3), (2, 50), (1000, 50)])
def test_divergence_equals_a_count_of_whole_texts(spark, odd_docs, min_docs, top):
    texts = ["foo, Foo;foo-bar (BAR) é9É \x00x\x7fy", "foo\x0bbar bar", "x" * 9000 + " " + "é," * 5000, "１２ a1b2 don't", "\x1cfoo bar東京 東京", ",,, ... 12 34", "bar", "bar"]
    rows = [(k, t, lang, source) for k, (t, lang, source) in enumerate((t, lang, f"s{(k * 7) % 5}") for k, t in enumerate(texts) for lang in ("en", None))]
    more = spark.createDataFrame([*rows, (1, None, "en", "only nulls"), (2, "...", "xx", "a"), (3, "", "xx", "b"), (4, "lone", "yy", "a")], "doc_id bigint, text string, lang string, source string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumn("a.b", F.lit(1))
    expected = plain_divergence([(r["text"], r["lang"], r["source"]) for r in docs.collect()], min_docs, top)
    assert diverging(docs, min_docs=min_docs, top_terms=top) == expected


def test_divergence_over_many_slices(spark):
    rows = [(" ".join(f"t{(k * j) % 97}x" for j in range(60)) + f" only{k}", "en" if k % 3 else "de", f"s{k % 7}") for k in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(9)
    assert diverging(docs, min_docs=30) == plain_divergence(rows, 30, 50)


def test_divergence_of_no_documents(no_docs):
    assert diverging(no_docs) == []


def test_each_chunk_is_tokenized_once_and_rare_terms_stay_behind(spark):
    listed = spark.createDataFrame([("Foo,", 2), ("foo", 1), ("foo", 3), ("bar", 1), ("a-b-a", 9), ("--", 99)], "chunk string, docs int")
    names, rows = source_divergence.chunk_terms(staged(listed, "listed"), 4)
    found = sorted((r["chunk"], r["name"]) for r in rows.join(names, "term").collect())
    assert found == [("Foo,", "foo"), ("a-b-a", "a"), ("a-b-a", "a"), ("a-b-a", "b"), ("foo", "foo")]
