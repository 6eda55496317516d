"""How far the sources of a language differ in their terms, by chunk factorization.

Method: texts are cut at white space into chunks. Chunks are counted per document, a bounded slice of
documents at a time; a slice keeps its distinct chunks and, compressed, which document has which how
often. Each globally distinct chunk is tokenized into terms once. Its terms are joined back to the
slices that hold it, and a slice turns them into the occurrences of each term per group and the
number of documents that have it, which add up over slices as a document lies in one slice only. A
group is a (language, source).

A term that could not reach `min_docs` even if all documents of its chunks were different is not
joined back. That loses none: the sum bounds its documents in every language from above.

Skew: a chunk of every document is one row per slice; the joins by chunk and by term are plain ones
whose hot sides adaptive execution splits. Terms travel as numbers; only kept ones get their text back. Sources are compared as columns of a matrix of kept terms,
summed per batch of terms, so no term is paired with itself over sources row by row. The table of
probabilities has a cell per kept term and source of its language, which is what the result is made of.

Cases: null text, language and source count as ''; a group without terms still takes part, with counts
of 0; a language without kept terms gives pairs of value 0 and no terms; a language with one source
gives no pairs; repeated rows and ids count as documents of their own; text of any length stays whole;
equal values rank by the UTF-8 bytes of the item; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import LOWER, UPPER, arrow_map, ascii_lower, salted_left_join, slices, staged
from tallybrook.llm.textarrays import joined, ranges, strings, word_spans

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # fixed value
MIN_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
SLICE_BYTES, SLICE_CHUNKS = 32 << 20, 1 << 20  # text and distinct chunks from which a slice takes no more
MATRIX_CELLS = 1 << 21  # of probabilities compared at a time
PART_SCHEMA = pa.schema(
    [("slice", pa.int64()), ("at", pa.int32()), ("chunk", pa.string()), ("docs", pa.int32()), ("n_chunks", pa.int64())]
    + [("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("groups", pa.list_(pa.int32())), ("n_pairs", pa.int64()), ("pairs", pa.binary())]
)
PART_DDL = "slice bigint, at int, chunk string, docs int, n_chunks bigint, langs array<string>, sources array<string>, groups array<int>, n_pairs bigint, pairs binary"
COUNT_DDL = "lang string, source string, term bigint, docs bigint, occurrences bigint"


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed; the high bytes are mostly 0."""
    return pa.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class _Slice:
    """Documents of one slice, taken in a few megabytes at a time."""

    def __init__(self):
        self.size, self._chunks, self._groups = 0, {}, {}
        self._pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._group: list[int] = []

    def add(self, batch: pa.RecordBatch) -> None:
        texts = batch.column("text").to_pylist()
        buffer, starts, _ = joined(texts)
        begin, end, firsts = word_spans(buffer, starts)
        words = strings(buffer[ranges(begin, end - begin)], end - begin).dictionary_encode()
        at, n = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
        pair, count = np.unique(np.repeat(np.arange(len(texts)), np.diff(firsts)) * n + at, return_counts=True)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self._chunks.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        place[new] = np.arange(len(self._chunks), len(self._chunks) + len(new))
        self._chunks.update(zip([distinct[k] for k in new], place[new].tolist()))
        self._pairs.append(tuple(x.astype(np.int32) for x in (pair // n + len(self._group), place[pair % n], count)))
        for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            self._group.append(self._groups.setdefault(g, len(self._groups)))
        self.size += len(buffer)

    def full(self) -> bool:
        return self.size >= SLICE_BYTES or len(self._chunks) >= SLICE_CHUNKS

    def rows(self, slice_id: int) -> Iterator[pa.RecordBatch]:
        """One row that says which document has which chunk how often, and one per distinct chunk."""
        doc, place, count = (np.concatenate(x) for x in zip(*self._pairs))
        n = len(self._chunks)
        docs = np.bincount(place, minlength=n)
        order = np.argsort(-docs, kind="stable")  # frequent ones get small numbers
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        pair = doc.astype(np.int64) * n + rank[place]
        by_pair = np.argsort(pair)
        known = {"slice": slice_id, "n_chunks": n, "langs": [lang for lang, _ in self._groups], "sources": [source for _, source in self._groups]}
        known |= {"groups": self._group, "n_pairs": len(pair), "pairs": _squeezed(np.concatenate([np.diff(pair[by_pair], prepend=0), count[by_pair]]))}
        yield pa.RecordBatch.from_pylist([known], PART_SCHEMA)
        chunks = pa.array(list(self._chunks), pa.string()).take(pa.array(order))
        columns = {"slice": pa.array(np.full(n, slice_id)), "at": pa.array(np.arange(n, dtype=np.int32)), "chunk": chunks, "docs": pa.array(docs[order].astype(np.int32))}
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in PART_SCHEMA], schema=PART_SCHEMA)


def chunk_slices(docs: DataFrame) -> DataFrame:
    """Rows of slices and of their chunks (`_Slice.rows`). docs: text, lang, source without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id, current = TaskContext.get().partitionId() << 32, None
        for batch in slices(batches, max_bytes=SLICE_BYTES // 8):
            current = current or _Slice()
            current.add(batch)
            if current.full():
                yield from current.rows(slice_id)
                slice_id, current = slice_id + 1, None
        if current:
            yield from current.rows(slice_id)

    return arrow_map(docs.select("text", "lang", "source"), run, PART_DDL)


def chunk_terms(listed: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Numbered terms (term, name), without those that cannot reach `min_docs`, and rows (chunk, term),
    repeated as the term stands in the chunk.

    listed: chunk and the number of documents that have it, once per slice.
    """
    totals = listed.groupBy("chunk").agg(F.sum("docs").alias("docs"))
    names = F.regexp_extract_all(ascii_lower(F.col("chunk")), F.lit(TERM), F.lit(0))
    tokenized = staged(totals.withColumn("names", names).where(F.size("names") > 0), "chunk-terms")
    bound = tokenized.select("docs", F.explode(F.array_distinct("names")).alias("name")).groupBy("name").agg(F.sum("docs").alias("docs"))
    reachable = bound.where(F.col("docs") >= min_docs).select("name", F.monotonically_increasing_id().alias("term"))
    reachable = staged(reachable, "reachable-terms")  # so that a number stays what it is
    return reachable, tokenized.select("chunk", F.explode("names").alias("name")).join(reachable, "name").select("chunk", "term")


def _slice_counts(row: pa.RecordBatch) -> pa.RecordBatch:
    """Documents and occurrences per group and term of one slice, from the terms of its chunks."""
    one = {name: row.column(name)[0] for name in row.schema.names}
    n_chunks, n_pairs = one["n_chunks"].as_py(), one["n_pairs"].as_py()
    known = one["known"].values
    at, term = (known.field(name).to_numpy() for name in ("at", "term"))
    names, local = np.unique(term, return_inverse=True)
    sizes = np.bincount(at, minlength=n_chunks)
    by_chunk = local[np.argsort(at, kind="stable")]

    numbers = _unsqueezed(one["pairs"].as_py(), 2 * n_pairs)
    pair, count = np.cumsum(numbers[:n_pairs]), numbers[n_pairs:].astype(np.int32)
    doc, chunk = (pair // n_chunks).astype(np.int32), (pair % n_chunks).astype(np.int32)
    del numbers, pair
    has = sizes[chunk]
    cells = np.repeat(doc, has).astype(np.int64) * len(names) + by_chunk[ranges((np.cumsum(sizes) - sizes)[chunk], has)]
    cell, at = np.unique(cells, return_inverse=True)  # a document and one of its terms
    occurrences = np.bincount(at, np.repeat(count, has), len(cell))  # whole numbers below 2^53
    group = np.asarray(one["groups"].values)[cell // len(names)].astype(np.int64)
    key, at = np.unique(group * len(names) + cell % len(names), return_inverse=True)
    group = pa.array(key // len(names))
    columns = {
        "lang": one["langs"].values.take(group),
        "source": one["sources"].values.take(group),
        "term": pa.array(names[key % len(names)]),
        "docs": pa.array(np.bincount(at, minlength=len(key))),
        "occurrences": pa.array(np.bincount(at, occurrences, len(key)).astype(np.int64)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def term_counts(parts: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, term, docs, occurrences.

    parts: what `chunk_slices` gives, written. terms: rows (chunk, term).
    """
    found = parts.where("chunk IS NOT NULL").select("slice", "at", "chunk").join(terms, "chunk")
    known = found.groupBy("slice").agg(F.collect_list(F.struct("at", "term")).alias("known"))
    held = parts.where("pairs IS NOT NULL").select("slice", "n_chunks", "langs", "sources", "groups", "n_pairs", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _slice_counts(batch.slice(k, 1))

    counted = arrow_map(held.join(known, "slice"), run, COUNT_DDL)
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))


def _probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in whole numbers of 38 digits."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.call_function("div", product, (total + PRIOR * terms).cast("decimal(20,0)")) + 1


def _compared(cells: DataFrame) -> DataFrame:
    """lang, i, j, value: the distance of the i-th and the j-th source, i < j, over all kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                own = batch.column("ps").filter(pa.array(langs == lang))
                width = len(own[0])
                matrix = np.asarray(own.flatten()).reshape(len(own), width)
                for i in range(width - 1):
                    value = np.zeros(width - 1 - i, np.int64)
                    step = max(1, MATRIX_CELLS // width)
                    for k in range(0, len(matrix), step):
                        value += np.abs(matrix[k : k + step, i : i + 1] - matrix[k : k + step, i + 1 :]).sum(0)
                    j = np.arange(i + 1, width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(j), pa.string()), pa.array(np.full(len(j), i), pa.int32()), pa.array(j, pa.int32()), pa.array(value)],
                        ["lang", "i", "j", "value"],
                    )

    sums = arrow_map(cells.select("lang", "ps"), run, "lang string, i int, j int, value bigint")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_column: str = "text", lang_column: str = "lang", source_column: str = "source"
) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    columns = {"text": text_column, "lang": lang_column, "source": source_column}
    plain = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in columns.items()))
    parts = staged(chunk_slices(plain), "divergence-slices")
    names, terms = chunk_terms(parts.where("chunk IS NOT NULL").select("chunk", "docs"), min_docs)
    counts = staged(term_counts(parts, terms), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("total"))
    kept = kept.where(F.col("docs") >= min_docs).drop("docs")
    by_source = counts.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "occurrences"))).alias("by_source"))
    kept = kept.join(by_source, ["lang", "term"]).join(names, "term").drop("term").withColumnRenamed("name", "term")
    kept = staged(kept, "divergence-terms")

    per_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    per_group = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = parts.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("sources").alias("source")))).distinct()
    groups = groups.join(per_group, ["lang", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    in_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("sources"))
    in_lang = staged(in_lang.join(per_lang, "lang", "left"), "divergence-groups")

    cells = salted_left_join(kept, in_lang, ["lang"])
    counted = F.transform("sources", lambda s: F.coalesce(F.element_at("by_source", s["source"]), F.lit(0)))
    cells = cells.select("lang", "term", "sources", counted.alias("counts"), "terms", _probability(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"))
    ps = F.transform("sources", lambda s, i: _probability(F.get("counts", i), s["size"], F.col("terms")))
    cells = staged(cells.withColumn("ps", ps).drop("terms"), "divergence-cells")

    above = F.filter(F.arrays_zip(F.col("sources.source").alias("source"), "counts", "ps"), lambda x: (x["counts"] > 0) & (x["ps"] > F.col("q")))
    terms = cells.select("lang", F.col("term").alias("item"), "q", F.inline(above)).withColumn("value", F.col("ps") - F.col("q"))

    names = in_lang.select("lang", "sources.source")
    pairs = names.select("lang", "source", F.posexplode("source").alias("i", "left"))
    pairs = pairs.select("lang", "i", "left", F.posexplode("source").alias("j", "right")).where("i < j")
    pairs = pairs.join(_compared(cells), ["lang", "i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    both = F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item")))
    pairs = pairs.select("lang", F.inline(both), "value")
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term", top_terms))


def oracle(documents: str = "documents", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> str:
    """Terms straight from whole texts, one row per occurrence, and the full grid of groups and terms."""
    p = f"1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (size + {PRIOR} * v)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM {documents}),
    found AS (SELECT rid, lang, source, unnest(t) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS total FROM found GROUP BY lang, term HAVING count(DISTINCT rid) >= {min_docs}),
    langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    grid AS (SELECT g.lang, g.source, k.term, k.total, coalesce(f.n, 0) AS n FROM groups g JOIN kept k USING (lang)
        LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL) f USING (lang, source, term)),
    sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size FROM grid),
    cells AS (SELECT s.lang, source, term, n, ({p.replace("size", "s.size")})::BIGINT AS p, ({p.replace("(n +", "(total +").replace("size", "l.size")})::BIGINT AS q FROM sized s JOIN langs l USING (lang)),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
    terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM cells WHERE n > 0 AND p > q),
    both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
    SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank
    FROM both_parts QUALIFY part = 'pair' OR rank <= {top_terms}"""
