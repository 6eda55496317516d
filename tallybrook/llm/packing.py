"""Hierarchical multi-length packing of tokenised documents into training sequences.

Method: windows have several lengths (2048, 1024, 512, 256 tokens). A document first gives off whole
longest windows; what remains is routed to the shortest window that holds it. Tiers are packed from
long to short: a remainder opens a window of its tier, and its gap, which is shorter than half the
window, is filled from the shorter tiers, with the longest remainders that fit and, when none fits,
with a cut of the shortest one. Windows that stay open when nothing shorter is left are poured
together into longest windows. The last tokens of a task, fewer than one longest window, end in
windows of falling powers of two. So no window needs padding. Windows of one length are then dealt
over steps, groups of equal token budget, so that steps of a length differ by one window at most.

A task packs its own documents, a bounded slice at a time, with what the slice before left open
(below 2048 tokens); nothing is gathered. Sequence ids count within a task, whose number they carry:
a task that is run again on the same rows gives the same sequences.

`word_ids` has the tokens: the tokenizer drops white space and never looks across it, so each distinct
part of a word is encoded once per task and then looked up.

Cases: a null or empty text is one piece that holds the end id; repeated rows and ids are packed like
others; a null id stays null; a text is never cut short, however long (a text without white space
must fit a task's memory, as the tokenizer takes it whole); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import arrow_map, slices
from tallybrook.llm.word_ids import WordEncoder

TOKENIZER = "word_bpe_49k.json"
WINDOWS = (2048, 1024, 512, 256)
END_ID = 1
END = np.array([END_ID], np.uint32)
STEP_TOKENS = 1 << 18  # of one training step
SLICE_BYTES = 4 << 20
TASK_BITS = 36  # a sequence id is the task's number above, its own number below


@dataclass
class Piece:
    row: int  # of the document within what is packed together
    start: int
    length: int


class Waiting:
    """Remainders by length; a bit per length that has any finds the next one to take."""

    def __init__(self, longest: int):
        self._by_length: list[list[Piece]] = [[] for _ in range(longest + 1)]
        self._some = 0

    def put(self, piece: Piece) -> None:
        self._by_length[piece.length].append(piece)
        self._some |= 1 << piece.length

    def _take(self, length: int) -> Piece:
        pieces = self._by_length[length]
        piece = pieces.pop()
        if not pieces:
            self._some &= ~(1 << length)
        return piece

    def longest(self, limit: int) -> Piece | None:
        """The longest one up to `limit`."""
        some = self._some & ((1 << (limit + 1)) - 1)
        return self._take(some.bit_length() - 1) if some else None

    def cut(self, length: int, limit: int) -> Piece | None:
        """`length` tokens off the shortest one up to `limit`; its rest goes on waiting."""
        some = self._some & ((1 << (limit + 1)) - 1)
        if not some:
            return None
        piece = self._take((some & -some).bit_length() - 1)
        self.put(Piece(piece.row, piece.start + length, piece.length - length))
        return Piece(piece.row, piece.start, length)


def _poured(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows from pieces one after the other, cut at the windows' ends, and what remains."""
    full, current, gap = [], [], window
    for piece in pieces:
        while piece.length >= gap:
            current.append(Piece(piece.row, piece.start, gap))
            piece = Piece(piece.row, piece.start + gap, piece.length - gap)
            full.append(current)
            current, gap = [], window
        if piece.length:
            current.append(piece)
            gap -= piece.length
    return full, current


def pack_lengths(lengths: Sequence[int], windows: Sequence[int] = WINDOWS) -> tuple[list[list[Piece]], list[Piece]]:
    """Exactly full windows for documents of these lengths, and pieces of less than one longest window."""
    windows = sorted(windows, reverse=True)
    top, full, waiting = windows[0], [], Waiting(windows[0])
    for row, length in enumerate(map(int, lengths)):
        whole = length - length % top
        full += [[Piece(row, start, top)] for start in range(0, whole, top)]
        if whole < length:
            waiting.put(Piece(row, whole, length - whole))
    left_open: list[Piece] = []
    for window, shorter in zip(windows, [*windows[1:], windows[-1]]):
        # what is longer than the next tier's window opens a window here; the last tier takes all
        while (first := waiting.longest(window)) is not None:
            if first.length <= shorter and window != windows[-1]:
                waiting.put(first)
                break
            content, gap = [first], window - first.length
            while gap:
                piece = waiting.longest(min(gap, shorter)) or waiting.cut(gap, shorter)
                if piece is None:
                    break
                content.append(piece)
                gap -= piece.length
            if gap:
                left_open += content
            else:
                full.append(content)
    poured, tail = _poured(left_open, top)
    return full + poured, tail


def _powers(tail: list[Piece]) -> list[list[Piece]]:
    """The last pieces in windows of falling powers of two."""
    found, left = [], tail
    while left:
        total = sum(p.length for p in left)
        content, left = _poured(left, 1 << (total.bit_length() - 1))
        found += content
    return found


class _Open:
    """Pieces that wait for the next slice, with their ids."""

    def __init__(self, keys: list, tokens: list[np.ndarray], starts: list[int], totals: list[int]):
        self.keys, self.tokens, self.starts, self.totals = keys, tokens, starts, totals


def _schema(id_type: str, id_column: str) -> str:
    return (
        f"`{id_column}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint,"
        " sequence_id bigint, offset bigint, window int, task bigint, place bigint"
    )


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """One row per piece: the id, `start` in its document's ids, `length`, `ids` (little-endian, four
    bytes each), `doc_tokens`, `sequence_id`, `offset` in it, the sequence's `window`, and the `task` that
    packed it as its `place`-th of that window.

    `tokenizer` is the path of a tokenizer file, read by the driver and sent to the tasks.
    """
    rules = Path(tokenizer or public_tokenizers.path(TOKENIZER)).read_text()
    rows = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text_column}`").alias("text"))
    schema = _schema(rows.schema["__id"].dataType.simpleString(), id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordEncoder(rules), TaskContext.get().partitionId()
        packer = _TaskPacker(task, windows, id_column)
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            tokens = [np.concatenate([ids, END]) for ids in encoder.ids(batch.column("text").to_pylist())]
            yield from packer.add(batch.column(0), tokens)
        yield from packer.end()

    return arrow_map(rows, run, schema)


class _TaskPacker:
    """Packs slice after slice of one task."""

    def __init__(self, task: int, windows: Sequence[int], id_column: str):
        self._task, self._windows, self._id_column = task, windows, id_column
        self._sequences, self._places = 0, {}
        self._key_type, self._open = None, _Open([], [], [], [])

    def add(self, keys: pa.Array, tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self._key_type = keys.type
        known = self._open
        rows = _Open(known.keys + keys.to_pylist(), known.tokens + tokens, known.starts + [0] * len(tokens), known.totals + [len(t) for t in tokens])
        full, tail = pack_lengths([len(t) for t in rows.tokens], self._windows)
        yield self._rows(full, rows)
        self._open = _Open(
            [rows.keys[p.row] for p in tail],
            [rows.tokens[p.row][p.start : p.start + p.length].copy() for p in tail],
            [rows.starts[p.row] + p.start for p in tail],
            [rows.totals[p.row] for p in tail],
        )

    def end(self) -> Iterator[pa.RecordBatch]:
        if self._open.keys:
            yield self._rows(_powers([Piece(row, 0, len(t)) for row, t in enumerate(self._open.tokens)]), self._open)

    def _rows(self, sequences: list[list[Piece]], rows: _Open) -> pa.RecordBatch:
        pieces = [p for s in sequences for p in s]
        lengths = np.fromiter((p.length for p in pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
        before = np.cumsum(lengths) - lengths
        firsts = np.cumsum(counts) - counts
        windows = np.add.reduceat(lengths, firsts) if len(sequences) else lengths
        places = np.zeros(len(sequences), np.int64)
        for window in np.unique(windows):
            own = np.flatnonzero(windows == window)
            places[own] = self._places.get(int(window), 0) + np.arange(len(own))
            self._places[int(window)] = self._places.get(int(window), 0) + len(own)
        sequence_ids = (self._task << TASK_BITS) + self._sequences + np.arange(len(sequences))
        self._sequences += len(sequences)
        columns = {
            self._id_column: pa.array([rows.keys[p.row] for p in pieces], self._key_type),
            "start": np.fromiter((rows.starts[p.row] + p.start for p in pieces), np.int64, len(pieces)),
            "length": lengths,
            "ids": pa.array([rows.tokens[p.row][p.start : p.start + p.length].astype("<u4").tobytes() for p in pieces], pa.binary()),
            "doc_tokens": np.fromiter((rows.totals[p.row] for p in pieces), np.int64, len(pieces)),
            "sequence_id": np.repeat(sequence_ids, counts),
            "offset": before - np.repeat(before[firsts] if len(sequences) else before, counts),
            "window": np.repeat(windows, counts).astype(np.int32),
            "task": np.full(len(pieces), self._task, np.int64),
            "place": np.repeat(places, counts),
        }
        return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], list(columns))


def with_steps(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Deal the sequences of each window over steps; adds `step`, replaces `task` and `place`.

    One row per task and window is enough to number the sequences of a window without gaps, and
    dealing by that number gives each step of a window equally many of them, or one more.
    """
    counts = pieces.groupBy("window", "task").agg((F.max("place") + 1).alias("sequences"))
    by_task = Window.partitionBy("window").orderBy("task")
    all_tasks = Window.partitionBy("window")
    earlier = F.sum("sequences").over(by_task) - F.col("sequences")
    steps = F.ceil(F.sum("sequences").over(all_tasks) * F.col("window") / step_tokens)
    plan = counts.select("window", "task", earlier.alias("earlier"), steps.alias("steps"))
    step = (F.col("earlier") + F.col("place")) % F.col("steps")
    return pieces.join(plan, ["window", "task"]).withColumn("step", step).drop("task", "place", "earlier", "steps")
