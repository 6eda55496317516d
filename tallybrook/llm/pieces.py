"""SentencePiece encoding with sampled segmentations, and lossless decoding.

Method: the pieces of a given model span a lattice over the text. Forward filtering sums, for each
position, the weight of all segmentations up to it; backward sampling then draws one, from the end,
with random numbers that follow from the row's key, the word and the step. The same key and text so
give the same pieces wherever and however often a row is encoded. The model is read from a file on
the driver, never trained; the weight of a piece is (its rank + RANK_OFFSET) ^ -sharpness, as the
scores of such models are ranks.

No piece has white space behind other characters, so the lattice falls apart at words; the forward
pass runs once for each distinct word of a slice.

Decoding joins the pieces' bytes and drops the space that encoding puts in front. Characters that
the model lacks, and the model's own sign for a space, are spelled in byte pieces.

Cases: a null text has null pieces and decodes to null; an empty text has none; a null key is a key
like any other; repeated rows get the same pieces; words beyond LONG characters take a slower path
with the same results in law; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import OWN_COLUMNS, arrow_map, schema_with, slices
from tallybrook.llm.textarrays import mixed, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANK_OFFSET = 10.0
UNKNOWN = 1e-6  # weight of a character that is spelled in bytes
LONG = 48
SLICE_BYTES = 512 << 10  # of texts that a task holds as arrays at a time
SPACE = 0x2581  # fixed value: the model's sign for a space
LITERAL = 0x110000  # stands for that sign in a text
_WORD = re.compile(" +[^ ]*")
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """A hash table of all prefixes of pieces, and each piece's weight and bytes."""

    keys: np.ndarray
    values: np.ndarray  # piece id; -1: a prefix only
    weights: np.ndarray
    flat: np.ndarray  # the bytes of all pieces
    first: np.ndarray
    size: np.ndarray
    bytes_at: np.ndarray  # id of each byte piece
    longest: int
    by_text: dict[str, int]

    @classmethod
    def load(cls, path: str = MODEL, sharpness: float = 1.0) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.vocab_size()
        spelled, by_text, bytes_at = [], {}, np.full(256, -1, np.int64)
        for k in range(count):
            text = model.id_to_piece(k)
            if model.is_byte(k):
                spelled.append(bytes([int(text[3:5], 16)]))
                bytes_at[spelled[-1][0]] = k
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                spelled.append(b"")
            else:
                spelled.append(text.replace(chr(SPACE), " ").encode())
                if not re.search(f"[^{chr(SPACE)}]{chr(SPACE)}", text):
                    by_text[text] = k
        ranks = -np.array([model.get_score(k) for k in range(count)])
        weights = np.where(ranks >= 0, (np.maximum(ranks, 0) + RANK_OFFSET) ** -sharpness, 0.0)
        prefixes: dict[int, int] = {}
        for text, k in by_text.items():
            code = 0
            for n, letter in enumerate(text):
                code = _advance(np.array([code], np.uint64), np.array([ord(letter)], np.uint64))[0]
                prefixes[int(code)] = k if n + 1 == len(text) else prefixes.get(int(code), -1)
        slots = 1 << max((8 * len(prefixes)).bit_length(), 4)
        keys, values = np.zeros(slots, np.uint64), np.full(slots, -2, np.int32)
        for code, k in prefixes.items():
            at = code >> (64 - slots.bit_length() + 1)
            while values[at] != -2:
                at = (at + 1) % slots
            keys[at], values[at] = code, k
        size = np.array([len(s) for s in spelled])
        return cls(keys, values, weights, np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size, size, bytes_at, max(map(len, by_text)), by_text)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The value of each prefix, -2 if there is none."""
        at = (codes >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)
        out = self.values[at]
        live = np.flatnonzero((out != -2) & (self.keys[at] != codes))
        while len(live):
            at[live] = (at[live] + 1) % len(self.keys)
            out[live] = self.values[at[live]]
            live = live[(out[live] != -2) & (self.keys[at[live]] != codes[live])]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows of ids, each with the space in front, and where each row begins."""
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        return self.flat[ranges(self.first[ids], size)], ends[offsets]


def _advance(code: np.ndarray, letter: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(code + (letter + np.uint64(1)) * _STEP)


class Lattice:
    """Forward weights of distinct words, up to LONG characters each.

    Nodes are laid out by position: position j holds the words with at least j characters, longest
    first.
    """

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        self.vocabulary = vocabulary
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        self.rank = np.empty(len(texts), np.int64)
        self.rank[order] = np.arange(len(texts))
        self.size = size[order]
        longest = int(self.size[0]) if len(texts) else 0
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        letters = np.where(letters == SPACE, LITERAL, np.where(letters == 32, SPACE, letters)).astype(np.uint64)
        first = (np.cumsum(size) - size)[order]
        live = np.searchsorted(-self.size, -np.arange(longest + 1), "right")  # words with at least j characters
        self.base = np.append(0, np.cumsum(live))
        column = [first[: live[j + 1]] + j for j in range(longest)]
        grid = letters[np.concatenate(column)] if column else letters
        begin = np.append(0, np.cumsum(live[1:]))  # of the letters at position j
        at = np.arange(len(grid))
        word = at - np.repeat(begin[:-1], live[1:])
        position = np.repeat(np.arange(longest), live[1:])
        code = np.zeros(len(grid), np.uint64)
        self.pieces: list[np.ndarray] = []  # by length - 1: the piece that begins at each letter
        edges = []
        for length in range(1, min(vocabulary.longest, longest) + 1):
            inside = position[at] + length <= self.size[word[at]]
            at, code = at[inside], code[inside]
            code = _advance(code, grid[begin[position[at] + length - 1] + word[at]])
            found = vocabulary.find(code)
            row = np.full(len(grid), -1, np.int32)
            row[at] = np.maximum(found, -1)
            if length == 1:
                self.unknown, which = np.unique(grid[row < 0], return_inverse=True)
                row[row < 0] = len(vocabulary.weights) + which
            self.pieces.append(row)
            some = np.flatnonzero(row >= 0)
            edges.append((some, np.searchsorted(some, begin)))
            at, code = at[found != -2], code[found != -2]
        self.begin = begin
        self.weights = np.append(vocabulary.weights, np.full(len(self.unknown) if longest else 0, UNKNOWN))
        self.alpha = np.zeros(int(self.base[-1]))
        self.alpha[: len(texts)] = 1.0
        for j in range(1, longest + 1):
            for length in range(1, min(j, len(edges)) + 1):
                some, bounds = edges[length - 1]
                start = j - length
                own = some[bounds[start] : bounds[start + 1]]
                if len(own):
                    w = own - begin[start]
                    self.alpha[self.base[j] + w] += self.alpha[self.base[start] + w] * self.weights[self.pieces[length - 1][own]]

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each given word, drawn from the end, in order of words; and their number."""
        rank = self.rank[word]
        position = self.size[rank]
        live = np.flatnonzero(position > 0)
        steps, count = [], np.zeros(len(word), np.int64)
        while len(live):
            k = len(steps)
            with np.errstate(over="ignore"):
                draw = (mixed(seed[live] + np.uint64(k + 1) * _STEP) >> np.uint64(11)).astype(float) * 2.0**-53
            r, j = rank[live], position[live]
            rest = draw * self.alpha[self.base[j] + r]
            chosen, width = np.full(len(live), -1, np.int64), np.zeros(len(live), np.int64)
            open_, last = np.arange(len(live)), np.zeros(len(live), np.int64)
            for length in range(1, len(self.pieces) + 1):
                start = j[open_] - length
                some = start >= 0
                open_, start = open_[some], start[some]
                if not len(open_):
                    break
                piece = self.pieces[length - 1][self.begin[start] + r[open_]]
                mass = np.where(piece >= 0, self.alpha[self.base[start] + r[open_]] * self.weights[piece], 0.0)
                valid = mass > 0
                chosen[open_[valid]], width[open_[valid]] = piece[valid], length  # stays, if rounding leaves no other
                rest[open_] -= mass
                open_ = open_[rest[open_] >= 0]
            steps.append((live, chosen))
            count[live] += 1
            position[live] -= width
            live = live[position[live] > 0]
        out = np.empty(int(count.sum()), np.int64)
        end = np.cumsum(count) - 1
        for k, (rows, chosen) in enumerate(steps):
            out[end[rows] - k] = chosen
        return out, count


def _slow(vocabulary: Vocabulary, text: str, seed: int) -> list[int]:
    """Pieces of one long word, in logarithms; an unknown character is -1 - its code."""
    text = text.translate({32: SPACE, SPACE: LITERAL - 1})
    edges: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text) + 1)]
    alpha = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for start in range(max(0, j - vocabulary.longest), j):
            piece = vocabulary.by_text.get(text[start:j])
            weight = UNKNOWN
            if piece is None:
                if j - start > 1:
                    continue
                piece = -1 - (SPACE if ord(text[start]) == LITERAL - 1 else ord(text[start]))
            else:
                weight = float(vocabulary.weights[piece])
            if weight > 0:
                edges[j].append((start, piece, alpha[start] + math.log(weight)))
        top = max(e[2] for e in edges[j])
        alpha[j] = top + math.log(sum(math.exp(e[2] - top) for e in edges[j]))
    out, j = [], len(text)
    while j:
        with np.errstate(over="ignore"):
            draw = float(mixed(np.array([seed], np.uint64) + np.uint64(len(out) + 1) * _STEP)[0] >> np.uint64(11)) * 2.0**-53
        for start, piece, weight in reversed(edges[j]):
            draw -= math.exp(weight - alpha[j])
            if draw < 0:
                break
        out.append(piece)
        j = start
    return out[::-1]


def encode_batch(vocabulary: Vocabulary, texts: list[str | None], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts, and where each text's begin (with the end)."""
    found = [_WORD.findall(" " + t) if t else [] for t in texts]
    per_text = np.fromiter(map(len, found), np.int64, len(found))
    word, distinct = pd.factorize(np.array([w for ws in found for w in ws], object))
    with np.errstate(over="ignore"):
        number = ranges(np.zeros(len(texts), np.int64), per_text).astype(np.uint64)
        seed = mixed(np.repeat(seeds.astype(np.int64).view(np.uint64), per_text) + mixed(number + np.uint64(1)))
    long = np.fromiter((len(w) > LONG for w in distinct), bool, len(distinct))
    lattice = Lattice(vocabulary, ["" if skip else w for w, skip in zip(distinct, long, strict=True)])
    ids, count = lattice.sample(word, seed) if len(word) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    unknown = [SPACE if c == LITERAL else int(c) for c in lattice.unknown] if len(distinct) and lattice.size[0] else []
    if long.any():
        slow = {int(k): _slow(vocabulary, distinct[word[k]], int(seed[k])) for k in np.flatnonzero(long[word])}
        extra = {c for s in slow.values() for c in s if c < 0}
        place = {c: len(vocabulary.weights) + len(unknown) + n for n, c in enumerate(sorted(extra))}
        unknown += [-1 - c for c in sorted(extra)]
        starts = np.cumsum(count) - count
        at = np.repeat([starts[k] for k in slow], [len(s) for s in slow.values()])
        ids = np.insert(ids, at, [place.get(c, c) for s in slow.values() for c in s])
        count[list(slow)] = [len(s) for s in slow.values()]
    ends = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(per_text))]
    odd = ids >= len(vocabulary.weights)
    if odd.any():  # spell what the model lacks in bytes
        spelled = [chr(c).encode() for c in unknown]
        flat = vocabulary.bytes_at[np.frombuffer(b"".join(spelled), np.uint8)]
        size = np.array([len(s) for s in spelled])
        which = ids[odd] - len(vocabulary.weights)
        width = np.ones(len(ids), np.int64)
        width[odd] = size[which]
        out = np.repeat(ids, width)
        out[np.repeat(odd, width)] = flat[ranges((np.cumsum(size) - size)[which], size[which])]
        ends = np.append(0, np.cumsum(width))[ends]
        ids = out
    return ids, ends


def _lossless(vocabulary: Vocabulary, texts: list[str | None], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text's pieces decode to it."""
    decoded, first = vocabulary.decode(ids, ends)
    wanted = np.frombuffer(b"".join(b" " + t.encode() if t else b"" for t in texts), np.uint8)
    size = np.fromiter((len(t.encode()) + 1 if t else 0 for t in texts), np.int64, len(texts))
    same = np.diff(first) == size
    if same.all():
        wrong = np.append(0, np.cumsum(decoded != wanted))
        return np.diff(wrong[first]) == 0
    starts = np.cumsum(size) - size
    return np.array([s and bool((decoded[f : f + n] == wanted[a : a + n]).all()) for s, f, a, n in zip(same, first[:-1], starts, size, strict=True)], bool)


def encode(docs: DataFrame, key: Column, keep: list[str | Column], vocabulary: Vocabulary | None = None) -> DataFrame:
    """The columns `keep` of `docs` with `pieces` and whether they decode to the text (`lossless`)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())  # 5 MB
    kept = docs.select(*keep, F.col("text").alias("__text"), F.xxhash64(key).alias("__seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in slices(batches, "__text", SLICE_BYTES):
            texts = batch.column("__text").to_pylist()
            ids, ends = encode_batch(vocabulary, texts, batch.column("__seed").to_numpy())
            null = pa.array([t is None for t in texts])
            pieces = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null)
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in OWN_COLUMNS]
            names = [n for n in batch.schema.names if n not in OWN_COLUMNS]
            lossless = pa.array(_lossless(vocabulary, texts, ids, ends))
            yield pa.RecordBatch.from_arrays([*columns, pieces, lossless], names=[*names, "pieces", "lossless"])

    return arrow_map(kept, run, schema_with(kept, "pieces array<int>, lossless boolean"))


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """`encoded` with `text`, which replaces `pieces`."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())
    kept = [(n, t) for n, t in encoded.dtypes if n not in ("pieces", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            pieces = batch.column("pieces")
            ends = np.append(0, np.cumsum(pieces.value_lengths().fill_null(0).to_numpy().astype(np.int64)))
            decoded, first = vocabulary.decode(pieces.flatten().to_numpy(), ends)
            whole = decoded.tobytes()
            null = pieces.is_null().to_pylist()
            texts = [None if none else whole[a + 1 : b].decode() for none, a, b in zip(null, first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in kept), pa.array(texts, pa.string())], names=[*(n for n, _ in kept), "text"])

    return arrow_map(encoded.select(*(n for n, _ in kept), "pieces"), run, ", ".join(f"`{n}` {t}" for n, t in [*kept, ("text", "string")]))
