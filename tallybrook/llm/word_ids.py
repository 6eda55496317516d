"""Token ids of whole texts by a tokenizer that never looks across white space.

A text is cut into words at ASCII white space, and a word once more where letters or digits end and
ASCII punctuation follows, which no token spans either. ASCII parts are taken in lower case, as the
tokenizer lowers them itself. Each distinct part is encoded once per task and then looked up, so the
cost follows the number of distinct parts more than that of words.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallybrook.llm.textarrays import joined, ranges, segment_sums, strings, word_spans

AT_ONCE = 4 << 20  # bytes of text looked up at a time
CACHED_PARTS = 400_000  # a task's memory of encoded parts; it is emptied when full
TOGETHER = 500  # parts that are encoded in one call
# none of these begins a contraction or belongs to a special token's brackets
PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
BRACKET = "<|"


def _units(texts: Sequence[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(text number, text or a part of it cut at white space), some megabytes at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        start, text = 0, text or ""
        while start < len(text):
            stop = start + AT_ONCE
            while stop < len(text) and text[stop] not in " \t\n\x0b\x0c\r":
                stop += 1
            held.append((row, text[start:stop]))
            size += min(stop, len(text)) - start
            start = stop
            if size >= AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _cut(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Parts before the punctuation at a word's end; which words have such an end; these ends."""
    core = pc.ascii_rtrim(words, characters=PUNCTUATION)
    core = pc.if_else(pc.match_substring_regex(core, "[0-9A-Za-z]$"), core, words)
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    core_lengths = pc.binary_length(core).to_numpy().astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if lengths.sum() else np.zeros(0, np.uint8)
    starts = np.cumsum(lengths) - lengths
    has_end = lengths > core_lengths
    own = (lengths - core_lengths)[has_end]
    ends = strings(data[ranges((starts + core_lengths)[has_end], own)], own)
    plain = pc.and_(pc.string_is_ascii(core), pc.invert(pc.match_substring(core, BRACKET)))
    return pc.if_else(plain, pc.ascii_lower(core), core), has_end, ends


def _keeps_letters_together(rules: dict) -> bool:
    """Whether a word of letters is one run to the file's pre-tokenizer: what comes before `[\\p{L}]+` among
    its alternatives begins with an apostrophe."""
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, found, _ = (steps[0].get("pattern") or {}).get("Regex", "").partition("[\\p{L}]+")
    return bool(found) and all(x.startswith("'") for x in first.split("|")[:-1]) and [s["type"] for s in steps[1:]] == ["ByteLevel"]


def _encoded(tokenizer, parts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class WordEncoder:
    def __init__(self, tokenizer: str):
        """`tokenizer` is the content of a tokenizer file."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer, pre_tokenizers

        rules = json.loads(tokenizer)
        self._tokenizer = self._for_letters = Tokenizer.from_str(tokenizer)
        if _keeps_letters_together(rules):
            # the same model; lower-case ASCII letters need neither normal form nor the cut by pattern
            self._for_letters = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
            self._for_letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = rules["model"].get("end_of_word_suffix")
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self._parts: dict[str, int] = {}
        self._ids, self._first, self._count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Parts of letters only end with the one id marked so, which tells many of them apart in one call."""
        ascii_letters, letters, apart = [], [], []
        for p in parts:
            if p.isascii():
                (ascii_letters if p.isalpha() else apart).append(p)
            else:
                (letters if unicodedata.normalize("NFC", p).lower().isalpha() else apart).append(p)
        ids, counts, order = [], [], []
        for tokenizer, some in ((self._for_letters, ascii_letters), (self._tokenizer, letters)):
            groups = [some[k : k + TOGETHER] for k in range(0, len(some), TOGETHER)]
            for own, together in zip(groups, _encoded(tokenizer, [" ".join(own) for own in groups])):
                ends = np.flatnonzero(self._ends[together]) + 1
                if len(ends) == len(own):
                    ids.append(together)
                    counts.append(np.diff(ends, prepend=0))
                    order += own
                else:
                    apart += own
        one_by_one = _encoded(self._tokenizer, apart)
        counts.append(np.fromiter(map(len, one_by_one), np.int64, len(one_by_one)))
        count, order = np.concatenate(counts), order + apart
        self._parts.update(zip(order, range(len(self._count), len(self._count) + len(order))))
        self._first = np.append(self._first, len(self._ids) + np.cumsum(count) - count)
        self._count = np.append(self._count, count)
        self._ids = np.concatenate([self._ids, *ids, *one_by_one])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where each part's encoding is."""
        found = parts.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self._parts) > CACHED_PARTS:
            self._forget()
        known = np.fromiter(map(self._parts.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            parts = [distinct[k] for k in new]
            self._learn(parts)
            known[new] = np.fromiter(map(self._parts.__getitem__, parts), np.int64, len(parts))
        return known[found.indices.to_numpy()]

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        buffer, starts, _ = joined(texts)
        begin, end, firsts = word_spans(buffer, starts)
        words = strings(buffer[ranges(begin, end - begin)], end - begin).dictionary_encode()
        cores, has_end, ends = _cut(words.dictionary)
        places = self._places(pa.concat_arrays([cores, ends]))
        # one part or two for each distinct word, then the ids of each distinct word, then of each word
        parts_of = 1 + has_end.astype(np.int64)
        first_part = np.cumsum(parts_of) - parts_of
        parts = np.empty(len(places), np.int64)
        parts[first_part] = places[: len(cores)]
        parts[first_part[has_end] + 1] = places[len(cores) :]
        ids = self._ids[ranges(self._first[parts], self._count[parts])]
        size = segment_sums(self._count[parts], first_part, parts_of)
        at = words.indices.to_numpy()
        return ids[ranges((np.cumsum(size) - size)[at], size[at])], segment_sums(size[at], firsts[:-1], np.diff(firsts))

    def ids(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for units in _units(texts):
            ids, sizes = self._looked_up([text for _, text in units])
            ends = np.cumsum(sizes)
            for (row, _), start, end in zip(units, ends - sizes, ends):
                found[row].append(ids[start:end])
        return [np.concatenate(parts) if parts else np.zeros(0, np.uint32) for parts in found]
