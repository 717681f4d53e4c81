"""Token ids of whole texts, by the tokenizers library.

The library is asked once for each distinct unit of text and its answer is kept, because a corpus repeats
its words. Units end where the tokenizer's own pre-tokenizer surely cuts: around runs of white space, and
between runs of letters, digits and other signs. A piece between blanks that holds an apostrophe or
anything beyond ASCII and Latin letters is one unit; a text with Unicode's other kinds of white space goes
to the library whole. That is exact for byte-level BPE (a blank belongs to the run behind it) and for word
BPE that drops white space; which of the two holds is found out by encoding "a b".
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import FOLD, SPACES, Chunk, chunks, hashes, mix

#: Units that a worker keeps (about 50 bytes each); beyond them it forgets the half that it met least.
KEPT = 1 << 18
#: Words that go to the library as one text; texts that go to it in one call.
JOINED, AT_ONCE = 200, 64

_U = np.uint64
#: 1 letters, 2 signs, 3 digits, 4 what makes its piece one unit. White space gets 0 (goes with the next unit, or is dropped), 5 or 6.
_KIND = np.full(256, 4, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[[k for k in range(0x21, 0x7F) if not chr(k).isalnum() and k != 0x27]] = 2
_KIND[0x30:0x3A] = 3


def _exotic(buf: np.ndarray) -> np.ndarray:
    """Where Unicode's white space beyond ASCII begins."""
    at = np.flatnonzero((buf[:-8] == 0xC2) | ((buf[:-8] >= 0xE1) & (buf[:-8] <= 0xE3)))
    a, b, c = buf[at], buf[at + 1], buf[at + 2]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[hit]


class Encoder:
    """``special``: the strings of added tokens in a text are those tokens, as the library has it by default; else they are ordinary text."""

    def __init__(self, path: str, end: int, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core; more threads only hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [FOLD[np.frombuffer(x.content.encode(), np.uint8)].tobytes() for x in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        a, b, both, capital = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", "b", "a b", "A"))
        self.glued, self.folds = both != a + b, capital == a
        # words joined by blanks come apart again where a token begins with the blank, or ends the word
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(k) or "" for k in range(n)]
        self.opens = np.array([x.startswith("Ġ") for x in names])
        self.closes = np.array([x.endswith("</w>") for x in names])
        self.end = end
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._rebuild()

    # the units' hashes in an open-addressing table
    def _rebuild(self) -> None:
        bits = max(16, (2 * len(self.keys)).bit_length() + 1)
        self.slots, self.owner = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self._insert(self.keys, np.arange(len(self.keys)))

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        left, at = np.arange(len(keys)), (keys & _U(len(self.slots) - 1)).astype(np.int64)
        while len(left):
            free = left[self.slots[at[left]] == 0]
            self.slots[at[free]] = keys[free]
            done = self.slots[at[left]] == keys[left]
            self.owner[at[left[done]]] = numbers[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of units, -1 for new ones."""
        at = (keys & _U(len(self.slots) - 1)).astype(np.int64)
        there = self.slots[at]
        out = np.where(there == keys, self.owner[at], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            there = self.slots[at[left]]
            same = there == keys[left]
            out[left[same]] = self.owner[at[left[same]]]
            left = left[~same & (there != 0)]
        return out

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, size = [np.zeros(0, np.uint32)], []
        for k in range(0, len(pieces), AT_ONCE):  # the library's answers are large
            for x in self.tokenizer.encode_batch(pieces[k : k + AT_ONCE], add_special_tokens=False):
                ids = x.ids
                out.append(np.array(ids, np.uint32))
                size.append(len(ids))
        return np.concatenate(out), np.array(size, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words of letters, each with its blank, many to a text."""
        glue = "" if self.glued else " "
        ids, _ = self._library([glue.join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])
        edge = np.flatnonzero(self.opens[ids]) if self.glued else np.flatnonzero(self.closes[ids]) + 1
        size = np.diff(np.append(edge, len(ids)) if self.glued else np.append(0, edge))
        return (ids, size) if len(size) == len(words) else self._library(words)

    def _learn(self, buf: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray, blank: np.ndarray, word: np.ndarray) -> None:
        raw = buf.tobytes()
        text = [(" " if g else "") + raw[a:b].decode() for a, b, g in zip(first.tolist(), last.tolist(), blank.tolist())]
        easy = word & (blank | (not self.glued))
        order = np.concatenate((np.flatnonzero(easy), np.flatnonzero(~easy)))
        easy = easy[order]
        text = [text[k] for k in order]
        n = int(easy.sum())
        (ids1, size1), (ids2, size2) = self._words(text[:n]), self._library(text[n:])
        size = np.concatenate((size1, size2))
        base = len(self.size)
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, ids1, ids2))
        self.keys = np.concatenate((self.keys, keys[order]))
        self.met = np.concatenate((self.met, np.zeros(len(size), np.int64)))
        if 3 * len(self.keys) > len(self.slots):
            self._rebuild()
        else:
            self._insert(keys[order], base + np.arange(len(order)))

    def _forget(self) -> None:
        keep = self.met > np.partition(self.met, -(KEPT // 2))[-(KEPT // 2)]
        size = self.size[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.begin[keep] - ends + size, size) + np.arange(size.sum())]
        self.begin, self.size, self.met, self.keys = ends - size, size, self.met[keep] // 2, self.keys[keep]
        self._rebuild()

    def _added(self, buf: np.ndarray) -> np.ndarray:
        """Where strings of added tokens begin, whatever their case."""
        raw, at = FOLD[buf].tobytes() if self.added else b"", []
        for x in self.added:
            k = raw.find(x)
            while k >= 0:
                at.append(k)
                k = raw.find(x, k + 1)
        return np.array(at, np.int64)

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts, each text's end id included, and how many each text has."""
        buf = FOLD[c.buf] if self.folds else c.buf
        body = buf[:-8]
        space = SPACES[body]
        kind = _KIND[body]
        kind[np.flatnonzero((body[:-1] == 0xC3) & ((body[1:] == 0x97) | (body[1:] == 0xB7)))] = 4  # the Latin signs of multiplication and division
        kind[space] = 0
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        last = np.flatnonzero(~space[:-1] & space[1:]) + 1
        odd = np.concatenate(([0], np.cumsum(kind == 4)))
        odd = np.flatnonzero(odd[last] > odd[first])
        if len(odd):
            step = np.zeros(len(body) + 1, np.int8)
            step[first[odd]] += 1
            step[last[odd]] -= 1
            kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = 4
        if self.glued:  # of a run of white space, all but the last sign is a unit, and so is a last sign other than a blank
            inside = np.ones(len(body), bool)
            inside[np.concatenate(([0], c.end))] = False
            own = space & inside
            follows = np.append(inside[1:] & ~space[1:], False)
            kind[own] = np.where(follows[own], np.where(body[own] == 0x20, 0, 5), 6)
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        # texts without white space between them still end where they end: the separator has kind 0
        kinds = kind[edge]
        start, stop = edge[kinds > 0], np.append(edge[1:], len(body))[kinds > 0]
        kinds = kinds[kinds > 0]
        of = np.append(np.searchsorted(start, c.start), len(start))
        blank = np.zeros(len(start), bool)
        if self.glued:
            blank = (kind[start - 1] == 0) & (body[start - 1] == 0x20)
            blank[of[:-1][(of[:-1] < len(start))]] &= start[of[:-1][of[:-1] < len(start)]] != c.start[of[:-1] < len(start)]
        keys = hashes(buf, start, stop)
        keys = mix(keys ^ np.where(blank, _U(0x9E3779B97F4A7C15), _U(0)))
        keys[keys == 0] = 1
        at = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, pick = np.unique(keys[new], return_index=True)
            pick = new[pick]
            self._learn(buf, fresh, start[pick], stop[pick], blank[pick], kinds[pick] == 1)
            at[new] = self._find(keys[new])
        self.met += np.bincount(at, minlength=len(self.met))
        size = self.size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        count = ends[of[1:]] - ends[of[:-1]] + 1
        # each text's ids, then its end id: the ids move on by one for each text before
        ids = np.full(int(ends[-1]) + c.n, self.end, np.uint32)
        text = np.repeat(np.arange(c.n), np.diff(of))
        to = np.repeat(ends[:-1] + text, size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        ids[to] = self.flat[np.repeat(self.begin[at] - ends[:-1], size) + np.arange(ends[-1])]
        whole = np.unique(np.searchsorted(c.start, np.concatenate((_exotic(c.buf), self._added(c.buf))), "right") - 1)
        if len(whole):
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in whole.tolist():
                parts[k] = np.array([*self.tokenizer.encode(c.buf[c.start[k] : c.end[k]].tobytes().decode(), add_special_tokens=False).ids, self.end], np.uint32)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if len(self.size) > KEPT:
            self._forget()
        return ids, count


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One a Python worker."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end, special=True)
    return _encoders[path, end]


def width_of(path: str) -> int:
    """Bytes an id takes."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def packed(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    """One binary value a row."""
    raw, ends = ids.tobytes(), np.cumsum(count) * ids.itemsize
    return pa.array([raw[a:b] for a, b in zip((ends - count * ids.itemsize).tolist(), ends.tolist())], pa.binary())


def token_table(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``(doc_id, mark, part, n_tokens, ids)``: each text's ids and the end id, little-endian, 2 bytes each if the vocabulary allows, else 4.

    mark is xxhash64 of the text, part the task that encoded it. Null texts are empty.
    """
    width = width_of(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end)
        for c in chunks(batches):
            ids, count = enc.encode(c)
            part = pa.array(np.full(c.n, TaskContext.get().partitionId()), pa.int32())
            yield pa.record_batch([c.column("doc_id"), c.column("mark"), part, pa.array(count), packed(ids.astype(f"<u{width}"), count)], ["doc_id", "mark", "part", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(run, "doc_id long, mark long, part int, n_tokens long, ids binary")
