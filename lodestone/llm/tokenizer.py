"""Byte-level BPE through the tokenizers library, whole columns at a time, with the ids of known pieces kept.

A byte-level tokenizer first splits a text into pre-tokens and then encodes each alone. Some borders between
pre-tokens show in the bytes themselves (see ``_borders``), so a text may be cut there and its pieces encoded
alone. Pieces recur: each distinct one is encoded once, by the library, and its ids are then copied.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from lodestone.llm.common import chunks, utf8, word_hashes

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Visible ASCII: surely no white space.
_GRAPH = np.zeros(256, bool)
_GRAPH[33:127] = True
#: Visible ASCII that is neither letter, digit nor apostrophe.
_SIGN = _GRAPH & ~_LETTER
_SIGN[48:58] = _SIGN[39] = False


#: Pieces that are one pre-token: letters, or signs, after at most one space.
_SINGLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+)")
#: The character by which a byte-level vocabulary writes each byte: itself if Latin-1 shows it, else the next from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTER = dict(zip(_SHOWN, _SHOWN, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a piece surely begins.

    Row starts; a space between two characters that surely aren't white space; a sign after a letter; a line feed
    after visible ASCII; a letter after such a line feed. Of characters beyond ASCII only those of two bytes led by C3
    or above count as surely not white space, and those led by C3 as letters (but for multiplication and division signs).
    """
    n = len(data)
    cur = data
    prev = np.empty_like(data)
    prev[0], prev[1:] = 10, data[:-1]
    lead = np.zeros_like(data)
    lead[2:] = data[:-2]
    after = np.empty_like(data)
    after[-1], after[:-1] = 10, data[1:]
    two = (prev >= 0x80) & (prev < 0xC0) & (lead >= 0xC3) & (lead < 0xE0)
    left = _GRAPH[prev] | two
    letter = _LETTER[prev] | (two & (lead == 0xC3) & (prev != 0x97) & (prev != 0xB7))
    right = _GRAPH[after] | ((after >= 0xC3) & (after < 0xE0))
    at = (cur == 32) & left & right
    at |= letter & _SIGN[cur]
    at |= (cur == 10) & _GRAPH[prev]
    at |= (prev == 10) & _GRAPH[lead] & _LETTER[cur]
    at[offsets[offsets < n]] = True
    return np.flatnonzero(at)


class Encoder:
    """Encodes columns of text. It keeps the ids of up to ``keep`` pieces of at most ``longest`` bytes.

    Known pieces are two arrays, their hashes in order and their places; a piece's ids end where the next one's begin. So
    250,000 of them take some 6 MB.
    """

    def __init__(self, path: str, keep: int = 250_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._keep, self._longest = keep, longest
        self._forget()

    def _forget(self) -> None:
        self._hashes, self._places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._start = np.zeros(1 << 12, np.int32)  # of as many pieces as count, and the end of the last
        self._pool, self._used, self._count = np.zeros(1 << 14, self.dtype), 0, 0

    def _raw(self, pieces: list[bytes]) -> list[list[int]]:
        """A piece that is one pre-token goes to the library's merges at once, any other through its whole encoder."""
        merges, single = self._tokenizer.model.tokenize, _SINGLE.fullmatch
        out = [[t.id for t in merges(p.decode("latin-1").translate(_CHARACTER))] if single(p) else None for p in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self._tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each piece; -1 where it isn't known."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self._hashes):
            at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
            known = self._hashes[at] == hashes
            out[known] = self._places[at[known]]
        return out

    def _learn(self, hashes: np.ndarray, places: np.ndarray) -> None:
        at = np.searchsorted(self._hashes, hashes)
        self._hashes, self._places = np.insert(self._hashes, at, hashes), np.insert(self._places, at, places)

    def _add(self, pieces: list[bytes]) -> None:
        found = self._raw(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum()))
        for name, need in (("_start", self._count + len(sizes) + 1), ("_pool", self._used + len(ids))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old) // 2, need - len(old)), old.dtype)]))
        self._start[self._count + 1 : self._count + len(sizes) + 1] = self._used + np.cumsum(sizes)
        self._pool[self._used : self._used + len(ids)] = ids
        self._count += len(sizes)
        self._used += len(ids)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = _borders(data, offsets)
        ends = np.append(starts[1:], len(data))
        unique, where, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self._hashes) + len(unique) > self._keep:
            self._forget()
        place = self._find(unique)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw, first, last = data.tobytes(), starts[where[new]], ends[where[new]]
            place[new] = self._count + np.arange(len(new))
            self._add([raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            short = new[last - first <= self._longest]
            self._learn(unique[short], place[short])
        piece = place[inverse]
        begin = self._start[piece].astype(np.int64)
        sizes = self._start[piece + 1] - begin
        stop = np.cumsum(sizes)
        ids = self._pool[np.repeat(begin - (stop - sizes), sizes) + np.arange(stop[-1])]
        bounds = np.append(stop - sizes, stop[-1])[np.searchsorted(starts, offsets)]
        if self._used > 8 * self._keep or self._count > 2 * self._keep:  # ids of long pieces, which aren't known later
            self._forget()
        return ids, bounds

    def rows(self, column: pa.Array):
        """For each run of rows: (first row, all their ids, each row's offsets into the ids)."""
        data, offsets = utf8(column)
        for first, part, edges in chunks(data, offsets):
            if len(part):
                yield first, *self._chunk(part, edges)
            else:
                yield first, np.zeros(0, self.dtype), np.zeros(len(edges), np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@functools.lru_cache
def byte_lengths(path: str) -> np.ndarray:
    """How many bytes of text each id stands for: a byte-level vocabulary writes each byte as one character."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def default_path() -> str:
    """The tokenizer file named by the public package; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
