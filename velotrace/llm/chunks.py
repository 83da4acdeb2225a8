"""Cuts a text into chunks whose tokens don't depend on what stands around them.

The pattern of byte-level vocabularies attaches one space to the word that follows. A cut before a space is therefore
a token boundary unless white space stands on both sides of it (or before it and the text's end behind it), where the
run of white space is one match. The same holds before a line feed that follows no white space. Short runs are kept
together; texts with other runs are taken whole; each distinct chunk is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather, offsets

#: Distinct chunks, and their characters, that a worker keeps between batches; a bound on memory, without effect on results.
KEEP, KEEP_CHARS = 250_000, 5_000_000
#: Bytes of text that are encoded at a time.
BLOCK = 1_000_000
#: New chunks that are encoded at a time.
LEARN = 40_000


class _Index(dict):
    """Numbers keys as they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


def _cut(texts: pa.Array) -> pa.ListArray:
    out = pc.replace_substring(texts, " ", "\0 ")
    if pc.any(pc.match_substring(texts, "\n")).as_py():
        for old, new in (("\n", "\0\n"), ("\n\0\n", "\n\n"), (" \0\n", " \n")):
            out = pc.replace_substring(out, old, new)
    return pc.split_pattern(out, "\0")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, one after another, and where each string begins and the last ends."""
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if at else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return flat, at - at[0]


class ChunkEncoder:
    """Encodes texts by way of their distinct chunks, which encode(array of strings) -> (flat ids, counts) handles."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype=np.uint16, keep: int = KEEP, keep_chars: int = KEEP_CHARS):
        self.encode, self.dtype, self.keep, self.keep_chars = encode, dtype, keep, keep_chars
        self.clear()

    def clear(self) -> None:
        self.known, self.chars = {}, 0
        self.ids = np.zeros(0, self.dtype)
        self.at = np.zeros(1, np.int64)
        self.opens = self.closes = np.zeros(0, bool)
        self.used = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forgets the chunks that were met once, or all if that isn't enough."""
        stay = self.used > 1
        keys = list(compress(self.known, stay))
        chars = sum(map(len, keys))
        if 2 * len(keys) > self.keep or 2 * chars > self.keep_chars:
            self.clear()
            return
        self.known, self.chars = dict(zip(keys, range(len(keys)))), chars
        sizes = np.diff(self.at)[stay]
        self.ids = gather(self.ids, self.at[:-1][stay], sizes)
        self.at = offsets(sizes)
        self.opens, self.closes, self.used = self.opens[stay], self.closes[stay], np.ones(len(keys), np.int64)

    def _learn(self, new: pa.Array) -> None:
        got = [self.encode(new.slice(i, LEARN)) for i in range(0, len(new), LEARN)]
        ids, sizes = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        self.chars += pc.sum(pc.utf8_length(new)).as_py()
        self.ids = np.concatenate([self.ids, ids.astype(self.dtype)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        # what counts as white space here covers at least what the pattern takes for it
        flag = lambda x: x.to_numpy(zero_copy_only=False)
        space = lambda a, b: flag(pc.utf8_is_space(pc.utf8_slice_codeunits(new, a, b)))
        alone = flag(pc.equal(new, " "))
        self.opens = np.concatenate([self.opens, flag(pc.starts_with(new, "\n")) | flag(pc.starts_with(new, " ")) & (alone | space(1, 2))])
        self.closes = np.concatenate([self.closes, space(-1, None)])

    def encode_all(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has; null counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if len(self.known) > self.keep or self.chars > self.keep_chars:
            self.shrink()
        nul = np.flatnonzero(pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False))
        if len(nul):
            texts = pc.if_else(pc.match_substring(texts, "\0"), "", whole_texts := texts)
        else:
            whole_texts = texts
        cut = _cut(texts)
        at = cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        distinct = cut.flatten().dictionary_encode()
        keys = distinct.dictionary.to_numpy(zero_copy_only=False)
        words = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(words < 0)
        if len(fresh):
            words[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(keys[fresh].tolist(), words[fresh].tolist()))
            self._learn(distinct.dictionary.take(pa.array(fresh)))
        index = words[distinct.indices.to_numpy()]
        del cut, distinct, keys
        self.used = np.pad(self.used, (0, len(self.known) - len(self.used))) + np.bincount(index, minlength=len(self.known))
        lens = np.diff(self.at)[index]
        counts = np.diff(offsets(lens)[at])
        flat = gather(self.ids, self.at[index], lens)
        # a space between white space, or behind white space at the end: the text is encoded whole
        odd = self.closes[index[:-1]] & self.opens[index[1:]]
        odd[at[1:-1] - 1] = False
        whole = set((np.searchsorted(at, np.flatnonzero(odd), "right") - 1).tolist()) | set(nul.tolist())
        if whole:
            again = sorted(whole)
            pieces = np.split(flat, offsets(counts)[1:-1])
            ids, n = self.encode(whole_texts.take(pa.array(again)))
            for i, g, k in zip(again, np.split(ids.astype(self.dtype), offsets(n)[1:-1]), n):
                pieces[i], counts[i] = g, k
            flat = np.concatenate(pieces)
        return flat, counts


def text_blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes each, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right"))
        yield begin, max(end, begin + 1)
        begin = max(end, begin + 1)


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most characters each, one text at least."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
