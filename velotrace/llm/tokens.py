"""Token ids by the tokenizers library, as arrays, for whole texts."""

from __future__ import annotations

import json
import os
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import ChunkEncoder, raw_bytes, text_blocks
from .common import gather, held, offsets

#: Pieces that are one text for the library, and texts for one call of it.
JOIN, CALL = 512, 16


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary lies; each machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


class LibraryEncoder:
    """The tokenizers library on lists of chunks.

    Much of the library's time goes into its splitting pattern. So chunks of Latin script are split here by the same
    pattern, and each distinct piece is given to the library once, its bytes already written as the vocabulary's
    characters, many in a call; the tokens' lengths in bytes tell where each piece ends. Other chunks, where tables of letters may differ between libraries, and
    vocabularies with another way of splitting are left to the library alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.split = None
        rule = json.loads(self.t.to_str()).get("pre_tokenizer") or {}
        if (rule.get("type"), rule.get("add_prefix_space"), rule.get("use_regex")) == ("ByteLevel", False, True):
            import public_tokenizers
            import regex

            self.split = regex.compile(public_tokenizers.PATTERN)
            # the bytes that have no printable character of their own follow 255, in order
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            self.letters = np.zeros(256, np.uint32)
            self.letters[shown], self.letters[hidden] = shown, 256 + np.arange(len(hidden))
            self.whole = Tokenizer(self.t.model)  # pieces come once, so its own cache of them would only cost
            if hasattr(self.whole.model, "_resize_cache"):
                self.whole.model._resize_cache(0)
            self.whole.pre_tokenizer = pre_tokenizers.Split("\0", "removed")
            self.bytes = np.zeros(self.size, np.int64)
            for token, i in vocab.items():  # a byte-level token has one character for each byte
                self.bytes[i] = len(token)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for i in range(0, len(texts), CALL):
            got += [np.array(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64)

    def near(self, chunks: pa.Array) -> np.ndarray:
        """Chunks whose characters all lie below U+0250, in Latin script, where tables of letters agree."""
        if self.split is None:
            return np.zeros(len(chunks), bool)
        data, at = raw_bytes(chunks)
        after = np.append(data[1:], 0)
        far = (data >= 0xCA) | ((data == 0xC9) & (after >= 0x90))
        return np.diff(offsets(far)[at]) == 0

    def parts(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """What the pattern makes of chunks, one after another, and how many parts each has. A word with signs behind it,
        the usual case, needs no pattern."""
        core = pc.utf8_rtrim(chunks, characters=punctuation)
        size = pc.binary_length(core).to_numpy()
        line = pc.starts_with(core, "\n").to_numpy(zero_copy_only=False)
        space = pc.starts_with(core, " ").to_numpy(zero_copy_only=False)
        body = pc.if_else(pa.array(line | space), pc.utf8_slice_codeunits(core, 1), core)
        word = pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False)
        signed = word & (size < pc.binary_length(chunks).to_numpy())
        broken = word & line
        other = np.flatnonzero(~word)
        found = [self.split.findall(c) for c in chunks.take(pa.array(other)).to_pylist()]
        counts = word.astype(np.int64) + signed + broken
        counts[other] = np.fromiter(map(len, found), np.int64, len(found))
        at = offsets(counts)
        # all parts that there are, and where each of them goes
        pool = [pc.if_else(pa.array(line), body, core).filter(pa.array(word)), self.tails(chunks, size, signed), pa.array(["\n"], pa.string()), pa.array(list(chain.from_iterable(found)), pa.string())]
        order = np.zeros(at[-1], np.int64)
        first = np.cumsum([0, *map(len, pool)])
        words = np.flatnonzero(word)
        order[at[words] + broken[words]] = np.arange(len(words))
        signs = np.flatnonzero(signed)
        order[at[signs + 1] - 1] = first[1] + np.arange(len(signs))
        order[at[np.flatnonzero(broken)]] = first[2]
        order[gather(np.arange(at[-1]), at[other], counts[other])] = first[3] + np.arange(first[4] - first[3])
        return pa.concat_arrays([p.cast(pa.string()) for p in pool]).take(pa.array(order)), counts

    @staticmethod
    def tails(chunks: pa.Array, core: np.ndarray, which: np.ndarray) -> pa.Array:
        """What stands behind the first core bytes of the chunks that are asked for."""
        data, at = raw_bytes(chunks)
        begin, size = (at[:-1] + core)[which], (np.diff(at) - core)[which]
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets(size).astype(np.int32)), pa.py_buffer(gather(data, begin, size)))

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that the pattern wouldn't split."""
        data, at = raw_bytes(pieces)
        sizes = np.diff(at)
        # a character for each byte, and one that no vocabulary has between pieces
        shown = np.insert(self.letters[data], at[1:-1], 0).astype("<u4").tobytes().decode("utf-32-le")
        cuts = [int(at[i]) + i for i in range(0, len(sizes), JOIN)] + [len(shown) + 1]
        calls = [shown[i : j - 1] for i, j in zip(cuts, cuts[1:])]
        got = [np.array(e.ids, np.uint32) for i in range(0, len(calls), CALL) for e in self.whole.encode_batch_fast(calls[i : i + CALL], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *got])
        lengths = self.bytes[ids]
        ends = np.searchsorted(np.cumsum(lengths), np.cumsum(sizes)) + 1
        if len(sizes) and (ends[-1] != len(ids) or lengths.sum() != sizes.sum()):
            raise AssertionError("tokens don't add up to their pieces")
        return ids, np.diff(ends, prepend=0)

    def __call__(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        near = self.near(chunks)
        flat, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if near.any():
            found, per = self.parts(chunks.filter(pa.array(near)))
            distinct = found.dictionary_encode()
            ids, sizes = self.pieces(distinct.dictionary)
            at = distinct.indices.to_numpy()
            lens = sizes[at]
            flat, counts = gather(ids, offsets(sizes)[:-1][at], lens), np.diff(offsets(lens)[offsets(per)])
        if near.all():
            return flat, counts
        rest, more = self.plain(chunks.filter(pa.array(~near)).to_pylist())
        all_ids, all_counts = np.concatenate([flat, rest]), np.concatenate([counts, more])
        back = np.empty(len(chunks), np.int64)
        back[np.concatenate([np.flatnonzero(near), np.flatnonzero(~near)])] = np.arange(len(chunks))
        return gather(all_ids, offsets(all_counts)[:-1][back], all_counts[back]), all_counts[back]


def encoder(path: str) -> ChunkEncoder:
    """One a worker process."""

    def make() -> ChunkEncoder:
        library = LibraryEncoder(path)
        return ChunkEncoder(library, np.uint16 if library.size <= 65536 else np.uint32)

    return held(("tokens", path), make)


def encode_blocks(batch, path: str):
    """Yields (begin, end, flat ids, counts) for runs of a batch's rows, whose texts are its second column."""
    e, texts = encoder(path), batch.column(1)
    for a, b in text_blocks(texts):
        yield a, b, *e.encode_all(texts.slice(a, b - a))
