"""Byte-level BPE in numpy, without a tokenizer library.

Pieces of text (matches of the splitting pattern) that a worker hasn't met are laid out as rows of matrices, one matrix
for each bucket of lengths, padded on the right. In each round every row merges its leftmost pair of least rank and closes the
hole; the ranks of the two pairs beside it are looked up in a hash table of pairs, and rows without a pair to merge
leave the matrix. The few pieces over LONGEST bytes are merged in the same order by a heap.

A piece that is a token as a whole is not looked up first: every token of these ranks is what merging its bytes gives.
Bpe checks that for the ranks it is given, and looks such pieces up if they hold a token that merging doesn't reach.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, _Index, text_blocks
from .common import gather, held, offsets, ship
from .tokens import default_vocabulary

#: Cells of a matrix that is merged at a time.
CELLS = 400_000
#: Bytes of a piece beyond which a matrix row would be wasteful; such pieces are merged one by one.
LONGEST = 192
NONE = np.int64(1 << 40)


def default_ranks() -> str:
    return default_vocabulary("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Open-addressing hash table from pairs of ids to the rank of their merge, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        key = (left.astype(np.int64) << 32) | right
        live = np.arange(len(key))
        at = self._slot(key)
        self.probes = 0
        while len(live):
            self.probes += 1
            free = self.keys[at[live]] == -1
            where, first = np.unique(at[live[free]], return_index=True)
            win = live[free][first]
            self.keys[where], self.values[where] = key[win], rank[win]
            live = live[self.keys[at[live]] != key[live]]
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        more = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if not len(more):
                break
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (found != -1)]
        return out


class Bpe:
    """Encodes and decodes by a file of ranks (base64 bytes and rank a line)."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.ranks = ranks
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_at = offsets(self.token_sizes)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # every way to cut a token in two known tokens is a pair that merges into it
        cuts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(c, np.int64) for c in zip(*cuts))
        self.table = PairTable(left, right, rank)
        digits = [b"%d," % i for i in range(self.size)]
        self.digit_sizes = np.array([len(d) for d in digits], np.int64)
        self.digit_at = offsets(self.digit_sizes)
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        self.unreached: dict[bytes, int] = {}
        ids, counts = self.encode_pieces(tokens)
        hit = (counts == 1) & (ids[np.minimum(offsets(counts)[:-1], max(len(ids) - 1, 0))] == np.arange(self.size))
        self.unreached = {t: r for t, r in ranks.items() if not hit[r]}

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, padded with -1, each merged to its end; changes and returns ids."""
        n, m = ids.shape
        if m < 2:
            return ids
        rank = np.where(ids[:, 1:] >= 0, self.table(ids[:, :-1].ravel(), np.maximum(ids[:, 1:], 0).ravel()).reshape(n, m - 1), NONE)
        live = np.flatnonzero((rank < NONE).any(axis=1))
        work, rank = ids[live], rank[live]
        columns = np.arange(m)[None, :]
        while len(live):
            r = np.arange(len(live))
            at = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[r, at]
            # what stands right of the pair moves one to the left
            source = np.minimum(columns + (columns > at[:, None]), m - 1)
            work = np.take_along_axis(work, source, axis=1)
            work[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], m - 2), axis=1)
            rank[:, -1] = NONE
            work[r, at] = best
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.table(work[before, at[before] - 1], best[before])
            behind = np.flatnonzero(at < m - 1)
            after = work[behind, at[behind] + 1]
            rank[behind, at[behind]] = np.where(after >= 0, self.table(best[behind], np.maximum(after, 0)), NONE)
            more = (rank < NONE).any(axis=1)
            if not more.all():
                ids[live[~more]] = work[~more]
                live, work, rank = live[more], work[more], rank[more]
        return ids

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, by a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        sizes, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        at = list(range(n + 1))

        def rank(i: int) -> int | None:
            j = nxt[i]
            return self.ranks.get(piece[at[i] : at[i] + sizes[i] + sizes[j]]) if j < n else None

        heap = [(r, i, 2) for i in range(n) if (r := rank(i)) is not None]
        heapify(heap)
        while heap:
            r, i, size = heappop(heap)
            j = nxt[i] if sizes[i] else n
            if j >= n or sizes[i] + sizes[j] != size or ids[i] < 0:
                continue
            ids[i], sizes[i], sizes[j] = r, size, 0
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heappush(heap, (new, k, sizes[k] + sizes[nxt[k]]))
        return [x for x, s in zip(ids, sizes) if s]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        alone = [i for i, p in enumerate(pieces) if p in self.unreached] if self.unreached else []
        if alone:
            rest = list(pieces)
            for i in alone:
                rest[i] = b""
            ids, counts = self.merged(rest)
            ids = np.insert(ids, offsets(counts)[alone], [self.unreached[pieces[i]] for i in alone])
            counts[alone] = 1
            return ids, counts
        return self.merged(pieces)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        at = offsets(sizes)[:-1]
        counts = np.zeros(len(pieces), np.int64)
        parts, owners = [], []
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        begin = int(np.searchsorted(ordered, 1))
        while begin < len(order):
            low = int(ordered[begin])
            if low > LONGEST:
                for i in order[begin:].tolist():
                    got = np.array(self.merge_long(pieces[i]), np.int64)
                    counts[i] = len(got)
                    parts.append(got)
                    owners.append(np.array([i]))
                break
            width = min(LONGEST, low + low // 4)
            end = min(int(np.searchsorted(ordered, width, "right")), begin + max(1, CELLS // width))
            rows = order[begin:end]
            cell = np.arange(width)[None, :]
            inside = cell < sizes[rows][:, None]
            ids = np.where(inside, flat[np.minimum(at[rows][:, None] + cell, len(flat) - 1)], -1)
            ids = self.merge(ids)
            kept = ids >= 0
            counts[rows] = kept.sum(axis=1)
            parts.append(ids[kept])
            owners.append(rows)
            begin = end
        if not parts:
            return np.zeros(0, np.int64), counts
        who = np.concatenate(owners)
        start = np.empty(len(pieces), np.int64)
        start[who] = offsets(counts[who])[:-1]
        start[sizes == 0] = 0
        return gather(np.concatenate(parts), start, counts), counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For the chunk cache: ids and counts of texts, each distinct piece encoded once."""
        found = [self.pattern.findall(t) for t in texts.to_pylist()]
        index = _Index()
        per = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(found)), np.int64, int(per.sum()))
        ids, counts = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in index.new])
        lens = counts[at]
        return gather(ids, offsets(counts)[:-1][at], lens), np.diff(offsets(lens)[offsets(per)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return gather(self.token_bytes, self.token_at[ids], self.token_sizes[ids])

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """The ids as decimals, a comma after each."""
        return gather(self.digit_bytes, self.digit_at[ids], self.digit_sizes[ids])


def encoder(path: str, pattern: str) -> tuple[Bpe, ChunkEncoder]:
    """One a worker process."""

    def make() -> tuple[Bpe, ChunkEncoder]:
        bpe = Bpe(path, pattern)
        return bpe, ChunkEncoder(bpe, np.uint16 if bpe.size <= 65536 else np.uint32)

    return held(("bpe", path, pattern), make)


def _encoded(batch: pa.RecordBatch, chunked: ChunkEncoder):
    texts = batch.column(1)
    for a, b in text_blocks(texts):
        yield a, b, *chunked.encode_all(texts.slice(a, b - a))


def _texts(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(df: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of (doc_id, text). A null text is empty and has no ids; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunked = encoder(ranks or default_ranks(), pattern or default_pattern())
        for batch in batches:
            for a, b, flat, counts in _encoded(batch, chunked):
                lists = pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return _texts(df).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids give no bytes."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = encoder(ranks or default_ranks(), pattern or default_pattern())
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x).tobytes() for x in lists], pa.binary())], ["doc_id", "bytes"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(df: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes whole texts, decodes the ids, and sums up both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunked = encoder(ranks or default_ranks(), pattern or default_pattern())
        for batch in batches:
            for a, b, flat, counts in _encoded(batch, chunked):
                at = offsets(counts)
                decoded, decimals = bpe.decode(flat), bpe.decimals(flat)
                bytes_at, digits_at = offsets(bpe.token_sizes[flat])[at].tolist(), offsets(bpe.digit_sizes[flat])[at].tolist()
                view, digits = memoryview(decoded), memoryview(decimals)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts, pa.int64()),
                        pa.array([sha256(digits[i : max(i, j - 1)]).hexdigest() for i, j in zip(digits_at, digits_at[1:])]),
                        pa.array([sha256(view[i:j]).hexdigest() for i, j in zip(bytes_at, bytes_at[1:])]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _texts(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
