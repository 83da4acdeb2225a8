"""Best-fit packing of token sequences by exact-complement hashing.

Every document becomes its ids and an end id; documents over the capacity are cut so that only their first piece is
short. Placement then depends on lengths alone, so it is planned on the histogram of lengths, which has at most
capacity entries whatever the input holds: from the longest piece down, the gap is filled exactly by one, two or three
lengths whose sum is indexed, as often as their counts allow; what is left goes by best fit. Pieces are numbered within
their length without gaps and look up their place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_copies, give_back, md5_bucket, offsets, ship, written
from .tokens import default_vocabulary, encode_blocks

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of these lengths: document, start and length of each piece; a short piece comes first."""
    full, rest = lengths // capacity, lengths % capacity
    n = full + (rest > 0)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(offsets(n)[:-1], n)
    short = np.where(rest > 0, rest, capacity)[doc]
    return doc, np.where(k == 0, 0, short + (k - 1) * capacity), np.where(k == 0, short, capacity)


def pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document of (doc_id, text); with_ids adds the ids themselves as an array.

    A null text is empty and gives the end id alone. Other columns are left out. Repeated rows give repeated pieces.
    """
    ship(df.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        for batch in batches:
            keys = batch.column(0)
            for a, b, flat, counts in encode_blocks(batch, path):
                ids = np.insert(flat.astype("<u4"), np.cumsum(counts), end_id)
                counts = counts + 1
                doc, start, length = cut(counts, capacity)
                at = offsets(counts)[:-1][doc] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist())]
                first = np.searchsorted(doc, np.arange(b - a))
                columns = [keys.slice(a, b - a).take(pa.array(doc)), pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each. Lengths are from 1 to capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> int:
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        n = int(min(left[x] // k for x, k in need.items()))
        if n:
            for x, k in need.items():
                left[x] -= n * k
            out.append((pattern, n))
        return n

    def pairs(total: int) -> np.ndarray:
        """The larger lengths of pairs with this sum, the most unequal first."""
        if total < 2:
            return np.zeros(0, np.int64)
        x = np.arange((total + 1) // 2, total)
        return x[(left[x] > 0) & (left[total - x] > 0)][::-1]

    consume((capacity,))
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if left[a]:
            consume((a, gap))
        if left[a]:
            for b in pairs(gap).tolist():
                consume((a, b, gap - b))
                if not left[a]:
                    break
        if left[a]:
            for b in range(min(gap - 2, a), (gap + 2) // 3 - 1, -1):
                if not left[b]:
                    continue
                for c in pairs(gap - b).tolist():
                    if c <= b:
                        consume((a, b, c, gap - b - c))
                    if not left[a] or not left[b]:
                        break
                if not left[a]:
                    break
    # what is left: best fit, longest first; open[gap] has the patterns with that much room
    open_: dict[int, list[list]] = {}
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            room = min((g for g in open_ if g >= a), default=0)
            if room:
                group = open_[room]
                pattern, m = group[-1]
                k = min(n, m)
                if k == m:
                    group.pop()
                    if not group:
                        del open_[room]
                else:
                    group[-1][1] -= k
                n -= k
                (open_.setdefault(room - a, []) if room > a else out).append([(*pattern, a), k] if room > a else ((*pattern, a), k))
                continue
            each = capacity // a
            k = max(1, n // each)
            pattern = (a,) * min(each, n)
            rest = capacity - sum(pattern)
            (open_.setdefault(rest, []) if rest else out).append([pattern, k] if rest else (pattern, k))
            n -= k * len(pattern)
    out += [(tuple(p), k) for group in open_.values() for p, k in group]
    return out


def places(plan_: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As sorted runs of (length, first rank): the key length << 40 | rank, the first sequence, and the offset there."""
    base, taken, rows = 0, {}, []
    for pattern, n in plan_:
        at = 0
        for x in pattern:
            rank = taken.get(x, 0)
            rows.append(((x << 40) | rank, base, at))
            taken[x] = rank + n
            at += x
        base += n
    rows.sort()
    key, seq, at = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return key, seq, at, key & ((1 << 40) - 1)


def place(cut_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be a written table, as it is read several times."""
    spark = cut_.sparkSession
    histogram = {r[0]: r[1] for r in cut_.groupBy("length").count().collect()}  # at most capacity rows
    key, seq, at, first = places(plan(histogram, capacity))
    bucket = md5_bucket(F.concat_ws(":", F.coalesce(F.col("doc_id"), F.lit(0)), "piece", "ids_crc32"))
    ranked = gapless_copies(cut_, ["length"], bucket, [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "start")], "_rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b.pop("_rank").to_numpy(np.int64)
            i = np.searchsorted(key, (b["length"].to_numpy(np.int64) << 40) | rank, "right") - 1
            yield b.assign(sequence_id=seq[i] + rank - first[i], offset=at[i])

    ship(spark)
    return ranked.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in cut_.dtypes), "sequence_id long, offset long"]))


def pack(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each document.

    A null text is empty and has the end id alone. Rows that share an id, are repeated or have none are each packed;
    pieces of one length are dealt out by id, piece and checksum, so that neither fills a task. Other columns are left out;
    an empty table gives no rows.
    """
    return place(written(pieces(df, capacity, end_id, vocabulary), "pieces"), capacity)


def sequences(df: DataFrame, placed: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), pieces in the order of their offsets. doc_id must be unique."""
    full = pieces(df, capacity, end_id, vocabulary, with_ids=True).select("doc_id", "piece", "ids")
    rows = placed.join(full, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return rows.select("sequence_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids"))
