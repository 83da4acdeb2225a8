"""Token ids as binary shards with keyed access by a minimal perfect hash.

A shard ``shard-NNNNNN.ids`` is the raw ids of its documents one after another, as little-endian unsigned 16-bit or
32-bit integers, in ascending order of the document key; shards follow one another in key order too. Beside it lies
``shard-NNNNNN.idx``:

    8 bytes   magic
    u64       length of the JSON header, then the header: item size, counts, level sizes, byte places of the sections
    levels    bit arrays of a cascade of hash levels: a key is held by the first level where no other key of that level
              hashes to its bit; its slot is the number of bits set before its own
    ranks     u32 for each 64-bit word: bits set before it
    slots     u32 fingerprint, u64 first id, u32 number of ids, in slot order
    keys      i64 document keys and u32 occurrence numbers in file order, for scans
    rest      file positions of keys that no level could hold

A keyed read hashes once a level (about 1.6 levels on average), checks the fingerprint and reads one run of ids; its
cost doesn't grow with the shard. Repeated keys are told apart by their occurrence number; a null key has one of its own.

Files are written under a name of the attempt and then renamed, so a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, offsets, ship, written
from .tokens import default_vocabulary, encode_blocks, encoder

END_ID = 0
MAGIC = b"VTIDX001"
LEVELS = 24
#: Bits of a level for each key that reaches it.
ROOM = 2.0
#: Ids that a reader holds at a time.
READ_IDS = 4_000_000
SLOT = np.dtype([("fingerprint", "<u4"), ("start", "<u8"), ("n", "<u4")])
NULL_KEY = np.iinfo(np.int64).min


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit permutation of the keys."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(keys.view(np.uint64)) + occurrence.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h, level) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Keys, as distinct 64-bit hashes, to slots 0 to n - 1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.at = offsets(np.array(sizes, np.int64))
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = offsets(ones)[:-1].astype(np.uint32)

    @classmethod
    def build(cls, h: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The function, and which keys no level could hold."""
        left, sizes, bits = np.arange(len(h)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-max(64, int(len(left) * ROOM)) // 64) * 64
            at = _bit(h[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(sizes, np.packbits(flat, bitorder="little").view("<u8")), left

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that weren't there, any slot or -1."""
        out = np.full(len(h), -1, np.int64)
        live = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(live):
                break
            bit = _bit(h[live], level, size) + self.at[level]
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            there = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            out[live[there]] = (self.ranks[bit >> 6] + below)[there]
            live = live[~there]
        return out


def build_index(keys: np.ndarray, occurrence: np.ndarray, counts: np.ndarray, item: int) -> bytes:
    """The .idx file of documents in file order."""
    h = hashed(keys, occurrence)
    mph, rest = PerfectHash.build(h)
    held = np.ones(len(h), bool)
    held[rest] = False
    slots = np.zeros(int(held.sum()), SLOT)
    starts = offsets(counts)
    at = mph.slots(h[held])
    for name, values in (("fingerprint", (mix(h, 99) >> np.uint64(32))[held]), ("start", starts[:-1][held]), ("n", counts[held])):
        slots[name][at] = values
    parts = {"words": mph.words, "ranks": mph.ranks, "slots": slots, "keys": keys.astype("<i8"), "occurrence": occurrence.astype("<u4"), "counts": counts.astype("<u4"), "rest": rest.astype("<u4")}
    body, places = b"", {}
    blobs = []
    for name, values in parts.items():
        blob = values.tobytes()
        places[name] = [len(body) + sum(map(len, blobs)), len(blob)]
        blobs.append(blob)
    head = json.dumps({"item": item, "docs": len(keys), "ids": int(starts[-1]), "sizes": mph.sizes, "places": places}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *blobs])


class Shard:
    """Keyed and sequential reads of a shard."""

    def __init__(self, fs, path: str):
        with fs.open_input_file(f"{path}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{path}.idx isn't an index of token ids")
        begin = 16 + int.from_bytes(raw[8:16], "little")
        self.head = json.loads(raw[16:begin])

        def part(name: str, dtype) -> np.ndarray:
            at, n = self.head["places"][name]
            return np.frombuffer(raw, dtype, n // np.dtype(dtype).itemsize, begin + at)

        self.fs, self.path, self.dtype = fs, path, "<u2" if self.head["item"] == 2 else "<u4"
        self.mph = PerfectHash(self.head["sizes"], part("words", "<u8"))
        self.slots_, self.keys, self.occurrence, self.counts, self.rest = part("slots", SLOT), part("keys", "<i8"), part("occurrence", "<u4"), part("counts", "<u4"), part("rest", "<u4")

    def locate(self, keys: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 where the shard has no such key."""
        h = hashed(np.asarray(keys, np.int64), np.asarray(occurrence))
        at = self.mph.slots(h)
        hit = at >= 0
        start, n = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        found = self.slots_[at[hit]]
        ok = found["fingerprint"] == (mix(h, 99) >> np.uint64(32))[hit].astype(np.uint32)
        where = np.flatnonzero(hit)[ok]
        start[where], n[where] = found["start"][ok], found["n"][ok]
        if len(self.rest):
            starts = offsets(self.counts.astype(np.int64))
            for i in self.rest.tolist():
                same = (np.asarray(keys) == self.keys[i]) & (np.asarray(occurrence) == self.occurrence[i])
                start[same], n[same] = starts[i], self.counts[i]
        return start, n

    def read(self, start: int, n: int) -> np.ndarray:
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            return np.frombuffer(f.read_at(int(n) * self.head["item"], int(start) * self.head["item"]), self.dtype)

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        start, n = self.locate(np.array([NULL_KEY if key is None else key]), np.array([occurrence]))
        return None if n[0] < 0 else self.read(start[0], n[0])


def file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def shard_name(i: int) -> str:
    return f"shard-{i:06d}"


def write(df: DataFrame, path: str, end_id: int = END_ID, vocabulary: str | None = None, shards: int | None = None) -> DataFrame:
    """Encodes (doc_id, text), writes the shards into path, and returns their manifest: (shard, docs, ids, start).

    Null texts are empty and hold the end id alone; null ids come first; rows that share an id all are written, in any
    order, and told apart by their occurrence within a shard. An empty table writes no shard. Other columns are left out. path must be seen by driver and executors.
    """
    spark = df.sparkSession
    ship(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the text's checksum only parts rows that share an id
    rows = rows.withColumn("_tie", F.crc32(F.col("text").cast("binary"))).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        vocab = vocabulary or default_vocabulary()
        item = np.dtype(encoder(vocab).dtype).itemsize
        fs, root = file_system(path)
        keys, counts, out = [], [], None
        try:
            for batch in batches:
                if out is None:
                    fs.create_dir(root, recursive=True)
                    tmp = f"{root}/.{shard_name(part)}-{attempt}"
                    out = fs.open_output_stream(f"{tmp}.ids")
                key = batch.column(0).fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)
                for a, b, flat, n_ids in encode_blocks(batch, vocab):
                    ids = np.insert(flat, np.cumsum(n_ids), end_id).astype(f"<u{item}")
                    out.write(memoryview(ids).cast("B"))
                    keys.append(key[a:b])
                    counts.append(n_ids + 1)
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        key, n_ids = np.concatenate(keys), np.concatenate(counts)
        first = np.searchsorted(key, key)
        with fs.open_output_stream(f"{tmp}.idx") as f:
            f.write(build_index(key, np.arange(len(key)) - first, n_ids, item))
        for end in ("ids", "idx"):
            fs.move(f"{tmp}.{end}", f"{root}/{shard_name(part)}.{end}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "docs": [len(key)], "ids": [int(n_ids.sum())]})

    manifest = written(rows.select("doc_id", "text").mapInArrow(run, "shard int, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: each is looked up by its key."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(path)
        for batch in batches:
            for shard, base in zip(batch["shard"], batch["start"]):
                s = Shard(fs, f"{root}/{shard_name(shard)}")
                begin = 0
                while begin < len(s.keys):
                    most = int(np.searchsorted(np.cumsum(s.counts[begin:], dtype=np.int64), READ_IDS, "right"))
                    end = begin + max(1, most)
                    start, n = s.locate(s.keys[begin:end], s.occurrence[begin:end])
                    if (n < 0).any():
                        raise ValueError(f"{s.path}: keys of the shard aren't in its index")
                    ids = s.read(start.min(), (start + n).max() - start.min()).astype("<u4")
                    view, at = memoryview(ids).cast("B"), start - start.min()
                    crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]
                    key = pd.array(s.keys[begin:end], "Int64")
                    key[s.keys[begin:end] == NULL_KEY] = pd.NA
                    yield pd.DataFrame({"doc_id": key, "start": base + start, "n_tokens": n, "ids_crc32": crc})
                    begin = end

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("shard", "start").repartition(n, "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards into a new folder of the shared one and reads every document back."""
    path = fresh_path(df.sparkSession, "tokens")
    return read(write(df, path, end_id, vocabulary), path)
