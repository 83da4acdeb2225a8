"""Media columns: payloads as FLAC streams in a binary column, decoded samples as seekable PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flac
from .chunks import blocks
from .common import discard, held, offsets, ship, written

UNIT = 64
#: Samples of a block of decoded audio.
PCM_SAMPLES = 4096
#: Parts of the rows whose streams are stored one after another.
PARTS = 4


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each filled up with zero bytes to a positive multiple of the unit, and their lengths then."""
    full = [t + bytes(-len(t) % UNIT or (0 if t else UNIT)) for t in texts]
    return np.frombuffer(b"".join(full), np.uint8), np.fromiter(map(len, full), np.int64, len(full))


def features(samples: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Whole-number features of signed samples: sum of squares, greatest magnitude, changes of sign."""
    at = offsets(sizes)
    square = np.add.reduceat(samples * samples, at[:-1]).tolist()
    peak = np.maximum.reduceat(np.abs(samples), at[:-1]).tolist()
    sign = samples < 0
    change = np.append(sign[1:] != sign[:-1], False)
    change[at[1:] - 1] = False
    turns = np.add.reduceat(change.astype(np.int64), at[:-1]).tolist()
    return [f"energy={a};peak={b};crossings={c}" for a, b, c in zip(square, peak, turns)]


def _bytes(df: DataFrame, column: str, kind: str) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast(kind).cast("binary").alias("body"))


def _groups(batch: pa.RecordBatch, rows: int = 256, column: int = 1) -> Iterator[tuple[int, list]]:
    held("media", dict)  # another operator's tables go
    for at in range(0, batch.num_rows, rows):
        bodies = batch.column(column).slice(at, rows).to_pylist()
        for a, b in blocks([x or b"" for x in bodies], flac.AT_A_TIME):
            yield at + a, bodies[a:b]


def store(df: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a FLAC stream of 8-bit samples, and its bytes without padding. A null text
    is empty: one unit of zero bytes. Repeated rows and rows without an id have a stream each; other columns are left
    out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, bodies in _groups(batch):
                texts = [b or b"" for b in bodies]
                media = flac.encode(*padded(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bodies)), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return _bytes(df, column, "string").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def seekable(streams: DataFrame, samples: int = PCM_SAMPLES) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, bits, first_sample, pcm): the stored streams decoded, a row each.

    pcm is an array of blocks, little-endian and signed, and first_sample tells where each begins, so that a reader takes
    the blocks it needs. A stream that is damaged or not supported is an error: it was stored here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, bodies in _groups(batch, column=2):
                starts, blocks_, counts = [], [], []
                for x in flac.decode(bodies):
                    if x is None:
                        raise flac.FlacError("a stored stream can't be read")
                    raw = memoryview(flac.pcm(x, 1))
                    firsts = range(0, len(x), samples)
                    starts += firsts
                    blocks_ += [raw[i : i + samples] for i in firsts]
                    counts.append(len(firsts))
                places = pa.array(offsets(np.array(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(at, len(bodies)) for i in (0, 1)),
                        pa.array(list(map(len, bodies)), pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in bodies]),
                        pa.array([flac.info(m).bits for m in bodies], pa.int32()),
                        pa.ListArray.from_arrays(places, pa.array(starts, pa.int64())),
                        pa.ListArray.from_arrays(places, pa.array(blocks_, pa.binary())),
                    ],
                    ["doc_id", "n_bytes", "media_bytes", "media_sha256", "bits", "first_sample", "pcm"],
                )

    return streams.mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, bits int, first_sample array<long>, pcm array<binary>")


def samples_at(table: DataFrame, start: Column, count: Column) -> DataFrame:
    """(doc_id, pcm) of so many 8-bit samples from a place on, out of the blocks of seekable() that hold them alone."""
    last = F.greatest(start + count - 1, start)
    inside = F.filter(F.arrays_zip("first_sample", "pcm"), lambda b: (b["first_sample"] <= last) & (b["first_sample"] + F.octet_length(b["pcm"]) > start))
    cut = F.transform(inside, lambda b: F.substring(b["pcm"], (F.greatest(start - b["first_sample"], F.lit(0)) + 1).cast("int"), F.greatest(start + count - F.greatest(start, b["first_sample"]), F.lit(0)).cast("int")))
    return table.select("doc_id", F.aggregate(cut, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("pcm"))


def pcm_blocks(df: DataFrame, column: str = "media", samples: int = 4096) -> DataFrame:
    """(doc_id, block, first_sample, n_samples, pcm, error): decoded streams in blocks of so many samples.

    pcm is little-endian and signed. A stream that is null, damaged or not supported gives one row with an error and no
    samples; repeated rows give repeated blocks; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, bodies in _groups(batch):
                keys = batch.column(0).slice(at, len(bodies)).to_pylist()
                for key, body, x in zip(keys, bodies, flac.decode([b or b"" for b in bodies])):
                    if x is None:
                        rows = [(key, 0, 0, 0, None, "no stream" if body is None else "damaged or not supported")]
                    else:
                        width = (flac.info(body).bits + 7) // 8
                        rows = [(key, i // samples, i, len(x[i : i + samples]), flac.pcm(x[i : i + samples], width), None) for i in range(0, max(len(x), 1), samples)]
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["doc_id", "block", "first_sample", "n_samples", "pcm", "error"])

    return _bytes(df, column, "binary").mapInArrow(run, "doc_id long, block long, first_sample long, n_samples long, pcm binary, error string")


def round_trip(df: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): every text is
    stored as a stream in a table, the streams are read from there and decoded into a table of seekable blocks, and those
    are read and summed up. Streams, which hardly shrink, are kept for one part of the rows at a time.

    A null text is empty. Repeated rows, and rows without an id, have a result each; equal texts have equal ones. Other
    columns are left out; an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    part, tables = F.pmod(F.xxhash64("doc_id", column), F.lit(PARTS)), []
    for i in range(PARTS):
        streams = written(store(df.where(part == i), column), "media", "zstd")
        tables.append(written(seekable(streams), "pcm", "zstd"))
        discard(streams)
    table = reduce(DataFrame.unionAll, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies = [b"".join(x) for x in part.column(6).to_pylist()]
                flat = np.frombuffer(b"".join(bodies), np.int8).astype(np.int64)
                sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
                ends = offsets(sizes).tolist()
                view = memoryview((flat + 128).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes),
                        pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]),
                        pa.array([zlib.crc32(view[b - UNIT : b]) for b in ends[1:]], pa.int64()),
                        part.column(2),
                        part.column(3),
                        pa.array(features(flat, sizes)),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return table.mapInArrow(run, schema)
