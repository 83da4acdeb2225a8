"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are whole numbers, floor(scale * x). Inner products become distances by one more coordinate: with M the greatest
squared length of any vector, data x become (x, sqrt(M - |x|^2)) and queries q become (q, 0), so that
|x' - q'|^2 = M + |q|^2 - 2 <x, q>, and the highest scores are the nearest neighbours.

1. Pivots are drawn from the data, about the root of its number; queries and data go to their nearest pivot's cell.
2. Summaries of the cells (rows, least and greatest distance to the pivot) bound how near to a query any vector of a cell
   can be: by the triangle inequality, and as a cell's vectors lie on its pivot's side of the plane between two pivots.
3. Each query is answered in the nearest cells that hold enough rows, which bounds its k-th neighbour, and then goes only
   to the cells that the bounds leave. Queries are a hundredth of the rows, so it is they that are replicated; each vector
   is dealt out once for as many queries as a task takes.
4. Cells are cut into chunks and their queries into parts of a bounded size; a chunk keeps the k best of each query it
   meets, and the best of all chunks remain.

Where no cell can be left out, as with vectors that are all about equally far from one another, this is a search of all
rows in blocks, with each vector dealt out twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import ship, written

SCALE, TOP, EVERY = 1024, 10, 100
#: Pivots, which the driver and every task hold, at most: by number and by bytes.
PIVOTS, PIVOT_BYTES = 4096, 16_000_000
#: Rows that the cells of a query's first search hold, as a multiple of k.
ENOUGH = 8
#: Queries of a part, whole numbers of a chunk of vectors, and queries that are scored at a time.
QUERIES, CHUNK, SCORED = 4096, 1 << 20, 256
#: Room for rounding in distances, relative.
SLACK = 1e-9
LARGEST = 2.0**63


def packed(x: np.ndarray) -> bytes:
    """A digit for the bytes of a component, and the components in as few bytes as hold them."""
    most = int(np.abs(x).max(initial=0))
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return b"%d" % size + x.astype(f"<i{size}").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[:1].decode()}", offset=1).astype(np.int64)


def whole_numbers(df: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors as packed whole numbers; those that are null or hold null, NaN or infinite components are left
    out, and so are rows without an id. A component whose whole number doesn't fit a long is an error."""

    @pandas_udf("binary")
    def floor(batch: pd.Series) -> pd.Series:
        out = []
        for x in batch:
            whole = np.floor(np.asarray(x, np.float64) * scale)
            if np.abs(whole).max(initial=0) >= LARGEST:
                raise OverflowError(f"a component times {scale} does not fit a long")
            out.append(packed(whole.astype(np.int64)))
        return pd.Series(out)

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_x")).where("vec_id is not null and _x is not null")
    odd = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd).select("vec_id", floor("_x").alias("v"))


def _matrix(blobs, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    parts = [unpacked(b) for b in blobs]
    if all(len(p) == width for p in parts):
        return np.concatenate([np.zeros(0, np.int64), *parts]).reshape(len(parts), width)
    out = np.zeros((len(parts), width), np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exactly: as floats where no sum can leave the whole numbers that those hold, as longs where none
    can leave those, else as numbers of any size. A score that doesn't fit a long is an error."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < LARGEST / 2:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    if exact.size and (exact.max() >= 1 << 63 or exact.min() < -(1 << 63)):
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to smaller ids, without the row's own id: row, id, score."""
    order = np.argsort(ids, kind="stable")
    score, ids = score[:, order], ids[order]
    rows, picked = [], []
    for i in range(len(score)):
        s = score[i]
        at = np.flatnonzero(ids != own[i])
        if len(at) > k:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            above, tied = at[s[at] > least], at[s[at] == least]
            at = np.concatenate([above, tied[: k - len(above)]])
        rows.append(np.full(len(at), i))
        picked.append(at)
    row, at = np.concatenate(rows), np.concatenate(picked)
    return row, ids[at], score[row, at]


@dataclass
class Cells:
    """The pivots, with the coordinate that turns products into distances, and a summary of each cell."""

    width: int
    top: float
    pivots: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def lifted(self, blobs, query: bool) -> np.ndarray:
        """Vectors with one more coordinate."""
        x = _matrix(blobs, self.width).astype(np.float64)
        return np.hstack([x, (np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - np.square(x).sum(1), 0)))[:, None]])

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors to all pivots."""
        p = self.pivots
        return np.sqrt(np.maximum(np.square(x).sum(1)[:, None] + np.square(p).sum(1)[None, :] - 2 * x @ p.T, 0))

    def most(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each lifted query the distances to all pivots and the highest score that a vector of each cell can have;
        none for empty cells."""
        d = self.away(x)
        own = d.argmin(axis=1)
        between = self.away(self.pivots)[own]
        mine = d[np.arange(len(x)), own][:, None]
        side = np.divide(np.square(d) - np.square(mine), 2 * between, out=np.zeros_like(d), where=between > 0)
        least = np.maximum.reduce([d - self.far[None, :], self.near[None, :] - d, side, np.zeros_like(d)])
        room = SLACK * 4 * np.sqrt(max(self.top, 1.0)) + 1e-6
        score = (self.top + np.square(x).sum(1)[:, None] - np.square(np.maximum(least - room, 0))) / 2
        score += SLACK * (self.top + np.abs(score)) + 1
        score[:, self.rows == 0] = -np.inf
        return d, score


def draw(data: DataFrame, n: int, number: int) -> list[bytes]:
    """At most so many distinct vectors, those with the least hash; a share of the hash's range that holds somewhat more
    is cut out first. Any pivots give the same result."""
    d = data.select("v", F.xxhash64("v").alias("h"))
    if n > 4 * number:
        d = d.where(F.col("h") < int(-(2**63) + 2**64 * (2.0 * number / n)))
    got = [bytes(r[0]) for r in d.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(number).select("v").collect()]
    return got or [bytes(r[0]) for r in data.select("v").limit(1).collect()]


def summed(data: DataFrame, pivots: int) -> tuple[DataFrame, Cells] | None:
    """data with each vector's cell, written, and the cells; None if there is no vector."""

    @pandas_udf("double")
    def square(v: pd.Series) -> pd.Series:
        return pd.Series([float(np.square(unpacked(b).astype(np.float64)).sum()) for b in v])

    size = (F.octet_length("v") - 1) / F.substring("v", 1, 1).cast("string").cast("int")
    n, width, top = data.agg(F.count(F.lit(1)), F.max(size.cast("int")), F.max(square("v"))).first()
    if not n:
        return None
    number = max(1, min(pivots, PIVOT_BYTES // (8 * (width + 1)), math.ceil(math.sqrt(n))))
    drawn = draw(data, n, number)
    c = Cells(width, top, np.zeros((0, width + 1)), *[np.zeros(len(drawn))] * 3)
    c.pivots = c.lifted(drawn, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = c.away(c.lifted(b.column(1).to_pylist(), False))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["vec_id", "v", "row", "cell", "away"])

    placed = written(data.mapInArrow(run, "vec_id long, v binary, row long, cell int, away double"), "placed")
    c.rows, c.near, c.far = (np.zeros(len(drawn)) for _ in range(3))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)), F.min("away"), F.max("away")).collect():  # a row a pivot
        c.rows[r[0]], c.near[r[0]], c.far[r[0]] = r[1:]
    return placed, c


def first_cells(asked: DataFrame, c: Cells, k: int) -> DataFrame:
    """(query_id, v, cell): the nearest cells of each query that hold enough rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SCORED):
                s = b.slice(at, SCORED)
                d, _ = c.most(c.lifted(s.column(1).to_pylist(), True))
                d[:, c.rows == 0] = np.inf
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(c.rows[order], axis=1) - c.rows[order]
                row, place = np.nonzero((before < ENOUGH * k) & (c.rows[order] > 0))
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(row)), s.column(1).take(pa.array(row)), pa.array(order[row, place].astype(np.int32))], ["query_id", "v", "cell"])

    return asked.mapInArrow(run, "query_id long, v binary, cell int")


def other_cells(asked: DataFrame, c: Cells, k: int) -> DataFrame:
    """(query_id, v, cell) of the cells that may hold a better one than what a query (query_id, v, least: the score to
    beat, or null; cells: those that it has been to) has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SCORED):
                s = b.slice(at, SCORED)
                _, most = c.most(c.lifted(s.column(1).to_pylist(), True))
                least = np.array([-np.inf if x is None else float(x) for x in s.column(2).to_pylist()])
                want = (most >= least[:, None]) & (c.rows > 0)[None, :]
                for i, been in enumerate(s.column(3).to_pylist()):
                    want[i, been or []] = False
                row, cell = np.nonzero(want)
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(row)), s.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["query_id", "v", "cell"])

    return asked.mapInArrow(run, "query_id long, v binary, cell int")


def met(placed: DataFrame, routed: DataFrame, c: Cells, k: int) -> DataFrame:
    """(query_id, v, vec_id, score): the k best of each query in each chunk of the cells that it is sent to.

    routed must be a written table. Neither side of a task is larger than a chunk or a part, whatever a cell holds.
    """
    spark = placed.sparkSession
    per_chunk = max(SCORED, CHUNK // max(c.width, 1))
    asks = {r[0]: r[1] for r in routed.groupBy("cell").count().collect()}  # a row a pivot at most
    sizes = [(i, max(1, math.ceil(c.rows[i] / per_chunk)), math.ceil(n / QUERIES)) for i, n in sorted(asks.items())]
    cells = F.broadcast(spark.createDataFrame(sizes, "cell int, chunks int, parts int"))  # likewise
    x = placed.join(cells, "cell").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "chunk", "part", "vec_id", "v")
    q = routed.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("query_id", "v"), F.col("parts")).cast("int"))
    q = q.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", "chunk", "part", "query_id", "v")
    width = c.width

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "v": [], "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        ids, vectors, out = x["vec_id"].to_numpy(np.int64), _matrix(x["v"], width), []
        for at in range(0, len(q), SCORED):
            some = q.iloc[at : at + SCORED]
            own = some["query_id"].to_numpy(np.int64)
            row, vec, score = best(scores(_matrix(some["v"], width), vectors), ids, own, k)
            out.append(pd.DataFrame({"query_id": own[row], "v": some["v"].to_numpy()[row], "vec_id": vec, "score": score}))
        return pd.concat(out)

    keys = ["cell", "chunk", "part"]
    return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(solve, "query_id long, v binary, vec_id long, score long")


def search(df: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, its k highest inner products with
    other rows, all if they are fewer, ties to the smaller id.

    Null vectors and those with null or non-finite components take no part, nor do rows without an id; a shorter vector
    has zeros where it ends; an empty vector scores 0. A repeated row is a candidate once for each time it is there,
    but not for its own id; as a query it counts once, and rows that share an id but not a vector are one query that
    scores by each of them. Other columns are left out; an empty table gives no rows. A whole number or score that doesn't
    fit a long is an error.
    """
    spark = df.sparkSession
    ship(spark)
    data = written(whole_numbers(df, scale, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    found = summed(data, pivots)
    asked = written(data.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct(), "queries")
    if found is None or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, c = found
    begun = written(first_cells(asked, c, k), "routes")
    first = written(met(placed, begun, c, k), "answers")
    # of k answers in the cells it has been to, the least is what a query has to beat
    place = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score")))
    least = first.withColumn("_n", place).where(F.col("_n") == k).select("query_id", "v", F.col("score").alias("least"))
    been = begun.groupBy("query_id", "v").agg(F.collect_list("cell").alias("cells"))
    rest = asked.join(least, ["query_id", "v"], "left").join(been, ["query_id", "v"], "left").select("query_id", "v", "least", "cells")
    routed = written(other_cells(rest, c, k), "routes")
    return ranked(first.unionAll(met(placed, routed, c, k)).drop("v"), k)


def ranked(local: DataFrame, k: int) -> DataFrame:
    """The k best of each query among what its chunks have kept."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
