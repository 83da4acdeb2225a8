"""Connected components of graphs, raster cells and hexagons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hexgrid import NEIGHBOURS
from ..tables import discard, written


#: Edges whose components are found on the driver.
LOCAL_EDGES = 1_000_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    return written(df, "lineage")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected edges (u, v), the component being its smallest node.

    Few edges, as those of a city's cells, are laid out in arrays on the driver. With more, the search is distributed: it
    alternates two steps that hang a node's neighbours on the smallest of them, those above the node and those below;
    each takes one aggregation and one join on the node, so a node with very many neighbours stays a plain join.
    """
    edges = cut_lineage(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    if edges.count() <= LOCAL_EDGES:
        got = edges.toArrow()
        ends = np.stack([got["u"].to_numpy(), got["v"].to_numpy()])
        node, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        found = pa.table({"node": node, "component": node[roots(at[0], at[1], len(node))]})
        return edges.sparkSession.createDataFrame(found, "node long, component long")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u")
        down = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v")))
        before, e = e, cut_lineage(down.where("u <> v").distinct())
        discard(before)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """G4 in arrays: the least node of the component of each of n nodes.

    Roots are hung on the least root that an edge leads to, and chains of roots are shortened, until nothing moves.
    """
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        now = root.copy()
        np.minimum.at(now, root[u], least)
        np.minimum.at(now, root[v], least)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, root):
            return root
        root = now


def largest_label(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which of n nodes are in the component with most of them, of equal ones in that of the least node."""
    root = roots(u, v, n)
    return root == np.bincount(root).argmax() if n else np.zeros(0, bool)


def _neighbours(cells: DataFrame, a: str, b: str, steps) -> DataFrame:
    """Pairs of neighbouring cells as edges of whole numbers that keep the order of (a, b)."""
    key = lambda x, y: x * F.lit(1 << 32) + (y + (1 << 31))
    keyed = cells.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).distinct()
    keyed = keyed.withColumn("id", key(F.col("a"), F.col("b")))
    near = keyed.select(F.col("id").alias("u"), F.explode(F.array(F.lit(0).alias("z"), *[F.lit(i) for i in range(1, len(steps) + 1)])).alias("s"), "a", "b")
    shift = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), *steps)])
    near = near.withColumn("d", F.element_at(shift, F.col("s") + 1))
    near = near.select("u", (F.col("a") + F.col("d.x")).alias("a"), (F.col("b") + F.col("d.y")).alias("b"))
    return near.join(keyed.withColumnRenamed("id", "v"), ["a", "b"]).select("u", "v")


def _labelled(cells: DataFrame, a: str, b: str, steps) -> DataFrame:
    found = components(_neighbours(cells, a, b, steps))
    row = F.shiftright("node", 32)
    return found.select(row.alias(a), (F.col("node") - row * F.lit(1 << 32) - (1 << 31)).cast("long").alias(b), "component")


def raster_components(cells: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """SP18: 8-neighbour components of cells, numbered from 1 in the order of their first cell."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    d = _labelled(cells, row, col, steps)
    order = F.dense_rank().over(Window.orderBy("component"))
    number = d.select("component").distinct().withColumn("label", order.cast("long"))
    return d.join(number, "component").select(row, col, "label")


def hex_components(cells: DataFrame) -> DataFrame:
    """SP19 and O6: components of hexagons (q, r), numbered from 1, the largest first, equal ones by their first cell."""
    d = _labelled(cells, "q", "r", NEIGHBOURS)
    size = d.groupBy("component").agg(F.count(F.lit(1)).alias("n_cells"))
    number = size.withColumn("cluster_id", F.row_number().over(Window.orderBy(F.desc("n_cells"), "component")).cast("long"))
    return d.join(number, "component").select("q", "r", "cluster_id", "n_cells")
