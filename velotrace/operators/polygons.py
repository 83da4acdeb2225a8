"""Points, lines and regions against tables of areas.

An area is (name, ord, points): a ring, and its place in an order in which later areas win. Areas are cut into the cells
of a square grid: where no side of a ring comes near a cell, the whole cell lies inside or outside, and no ring is looked
at; only cells on a border carry the ring. Cells are broadcast behind a check of their bytes, so points aren't moved; with
more, both sides are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import relational
from .graphs import cut_lineage


def _span(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def _box(points: Column, axis: str) -> tuple[Column, Column]:
    values = F.transform(points, lambda p: p[axis])
    return F.array_min(values), F.array_max(values)


def _boxed(df: DataFrame, points: str, cell: float) -> DataFrame:
    """Each row once for each cell (_c, _r) of its points' bounding box."""
    p = F.col(points)
    return df.where(F.size(p) > 0).withColumn("_c", F.explode(_span(*_box(p, "x"), cell))).withColumn("_r", F.explode(_span(*_box(p, "y"), cell)))


def cells(areas: DataFrame, cell: float) -> DataFrame:
    """(_c, _r, _areas): for each cell the areas that may hold points of it, with their rings; null rings hold all of it."""
    a = cut_lineage(areas.select("ord", "name", geometry.closed(F.col("points")).alias("ring")).where("size(ring) >= 4"))
    side = a.select("ord", F.explode(geometry.sides(F.col("ring"))).alias("s")).select("ord", F.array("s.a", "s.b").alias("s"))
    edge = _boxed(side, "s", cell).select("ord", "_c", "_r").distinct().withColumn("_edge", F.lit(True))
    d = _boxed(a, "ring", cell).join(edge, ["ord", "_c", "_r"], "left")
    inside = geometry.in_ring((F.col("_c") + 0.5) * cell, (F.col("_r") + 0.5) * cell, F.col("ring"))
    d = d.where(F.coalesce("_edge", F.lit(False)) | inside).withColumn("ring", F.when(F.col("_edge"), F.col("ring")))
    return d.groupBy("_c", "_r").agg(F.collect_list(F.struct("ord", "name", "ring")).alias("_areas"))


def _held(found: DataFrame) -> DataFrame:
    """Cells to be broadcast if they are known to be small."""
    found = cut_lineage(found)
    points = F.aggregate("_areas", F.lit(0), lambda n, a: n + 8 + F.greatest(F.coalesce(F.size(a["ring"]), F.lit(0)), F.lit(0)))
    size = found.agg(F.coalesce(F.sum(points), F.lit(0))).first()[0] * 16
    return F.broadcast(found) if size <= relational.BROADCAST_BYTES else found


def with_area(df: DataFrame, areas: DataFrame, x: Column, y: Column, cell: float, into: str, default: Column, border: bool = False) -> DataFrame:
    """J5, and J6 with border: each row with the name of the last area that holds its point, or the default.

    Without border a point on a side lies outside, with it inside. Points with a null or non-finite coordinate lie
    nowhere.
    """
    d = df.withColumns({"_x": x, "_y": y, "_c": F.floor(x / cell).cast("long"), "_r": F.floor(y / cell).cast("long")})
    d = d.join(_held(cells(areas, cell)), ["_c", "_r"], "left")
    fine = geometry.finite(F.col("_x")) & geometry.finite(F.col("_y"))
    hits = F.filter("_areas", lambda a: fine & (a["ring"].isNull() | geometry.in_ring(F.col("_x"), F.col("_y"), a["ring"], border)))
    last = F.array_max(F.transform(hits, lambda a: F.struct(a["ord"].alias("ord"), a["name"].alias("name"))))
    return d.withColumn(into, F.coalesce(last["name"], default)).drop("_x", "_y", "_c", "_r", "_areas")


def met(df: DataFrame, key: str, points: str, areas: DataFrame, cell: float, closed: bool = False) -> DataFrame:
    """(key, names): the areas that lines, or with closed rings, share a point with, borders included, in the order of
    areas; rows that meet none don't appear.

    Shapes and areas meet in the cells of their bounding boxes and are then held against one another.
    """
    a = cut_lineage(areas.select("ord", "name", F.col("points").alias("ring")))
    boxed = _boxed(a, "ring", cell).groupBy("_c", "_r").agg(F.collect_list(F.struct("ord", "name", "ring")).alias("_areas"))
    shape = F.col("_p")
    d = df.select(F.col(key), (geometry.closed(F.col(points)) if closed else F.col(points)).alias("_p"))
    d = _boxed(d, "_p", cell).join(_held(boxed), ["_c", "_r"])
    first = F.element_at(shape, 1)

    def touches(a: Column) -> Column:
        hit = geometry.line_meets_ring(shape, a["ring"])
        if closed:  # an area may lie within the region as a whole
            inner = F.element_at(a["ring"], 1)
            hit = hit | geometry.in_ring(inner["x"], inner["y"], shape, True)
        return hit & geometry.finite(first["x"])

    hits = F.transform(F.filter("_areas", touches), lambda a: F.struct(a["ord"].alias("ord"), a["name"].alias("name")))
    d = d.select(key, F.explode(hits).alias("_h")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_h")).alias("_h"))
    return d.select(key, F.transform("_h", lambda h: h["name"]).alias("names"))


def flagged(lines: DataFrame, key: str, points: str, areas: DataFrame, cell: float) -> DataFrame:
    """Lines with in_area, 1 if they share a point with any area, else 0. key must be unique."""
    hit = met(lines, key, points, areas, cell).select(key, F.lit(1).alias("_hit"))
    return lines.join(hit, key, "left").withColumn("in_area", F.coalesce("_hit", F.lit(0))).drop("_hit")


def first_area(regions: DataFrame, key: str, points: str, areas: DataFrame, cell: float) -> DataFrame:
    """Regions with area, the first area that they share a point with, else null. key must be unique."""
    hit = met(regions, key, points, areas, cell, True).select(key, F.element_at("names", 1).alias("area"))
    return regions.join(hit, key, "left")
