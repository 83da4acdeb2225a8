"""Road networks and routes.

The graph of a city's drivable roads is bounded by the city, not by the trips. Behind a check of its bytes it is fetched
as columns, laid out as arrays, and broadcast; trips stay where they are and are routed one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.geometry import sides
from ..functions.scalars import DRIVABLE, node_key, one_way
from .graphs import components, largest_label
from .relational import numbered, with_nearest

#: Bytes that a graph may take in each task, and that an edge takes; larger networks have to be cut into regions first.
GRAPH_BYTES, EDGE_BYTES = 512_000_000, 72
#: Segments whose component is found on the driver, in arrays of a bounded size; with more, the search is distributed.
LOCAL_SEGMENTS = 1_000_000
EPS = 1e-9
PATHS = "route_id string, alt_rank int, dist_m double, ratio double, n_edges int, status string, alt_status string, points array<struct<x:double,y:double>>"


def drivable(roads: DataFrame) -> DataFrame:
    """Roads (osm_id, fclass, oneway, points) of drivable classes, with a normal oneway."""
    d = roads.withColumn("fclass", F.lower(F.trim("fclass"))).where(F.col("fclass").isin(*DRIVABLE) & (F.size("points") >= 2))
    return d.withColumn("oneway", one_way(F.col("oneway")))


def split(roads: DataFrame) -> DataFrame:
    """Segments of two points with a length, numbered in the order of road and place along it."""
    d = roads.select("osm_id", "fclass", "oneway", F.posexplode(sides(F.col("points"))).alias("part", "s"))
    d = d.select("osm_id", "fclass", "oneway", "part", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    d = d.withColumn("length_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("length_m > 0")
    d = numbered(d, ["osm_id", "x1", "y1", "x2", "y2", "part"], "road_idx")
    return d.withColumns({"u": node_key(F.col("x1"), F.col("y1")), "v": node_key(F.col("x2"), F.col("y2"))}).drop("part")


def edges(segments: DataFrame) -> DataFrame:
    """Directed edges by oneway; of parallel ones the shortest, ties to the smaller road_idx."""
    there = F.struct(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(False).alias("back"))
    back = F.struct(F.col("v").alias("a"), F.col("u").alias("b"), F.lit(True).alias("back"))
    ways = F.when(F.col("oneway") == "B", F.array(there, back)).when(F.col("oneway") == "F", F.array(there)).otherwise(F.array(back))
    d = segments.withColumn("w", F.explode(ways)).select("w.a", "w.b", "w.back", "road_idx", "length_m", "x1", "y1", "x2", "y2")
    best = d.groupBy("a", "b").agg(F.min(F.struct("length_m", "road_idx", "back", "x1", "y1", "x2", "y2")).alias("e"))
    return best.select("a", "b", "e.*")


def largest_component(segments: DataFrame) -> DataFrame:
    """The segments of the weakly connected component with most nodes, numbered anew; of equal ones the one with the
    least node key."""
    if segments.count() <= LOCAL_SEGMENTS:
        got = segments.select("road_idx", "u", "v").toArrow()
        keys = pa.chunked_array([*got["u"].chunks, *got["v"].chunks], pa.string()).combine_chunks()
        names, node = np.unique(keys.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        u, v = node[: got.num_rows], node[got.num_rows :]
        label = largest_label(u, v, len(names))
        kept = np.sort(got["road_idx"].to_numpy()[label[u]])
        number = segments.sparkSession.createDataFrame(pa.table({"road_idx": kept, "_new": np.arange(len(kept))}), "road_idx long, _new long")
        return segments.join(F.broadcast(number), "road_idx").withColumn("road_idx", F.col("_new")).select(segments.columns)
    ends = numbered(segments.select(F.explode(F.array("u", "v")).alias("key")).distinct(), ["key"], "id")
    pair = segments.join(ends.select(F.col("key").alias("u"), F.col("id").alias("iu")), "u").join(ends.select(F.col("key").alias("v"), F.col("id").alias("iv")), "v")
    found = components(pair.select(F.col("iu").alias("u"), F.col("iv").alias("v")))
    top = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    keep = found.join(F.broadcast(top), "component", "left_semi").join(ends, found.node == ends.id).select(F.col("key").alias("u"))
    d = segments.join(keep, "u", "left_semi")  # a segment's ends are in one component
    return numbered(d.withColumnRenamed("road_idx", "_old"), ["_old"], "road_idx").select(segments.columns)


def snapped(trips: DataFrame, segments: DataFrame, c: Settings = DEFAULT) -> DataFrame:
    """Trips (route_id, sx, sy, ex, ey) with the nearest segment of either end within the tolerance, s_snap and e_snap;
    null where there is none."""
    payload = ["x1", "y1", "x2", "y2", "oneway"]
    for name in ("s", "e"):
        trips = with_nearest(trips, segments, c.snap_tolerance_m, payload, F.col(f"{name}x"), F.col(f"{name}y"), f"{name}_snap")
    return trips


def doors(place: Column, leaving: bool) -> Column:
    """The crossings by which a place on a segment is left or reached, as its direction allows, with the metres between
    them: an array of (node, metres)."""
    rest = F.hypot(place["x2"] - place["x1"], place["y2"] - place["y1"]) - place["position"]
    u = F.struct(node_key(place["x1"], place["y1"]).alias("node"), place["position"].alias("metres"))
    v = F.struct(node_key(place["x2"], place["y2"]).alias("node"), rest.alias("metres"))
    along, against = (v, u) if leaving else (u, v)
    return F.when(place["oneway"] == "B", F.array(along, against)).when(place["oneway"] == "F", F.array(along)).when(place["oneway"] == "T", F.array(against))


def direct_metres(s: Column, e: Column) -> Column:
    """The length of the way from one place to another on the same segment, null if they lie on different ones, are
    the same place, or the way is against the segment's direction."""
    move = e["position"] - s["position"]
    legal = F.when(move > 0, s["oneway"].isin("B", "F")).otherwise(s["oneway"].isin("B", "T"))
    return F.when((s["road_idx"] == e["road_idx"]) & (F.abs(move) > EPS) & legal, F.abs(move))


class Door(NamedTuple):
    """A crossing by which a place on a segment is left or reached, the metres between them, and the edge that is used."""

    node: int
    metres: float
    edge: tuple[int, int]


class Path(NamedTuple):
    metres: float
    edges: int
    nodes: tuple[int, ...]
    used: tuple[tuple[int, int], ...]


class Streets:
    """Directed streets as arrays: nodes in the order of their coordinates in millimetres, edges in that of their node."""

    def __init__(self, table: pa.Table):
        c = {n: table[n].to_numpy() for n in table.column_names}
        ends = np.stack([np.concatenate([c["ax"], c["bx"]]), np.concatenate([c["ay"], c["by"]])], axis=1)
        nodes, first, index = np.unique(ends, axis=0, return_index=True, return_inverse=True)
        a, b = np.split(index.ravel(), 2)
        order = np.lexsort((b, a))
        self.mx, self.my = nodes[:, 0], nodes[:, 1]
        self.x = np.concatenate([c["x_a"], c["x_b"]])[first]
        self.y = np.concatenate([c["y_a"], c["y_b"]])[first]
        self.begin = np.searchsorted(a[order], np.arange(len(nodes) + 1))
        self.to, self.metres = b[order], c["length_m"][order]

    def node(self, x: float, y: float) -> int:
        """The node at a place, by the same rounding as node_key; -1 if there is none."""
        mx, my = (int(math.floor(abs(v) * 1000 + 0.5)) * (1 if v >= 0 else -1) for v in (x, y))
        low, high = np.searchsorted(self.mx, mx, "left"), np.searchsorted(self.mx, mx, "right")
        at = low + np.searchsorted(self.my[low:high], my)
        return int(at) if at < high and self.my[at] == my else -1

    def doors(self, place: dict, leaving: bool) -> list[Door]:
        """How a place is left or reached, as its segment's direction allows."""
        u, v = self.node(place["x1"], place["y1"]), self.node(place["x2"], place["y2"])
        done = place["position"]
        rest = math.hypot(place["x2"] - place["x1"], place["y2"] - place["y1"]) - done
        along = Door(v, rest, (u, v)) if leaving else Door(u, done, (u, v))
        against = Door(u, done, (v, u)) if leaving else Door(v, rest, (v, u))
        allowed = {"B": (along, against), "F": (along,), "T": (against,)}[place["oneway"]]
        return [d for d in allowed if d.node >= 0]

    def travel(self, outs: list[Door], ins: list[Door], closed: tuple[int, int] | None, most: float) -> tuple[float, Door, list[int], Door] | None:
        """The shortest way from any of the doors out to any of the doors in, in one search, if it is shorter than most."""
        goals: dict[int, Door] = {}
        for d in ins:
            if d.node not in goals or d.metres < goals[d.node].metres:
                goals[d.node] = d
        cost: dict[int, float] = {}
        origin: dict[int, int | Door] = {}
        heap: list[tuple[float, int]] = []
        for d in outs:
            if d.metres < cost.get(d.node, math.inf):
                cost[d.node], origin[d.node] = d.metres, d
                heapq.heappush(heap, (d.metres, d.node))
        best, goal = most, None
        while heap:
            metres, node = heapq.heappop(heap)
            if metres >= best:
                break
            if metres > cost[node]:
                continue
            if node in goals and metres + goals[node].metres < best - EPS:
                best, goal = metres + goals[node].metres, node
            i, j = self.begin[node], self.begin[node + 1]
            for after, length in zip(self.to[i:j].tolist(), self.metres[i:j].tolist()):
                reach = metres + length
                if reach < best and reach < cost.get(after, math.inf) and (node, after) != closed:
                    cost[after], origin[after] = reach, node
                    heapq.heappush(heap, (reach, after))
        if goal is None:
            return None
        nodes = [goal]
        while not isinstance(origin[nodes[-1]], Door):
            nodes.append(origin[nodes[-1]])
        return best, origin[nodes[-1]], nodes[::-1], goals[goal]

    def shortest(self, s: dict, e: dict, closed: tuple[int, int] | None = None, most: float = math.inf) -> Path | None:
        """The shortest way between two places that doesn't use a closed edge and isn't longer than most: along their
        common segment, or by a door of each."""
        outs, ins = ([d for d in self.doors(p, leaving) if d.edge != closed] for p, leaving in ((s, True), (e, False)))
        found = None
        if s["road_idx"] == e["road_idx"]:
            move = e["position"] - s["position"]
            u, v = self.node(s["x1"], s["y1"]), self.node(s["x2"], s["y2"])
            edge = (u, v) if move > 0 else (v, u)
            if EPS < abs(move) <= most and any(d.edge == edge for d in outs):
                found = Path(abs(move), 1, (), (edge,))
        way = self.travel(outs, ins, closed, found.metres if found else most)
        if way:
            metres, out, nodes, into = way
            steps = list(zip(nodes, nodes[1:]))
            count = len(steps) + (out.metres > EPS) + (into.metres > EPS)
            found = Path(metres, count, tuple(nodes), tuple(dict.fromkeys([out.edge, *steps, into.edge])))
        return found

    def line(self, path: Path, s: dict, e: dict) -> list[dict]:
        """The points of a path, none twice in a row."""
        ends = []
        for p in (s, e):
            t = p["position"] / math.hypot(p["x2"] - p["x1"], p["y2"] - p["y1"])
            ends.append((p["x1"] + t * (p["x2"] - p["x1"]), p["y1"] + t * (p["y2"] - p["y1"])))
        places = [ends[0], *((float(self.x[n]), float(self.y[n])) for n in path.nodes), ends[1]]
        return [{"x": x, "y": y} for i, (x, y) in enumerate(places) if not i or (x, y) != places[i - 1]]

    def choices(self, route: str, s: dict, e: dict, c: Settings) -> tuple[list[Path], str]:
        """The shortest way and at most one other of a bounded length.

        Fixed rules: the edges of the first, each once and in its order, are shuffled by Python's generator, seeded with the
        first 16 bytes of the SHA-256 of seed|route; they are closed one at a time, and the first other way is taken.
        """
        first = self.shortest(s, e)
        if first is None or first.metres <= 0:
            return [], "not_applicable"
        edges = list(first.used)
        random.Random(int.from_bytes(hashlib.sha256(f"{c.random_seed}|{route}".encode()).digest()[:16], "big")).shuffle(edges)
        most = first.metres * c.alternative_ratio + 1e-7
        tried = (self.shortest(s, e, edge, most + 2 * EPS) for edge in edges[: c.alternative_attempts])
        other = next((p for p in tried if p and p.nodes != first.nodes and p.metres <= most), None)
        return ([first, other], "ok") if other else ([first], "no_valid_alternative")


def streets(network: DataFrame) -> Streets:
    """Directed edges as arrays, behind a check of their bytes."""
    n = network.count()
    if n * EDGE_BYTES > GRAPH_BYTES:
        raise ValueError(f"{n} edges are more than a task may hold ({GRAPH_BYTES // EDGE_BYTES}); cut the network into regions")
    part = lambda key, i: F.split(key, ":")[i].cast("long")
    place = lambda there, back: F.when(F.col("back"), F.col(back)).otherwise(F.col(there))
    d = network.select(
        part("a", 0).alias("ax"), part("a", 1).alias("ay"), part("b", 0).alias("bx"), part("b", 1).alias("by"),
        place("x1", "x2").alias("x_a"), place("y1", "y2").alias("y_a"), place("x2", "x1").alias("x_b"), place("y2", "y1").alias("y_b"), "length_m",
    )
    return Streets(d.toArrow())


def route(trips: DataFrame, network: DataFrame, c: Settings = DEFAULT) -> DataFrame:
    """Paths of snapped trips, a row for each path, one without points where there is none, with its status."""
    shared = network.sparkSession.sparkContext.broadcast(streets(network))
    kind = pa.schema([("route_id", pa.string()), ("alt_rank", pa.int32()), ("dist_m", pa.float64()), ("ratio", pa.float64()), ("n_edges", pa.int32()), ("status", pa.string()), ("alt_status", pa.string()), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])

    def status(r: dict) -> str | None:
        s, e = r["s_snap"], r["e_snap"]
        if any(r[k] is None or not math.isfinite(r[k]) for k in ("sx", "sy", "ex", "ey")):
            return "invalid_od"
        if s is None or e is None:
            return "snap_far"
        return "zero_distance" if s["road_idx"] == e["road_idx"] and abs(s["position"] - e["position"]) <= 1e-6 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            out = []
            for r in b.to_pylist():
                row = {"route_id": r["route_id"], "alt_rank": 1, "n_edges": 0, "status": status(r), "alt_status": "not_applicable"}
                paths, s, e = [], r["s_snap"], r["e_snap"]
                if row["status"] is None:
                    paths, row["alt_status"] = g.choices(r["route_id"], s, e, c)
                    row["status"] = "ok" if paths else "no_path"
                out += [row] if not paths else [row | {"alt_rank": i, "dist_m": p.metres, "ratio": p.metres / paths[0].metres, "n_edges": p.edges, "points": g.line(p, s, e)} for i, p in enumerate(paths, 1)]
            yield pa.RecordBatch.from_pylist(out, kind)

    return trips.select("route_id", "sx", "sy", "ex", "ey", "s_snap", "e_snap").mapInArrow(run, PATHS)


def path_faults(paths: DataFrame, c: Settings = DEFAULT) -> DataFrame:
    """Routes whose paths break a rule: ranks from 1 without gaps, lengths ascending, first ratio 1, none beyond the
    limit, no empty line."""
    fine = paths.where("status = 'ok'")
    g = fine.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("alt_rank", "dist_m", "ratio", F.size("points").alias("n")))).alias("p"))
    p = F.col("p")
    ranks = F.transform(p, lambda x: x["alt_rank"]) == F.sequence(F.lit(1), F.size(p))
    ascending = F.forall(F.sequence(F.lit(1), F.size(p)), lambda i: (i == 1) | (F.try_element_at(p, i)["dist_m"] >= F.try_element_at(p, F.greatest(i - 1, F.lit(1)))["dist_m"] - 1e-7))
    limits = F.forall(p, lambda x: (x["ratio"] <= c.alternative_ratio + 1e-7) & (x["n"] >= 2))
    return g.where(~(ranks & ascending & limits & (F.element_at(p, 1)["ratio"] == 1.0) & (F.size(p) <= 2))).select("route_id")
