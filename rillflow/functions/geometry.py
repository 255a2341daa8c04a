"""Planar geometry on arrays of struct(x, y), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(points: Column) -> Column:
    rest = F.size(points) - 1
    return F.zip_with(F.slice(points, F.lit(1), rest), F.slice(points, F.lit(2), rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(points: Column) -> Column:
    """Length of a polyline; 0 for fewer than two points."""
    step = lambda e: F.sqrt((e["b"]["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(_pairs(points), F.lit(0.0), lambda acc, e: acc + step(e)))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring."""
    cross = lambda e: (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).cast("double")
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.abs(F.aggregate(_pairs(ring), F.lit(0.0), lambda acc, e: acc + cross(e))) / 2)


def polygon_area(shell: Column, holes: Column) -> Column:
    return ring_area(shell) - F.aggregate(F.transform(holes, ring_area), F.lit(0.0), lambda acc, a: acc + a)


def drop_small_holes(holes: Column, least: float = 100.0) -> Column:
    return F.filter(holes, lambda h: ring_area(h) >= least)


def end_point(points: Column) -> Column:
    return F.element_at(points, -1)


def farthest(points: Column, x: Column, y: Column) -> Column:
    """Largest distance of any vertex from a point."""
    return F.array_max(F.transform(points, lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y))))


def chaikin(ring: Column, times: int = 3) -> Column:
    """A closed ring with its corners cut ``times`` times."""
    at = lambda e, t: F.struct((e["a"]["x"] * (1 - t) + e["b"]["x"] * t).alias("x"), (e["a"]["y"] * (1 - t) + e["b"]["y"] * t).alias("y"))
    for _ in range(times):
        cut = F.flatten(F.transform(_pairs(ring), lambda e: F.array(at(e, 0.25), at(e, 0.75))))
        ring = F.concat(cut, F.slice(cut, 1, 1))
    return ring


def resample(points: Column, count: int) -> Column:
    """``count`` points at equal distances along a polyline, both ends included."""
    pairs = _pairs(points)
    step = lambda e: F.sqrt((e["b"]["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"]))
    marks = F.transform(pairs, lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.aggregate(F.slice(pairs, F.lit(1), i), F.lit(0.0), lambda acc, p: acc + step(p)).alias("from"), step(e).alias("len")))

    def at(i: Column) -> Column:
        d = length(points) * i / (count - 1)
        e = F.coalesce(F.element_at(F.filter(marks, lambda m: (m["from"] <= d) & (m["len"] > 0)), -1), F.element_at(marks, 1))
        t = F.when(e["len"] > 0, F.least((d - e["from"]) / e["len"], F.lit(1.0))).otherwise(0.0)
        return F.struct((e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)


def to_wkt(points: Column) -> Column:
    text = F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", text), F.lit(")"))


def from_wkt(wkt: Column) -> Column:
    """Points of a LINESTRING."""
    body = F.split(F.regexp_extract(wkt, r"(?i)^\s*LINESTRING\s*\((.*)\)\s*$", 1), r"\s*,\s*")
    return F.transform(body, lambda t: F.struct(F.get(F.split(F.trim(t), r"\s+"), F.lit(0)).cast("double").alias("x"), F.get(F.split(F.trim(t), r"\s+"), F.lit(1)).cast("double").alias("y")))
