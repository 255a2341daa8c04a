"""Stream cells to lines: segments between heads and junctions, their vertices in order, and what flows into what."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.checkpoint import saved
from rillflow.operators.forest import upstream_counts
from rillflow.operators.raster import ROW

c = F.col


def ranked(links: DataFrame) -> DataFrame:
    """(id, end, rank) of chains (id, next): the last node of each node's chain and how many nodes it is from there, itself counted.

    List ranking by pointer doubling: log2(longest chain) rounds for all chains together. No two nodes have the same next.
    """
    now = saved(links.select("id", "next", c("id").alias("end"), F.lit(1).cast("long").alias("rank")))
    most = now.count().bit_length()
    for k in itertools.count():
        if now.where("next is not null").isEmpty():
            break
        if k > most:
            raise ValueError("the links have a cycle")
        ahead = now.select(c("id").alias("next"), c("next").alias("after"), c("end").alias("far"), c("rank").alias("more"))
        now = saved(now.join(ahead, "next", "left").select("id", c("after").alias("next"), F.coalesce("far", "end").alias("end"), (c("rank") + F.coalesce("more", F.lit(0))).alias("rank")))
    return now.select("id", "end", "rank")


def segment_cells(flow: DataFrame, order: DataFrame) -> DataFrame:
    """(id, segment, rank, down, strahler_order) of stream cells: a segment ends before its order changes or streams meet.

    flow: (id, down) of all cells; order: (id, strahler_order) of stream cells, at least 1. segment is the id of its first cell, and
    rank counts its cells from the last one, which has 1. down is the next stream cell, in the segment or beyond it.
    """
    nodes = order.select("id", F.greatest("strahler_order", F.lit(1)).alias("strahler_order"))
    edges = flow.join(nodes, "id").join(nodes.select(c("id").alias("down"), c("strahler_order").alias("below")), "down")
    edges = saved(edges.select("id", "down", "strahler_order", "below"))
    many = upstream_counts(edges).select(c("id").alias("down"), "n_up")
    inside = edges.join(many, "down").where("below = strahler_order and n_up = 1").select("id", c("down").alias("next"))
    chains = saved(ranked(nodes.select("id").join(inside, "id", "left")))
    heads = chains.groupBy("end").agg(F.max_by("id", "rank").alias("segment"))
    return chains.join(heads, "end").join(nodes, "id").join(edges.select("id", "down"), "id", "left").select("id", "segment", "rank", "down", "strahler_order")


def stream_lines(cells: DataFrame, values: DataFrame, size: float) -> DataFrame:
    """(segment, strahler_order, points, length, acc, slope, outlet, next) of segments with two points or more.

    cells: as from ``segment_cells``; values: (id, acc, slope). points are struct(r, c) in order, with the junction's cell behind the segment's own; length
    goes up to it, but acc is the last own cell's and slope the mean of own cells. next is the segment one step
    past the outlet, null if that is no segment's.
    """
    cells = saved(cells)
    at = lambda k: F.struct(F.expr(f"{k} div {ROW}").alias("r"), F.expr(f"{k} % {ROW}").alias("c"))
    own = cells.join(values, "id")
    each = own.groupBy("segment").agg(
        F.max("strahler_order").alias("strahler_order"), F.array_sort(F.collect_list(F.struct((-c("rank")).alias("k"), at("id").alias("p")))).alias("own"),
        F.min_by(F.struct("id", "down", "acc"), "rank").alias("last"), F.avg("slope").alias("slope"),
    )
    way = F.transform("own", lambda p: p["p"])
    lines = each.withColumn("points", F.when(c("last.down").isNull(), way).otherwise(F.concat(way, F.array(at("last.down")))))
    steps = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), lambda a, b: F.sqrt(((a["r"] - b["r"]) * (a["r"] - b["r"]) + (a["c"] - b["c"]) * (a["c"] - b["c"])).cast("double")))
    lines = saved(lines.where("size(points) > 1").select("segment", "strahler_order", "points", (F.aggregate(steps, F.lit(0.0), lambda t, v: t + v) * size).alias("length"), c("last.acc").alias("acc"), "slope", c("last.id").alias("outlet"), c("last.down").alias("down")))
    there = cells.select(c("id").alias("down"), c("segment").alias("next")).join(lines.select(c("segment").alias("next")), "next", "left_semi")
    return lines.join(there, "down", "left").drop("down")


def painted(flow: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, segment) of every cell: the segment of the first cell of a line on its way down, null if there is none."""
    from rillflow.operators import forest

    labelled = cells.join(lines.select("segment"), "segment", "left_semi").select("id", "segment")
    marked = flow.select("id", "down").join(labelled.select("id", F.lit(True).alias("stop")), "id", "left").select("id", "down", F.coalesce("stop", F.lit(False)).alias("stop"))
    found = forest.first_downstream(marked)
    return found.join(labelled.select(c("id").alias("label"), "segment"), "label", "left").select("id", "segment")
