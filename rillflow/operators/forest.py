"""Drainage forests: every node has at most one downstream node.

All of it is pointer doubling: after round j each node knows its ancestor at distance 2^j, so
a forest of depth d takes about log2(d) joins, for all nodes or starts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.checkpoint import saved as cut


def pointers(edges: DataFrame) -> Iterator[DataFrame]:
    """(id, anc) at distances 1, 2, 4, ... of (id, down); ends when no ancestor is so far away.

    No path is longer than there are links: a pointer that goes further belongs to a cycle.
    """
    step = cut(edges.where("down is not null").select("id", F.col("down").alias("anc")))
    links, distance = step.count(), 1
    while not step.isEmpty():
        if distance > links:
            raise ValueError("the downstream links have a cycle")
        yield step
        distance *= 2
        ahead = step.select(F.col("id").alias("anc"), F.col("anc").alias("next"))
        step = cut(step.join(ahead, "anc").select("id", F.col("next").alias("anc")))


def resolve_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, down) of links whose downstream node exists; dangling links are dropped."""
    there = nodes.select(*keys, F.col("id").alias("down"))
    return nodes.where("down is not null").select(*keys, "id", "down").join(there, [*keys, "down"]).select(*keys, "id", "down")


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, steps): every node from which ``start`` is reached, the start included."""
    pairs = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("steps")))
    distance = 1
    for step in pointers(edges):
        # nodes at 2^j to 2^(j+1) - 1 steps: no pair is found twice
        more = step.join(pairs.withColumnRenamed("id", "anc"), "anc").select("start", "id", (F.col("steps") + distance).alias("steps"))
        pairs = cut(pairs.union(more))
        distance *= 2
    return pairs


def subtree(nodes: DataFrame, edges: DataFrame, aggs: dict[str, str]) -> DataFrame:
    """(id, columns of ``aggs``) over each node and all nodes upstream; aggs: column to sum, min or max."""
    sums = {"sum": F.sum, "min": F.min, "max": F.max}
    acc = cut(nodes.select("id", *aggs))
    for step in pointers(edges):
        # a node's value over 2^j levels joins that of its ancestor 2^j levels down
        moved = acc.join(step, "id").select(F.col("anc").alias("id"), *aggs)
        acc = cut(acc.union(moved).groupBy("id").agg(*(sums[how](c).alias(c) for c, how in aggs.items())))
    return acc


def upstream_counts(edges: DataFrame) -> DataFrame:
    return edges.where("down is not null").groupBy(F.col("down").alias("id")).agg(F.count("*").alias("n_up"))


def to_confluence(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id) upstream of each start up to the first confluences.

    A start is always expanded, a node that is found is always returned, and it is expanded
    further if it has at most one upstream neighbour.
    """
    many = upstream_counts(edges).where("n_up > 1").select(F.col("id").alias("down"))
    single = edges.where("down is not null").join(many, "down", "left_anti").select("id", "down")
    first = edges.join(starts.select(F.col("id").alias("down")), "down").select(F.col("down").alias("start"), "id")
    found = closure(single, first.select("id").distinct()).select(F.col("start").alias("via"), "id")
    beyond = first.withColumnRenamed("id", "via").join(found, "via").select("start", "id")
    return starts.select(F.col("id").alias("start"), "id").union(beyond)


def best_children(nodes: DataFrame, edges: DataFrame, order: list[Column]) -> DataFrame:
    """(id, down) of each node's main tributary: the largest by ``order``, ties to the smaller id."""
    ranked = edges.join(nodes, "id").withColumn("rank", F.row_number().over(Window.partitionBy("down").orderBy(*(c.desc() for c in order), F.col("id"))))
    return ranked.where("rank = 1").select("id", "down")


def strahler(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, strahler_order) of forests whose ``edges`` (id, down) link ``nodes``: order is over k where two tributaries of order k or more meet, and all the way down.

    Each round joins nodes with one upstream neighbour to it, gives the chains without any the round's number and goes on
    with the others, which are fewer than half: each of them has two or more upstream.
    """
    from rillflow.operators.streams import ranked

    edges = cut(edges.where("down is not null").select("id", "down"))
    at, order, found = cut(nodes.select("id", F.col("id").alias("node"))), 1, None
    nodes = at.select("id")
    while True:
        single = upstream_counts(edges).where("n_up = 1").select(F.col("id").alias("down"))
        inside = edges.join(single, "down").select("id", F.col("down").alias("next"))
        chains = cut(ranked(nodes.join(inside, "id", "left")).select("id", "end"))
        over = edges.join(inside, "id", "left_anti").join(chains.select(F.col("id").alias("down"), F.col("end").alias("to")), "down")
        edges = cut(over.select("id", F.col("to").alias("down")))
        onward = cut(edges.select(F.col("down").alias("end")).distinct())
        moved = cut(at.join(chains.withColumnRenamed("id", "node"), "node").join(onward.withColumn("on", F.lit(True)), "end", "left").select("id", F.col("end").alias("node"), F.coalesce("on", F.lit(False)).alias("on")))
        ends = moved.where("not `on`").select("id", F.lit(order).cast("long").alias("strahler_order"))
        found = ends if found is None else found.union(ends)
        if onward.isEmpty():
            return found
        at, nodes, order = moved.where("`on`").select("id", "node"), onward.select(F.col("end").alias("id")), order + 1
        edges = cut(edges.join(onward.withColumnRenamed("end", "id"), "id", "left_semi").select("id", "down"))


def first_downstream(nodes: DataFrame) -> DataFrame:
    """(id, label): the first node downstream, itself included, that has ``stop``; null if none."""
    here = cut(nodes.select("id", F.when(F.col("stop"), F.col("id")).otherwise(F.col("down")).alias("at"), "stop"))
    stops = here.where("stop").select(F.col("id").alias("at"), F.lit(True).alias("done"))
    move = here.where("not stop and `at` is not null").select("id", "at")
    found = here.where("stop").select("id", F.col("at").alias("label"))
    move = cut(move)
    # each round doubles what a pointer passes
    for _ in range(move.count().bit_length() + 2):
        if move.isEmpty():
            break
        landed = move.join(stops, "at", "left")
        found = cut(found.union(landed.where("done").select("id", F.col("at").alias("label"))))
        going = landed.where("done is null").select("id", "at")
        # what points at a node that has its label takes it, else jumps on
        jump = going.join(found.select(F.col("id").alias("at"), F.col("label").alias("got")), "at", "left").join(move.select(F.col("id").alias("at"), F.col("at").alias("next")), "at", "left")
        move = cut(jump.select("id", F.coalesce("got", "next").alias("at")).where("`at` is not null"))
    else:
        if not move.isEmpty():
            raise ValueError("the downstream links have a cycle")
    return nodes.select("id").join(found, "id", "left").select("id", "label")


def integrity(nodes: DataFrame, catchments: DataFrame) -> DataFrame:
    """Per threshold: nodes, nodes with upstream, outlets, distinct ids, segments without a catchment, and ok."""
    up = resolve_edges(nodes, ["threshold"]).select("threshold", F.col("down").alias("id"), F.lit(1).alias("up")).distinct()
    sums = nodes.join(up, ["threshold", "id"], "left").groupBy("threshold").agg(F.count("*").alias("nodes"), F.count("up").alias("with_upstream"), F.count_if(F.col("down").isNull()).alias("outlets"), F.count_distinct("id").alias("distinct_ids"))
    lost = without_catchment(nodes, catchments)
    return sums.join(lost, "threshold", "left").select("threshold", "nodes", "with_upstream", "outlets", "distinct_ids", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"), ((F.col("nodes") == F.col("distinct_ids")) & F.col("missing").isNull()).alias("ok"))


def without_catchment(segments: DataFrame, catchments: DataFrame) -> DataFrame:
    """(threshold, missing): segments with an id but no catchment."""
    lost = segments.where("id is not null").join(catchments, ["threshold", "id"], "left_anti")
    return lost.groupBy("threshold").agg(F.count("*").alias("missing"))


def choose_threshold(counts: DataFrame, limit: int = 500) -> DataFrame:
    """(id, threshold, n): the finest threshold with at most ``limit`` segments, else the coarsest."""
    w = Window.partitionBy("id").orderBy((F.col("n") > limit).cast("int"), F.when(F.col("n") > limit, -F.col("threshold")).otherwise(F.col("threshold")))
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("id", "threshold", "n")
