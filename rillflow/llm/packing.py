"""Operator 3: best-fit packing of documents into sequences, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import table

#: Characters of a sequence.
CAPACITY = 8192
#: Pieces that are packed together, about: what a task holds, whatever the input.
GROUP = 4096


def best_fit(sizes: list[int], sources: list[object], clusters: list[object], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in the bin) of each item, taken in the given order.

    An item goes to the bin with the least room that still takes it and that holds none of
    its source and none of its cluster; ties go to the older bin. Bins stand in the order of
    (room, number); from the first with room enough the search goes to the successor until a
    bin's bitmaps allow the item. A None source or cluster conflicts with nothing.
    """

    def bits(values: list[object]) -> list[int]:
        # what occurs once can't conflict and needs no bit
        often = [v for v, n in Counter(values).items() if n > 1 and v is not None]
        place = {v: 1 << i for i, v in enumerate(often)}
        return [place.get(v, 0) for v in values]

    order: list[tuple[int, int]] = []  # (room, bin), ascending
    held: list[list[int]] = []  # of each bin: source bitmap, cluster bitmap, items
    out = []
    for size, source, cluster in zip(sizes, bits(sources), bits(clusters), strict=True):
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & source or held[order[at][1]][1] & cluster):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(held)
            held.append([0, 0, 0])
        state = held[b]
        out.append((b, state[2]))
        held[b] = [state[0] | source, state[1] | cluster, state[2] + 1]
        insort(order, (room - size, b))
    return out


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="first")
        none = lambda s: [None if pd.isna(v) else v for v in s]
        placed = best_fit(pdf["size"].tolist(), none(pdf["source"]), none(pdf["cluster"]), capacity)
        pdf["bin_id"] = [(int(g) << 24) + b for g, (b, _) in zip(pdf["grp"], placed, strict=True)]
        pdf["slot"] = [s for _, s in placed]
        return pdf.drop(columns="grp")

    return run


def pack(df: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, start, size, source, cluster, bin_id, slot) for each piece of each row of (doc_id, text, source).

    Sizes are code points. A text longer than ``capacity`` is cut into pieces of that size and
    a rest; ``start`` is a piece's first code point, so nothing is lost. No bin holds two
    pieces of one source or one duplicate cluster: the column ``cluster``, or equal texts. A
    null source conflicts with nothing; null and empty texts are pieces of size 0 without a
    cluster. Pieces are dealt by a hash into groups of about ``group`` and each group is
    packed on its own, longest first, ties by doc_id, so a hot source or group of copies
    spreads over all groups. Rows that repeat both id and text share a group.
    """
    if not 0 < capacity:
        raise ValueError("capacity must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col(cluster).cast("string") if cluster else F.hex(F.xxhash64(text))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.char_length(text).cast("long").alias("chars"), F.when(F.char_length(text) > 0, key).alias("cluster"))
    pieces = F.greatest(F.ceil(F.col("chars") / capacity), F.lit(1)).cast("int")
    count = df.select(F.sum(F.greatest(F.ceil(F.char_length(text) / capacity), F.lit(1)))).first()[0] or 0
    groups = max(1, -(-int(count) // group))
    if groups > 1 << 38:
        raise ValueError("too many groups for a 64-bit bin_id")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("piece").cast("long") * capacity
    rows = rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("chars") - start, F.lit(capacity)).alias("size"), "source", "cluster", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)).alias("grp"))
    return rows.groupBy("grp").applyInPandas(_pack_group(capacity), "doc_id long, piece int, start long, size long, source string, cluster string, bin_id long, slot int")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
