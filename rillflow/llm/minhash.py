"""Operator 13: near duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters the shingles over a circle of 2^32 places, a second one orders the circle.
Turned by one place after another, the second gives all coordinates of a signature: coordinate k of
a set is the least rank of its places moved on by k. Bands of coordinates are candidate keys; what
shares a key is united by verified links: each document with the first one it shares a key with, then the
firsts of what is still apart, then salted blocks that give only pairs whose sizes and sketches
leave room for the similarity. Keys whose documents are united already are closed, so that a
group of copies costs a tree and not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, table
from rillflow.llm.near import BLOCK, _chunks, _close, _light, _lists, _open, _rooted, _verified, parities, shingle_sets
from rillflow.llm.words import mix
from rillflow.operators.components import components

#: Words of a shingle and similarity of linked documents.
WIDTH, SIMILARITY = 3, 0.85
#: A pair of the similarity itself shares no band with a probability of (1 - 0.85^5)^32, 7e-9.
BANDS, ROWS = 32, 5


def _scatter(s: np.ndarray) -> np.ndarray:
    """The first permutation: 64-bit shingles to places."""
    return (mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _rank(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the circle of 2^32 places; changes its argument."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """``size`` coordinates of each set, none of which may be empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    place = _scatter(np.concatenate(sets))
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_rank(place + np.uint32(k)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands never share keys but by chance."""
    rows = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, r])
    return key


def _describe(width: int, bands: int, rows: int):
    """(doc_id, whole, n, keys, sketch) of (doc_id, whole, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, (texts,) in _chunks(batches, "text"):
            sets = shingle_sets(texts, width)
            keys, full = [np.zeros(0, np.uint64)] * len(sets), [i for i, s in enumerate(sets) if len(s)]
            if full:
                for i, k in zip(full, band_keys(signatures([sets[i] for i in full], bands * rows), bands), strict=True):
                    keys[i] = k
            columns = [given.column("doc_id"), given.column("whole"), pa.array([len(s) for s in sets], pa.int32()), _lists(keys), pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "n", "keys", "sketch"])

    return run


def linked(texts: DataFrame, known: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) between doc_ids, each verified: they connect what a chain of linked pairs with a common band connects.

    texts: (doc_id, text); known: (doc_id, n, keys, sketch).
    """
    every = known.select("doc_id", F.explode("keys").alias("key"))
    hubs = every.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
    first = every.join(cut(hubs), "key").groupBy("doc_id").agg(F.min("hub").alias("hub")).where("hub < doc_id")
    edges = _verified(texts, known, first.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), width, similarity)
    rooted = _rooted(every, _light(components(edges)))
    members = cut(rooted.join(_light(_open(rooted).select("key")), "key"))
    # of keys with the same members one will do
    each = [F.count("*").alias("size"), *(F.bit_xor(F.xxhash64("doc_id", F.lit(s))).alias(f"s{s}") for s in (1, 2))]
    kinds = _open(members, *each).groupBy("size", "s1", "s2").agg(F.min(F.struct("key", "low")).alias("m")).select("m.key", "size", "m.low")
    members = cut(members.join(_light(kinds), "key"))
    # of each root's members the first, with the first of the least root
    heads = members.groupBy("key", "low", "root").agg(F.min("doc_id").alias("doc_id"))
    stars = heads.where("root != low").join(heads.where("root = low").select("key", F.col("doc_id").alias("hub")), "key")
    stars = stars.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    edges = cut(edges.union(_verified(texts, known, stars, width, similarity)))
    # the rest: each two blocks of a key meet in one cell
    left = _rooted(members.where("size > 2").select("key", "doc_id"), _light(components(edges)))
    kinds = _light(_open(left, F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).drop("low"))
    left = left.join(kinds, "key").join(known.select("doc_id", "n", "sketch"), "doc_id").withColumn("place", F.lit(0))
    left = left.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = left.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "doc_id", "n", "place", "root", "sketch")
    rest = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_close(similarity), "a long, b long").distinct()
    return edges.union(_verified(texts, known, rest, width, similarity))


def minhash_components(df: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text) of ``df``.

    n_shingles counts the distinct ``width``-word shingles of the lower-cased text (A-Z), or is 1 for fewer
    words; component_id is the smallest doc_id that links reach, and kept tells the row that has it.
    Documents are linked if their shingle sets share ``similarity`` of their union. Null, empty and
    wordless texts have 0 shingles and no link. Equal texts are one before any comparison. Rows that
    share a doc_id are one document, whatever their texts, and each is a row of the result. Rows
    without doc_id are counted and link nothing: their component_id and kept are null.
    """
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("whole", F.unhex(F.md5("text")))
    all_rows = cut(texts.groupBy("doc_id", "whole").count())
    firsts = all_rows.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1").select("whole", "first")
    kinds = cut(all_rows.join(_light(firsts), "whole", "left").withColumn("first", F.coalesce("first", "doc_id")))
    # one row of each text; of a text without any doc_id, one for each row
    copies = _light(kinds.where("doc_id is null and first is not null or doc_id != first").select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("copy"), "whole"))
    once = texts.withColumn("copy", F.coalesce("doc_id", F.lit(-1 << 63))).join(copies, ["copy", "whole"], "left_anti").drop("copy")
    often = cut(all_rows.where("count > 1").select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("copy"), "whole"))
    if not often.isEmpty():
        marked = once.withColumn("copy", F.coalesce("doc_id", F.lit(-1 << 63)))
        one = marked.join(often, ["copy", "whole"], "left_semi").dropDuplicates(["copy", "whole"])
        once = marked.join(often, ["copy", "whole"], "left_anti").unionByName(one).drop("copy")
    known = cut(once.mapInArrow(_describe(width, bands, rows), "doc_id long, whole binary, n int, keys array<long>, sketch binary"))
    named = known.where("doc_id is not null")
    several = all_rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id")
    # a document's several texts are one group, but wordless texts connect nobody
    empty = named.where("n = 0").select("whole").distinct()
    own = kinds.join(_light(several), "doc_id", "left_semi").where("doc_id != first").join(empty, "whole", "left_anti").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    full = named.where("n > 0")
    edges = linked(once.where("doc_id is not null").select("doc_id", "text"), full.select("doc_id", "n", "keys", "sketch"), width, similarity)
    roots = components(reduce(DataFrame.union, [edges, own]))
    # written first: a plain join of two tables can be split where one text has many rows
    sizes = cut(known.select("whole", F.col("n").alias("n_shingles")).dropDuplicates(["whole"]))
    counted = kinds.join(sizes, "whole").join(roots, F.col("first") == F.col("node"), "left")
    led = counted.withColumn("leader", F.when(F.col("n_shingles") > 0, F.coalesce("root", "first")).otherwise(F.col("doc_id")))
    least = led.where("doc_id is not null").groupBy("doc_id").agg(F.min("leader").alias("component_id"))
    rows_of = led.join(least, "doc_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    return rows_of.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))
