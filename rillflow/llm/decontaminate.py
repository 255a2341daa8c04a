"""Operator 1: documents that hold benchmark items, by SimHash of item-sized windows.

All of it is DataFrame expressions. A window of an item's length whose weighted-shingle
similarity with the item is s shares 2 s / (1 + s) of the item's k shingles or more (s, if the
document is shorter), so every start is laid whose window holds that many positions with one
of the item's shingles; this loses no window and spares fingerprints of all others. A window's
fingerprint is compared through a multi-index: its 64 bits are cut into RADIUS + 1 blocks,
two fingerprints within RADIUS bits agree in one block at least, so a join on (item, block
number, block) finds all of them. A window meets only the item it was laid for: 64 bits cut
into 20 blocks are 3 or 4 bits each, which alone would pair most windows with most items of a
length. Every pair within the radius is then verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, table

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Item shingles that may be broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"
_LANES = 0x0000000100000001


def words(text: str) -> Column:
    """Lower-cased words of a text column, none for null."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), SPACE), lambda w: w != "")


def shingles(w: Column, width: Column | int) -> Column:
    """64-bit hashes of each run of ``width`` words; of the whole sequence if there are fewer."""
    size = width if isinstance(width, Column) else F.lit(width)
    last = F.greatest(F.size(w) - size + 1, F.lit(1))
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<long>"))


def fingerprint(hashes: Column) -> Column:
    """Bit b is 1 if over half the hashes have it. Counts of two bits share a long."""
    half = F.size(hashes)
    fp = F.lit(0).cast("long")

    def summed(shift: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(_LANES)))

    for shift in range(32):
        lanes = summed(shift)
        for lane in range(2):
            count = F.shiftrightunsigned(lanes, 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            fp = fp.bitwiseOR(F.when(count * 2 > half, F.shiftleft(F.lit(1).cast("long"), shift + 32 * lane)).otherwise(F.lit(0).cast("long")))
    return fp


def blocks(fp: Column, radius: int) -> Column:
    """(number, bits) of each of radius + 1 blocks of a fingerprint."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.array(*parts)


def _weighed(hashes: Column) -> Column:
    """The same naming on both sides: the n-th occurrence of x is (x, n)."""
    ordered = F.array_sort(hashes)
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, F.transform(ordered, lambda x, i: F.xxhash64(x, i.cast("long") + 1 - F.array_position(ordered, x)))).otherwise(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(0).cast("long"))))


def _starts(at: Column, k: Column, needed: Column, room: Column) -> Column:
    """Starts up to ``room`` whose window of k shingles holds ``needed`` or more of the ascending positions ``at``.

    The i-th position is the first in the windows that start after the one before it.
    """

    def of(i: Column) -> Column:
        low = F.greatest(F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.get(at, i + needed - 1) - k + 1)
        high = F.least(F.get(at, i), room)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - needed), of))
    return F.when(F.size(at) >= needed, every).otherwise(F.array().cast("array<int>"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, hamming): the best window of each document for each item it holds.

    Words are lower-cased runs without white space; ``start`` counts words from 0. Similarity:
    sum of the smaller over sum of the larger counts of five-word shingles (of the whole
    sequence in an item of fewer words), ``similarity`` or more. Documents shorter than an item
    are one window. Null and empty texts hold nothing, items without words are held by none;
    rows without an id take no part. Ties go to the first window. Rows that share a doc_id or
    item_id are judged one by one and give one row together.
    """
    items = benchmark.where("item_id is not null").select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), shingles(F.col("w"), SHINGLE).alias("s"))
    items = cut(items.withColumn("fp", fingerprint(F.col("s"))))
    probe = items.select("width", "n", "item_id", F.size("s").alias("k"), F.explode(F.array_distinct("s")).alias("h"))
    few = probe.count() <= BROADCAST_ROWS
    probe = F.broadcast(probe) if few else probe
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # SHINGLE values at most
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    hits = None
    for width in widths or [SHINGLE]:
        own = texts.withColumn("w", words("text")).where(F.size("w") >= width)
        each = own.select("doc_id", F.posexplode(shingles(F.col("w"), width)).alias("at", "h"))
        found = each.join(probe.where(F.col("width") == width), "h").select("doc_id", "item_id", "n", "k", "at")
        hits = found if hits is None else hits.union(found)
    held = hits.groupBy("doc_id", "item_id", "n", "k").agg(F.array_sort(F.collect_set("at")).alias("at"))
    held = held.where(F.size("at") >= F.col("k") * similarity - 1e-9)
    asked = held.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "n", "k", "at")).alias("asked"))
    laid = texts.join(asked, "doc_id").select("doc_id", words("text").alias("w"), F.explode("asked").alias("a"))
    laid = laid.select("doc_id", "w", "a.item_id", "a.n", "a.k", "a.at")
    share = F.when(F.size("w") < F.col("n"), F.lit(similarity)).otherwise(F.lit(2 * similarity / (1 + similarity)))
    needed = F.greatest(F.ceil(share * F.col("k") - 1e-9).cast("int"), F.lit(1))
    starts = _starts(F.col("at"), F.col("k"), needed, F.greatest(F.size("w") - F.col("n"), F.lit(0)))
    laid = laid.select("doc_id", "item_id", "w", "n", F.explode(starts).alias("start")).select("doc_id", "item_id", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
    laid = laid.select("doc_id", "item_id", "n", "start", shingles(F.col("w"), SHINGLE).alias("s")).dropDuplicates(["doc_id", "item_id", "n", "start", "s"])
    windows = laid.withColumn("fp", fingerprint(F.col("s"))).select("doc_id", "item_id", "n", "start", "s", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    index = items.select(F.col("item_id").alias("item"), F.col("n").alias("item_n"), F.col("s").alias("item_s"), F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("item_b"))
    near = windows.join(index, (F.col("item_id") == F.col("item")) & (F.col("n") == F.col("item_n")) & (F.col("b.number") == F.col("item_b.number")) & (F.col("b.bits") == F.col("item_b.bits")))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # of the blocks that agree, the first stands for the pair
    first = F.array_position(F.zip_with(blocks(F.col("fp"), radius), blocks(F.col("item_fp"), radius), lambda x, y: x == y), True) - 1
    near = near.withColumn("hamming", distance).where((F.col("hamming") <= radius) & (F.col("b.number") == first))
    both = F.size(F.array_intersect(_weighed(F.col("s")), _weighed(F.col("item_s"))))
    scored = near.withColumn("both", both).withColumn("similarity", F.col("both") / (F.size("s") + F.size("item_s") - F.col("both")))
    best = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n", "hamming")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.back")).alias("start"), F.col("m.n").alias("n_words"), "m.similarity", F.col("m.hamming"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
