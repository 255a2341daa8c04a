"""Near duplicates of operator 8: SimHash links first, then an exact way for what they leave open.

1. Equal texts are one.
2. Fingerprints of five-word shingles are linked within a few bits by the pigeonhole search,
   and linked texts are compared. This unites most copies for 8 bytes a text.
3. A fingerprint can miss alike texts, so prefix keys find the rest without loss: sets alike by
   s share one of the first (1 - s) n + 1 of their shingles in any one order of all shingles. Keys
   whose texts are united already are closed; in an open key the components' first texts
   are compared with the least of them, and what still stays apart is compared in salted
   blocks, which give only the pairs whose sketches, sizes and places leave room for alike texts.

A pair is tested by sketches of the sets first, which bound the similarity from above, and
then judged by the Jaccard similarity of the whole sets, made from both texts. Keys are counted
and reduced by aggregates that combine before the shuffle, and texts go only where a pair asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, slices
from rillflow.llm.simhash import RADIUS, fingerprints, links
from rillflow.llm.words import windows, words
from rillflow.operators.components import components

#: Words of a shingle and similarity of texts that are near duplicates.
WIDTH, SIMILARITY = 5, 0.8
#: Texts looked at for shingles that many share, times seen there to count as such, and how many are named at most.
FREQUENT_TEXTS, FREQUENT_SEEN, FREQUENT = 20_000, 3, 200_000
#: Rows of one or two longs that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Members of one block of a key; two blocks are compared at once.
BLOCK = 512
#: Bytes of text that a task holds as arrays at once; a longer text is alone.
CHUNK = 1 << 20


def _light(rows: DataFrame) -> DataFrame:
    """``rows``, written down, as a broadcast if they are few enough."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Hashes of each text's runs of ``width`` words, repeats included; of the whole sequence if it has fewer."""
    names, of = words([t.lower() for t in texts])
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    starts = np.arange(max(0, len(names) - width + 1))
    starts = starts[of[starts] == of[starts + width - 1]] if len(starts) else starts
    hashes, owner = [windows(names, starts, width)], [of[starts]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            hashes.append(windows(names, first[short], k))
            owner.append(short)
    h, who = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return np.split(h[order], np.searchsorted(who[order], np.arange(1, len(texts))))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    return [np.unique(h) for h in shingles(texts, width)]


def parities(s: np.ndarray) -> bytes:
    """A bit for each of 2^k classes of hashes, at least as many as there are hashes: whether their number is odd.

    Sets that differ in d hashes have sketches that differ in d bits or fewer.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Hashes in which the sets of two sketches differ at least; the longer sketch is folded to the shorter one."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return int(np.bitwise_count(p ^ q).sum())


def _chunks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with the UTF-8 of their text columns."""
    for batch in batches:
        texts = [[(t or "").encode() for t in batch.column(c).to_pylist()] for c in columns]
        sizes = [sum(map(len, row)) for row in zip(*texts, strict=True)]
        for part in slices(sizes, CHUNK):
            yield batch.slice(part.start, part.stop - part.start), [t[part] for t in texts]


def _each_shingle(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (texts,) in _chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts, width)).view(np.int64))], ["h"])

    return run


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, times seen) of what many texts share, by shingle, in a hashed share of the texts.

    Which shingles are named moves cost only: any one order of all shingles loses no pair.
    """
    room = 1 << 30
    share = min(1.0, FREQUENT_TEXTS / max(1, texts.count()))
    seen = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(room)) < int(room * share) + 1).mapInArrow(_each_shingle(width), "h long")
    top = seen.groupBy("h").count().where(F.col("count") >= FREQUENT_SEEN).orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    names = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], top.column("count").to_numpy()[order]


def _prefix(s: np.ndarray, names: np.ndarray, seen: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set: those not named first, then by the times seen."""
    if not len(s):
        return np.zeros(1, np.uint64)  # no word at all: one key for all of them
    take = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
    if len(names):
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        s = s[np.lexsort((s, np.where(names[at] == s, seen[at], 0)))]
    return s[:take]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def _describe(width: int, similarity: float, frequent):
    """(doc_id, fp, n, keys, sketch): fingerprint, size of the shingle set, its first shingles, rare ones first, and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = frequent.value
        for rows, (texts,) in _chunks(batches, "text"):
            every = shingles(texts, width)
            sets = [np.unique(h) for h in every]
            keys = _lists([_prefix(s, names, seen, similarity) for s in sets])
            columns = [rows.column("doc_id"), pa.array(fingerprints(every).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), keys, pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n", "keys", "sketch"])

    return run


def _maybe(similarity: float):
    """Pairs whose sizes and sketches leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy().astype(np.int64), batch.column("m").to_numpy().astype(np.int64)
            apart = np.array([least_difference(x, y) for x, y in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True)], np.int64)
            # of n + m hashes 2 i are in both sets, and i is similarity x the union or more
            keep = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (apart * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _alike(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (left, right) in _chunks(batches, "x", "y"):
            # rows of one left text mostly follow each other: its set is made once
            a = rows.column("a").to_numpy()
            new = np.r_[True, a[1:] != a[:-1]]
            heads, at = np.flatnonzero(new), np.cumsum(new) - 1
            sets = shingle_sets([left[i] for i in heads] + right, width)
            keep = []
            for i, q in enumerate(sets[len(heads) :]):
                p = sets[at[i]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(texts: DataFrame, known: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts are alike: by their sketches in ``known`` first, then by the texts.

    Each b's sketch, and its text if it comes to that, goes to its a.
    """
    right = known.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("q")).join(_light(pairs), "b")
    left = known.select(F.col("doc_id").alias("a"), "n", F.col("sketch").alias("p"))
    pairs = cut(right.join(left, "a").select("a", "b", "n", "m", "p", "q").mapInArrow(_maybe(similarity), "a long, b long"))
    asked = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
    right = texts.join(asked, texts.doc_id == asked.b).select("a", "b", F.col("text").alias("y"))
    left = texts.join(_light(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    return cut(right.join(left, "a").select("a", "b", "x", "y").mapInArrow(_alike(width, similarity), "a long, b long"))


def _linked(known: DataFrame, radius: int) -> DataFrame:
    """(a, b) of texts whose fingerprints are equal or linked: trees, never all pairs of a group."""
    firsts = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first")))
    same = known.select("doc_id", "fp").join(_light(firsts), "fp").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    at = lambda end: firsts.select(F.col("fp").alias(end), F.col("first").alias(f"at_{end}"))
    near = links(firsts.select("fp"), radius).join(at("a"), "a").join(at("b"), "b")
    return same.union(near.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b")).distinct())


def close_pairs(n: np.ndarray, place: np.ndarray, root: np.ndarray, side: np.ndarray, whole: bool, sketches: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one cell, of different roots and, unless ``whole``, of different sides, that may be alike.

    Sets of n shingles share the one at ``place`` of one order: their sizes, places and sketches
    must leave room for the similarity.
    """
    size = np.array([len(x) // 8 for x in sketches])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.unique(size):
        x = np.flatnonzero(size == w)
        p = np.frombuffer(b"".join(sketches[i] for i in x), np.uint64).reshape(len(x), w)
        for y in (x, np.flatnonzero(size == 2 * w)):  # longer sketches are of sets too large for these
            if not len(y):
                continue
            q = p if y is x else np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches[i] for i in y), np.uint64).reshape(len(y), 2, w), axis=1)
            step = max(1, (1 << 20) // (len(y) * int(w)))
            for at in range(0, len(x), step):
                i, j = x[at : at + step, None], y[None, :]
                most = (1 - similarity) * (n[i] + n[j]) + 1e-6
                ok = np.bitwise_count(p[at : at + step, None, :] ^ q[None, :, :]).sum(axis=2) * (1 + similarity) <= most
                ok &= (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                room = np.minimum(place[i], place[j]) + 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1)
                ok &= room * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-9
                if not whole:
                    ok &= side[i] != side[j]
                if y is x:
                    ok &= i < j
                r, c = np.nonzero(ok)
                found.append((x[at + r], y[c]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def _close(similarity: float):
    """Rows sorted by (key, low, high) to pairs (a, b): holds one cell, two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in _then_none(batches):
            if batch is not None:
                rest = pa.concat_batches([rest, batch]) if rest is not None else batch
                if rest.num_rows < 20_000:
                    continue
            if rest is None or not rest.num_rows:
                continue
            key, low, high = (rest.column(c).to_numpy() for c in ("key", "low", "high"))
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), True])
            if batch is not None:
                edge = edge[:-1]  # the last cell may go on
            doc, n, place, root, side = (rest.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "n", "place", "root", "side"))
            sketches = rest.column("sketch").to_pylist()
            pairs = [np.zeros((2, 0), np.int64)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s > 1 and (root[s:e] != root[s]).any():
                    i, j = close_pairs(n[s:e], place[s:e], root[s:e], side[s:e], low[s] == high[s], sketches[s:e], similarity)
                    x, y = doc[s:e][i], doc[s:e][j]
                    pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            every = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(every[0]), pa.array(every[1])], ["a", "b"])
            rest = rest.slice(edge[-1])

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of their doc_id, itself where it has none."""
    return rows.join(roots, F.col("doc_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc_id")).drop("node")


def _open(members: DataFrame, *more) -> DataFrame:
    """Keys whose members have several roots, with aggregates ``more``."""
    return members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *more).where("low < high").drop("high")


def alike_edges(texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between doc_ids of (doc_id, text), each alike by ``similarity``: they connect
    exactly what a chain of alike texts connects."""
    sc = texts.sparkSession.sparkContext
    described = texts.mapInArrow(_describe(width, similarity, sc.broadcast(_frequent(texts, width))), "doc_id long, fp long, n int, keys array<long>, sketch binary")
    known = cut(described)
    edges = _verified(texts, known, _linked(known, radius), width, similarity)
    keys = _rooted(known.select("doc_id", "n", "keys"), _light(components(edges))).select("doc_id", "n", "root", F.posexplode("keys").alias("place", "key"))
    members = cut(keys.join(_light(_open(keys).select("key")), "key"))
    # of keys with the same members one will do
    each = [F.count("*").alias("size"), *(F.bit_xor(F.xxhash64("doc_id", F.lit(s))).alias(f"s{s}") for s in (1, 2))]
    kinds = _open(members, *each).groupBy("size", "s1", "s2").agg(F.min(F.struct("key", "low")).alias("m")).select("m.key", "size", "m.low")
    members = cut(members.join(_light(kinds), "key"))
    # stars: of each root's members the first, with the first of the least root
    heads = members.groupBy("key", "low", "root").agg(F.min("doc_id").alias("doc_id"))
    stars = heads.where("root != low").join(heads.where("root = low").select("key", F.col("doc_id").alias("hub")), "key")
    stars = stars.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = cut(edges.union(_verified(texts, known, stars, width, similarity)))
    # the rest: each two blocks of a key meet in one cell
    left = _rooted(members.where("size > 2").select("key", "doc_id", "n", "place"), _light(components(edges)))
    kinds = _light(_open(left, F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).drop("low"))
    left = left.join(kinds, "key").join(known.select("doc_id", "sketch"), "doc_id")
    left = left.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = left.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "doc_id", "n", "place", "root", "sketch")
    rest = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_close(similarity), "a long, b long").distinct()
    return edges.union(_verified(texts, known, rest, width, similarity))


def near_duplicates(df: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, leader) for each doc_id of (doc_id, text) that repeats another: drop these.

    Documents are alike if they share ``similarity`` of the ``width``-word shingle set (Jaccard).
    A group is what chains of alike documents connect, and its leader is its smallest doc_id.
    Equal texts are one before any comparison. Null doc_ids repeat nothing and are repeated by
    none; null and empty texts repeat each other. Rows that share a doc_id are one document.
    """
    texts = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("whole", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = cut(texts.select("doc_id", "whole").distinct())
    firsts = rows.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1").select("whole", "first")
    kinds = cut(rows.join(_light(firsts), "whole", "left").withColumn("first", F.coalesce("first", "doc_id")))
    copies = _light(kinds.where("doc_id != first").select("doc_id", "whole"))
    once = texts.join(copies, ["doc_id", "whole"], "left_anti").select("doc_id", "text")
    # a document's several texts are one group, too
    several = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = kinds.join(_light(several), "doc_id", "left_semi").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    roots = components(reduce(DataFrame.union, [alike_edges(once, width, similarity, radius), own]))
    led = kinds.join(roots, F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("root", "first").alias("leader"))
    return led.groupBy("doc_id").agg(F.min("leader").alias("leader")).where("doc_id != leader")
