"""Operator 2: nearest neighbours by inner product through multiprobe p-stable hashing.

Vectors are taken by ranges of their norm (a factor of 2 each), scaled to the unit ball by
the range's largest norm and given one more coordinate that puts them on its sphere, so that
in a range the largest inner product is the smallest distance. Each table hashes a
vector by ``floor((a.x + b) / w)`` for a few Gaussian directions a. A query visits its own
bucket and the buckets one step away in the order of estimated success (Lv et al., 2007):
least sum of squared distances to the boundaries that a step crosses. Whatever the buckets
hold is ranked by the exact inner product of the original vectors. Queries that find fewer
than k are compared with all vectors, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import cut, table

K = 20
#: Probes chosen on sf0.001, sf0.01 and sf0.1.
TABLES, HASHES, WIDTH, PROBES = 2, 8, 2.7, 300
SEED = 11
#: Slots of a bucket by which it is dealt to a task.
COARSE = 2
#: Vectors that one block holds, about; more of one key are dealt over blocks. Queries compared at once.
BLOCK, ASKS = 4096, 512


def _directions(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((tables, hashes, dim))
    return a, rng.uniform(0, width, (tables, hashes))


def _steps(hashes: int) -> np.ndarray:
    return np.array(list(itertools.product((-1, 0, 1), repeat=hashes)), np.int64)


def buckets(x: np.ndarray, a: np.ndarray, b: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(slots, place in the slot from 0 to 1) of unit vectors in one table."""
    at = (x @ a.T + b) / width
    slot = np.floor(at)
    return slot.astype(np.int64), at - slot


def probes(slot: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` buckets of each query in the order of estimated success: (query, probe, hash)."""
    steps = _steps(slot.shape[1])
    low, high = place**2, (1 - place) ** 2
    cost = (low @ (steps == -1).T) + (high @ (steps == 1).T)
    order = np.argsort(cost, axis=1, kind="stable")[:, :count]
    return slot[:, None, :] + steps[order]


def _key(table_no: int, slot: np.ndarray) -> np.ndarray:
    key = np.full(slot.shape[:-1], table_no + 1, np.int64)
    for h in range(slot.shape[-1]):
        key = key * 64 + np.clip(slot[..., h] + 32, 0, 63)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, without overflow of the squares."""
    most = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    return np.minimum(most * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1)), np.finfo(float).max)


def _range(norm: np.ndarray, largest: float) -> np.ndarray:
    """Number of the norm's range: 0 from the largest down to half of it, and so on."""
    return np.maximum(np.floor(np.log2(largest) - np.log2(norm)), 0).astype(np.int64)


def _pack(dim: int):
    """Keeps usable vectors, as the bytes of their doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, v in enumerate(batch.column("v").to_pylist()):
                if v is not None and len(v) == dim and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        keep.append(i)
                        rows.append(x.tobytes())
            norms = _norms(np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), dim))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(rows, pa.binary()), pa.array(norms)], ["id", "v", "norm"])

    return run


def _deal(dim: int, largest: float, ranges: list[int], tables: int, hashes: int, width: float, count: int, asks: bool):
    """(key, cells, id, v) of each vector in each table; a query's buckets of one key share a row.

    The key is the norm's range and the table with the first COARSE slots of a bucket: the buckets of a key lie
    together, so that a query meets few tasks and each task sends its best of all of them. A
    query asks in each of ``ranges``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _directions(dim + 1, tables, hashes, width)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            norm = _norms(x)
            if asks:
                x, of = np.c_[x / norm[:, None], np.zeros(len(x))], None
            else:
                of = _range(norm, largest)
                x = x / largest * 2.0 ** of[:, None]
                x = np.c_[x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))]
            for t in range(tables):
                slot, place = buckets(x, a[t], b[t], width)
                slot = probes(slot, place, count) if asks else slot[:, None, :]
                cell, key = _key(t, slot).ravel(), _key(t, slot[..., :COARSE]).ravel()
                row = np.repeat(np.arange(len(x)), slot.shape[1])
                order = np.lexsort((key, row))
                cell, key, row = cell[order], key[order], row[order]
                head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
                cells = pa.ListArray.from_arrays(pa.array(np.r_[head, len(row)].astype(np.int32)), pa.array(cell))
                at = pa.array(row[head])
                for r in ranges if asks else [of[row[head]]]:
                    yield pa.RecordBatch.from_arrays([pa.array(key[head] + (r << 20)), cells, batch.column("id").take(at), batch.column("v").take(at)], ["key", "cells", "id", "v"])

    return run


def top_rows(scores: np.ndarray, k: int, room: np.ndarray) -> np.ndarray:
    """Mask of the k largest finite scores of each row, and of what lies ``room`` or less below the k-th."""
    if scores.shape[1] <= k:
        return np.isfinite(scores)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    return np.isfinite(scores) & (scores >= kth - room[:, None])


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct partners of each query."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])][: len(q)]
    q, v, s = q[once], v[once], s[once]
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
    return q[rank < k], v[rank < k], s[rank < k]


def _rank(k: int):
    """Rows sorted by (key, part), vectors before queries: each query's k best of each block.

    Holds one block of vectors, some queries and the best so far.
    """

    def compare(block, ids: np.ndarray, x: np.ndarray, cells: pa.ListArray):
        cell, row = cells.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(cells.offsets.to_numpy()))
        names, sizes, block_ids, block_x, longest = block
        at = np.minimum(np.searchsorted(names, cell), len(names) - 1)
        met = names[at] == cell
        asked = np.zeros((len(ids), len(names)), bool)
        asked[row[met], at[met]] = True
        scores = x @ block_x.T
        scores[~np.repeat(asked, sizes, axis=1) | (ids[:, None] == block_ids[None, :])] = -np.inf
        # a product of matrices may differ in the last bits from block to block: near the k-th
        # all are kept, and scored one by one
        i, j = np.nonzero(top_rows(scores, k, 1e-12 * longest * _norms(x)))
        yield ids[i], block_ids[j], (x[i] * block_x[j]).sum(axis=1)

    def emit(found):
        return _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, block = None, [], None
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])])
            for a, z in zip(edge, np.r_[edge[1:], len(key)], strict=True):
                if group != (key[a], part[a]):
                    group, parts, block = (key[a], part[a]), [], None
                rows = batch.slice(a, z - a)
                ids, x = rows.column("id").to_numpy(), _matrix(rows.column("v"))
                if not asks[a]:
                    parts.append((rows.column("cells").flatten().to_numpy(), ids, x))
                    continue
                if not parts:
                    continue
                if block is None:
                    cell, all_ids, all_x = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.lexsort((all_ids, cell))
                    cell = cell[order]
                    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    block = cell[head], np.diff(np.r_[head, len(cell)]), all_ids[order], all_x[order], _norms(all_x).max()
                for i in range(0, len(ids), ASKS):
                    found = list(compare(block, ids[i : i + ASKS], x[i : i + ASKS], rows.column("cells").slice(i, ASKS)))
                    if found:
                        best.append(emit(found))
                        held += len(best[-1][0])
                if held > 1_000_000:
                    best = [emit(best)]
                    held = len(best[0][0])
                    if held > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best[0]], ["query_id", "vec_id", "score"])
                        best, held = [], 0
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in emit(best)], ["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, asks: DataFrame, k: int = K, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, count: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found, for (id, v) of ``asks`` against (id, v) of ``df``.

    Score: inner product of the original vectors in double precision; ties go to the smaller
    id. Vectors that are null, zero, of another length than most, or that hold a null or
    non-finite component take no part, nor do null ids. A query is no neighbour of its own id;
    rows that repeat an id count once, by their best. Of equal vectors the k + 1 smallest ids
    can be among the k nearest, so the others are left out before the search. Buckets of any
    size are compared whole, dealt over blocks of about BLOCK vectors. A query that finds fewer
    than k is compared with all vectors.
    """
    sizes = df.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 1
    pack = lambda x: x.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(_pack(dim), "id long, v binary, norm double")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    vectors, queries = cut(pack(df).distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")), cut(pack(asks).distinct())
    largest = vectors.agg(F.max("norm")).first()[0] or 1.0
    # a double's exponent has about two thousand values: a bound for the list
    ranges = sorted(r[0] for r in vectors.select(F.greatest(F.floor(F.log2(F.lit(largest)) - F.log2("norm")), F.lit(0)).alias("r")).distinct().collect())
    ranges = sorted({r + d for r in ranges for d in (-1, 0, 1) if r + d >= 0}) if len(ranges) > 1 else ranges  # logarithms may round apart
    deal = lambda x, asks: x.select("id", "v").mapInArrow(_deal(dim, largest, ranges, tables, hashes, width, count, asks), "key long, cells array<long>, id long, v binary")
    found = _ranked(deal(vectors, False), deal(queries, True), k)
    few = queries.join(found.groupBy("query_id").count(), F.col("id") == F.col("query_id"), "left").where(F.coalesce("count", F.lit(0)) < k).select("id", "v")
    few = cut(few)
    if not few.isEmpty():
        one = lambda x: x.select(F.lit(0).cast("long").alias("key"), F.array(F.lit(0).cast("long")).alias("cells"), "id", "v")
        found = found.join(F.broadcast(few.select("id").distinct()) if few.count() <= 100_000 else few.select("id").distinct(), F.col("query_id") == F.col("id"), "left_anti").union(_ranked(one(vectors), one(few), k))
    return found


def _ranked(index: DataFrame, ask: DataFrame, k: int) -> DataFrame:
    """The k best of what shares a cell, for (key, cells, id, v) of vectors and of queries."""
    # one row per key
    parts = cut(index.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    index = index.join(parts, "key").select("key", F.pmod(F.xxhash64("id", "v"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "cells", "id", "v")
    ask = ask.join(parts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "cells", "id", "v")
    found = index.union(ask).repartition("key", "part").sortWithinPartitions("key", "part", "asks").mapInArrow(_rank(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cut(once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(rows, rows.where("id % 20 = 0"))
