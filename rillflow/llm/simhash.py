"""Operator 8: SimHash fingerprints linked by a generalised pigeonhole search.

Fingerprints within ``radius`` bits: the bits are cut into m parts, part i gets a threshold
t_i of -1 or more, and the thresholds sum to radius - m + 1. Two fingerprints within the
radius then lie within t_i in at least one part (a part with -1 is not probed). Correlated
bits go to the same part, so that parts are as independent as they can be, and m and the
thresholds are the cheapest by dynamic programming over the candidates that a sample
predicts for each (part, threshold). Any choice finds all links; the sample moves cost only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_sample, cut, slices, table
from rillflow.operators.components import components
from rillflow.llm.words import mix

WIDTH, RADIUS, SEED = 3, 3, 42
#: Fingerprints that the driver reads to plan the parts: a fixed bound.
SAMPLE = 20_000
CHUNK = 1 << 21
_LANES = np.uint64(0x0001000100010001)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, joined by one space.

    A-Z are lower-cased. A text of fewer words gives its whole sequence, one without words nothing.
    """
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = (ends - np.fromiter(map(len, w), np.int64, len(w)) - 1).tolist()
    digest, ends = xxhash.xxh64_intdigest, (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """Bit b of a fingerprint is 1 if over half the hashes of its array have it; zero for none."""
    step = 1 << 15  # below the 16 bits of a lane
    pieces = [h[i : i + step] for h in hashes for i in range(0, len(h), step)]
    owner = np.array([k for k, h in enumerate(hashes) for _ in range(0, len(h), step)], np.int64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    if pieces:
        flat = np.concatenate(pieces)
        heads = np.cumsum([0, *map(len, pieces)])[:-1]
        for shift in range(16):
            lanes = np.add.reduceat((flat >> np.uint64(shift)) & _LANES, heads)
            for lane in range(4):
                np.add.at(counts[:, shift + 16 * lane], owner, ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    bits = counts * 2 > sizes[:, None]
    return np.bitwise_or.reduce(np.where(bits, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)), axis=1) if len(hashes) else np.zeros(0, np.uint64)


def _print_texts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if t is not None else b"" for t in batch.column("text").to_pylist()]
            for part in slices([len(t) for t in texts], CHUNK):
                prints = fingerprints([shingle_hashes(t, width) for t in texts[part]])
                whole = np.array([xxhash.xxh3_64_intdigest(t) for t in texts[part]], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, part.stop - part.start), pa.array(prints.view(np.int64)), pa.array(whole.view(np.int64))], ["doc_id", "fp", "whole"])

    return run


def simhash(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, whole) for each row of (doc_id, text): its fingerprint, zero without words, and a hash of the text as it is."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_print_texts(width), "doc_id long, fp long, whole long")


def bit_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m parts; each part grows by the bit that correlates most with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        close = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(sample) > 1 else np.eye(64)
    free, parts = list(range(64)), []
    for k in range(m):
        room = (len(free) + m - k - 1) // (m - k)
        part = [max(free, key=lambda b: (close[b][free].sum(), -b))]
        free.remove(part[0])
        while len(part) < room:
            part.append(max(free, key=lambda b: (close[b][part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def part_values(prints: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.uint64)
    for place, bit in enumerate(part):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def plan(sample: np.ndarray, total: int, radius: int) -> list[tuple[list[int], int]]:
    """The cheapest [(bits of a part, its threshold)], parts with -1 left out."""
    best = None
    for m in range(1 if radius == 0 else 2, radius + 2):
        parts = bit_parts(sample, m)
        cost = []
        for part in parts:
            v = part_values(sample, part)
            q = v[: min(len(v), 200)]
            near = np.zeros(65)
            for row in q:
                near += np.bincount(np.bitwise_count(v ^ row), minlength=65)[:65]
            within = np.cumsum(near / max(1, len(q) * len(v)))
            balls = np.cumsum([len(list(itertools.combinations(range(len(part)), k))) if k <= 3 else 1e12 for k in range(radius + 2)])
            # a row dealt out costs about as much as comparing a hundred candidates
            cost.append([0.0] + [balls[t] / 2 + 1 + 0.01 * total * within[min(t, 64)] for t in range(radius + 1)])
        # state: sum of (t + 1) so far -> (cost, thresholds)
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (paid, chosen) in states.items():
                for t in range(-1, radius + 1):
                    now = used + t + 1
                    if now <= radius + 1 and (now not in step or paid + c[t + 1] < step[now][0]):
                        step[now] = (paid + c[t + 1], (*chosen, t))
            states = step
        paid, chosen = states[radius + 1]  # sum of t is then radius - m + 1
        if best is None or paid < best[0]:
            best = (paid, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def _masks(part: list[int], t: int) -> list[tuple[int, int]]:
    """(mask, its lowest bit) of every change of 1 to t bits of a part."""
    return [(sum(1 << b for b in bits), 1 << min(bits)) for k in range(1, t + 1) for bits in itertools.combinations(range(len(part)), k)]


def _deal(parts: list[tuple[list[int], int]]):
    """A fingerprint's own key in each part, and the keys of the values near it.

    Of two fingerprints that differ in a mask, the one with 0 at the mask's lowest bit probes
    the other's own key, so half the probes do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (part, t) in enumerate(parts):
                v = part_values(prints, part)
                tag = mix(np.array([i + 1], np.uint64))[0]
                keys, who = [v], [prints]
                for mask, low in _masks(part, t):
                    ask = (v & np.uint64(low)) == 0
                    keys.append(v[ask] ^ np.uint64(mask))
                    who.append(prints[ask])
                key = mix(np.concatenate(keys) ^ tag)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(who).view(np.int64))], ["key", "fp"])

    return run


def link_group(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever lies within the radius in one group: a tree, not all pairs.

    Breadth-first from each print not yet reached; each print is compared once with those
    still unreached, so memory is linear.
    """
    left = np.unique(prints)
    a, b = [], []
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            here = front.pop()
            near = np.bitwise_count(left ^ here) <= radius
            if near.any():
                got = left[near]
                left = left[~near]
                a.append(np.full(len(got), here))
                b.append(got)
                front.extend(got)
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


#: Groups up to this size are compared all at once, shifted against themselves.
_SMALL = 48


def _link(radius: int):
    def small(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for shift in range(1, _SMALL):
            if len(key) <= shift:
                return
            same = np.flatnonzero(key[shift:] == key[:-shift])
            if not len(same):
                return
            x, y = fp[same], fp[same + shift]
            near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
            yield x[near], y[near]

    def flush(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        in_small = np.repeat((size > 1) & (size <= _SMALL), size)
        found = list(small(key[in_small], fp[in_small]))
        found += [link_group(fp[edge[g] : edge[g + 1]], radius) for g in np.flatnonzero(size > _SMALL)]
        if found:
            x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            once = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(x[once].view(np.int64)), pa.array(y[once].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, rows = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows >= 1 << 17:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                done = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if done:
                    yield from flush(key[:done], fp[:done])
                keys, fps, rows = [key[done:]], [fp[done:]], len(key) - done
        if rows:
            yield from flush(np.concatenate(keys), np.concatenate(fps))

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: they connect exactly what a chain
    of links of ``radius`` bits or fewer connects. Groups give trees, never all their pairs."""
    total = prints.count()
    sample = np.array([r[0] for r in bounded_sample(prints, ["fp"], SAMPLE).collect()], np.int64).view(np.uint64)
    dealt = prints.mapInArrow(_deal(plan(sample, total, radius)), "key long, fp long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_link(radius), "a long, b long")


def simhash_components(df: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of (doc_id, text) of ``df``.

    component_id is the smallest doc_id that links of ``radius`` bits or fewer reach, the
    row's own included. Null and empty texts have fingerprint zero, linked like any other.
    Rows without doc_id keep a fingerprint and link others, and get the component's smallest
    doc_id. Copies meet as one fingerprint before any comparison.
    """
    rows = cut(simhash(df, width).select("doc_id", "fp"))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints.select("fp"), radius))
    classes = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = cut(classes.join(smallest, "root").select("fp", "component_id"))
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
