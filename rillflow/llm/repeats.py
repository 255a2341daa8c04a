"""Operator 6: exact removal of repeated passages, found by recompression.

Recompression rewrites a word sequence in rounds: a run of one word becomes one symbol,
then pairs (a, b) with a in the left half of the alphabet and b in the right half become
one symbol each. Symbols are named by 64-bit hashes of what they stand for, and halves are
picked by a hash of the symbol and the round, so every task gives the same name to the same
piece without a shared dictionary, and two equal passages get the same symbols inside.

Each symbol keeps its *context*: the words that its name and its place in the parse depend
on. A window of 50 words that holds the whole context of a symbol therefore has that symbol
wherever the window occurs. Every window is owned by the first symbol of the highest round
whose context it holds; at round 0 a single word's context is itself, so no window is left
without an owner. Equal windows have equal owners, hence

1. (owner, document) pairs are dealt by owner; owners of one document only are dropped;
2. documents with shared owners hash exactly the windows those own; (owner, document,
   window hashes) are dealt by owner, and a hash is a repeat in every document but the
   first that has it;
3. the repeats of each document go back to its text, where covered words are removed.

One document sends one row per owner however often it repeats a symbol, so a periodic
passage makes no hot group; a group is read as a stream in document order, and what is held
is one (hash, document) pair per distinct window of a group, not its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import slices, table
from rillflow.llm.words import mix, pair, windows, words

WIDTH = 50
ROUNDS = 9
#: Bytes of text that a task holds as arrays at once; a longer text is alone.
CHUNK = 1 << 20


def symbols(names: np.ndarray, doc: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, document, context start, context end) of each symbol, for rounds 0 to ``rounds``.

    Symbols whose context reaches beyond their document have a context start of -1.
    """
    n = len(names)
    at = np.arange(n)
    levels = [(names, doc, at, at + 1)]
    if not n:
        return levels
    # runs of one word, at the first round only: their context is the run and a word on each side
    head = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])])
    length = np.diff(np.r_[head, n])
    doc_of = doc[head]
    name = np.where(length > 1, pair(names[head], length.astype(np.uint64)), names[head])
    first, last = np.r_[True, doc_of[1:] != doc_of[:-1]], np.r_[doc_of[1:] != doc_of[:-1], True]
    low = np.where(first, -1, head - 1)
    high = np.where(last, -1, head + length + 1)
    low = np.where(high < 0, -1, low)
    levels.append((name, doc_of, low, high))
    for r in range(1, rounds):
        left = (mix(name + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(63)).astype(bool)
        same = doc_of[1:] == doc_of[:-1]
        joins = left[:-1] & ~left[1:] & same
        # a left symbol depends on its right neighbour, a right symbol on its left one
        k = len(name)
        near = np.where(left, np.arange(k) + 1, np.arange(k) - 1)
        inside = np.where(left, np.r_[same, False], np.r_[False, same])
        near = np.clip(near, 0, k - 1)
        bad = ~inside | (low < 0) | (low[near] < 0)
        new_low = np.where(bad, -1, np.minimum(low, low[near]))
        new_high = np.maximum(high, high[near])
        second = np.r_[False, joins]
        name = np.where(np.r_[joins, False], pair(name, np.r_[name[1:], np.uint64(0)]), name)[~second]
        doc_of, low, high = doc_of[~second], new_low[~second], new_high[~second]
        levels.append((name, doc_of, low, high))
    return levels


def owners(names: np.ndarray, doc: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, owner) of every window of ``width`` words that stays in one document."""
    n = len(names)
    starts = np.arange(max(0, n - width + 1))
    starts = starts[doc[starts] == doc[starts + width - 1]] if len(starts) else starts
    owner = np.zeros(len(starts), np.uint64)
    todo = np.arange(len(starts))
    levels = symbols(names, doc, rounds)
    for r in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        name, _, low, high = levels[r]
        fit = (low >= 0) & (high - low <= width)
        name, low, high = name[fit], low[fit], high[fit]
        if not len(name):
            continue
        first = np.searchsorted(low, starts[todo])
        safe = np.minimum(first, len(name) - 1)
        held = (first < len(name)) & (high[safe] <= starts[todo] + width)
        owner[todo[held]] = mix(name[safe[held]] + np.uint64(r + 1))
        todo = todo[~held]
    return starts, owner


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    texts = [t.encode() if t is not None else b"" for t in batch.column("text").to_pylist()]
    for part in slices([len(t) for t in texts], CHUNK):
        yield part, texts[part]


def _send_owners(width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part, texts in _texts(batch):
                names, doc = words(texts)
                starts, owner = owners(names, doc, width, rounds)
                of = doc[starts]
                order = np.lexsort((of, owner))
                owner, of = owner[order], of[order]
                once = np.r_[True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])][: len(owner)]
                owner, of = owner[once], of[once]
                yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(ids[part][of].astype(np.int64))], ["owner", "doc_id"])

    return run


def _shared_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by owner and document, those of owners with two documents or more."""
    last_owner, last_doc, sent = None, None, False
    for batch in batches:
        owner, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(owner):
            continue
        # the row before this batch is put in front, to be sent late if its owner goes on
        if last_owner is not None:
            owner, doc = np.r_[last_owner, owner], np.r_[last_doc, doc]
        new = np.r_[True, owner[1:] != owner[:-1]]
        group = np.cumsum(new) - 1
        differs = np.r_[False, ~new[1:] & (doc[1:] != doc[:-1])]
        many = np.bincount(group, differs) > 0
        if last_owner is not None and sent:
            many[0] = True
        keep = many[group]
        if last_owner is not None and sent:
            keep[0] = False
        sent = bool(many[group[-1]])
        last_owner, last_doc = owner[-1], doc[-1]
        repeat = np.r_[False, ~new[1:] & (doc[1:] == doc[:-1])]
        keep &= ~repeat
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(owner[keep])], ["doc_id", "owner"])


def _send_windows(width: int, rounds: int):
    """For each document with shared owners: (owner, document, hashes of the windows it owns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("owners")))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            listed = batch.column("owners")
            for part, texts in _texts(batch):
                names, doc = words(texts)
                starts, owner = owners(names, doc, width, rounds)
                of = doc[starts]
                wanted = listed.slice(part.start, part.stop - part.start)
                keys = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                key_doc = np.repeat(np.arange(len(wanted)), pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64))
                salt = lambda d: mix(d.astype(np.uint64) + np.uint64(77))
                keep = np.isin(owner ^ salt(of), keys ^ salt(key_doc))
                starts, owner, of = starts[keep], owner[keep], of[keep]
                hashes = windows(names, starts, width)
                order = np.lexsort((hashes, of, owner))
                owner, of, hashes = owner[order], of[order], hashes[order]
                fresh = np.r_[True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])][: len(owner)]
                once = fresh | np.r_[True, hashes[1:] != hashes[:-1]][: len(owner)]
                owner, of, hashes, fresh = owner[once], of[once], hashes[once], fresh[once]
                head = np.flatnonzero(fresh)
                offsets = np.r_[head, len(owner)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[head].view(np.int64)), pa.array(ids[part][of[head]].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))],
                    ["owner", "doc_id", "hashes"],
                )

    return run


def _find_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by owner and document: (document, hashes that a smaller document has)."""
    current, first = None, {}
    for batch in batches:
        docs, rows = [], []
        for owner, doc, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if owner != current:
                current, first = owner, {}
            again = [h for h in hashes if first.setdefault(h, doc) != doc]
            if again:
                docs.append(doc)
                rows.append(again)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "hashes"])


def _strip(width: int, extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("repeats")
            for part, texts in _texts(batch):
                here = listed.slice(part.start, part.stop - part.start)
                hit = [i for i, x in enumerate(pa.compute.is_valid(here).to_pylist()) if x]
                total = [len(t.split()) for t in texts]
                removed, kept = [0] * len(texts), [None] * len(texts)
                for group in slices([len(texts[i]) for i in hit], CHUNK):
                    some = hit[group]
                    names, doc = words([texts[i] for i in some])
                    starts = np.arange(max(0, len(names) - width + 1))
                    starts = starts[doc[starts] == doc[starts + width - 1]] if len(starts) else starts
                    picked = here.take(pa.array(some))
                    lists = [np.concatenate([np.asarray(y, np.int64) for y in x]) for x in picked.to_pylist()]
                    key = np.concatenate(lists).view(np.uint64)
                    key_doc = np.repeat(np.arange(len(some)), [len(x) for x in lists])
                    salt = lambda d: mix(d.astype(np.uint64) + np.uint64(77))
                    gone = starts[np.isin(windows(names, starts, width) ^ salt(doc[starts]), key ^ salt(key_doc))]
                    cover = np.zeros(len(names) + 1, np.int64)
                    np.add.at(cover, gone, 1)
                    np.add.at(cover, gone + width, -1)
                    covered = np.cumsum(cover[:-1]) > 0
                    bounds = np.searchsorted(doc, np.arange(len(some) + 1))
                    for j, i in enumerate(some):
                        mask = covered[bounds[j] : bounds[j + 1]]
                        removed[i] = int(mask.sum())
                        kept[i] = b" ".join(w for w, m in zip(texts[i].split(), mask.tolist(), strict=True) if not m)
                kept = [b" ".join(t.split()) if k is None else k for t, k in zip(texts, kept, strict=True)]
                columns = [batch.column("doc_id").slice(part.start, part.stop - part.start), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
                columns.append(pa.array([k.decode() if extra else hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return run


def strip_repeats(df: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of (doc_id, text) of ``df``.

    A word goes if a window of ``width`` words that covers it also starts in a document with
    a smaller doc_id; windows are judged on the input. ``kept`` is the words that stay,
    joined by one space, or with ``texts=False`` the SHA-256 of their UTF-8 in hex. A null
    or empty text has no words; a text of fewer than ``width`` words keeps all. A row without
    doc_id keeps its words and is no source for others. Rows that share a doc_id count as one
    document. Other columns are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.where("doc_id is not null and octet_length(text) >= 99").mapInArrow(_send_owners(width, rounds), "owner long, doc_id long")
    shared = sent.repartition("owner").sortWithinPartitions("owner", "doc_id").mapInArrow(_shared_owners, "doc_id long, owner long")
    wanted = shared.groupBy("doc_id").agg(F.collect_set("owner").alias("owners"))
    # both joins of the texts have the same left side, so it is shuffled once
    held = docs.join(wanted, "doc_id", "left").mapInArrow(_send_windows(width, rounds), "owner long, doc_id long, hashes array<long>")
    found = held.repartition("owner").sortWithinPartitions("owner", "doc_id").mapInArrow(_find_repeats, "doc_id long, hashes array<long>")
    repeats = found.groupBy("doc_id").agg(F.collect_list("hashes").alias("repeats"))
    return docs.join(repeats, "doc_id", "left").mapInArrow(_strip(width, texts), "doc_id long, n_words long, n_removed long, kept string")


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("kept", "kept_sha256")
