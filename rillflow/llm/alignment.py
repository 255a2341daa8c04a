"""Operator 11: cross-tokenizer alignment, relationally.

Two tokenizers cut the same bytes. Where tokens of both end together the text falls into groups, and
each pair of tokens whose byte ranges overlap is a link. Everything but the tokenizers' own calls is
DataFrame work: posexplode gives tokens, windowed cumulative lengths give their ends, tokens of both sides
with one end meet (the full outer equi-join on text and end, written as one aggregation, since
an end occurs once a side), running counts of the shared ends number the groups, and
each stretch between two neighbouring ends of either side is one link, of the tokens that cover it,
which a window fills in: the range join without its pairs.

The relation's unit is a stretch of text rather than a document. Where a letter or digit meets a sign or a space
both tokenizers end a token, if their rules say so (``separable`` reads them), and what follows is tokenized as if the
text began there; so a stretch between two such places has the same tokens wherever it stands. Each distinct
stretch is aligned once, weighed by its occurrences, and the documents join the results of their stretches: frequent ones, a
bounded number, by a broadcast, the others by a shuffle. Texts are read twice: for the counts of their stretches, and to
become numbers of frequent stretches, which is what moves. For other tokenizers a stretch is a whole text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.checkpoint import forget, saved
from rillflow.llm.common import cut, slices, table
from rillflow.llm.near import BROADCAST_ROWS, _light

#: Tokenizer files, read on the driver: a byte-level BPE and a piece model.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: What is broadcast has this size at most, each.
MODEL_BYTES = 64 << 20
#: Stretches whose results are broadcast, at most; the others are joined by a shuffle.
FREQUENT = 700_000
#: Added to the ids of the second tokenizer.
SIDE = 1 << 30
#: Bytes of text encoded at once.
CHUNK = 1 << 20
#: Bytes of text whose stretches are counted or looked up at once.
TEXTS = 32 << 20
#: Stretches of texts that become figures at once, one that is not frequent enough for a short number counts twice.
WORDS = 500_000
#: Texts are cut into stretches between a character of the first categories and one of the second, and after a line
#: end between one of the third and one of the fourth.
_CUT = ("L Nd", "P S Z Cc", "L M N P S", "L N P S")
#: Set before a stretch so that B encodes it as inside a text: no piece holds a line end.
_LEAD = "\n"


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def byte_tokenizer(raw: bytes) -> tuple[Tokenizer, dict[int, bytes]]:
    """The tokenizer and the bytes of each of its ids."""
    t = Tokenizer.from_str(raw.decode())
    t.encode_special_tokens = True
    of = _byte_of()
    return t, {i: bytes(of[c] for c in w) if all(c in of for c in w) else w.encode() for w, i in t.get_vocab(True).items()}


@functools.lru_cache(maxsize=2)
def piece_tokenizer(raw: bytes) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    t = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return t, [bytes([int(p[3:-1], 16)]) if t.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, t.id_to_piece(i)) for i in range(len(t)))]


def separable(a: bytes, b: bytes) -> bool:
    """Whether both tokenizers end a token wherever ``stretches`` cuts, and go on as if the text began there.

    A does if it splits by the byte-level pattern before it merges: a letter or digit is followed by a sign or white
    space in another part of that pattern, and a single line end is a part. B does if no piece has such
    a sign or space after a letter or digit, and none a line end.
    """
    rules = json.loads(a)
    pre = rules.get("pre_tokenizer") or {}
    first = rules.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    model, _ = piece_tokenizer(b)
    pieces = (model.id_to_piece(i).replace("▁", " ") for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    kind = unicodedata.category
    inside = lambda x, y: (kind(x)[0] == "L" or kind(x) == "Nd") and kind(y)[0] not in "LMN"
    return bool(first) and not any("\n" in p or any(map(inside, p, p[1:])) for p in pieces)


def _encode(a: bytes, b: bytes, whole: bool):
    """Tokens of each stretch: A's ids in order, then B's, which have SIDE added; none if either's bytes don't come back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (left, left_bytes), (right, right_bytes) = byte_tokenizer(a), piece_tokenizer(b)
        # B adds the space of a whole text itself; a stretch follows the lead, whose tokens go
        lead = 0 if whole else len(right.encode(_LEAD))
        for batch in batches:
            every = batch.to_pylist()
            for part in slices([len(t) for t in every], CHUNK) if every else [slice(0, 0)]:
                texts = every[part]
                ids_a = [e.ids for e in left.encode_batch(texts, add_special_tokens=False)]
                ids_b = [x[lead:] for x in right.encode([t[1:] if whole else _LEAD + t for t in texts], num_threads=1)]
                raw = [t.encode() for t in texts]
                ok = [b"".join(map(left_bytes.__getitem__, p)) == t == b"".join(map(right_bytes.__getitem__, q)) for t, p, q in zip(raw, ids_a, ids_b, strict=True)]
                yield pa.array([[*p, *(SIDE + i for i in q)] if k else [] for p, q, k in zip(ids_a, ids_b, ok, strict=True)], pa.list_(pa.int32()))

    return run


def vocabulary(spark: SparkSession, a: bytes, b: bytes) -> DataFrame:
    """(t, size): bytes of each token of both sides; its rows are those of two files of bounded size."""
    sizes = {i: len(x) for i, x in byte_tokenizer(a)[1].items()} | {SIDE + i: len(x) for i, x in enumerate(piece_tokenizer(b)[1])}
    return spark.createDataFrame(pa.table({"t": pa.array(list(sizes), pa.int32()), "size": pa.array(list(sizes.values()), pa.int32())}))


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The parts of ``_CUT`` that each character belongs to, as bits.

    Only where old and new tables of Unicode agree, since tokenizers have tables of their own; characters beyond the first plane belong to none.
    """

    def bits(kind: str) -> int:
        return sum(1 << k for k, part in enumerate(_CUT) if {kind, kind[0]} & set(part.split()))

    out = np.zeros(0x110000, np.uint8)
    out[:0x10000] = [bits(unicodedata.ucd_3_2_0.category(c)) & bits(unicodedata.category(c)) for c in map(chr, range(0x10000))]
    return out


def stretches(texts: pa.Array, whole: bool) -> tuple[pa.Array, np.ndarray]:
    """(stretches of all texts in order, where those of each text end). Texts begin with a space; null or empty ones have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    sizes = np.diff(offsets)
    if whole or not sizes.any():
        return texts.filter(pa.array(sizes > 0)), np.cumsum(sizes > 0)
    data, kinds, found = np.frombuffer(held, np.uint8), _classes(), []
    for part in slices(sizes.tolist(), CHUNK):
        low, high = offsets[part.start], offsets[part.stop]
        raw, first = data[low:high], offsets[part][sizes[part] > 0] - low
        chars, at = raw, None
        if len(raw) and raw.max() > 127:
            chars, at = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), np.flatnonzero((raw & 0xC0) != 0x80)
            first = np.searchsorted(at, first)
        kind = kinds[chars]
        cuts = np.zeros(len(kind), bool)
        cuts[1:] = (kind[:-1] << 1) & kind[1:] & 2
        line = np.flatnonzero(chars[1:-1] == 10) + 1
        cuts[line[(kind[line - 1] & 4 != 0) & (kind[line + 1] & 8 != 0)] + 1] = True
        # the space at a text's begin keeps its neighbours' characters out
        cuts[first] = True
        cuts = np.flatnonzero(cuts)
        found.append(low + (cuts if at is None else at[cuts]))
    starts = np.concatenate([*found, offsets[-1:]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), held), np.searchsorted(starts[:-1], offsets[1:])


def _counted(whole: bool):
    """(seg, n): distinct stretches of some texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for part in slices(pc.binary_length(texts).to_pylist(), TEXTS):
                found = pc.value_counts(stretches(texts[part], whole)[0])
                yield pa.record_batch([found.field(0), found.field(1)], ["seg", "n"])

    return run


def _listed(whole: bool):
    def run(texts: pa.Array) -> pa.Array:
        words, ends = stretches(texts, whole)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), words)

    return run


def packed(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2^30 as 16-bit units, one for those below 2^15 and else two, of which only the first has its highest bit set; and ``ends`` in units."""
    wide = numbers >= 1 << 15
    at = np.cumsum(1 + wide) - 1 - wide
    out = np.empty(len(numbers) + np.count_nonzero(wide), np.uint16)
    out[at] = np.where(wide, 1 << 15 | numbers >> 15, numbers)
    out[at[wide] + 1] = numbers[wide] & 0x7FFF
    return out, np.r_[at, len(out)][ends]


def unpacked(units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and ends that ``packed`` was given."""
    wide = np.flatnonzero(units >> 15)
    first = np.ones(len(units), bool)
    first[wide + 1] = False
    numbers = units.astype(np.int32)
    numbers[wide] = (numbers[wide] & 0x7FFF) << 15 | numbers[wide + 1]
    return numbers[first], np.r_[0, np.cumsum(first)][ends]


def _look(given, whole: bool):
    """Numbers of the stretches of each text, packed: places from 1 in the list of frequent ones, 0 for seldom ones, which follow in order."""
    kind = pa.struct([("numbers", pa.binary()), ("seldom", pa.list_(pa.string()))])

    def run(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        return pa.concat_arrays([pa.array([], kind), *(some(texts[part]) for part in slices(sizes, TEXTS))]) if any(sizes) else pa.array([{"numbers": b"", "seldom": []}] * len(texts), kind)

    def some(texts: pa.Array) -> pa.Array:
        words, ends = stretches(texts, whole)
        at = pc.index_in(words, value_set=given.value)
        other = pc.is_null(at)
        units, stops = packed(pc.fill_null(at, -1).to_numpy() + 1, ends)
        numbers = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((2 * np.r_[0, stops]).astype(np.int32)), pa.py_buffer(units)])
        until = np.r_[0, np.cumsum(other.to_numpy(zero_copy_only=False))][np.r_[0, ends]].astype(np.int32)
        return pa.StructArray.from_arrays([numbers, pa.ListArray.from_arrays(pa.array(until), words.filter(other))], fields=list(kind))

    return run


def align(tokens: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_a, n_b, n_groups, links, groups) of rows (keys, tokens): tokens as from ``_encode``, with the bytes of each in ``sizes`` (t, size).

    links: (a, b) of each overlapping pair of tokens; groups: `a1,a2|b1` joined by `;`. Keys must not repeat. Rows without
    tokens have n_a 0.
    """
    c = F.col
    # one shuffle of ids: all windows and groups below keep to the first key; their sorts find the keys in order
    each = tokens.repartition(keys[0]).sortWithinPartitions(*keys).select(*keys, F.posexplode_outer("tokens").alias("pos", "t")).join(F.broadcast(sizes), "t", "left")
    parts = {"side": (c("t") >= SIDE).cast("int"), "id": c("t").bitwiseAND(F.lit(SIDE - 1))}
    ends = F.sum("size").over(Window.partitionBy(*keys, "side").orderBy("pos"))
    starts = each.withColumns(parts).select(*keys, "side", "id", (ends - c("size")).alias("start"))
    met = starts.groupBy(*keys, "start").agg(F.max(F.when(c("side") == 0, c("id"))).alias("a"), F.max(F.when(c("side") == 1, c("id"))).alias("b"))
    so_far = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = F.when(c("a").isNotNull() & c("b").isNotNull(), 1).otherwise(0)
    on = [F.last(s, True).over(so_far).alias(f"on_{s}") for s in ("a", "b")]
    cuts = met.select(*keys, "start", "a", "b", *on, F.sum(shared).over(so_far).alias("grp"))
    # a token that begins a group begins on both sides
    listed = cuts.groupBy(*keys).agg(F.max("grp").alias("n_groups"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.array_sort(F.collect_list(F.struct("start", "a", "b", "on_a", "on_b"))).alias("at"))
    mark = lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), ";").otherwise(",")
    side = lambda s: F.array_join(F.transform(F.filter("at", lambda x: x[s].isNotNull()), lambda x: F.concat(mark(x), x[s].cast("string"))), "")
    parts_of = lambda s: F.split(F.substr(side(s), F.lit(2)), ";")
    groups = F.array_join(F.zip_with(parts_of("a"), parts_of("b"), lambda p, q: F.concat(p, F.lit("|"), q)), ";")
    links = F.transform("at", lambda x: F.struct(x["on_a"].alias("a"), x["on_b"].alias("b")))
    return listed.select(*keys, "n_a", "n_b", "n_groups", links.alias("links"), groups.alias("groups"))


def link_sums(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """``known`` with n_links, n_best and count_sum of its links, from (a, b, pair_count, best).

    Pairs up to a bound are looked up where the links lie; more are joined by a shuffle.
    """
    pairs = cut(pairs)
    if pairs.count() > BROADCAST_ROWS:
        link = known.select("key", F.explode("links").alias("l")).select("key", "l.a", "l.b").join(pairs, ["a", "b"])
        return known.join(link.groupBy("key").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("pair_count").alias("count_sum")), "key")
    held = pairs.toArrow()
    code = (held.column("a").to_numpy().astype(np.int64) << 32) | held.column("b").to_numpy()
    order = np.argsort(code)
    given = known.sparkSession.sparkContext.broadcast((code[order], held.column("pair_count").to_numpy()[order], held.column("best").to_numpy()[order]))

    def look(links: pa.Array) -> pa.Array:
        codes, counts, best = given.value
        flat, ends = links.flatten(), np.r_[0, np.cumsum(pc.list_value_length(links).to_numpy())]
        at = np.searchsorted(codes, (flat.field("a").to_numpy().astype(np.int64) << 32) | flat.field("b").to_numpy())
        total = lambda v: (s := np.r_[0, np.cumsum(v[at])])[ends[1:]] - s[ends[:-1]]
        return pa.StructArray.from_arrays([pa.array(np.diff(ends)), pa.array(total(best)), pa.array(total(counts))], ["n_links", "n_best", "count_sum"])

    sums = F.arrow_udf(look, "n_links long, n_best long, count_sum long")
    return known.withColumn("s", sums("links")).select("*", "s.n_links", "s.n_best", "s.count_sum").drop("s")


#: Of a stretch, a text or a document.
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _frequent(known: DataFrame, bound: int) -> int:
    """The least count that at most ``bound`` stretches have, from a histogram of its logarithms."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 16).cast("int")
    total = 0
    bins = {r.k: r["count"] for r in known.groupBy(step.alias("k")).count().collect()}
    for k in sorted(bins, reverse=True):
        total += bins[k]
        if total > bound:
            return int(np.ceil(2 ** ((k + 1) / 16)))
    return 0


def _compose(given):
    """Figures and digest of texts from the numbers of their stretches: frequent ones are looked up, the others come in the order of their places."""
    kind = pa.struct([*((x, pa.int64()) for x in FIGURES), ("groups_sha256", pa.string())])

    def run(numbers: pa.Array, rest: pa.Array) -> pa.Array:
        parts = slices(pc.divide(pc.binary_length(numbers), 2).to_pylist(), WORDS)
        done = [some(numbers[part], rest[part]) for part in parts]
        return pa.concat_arrays([pa.array([], kind), *done])

    def some(numbers: pa.Array, rest: pa.Array) -> pa.Array:
        figures, groups = given.value
        stops = np.r_[0, np.cumsum(pc.binary_length(numbers).to_numpy())] // 2
        at, ends = unpacked(np.frombuffer(b"".join(numbers.to_pylist()), np.uint16), stops)
        seldom, more = at == 0, rest.flatten()
        text, mine = pc.take(groups, pa.array(at)), {}
        if len(more):
            own = more.field("groups")
            text = pc.replace_with_mask(text, pa.array(seldom), own)
            n_groups = pc.add(pc.count_substring(own, ";"), 1).to_numpy()
            n_a = pc.count_substring(pc.replace_substring_regex(own, r"\|[0-9,]*", ""), ",").to_numpy() + n_groups
            n_b = pc.count_substring(own, ",").to_numpy() + 2 * n_groups - n_a
            # each group begins with an end of both sides, and every end makes a link
            mine = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, **{x: more.field(x).to_numpy() for x in ("n_best", "count_sum")}}
        filled, sums = np.flatnonzero(np.diff(ends)), []
        for x in FIGURES:
            values, total = figures[x][at], np.zeros(len(numbers), np.int64)
            if mine:
                values[seldom] = mine[x]
            total[filled] = np.add.reduceat(values, ends[filled]) if len(filled) else 0
            sums.append(pa.array(total))
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), text), ";")
        digests = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() if k else "" for x, k in zip(whole, np.diff(ends), strict=True)], pa.string())
        return pa.StructArray.from_arrays([*sums, digests], fields=list(kind))

    return run


def aligned(df: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of (doc_id, text) of ``df``.

    Tokenizer A encodes a space and the text, B the text, to which it adds the space. Null and empty texts, and those
    whose joined token bytes differ from space and text, have no tokens: zeros and ''. A link's count is
    how many links of all rows have its pair of ids; it is among the best if no pair of its B id has a larger
    one. Rows may repeat and doc_ids be null: each is a row of the result and counts.
    """
    c, spark = F.col, df.sparkSession
    models = [open(p, "rb").read() for p in (byte_bpe, pieces)]
    if max(map(len, models)) > MODEL_BYTES:
        raise ValueError("a tokenizer file is larger than what may be broadcast")
    whole = not separable(*models)
    rows = df.select(c("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(c("text").cast("string")).alias("text"))
    rows = rows.select("doc_id", F.when(c("text") != "", F.concat(F.lit(" "), "text")).alias("text"))
    full = rows.where("text is not null").select("text")
    count = lambda texts: texts.select("text").mapInArrow(_counted(whole), "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n"))

    # each distinct stretch once: tokens, groups and links in the stage that counts it
    encode = F.arrow_udf(_encode(*models, whole), "array<int>")
    counts = count(full).select(F.xxhash64("seg").alias("key"), "seg", "n", encode("seg").alias("tokens"))
    found = align(counts, vocabulary(spark, *models), ["key", "seg", "n"]).drop("key")
    found = saved(found.withColumn("key", F.monotonically_increasing_id()))
    bad = saved(found.where("n_a = 0").select("seg"))
    known = found.where("n_a > 0")
    if not bad.isEmpty():
        # texts with a stretch that does not come back have no tokens, and their stretches do not count
        keys = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
        listed = F.arrow_udf(_listed(whole), "array<string>")
        lost = saved(full.select(*keys, F.explode(listed("text")).alias("seg")).join(_light(bad), "seg").select("h1", "h2").distinct())
        less = count(full.select("text", *keys).join(lost, ["h1", "h2"], "left_semi")).withColumnRenamed("n", "less")
        known = known.join(_light(less), "seg", "left").withColumn("n", c("n") - F.coalesce("less", F.lit(0))).drop("less").where("n > 0")
        rows = rows.select("*", *keys).join(lost.withColumn("lost", F.lit(True)), ["h1", "h2"], "left").select("doc_id", F.when(c("lost").isNull(), c("text")).alias("text"))

    # counts of id pairs over the corpus, and what they make of each stretch
    link = known.select("key", "n", F.explode("links").alias("l")).select("key", "n", "l.a", "l.b")
    pairs = link.groupBy("a", "b").agg(F.sum("n").alias("pair_count"))
    top = F.max("pair_count").over(Window.partitionBy("b"))
    pairs = pairs.select("a", "b", "pair_count", (c("pair_count") == top).cast("long").alias("best"))
    info = saved(link_sums(known, pairs).select("seg", "n", *FIGURES, "groups"))
    forget(found)

    # every text as numbers of its stretches; a seldom stretch has fewer occurrences than each frequent one
    least = _frequent(info, frequent)
    often, seldom = info.where(c("n") >= least).toArrow().sort_by([("n", "descending")]), info.where(c("n") < least).drop("n")
    first = {x: np.r_[0, often.column(x).to_numpy()] for x in FIGURES}
    groups = pa.concat_arrays([pa.array([""], pa.string()), *(x.cast(pa.string()) for x in often.column("groups").chunks)])
    segs = pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in often.column("seg").chunks)])
    look = F.arrow_udf(_look(spark.sparkContext.broadcast(segs), whole), "numbers binary, seldom array<string>")
    texts = saved(rows.select("doc_id", look("text").alias("t")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "t.*"))
    parts = texts.select("row", F.posexplode("seldom").alias("pos", "seg"))
    rest = parts.join(seldom, "seg").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "n_best", "count_sum", "groups"))).alias("rest"))
    compose = F.arrow_udf(_compose(spark.sparkContext.broadcast((first, groups))), ", ".join(f"{x} long" for x in FIGURES) + ", groups_sha256 string")
    return texts.select("row", "doc_id", "numbers").join(rest, "row", "left").select("doc_id", compose("numbers", "rest").alias("d")).select("doc_id", "d.*")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
