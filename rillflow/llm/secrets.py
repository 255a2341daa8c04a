"""Operator 5: secrets, by fixed patterns and by a token-efficiency test.

Random strings split into many short tokens under a byte-pair vocabulary, prose into few
long ones. A run of key characters is reported as ``random`` if its characters per token
are below a limit, unless it is a known digest, identifier, number, date or path.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import table

#: A tiktoken vocabulary file (base64 token and rank on each line), read on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What is broadcast has this size at most.
VOCABULARY_BYTES = 16 << 20
#: Prose in cased, digit-bearing runs stays above this many characters per token.
CHARS_PER_TOKEN = 2.0

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
#: Letter runs are not listed: words have many characters a token, and what has few is no word.
_KNOWN = re.compile(
    r"""(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})   # UUID
    | [0-9_+/-]+                                                            # numbers, dates, phone numbers
    | (?:[A-Z]?[a-z]{1,3}|[0-9]+)(?:[-_/+](?:[A-Z]?[a-z]{1,3}|[0-9]+)?)+    # short words, which have few characters a token
    """,
    re.X,
)
#: Fixed value: the published split pattern of this family of byte-pair vocabularies.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def looks_random(run: str, enc: tiktoken.Encoding, limit: float) -> bool:
    if re.fullmatch(r"[0-9a-fA-F]+", run) and len(run) in DIGESTS:
        return False
    if _KNOWN.fullmatch(run):
        return False
    return len(run) / len(enc.encode_ordinary(run)) < limit


def spans(text: str, enc: tiktoken.Encoding, limit: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of every span, by start, then kind; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    base = sorted(found)
    at, reach = 0, 0  # runs don't overlap: base spans that start before a run's end are passed once
    for m in _RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and looks_random(m[0], enc, limit):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(raw, limit: float, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans(t, enc, limit) if t else [] for t in texts]
            columns = {"row": batch.column("row")}
            for k, kind in enumerate(KINDS[:3]):
                columns[f"n_{kind}"] = pa.array([sum(s[1] == k for s in f) for f in found], pa.int64())
            columns["base"] = pa.array([written([s for s in f if s[1] < 3]) for f in found], pa.string())
            columns["spans"] = pa.array([written(f) for f in found], pa.string())
            columns["redacted"] = pa.array([redact(t, f, mark) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return raw


def scan_secrets(df: DataFrame, vocabulary: str = VOCABULARY, limit: float = CHARS_PER_TOKEN, mark: str = "<secret>") -> DataFrame:
    """(row, n_assign, n_access, n_hex, base, spans, redacted) for each row of ``df``; ``row`` is the whole row, a struct.

    Base kinds are leftmost and non-overlapping within their kind; a match that fails its
    length is dropped and its characters are spent. ``random`` spans overlap no base span.
    A null text has no spans and stays null; rows are judged one by one, so repeated rows and
    ids are kept. Texts are read once and nothing is shuffled.
    """
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    found = [*((f"n_{k}", T.LongType()) for k in KINDS[:3]), *((c, T.StringType()) for c in ("base", "spans", "redacted"))]
    return rows.mapInArrow(_scan(raw, limit, mark), T.StructType([rows.schema["row"], *(T.StructField(*f) for f in found)]))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
