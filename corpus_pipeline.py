"""The corpus pipeline: stages over documents, each by one training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, table
from rillflow.llm.decontaminate import contaminated
from rillflow.llm.near import near_duplicates
from rillflow.llm.packing import pack
from rillflow.llm.secrets import scan_secrets
from rillflow.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, and one of
    rows that are equal in doc_id and text. Rows without doc_id stay; null and empty texts repeat each other."""
    kept = docs.join(near_duplicates(docs).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    often = docs.where("doc_id is not null").groupBy("doc_id", F.md5(F.coalesce("text", F.lit("")))).count().where("count > 1")
    often = cut(often.select("doc_id").distinct())
    if often.isEmpty():
        return kept
    once = kept.join(often, "doc_id", "left_semi").withColumn("_text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "_text"])
    return kept.join(often, "doc_id", "left_anti").union(once.select(kept.columns)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark, and n_chars follows."""
    found = scan_secrets(docs)
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("spans") == "", F.col("row.n_chars")).otherwise(F.char_length("redacted").cast("long"))}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their text and their place in a sequence. Rows that repeat both
    doc_id and text are packed each; null and empty texts are pieces without text."""
    packed, digest = pack(docs), F.hex(F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = docs.where(F.char_length("text") > 0).select(F.col("doc_id").cast("long").alias("d"), digest.alias("c"), "text").dropDuplicates(["d", "c"])
    held = packed.join(texts, packed.doc_id.eqNullSafe(texts.d) & (packed.cluster == texts.c), "left")
    return held.select(*packed.columns, F.coalesce(F.substring("text", (F.col("start") + 1).cast("int"), F.col("size").cast("int")), F.lit("")).alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Training a classifier and packing are no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result but the last is written to the shared
    checkpoint folder, since the next stage reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
