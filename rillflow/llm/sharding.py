"""Operator 10: jump consistent hashing into shards, with a gapless slot in each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import table, text_bytes

SHARDS = 16
#: Cells of a shard that are numbered on their own. Raise it with the rows: a cell should
#: hold no more rows than one task can sort.
CELLS = 1024

_LCG = np.uint64(2862933555777941757)  # fixed multiplier of the published algorithm


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys, vectorised.

    ``b`` only grows, so at most ``shards`` jumps are made; rows that have landed drop out.
    """
    key = keys.astype(np.uint64, copy=True)
    landed = np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    b = np.zeros(len(key), np.int64)
    while len(active):
        landed[active] = b
        key = key * _LCG + np.uint64(1)
        step = float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0)
        j = np.floor((b + 1).astype(np.float64) * step)
        going = j < shards
        active, key, b = active[going], key[going], j[going].astype(np.int64)
    return landed.astype(np.int32)


def _jump(keys: pd.Series, shards: pd.Series) -> pd.DataFrame:
    n = int(shards.iloc[0]) if len(shards) else 1
    k = keys.to_numpy(np.int64).view(np.uint64)
    return pd.DataFrame({"shard": jump_hash(k, n), "grown": jump_hash(k, n + 1)})


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """Rows of ``df`` as (key, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``key``: the 64-bit hash of the key and the number of shards decide, so a
    further shard takes rows only into itself. A null key hashes like any other value;
    a null text has size 1 and checksum 0. Equal keys share a shard.

    Slots: each shard is cut into cells by a hash of key and text, cells are counted with a
    pre-aggregated job, and a row's slot is its cell's offset plus its rank in the cell. No
    task sorts a whole shard, and repeated rows get slots of their own. Only the narrow
    columns are shuffled; texts are read once.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    jump = F.pandas_udf(_jump, "shard int, grown int")
    rows = df.select(F.col(key).alias("k"), text_bytes(text).alias("bytes"), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("crc"))
    rows = rows.withColumn("jump", jump(F.xxhash64("k"), F.lit(shards)))
    rows = rows.select("k", (F.col("bytes") + 1).alias("size"), "crc", "jump.shard", "jump.grown", F.pmod(F.xxhash64("k", "crc"), F.lit(cells)).cast("int").alias("cell"))
    counts = rows.groupBy("shard", "cell").count()
    # shards x cells rows at most, whatever the input: a fixed bound for the broadcast
    before = counts.select("shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k", "crc", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(before), ["shard", "cell"])
        .select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.col("grown").alias("grown_shard"))
    )


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
