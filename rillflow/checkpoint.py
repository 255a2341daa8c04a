"""Cutting lineage between rounds of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Rows from which a saved table is not broadcast, and bytes of files below which it isn't counted.
MANY, FEW_BYTES = 250_000, 1 << 16


def folder(df: DataFrame) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` if it isn't yet.

    Only a local master may go without that setting (tests): it then gets a temporary folder.
    A cluster without it is an error, because executors don't see each other's local folders.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="rillflow-checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    folder(df)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in that folder: for loops of joins.

    A checkpoint keeps the planner's guess of its size, and each join of two of them multiplies
    the guesses, so after some tens of joins planning alone takes seconds; a table has the size of its files.
    Files of ids are many times smaller than their rows, so a table of ``MANY`` rows asks for merge joins: by its
    size it would be collected on the driver.
    """
    path = f"{folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if _bytes(df, path) >= FEW_BYTES and found.count() >= MANY:
        found = found.hint("merge")
    found._saved_at = path
    return found


def _bytes(df: DataFrame, path: str) -> int:
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def forget(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote for these. Only for tables that nothing reads any more: whatever was made
    of them is saved itself, so that a lost executor's tasks don't go back to them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
