"""Shared pieces of the corpus operators: workers' path, salted ranks, names."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.plans.lineage import materialise, shared_dir


__all__ = ["documents", "free_names", "group_ranks", "map_arrow", "materialise", "shared_dir", "shuffle_partitions", "tidy", "whole_text"]


def tidy() -> None:
    """Give freed memory back to the system: an idle worker of a pool keeps it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def _tidied(rows: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            tidy()

    return run


def map_arrow(df: DataFrame, rows: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow, with this package on the path of workers that see its folder.

    Elsewhere it must be installed or passed with --py-files, as any package.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return df.mapInArrow(_tidied(rows), schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_ranks(df: DataFrame, group: str, rid: str, out: str) -> DataFrame:
    """Add `out`: a gapless rank from 0 of each row within its group.

    rid must be unique and fixed (written in a table). A group may hold any
    share of the rows: it is split by a salt of rid, rows are numbered within
    (group, salt), and the salts' counts, summed up in order, give the offsets.
    No task sees more than a salt's rows of a group, and none a whole group.
    """
    salts = max(64, 2 * shuffle_partitions(df.sparkSession))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(rid), F.lit(salts)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(rid)) - 1
    return (
        salted.withColumn("_local", local)
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_s")))
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_salt", "_local", "_g", "_s", "_before")
    )


def whole_text(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
