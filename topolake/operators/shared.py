"""Lineage cuts for iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The most rows that are broadcast: about 100 bytes each, so 20 MB.
MOST_BROADCAST = 200_000


def cut(df: DataFrame) -> DataFrame:
    """The same rows under a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, for loops: unlike a checkpoint it carries no estimate of its size from
    round to round, which a join in each round would multiply, and small tables are known to be small."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where that is unset, elsewhere that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="topolake-"))
    return sc.getCheckpointDir()


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table of rules or parameters; the size is counted, and a larger one joins by a shuffle."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def many(df: DataFrame) -> DataFrame:
    """A hint to join these rows by a shuffle. Spark takes rows that were exploded to be as large as the file they come from, so
    without it some hundred MB of words or runs of a small file are sent through the driver to be broadcast. Files of names or keys are
    compressed, too: tables that Spark takes to be under its limit for broadcasts have many times their file's bytes in memory."""
    return df.hint("merge")


def first_by(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def spread_top_by(df: DataFrame, key: str, k: int, by: Column, *order: Column, parts: int = 64) -> DataFrame:
    """top_by for keys that hold a large part of all rows: the first k of each of `parts` shares of a key (dealt by a hash of `by`), then of those."""
    share = df.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(parts)))
    return top_by(top_by(share, [key, "_share"], k, *order).drop("rank", "_share"), [key], k, *order)


def top_by(df: DataFrame, keys: list[str | Column], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in that order, with their `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
