"""What the corpus operators share: the shared folder, tables in it, Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.shared import shared_folder
from ..ship import ship

#: ASCII white space, the separators of words in every operator that counts words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The most bytes of an Arrow batch that a Python worker is handed at once; very long texts make short batches.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset (tests)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows as a Parquet table in the shared folder; it outlives lost executors and is read by column."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns of any name cannot clash with its own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


#: A key that more than one row in SHARE has is looked up by a broadcast; there are at most SHARE such keys.
SHARE = 10_000


def join_spread(rows: DataFrame, table: DataFrame, key: str, total: int, share: int = SHARE) -> DataFrame:
    """rows with the columns of table (a row a key, `n` rows of that key, which is left out), by equality of the key.

    Keys that hold a large part of all `total` rows meet a broadcast of those few; no task gathers them.
    """
    often = F.col("n") * share > total
    hot, rest = table.where(often).drop("n"), table.where(~often).drop("n")
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_often"))), key, "left")
    return marked.where("_often").drop("_often").join(F.broadcast(hot), key).unionByName(marked.where("_often is null").drop("_often").join(rest, key))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as no column of the frame has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(it: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that what a step makes of one stays small."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Give freed memory back to the system where the C library can; a worker that is kept for later stages is then small."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 5000, nbytes: int = 0, weigh=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows, or of about `nbytes` as `weigh` counts a row's bytes."""
    held: list[dict] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= size or (nbytes and weight >= nbytes):
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
