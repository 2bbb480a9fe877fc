"""Parquet tables of the search engine: intermediate ones in the shared folder, and keyed ones for lookups that prune."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of a keyed table: what a lookup reads for one key at most.
ROW_GROUP = 8 << 20
#: Keys of one ``IN``; Spark passes no longer lists to Parquet by value.
IN_KEYS = 10
#: Rows of a few numbers up to which a counted table is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and lost executors cost no more than a read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_keyed(df: DataFrame, path: str, key: str, also: Sequence[str] = (), row_group: int = ROW_GROUP) -> None:
    """Write ``df`` sorted by ``key`` over all files, in small row groups, with Bloom filters on it and on ``also``.

    A lookup by key then reads the row groups whose range holds it; one by another column those whose filter does.
    """
    keyed_writer(df.repartitionByRange(key).sortWithinPartitions(key), key, also, row_group).parquet(path)


def keyed_writer(df: DataFrame, key: str, also: Sequence[str] = (), row_group: int = ROW_GROUP) -> DataFrameWriter:
    writer = df.write.option("parquet.block.size", row_group)
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", True)
    for column in (key, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
    return writer


def one_of(column: str, values: Sequence) -> Column:
    """Whether the column has one of a bounded list of values, as filters that reach the Parquet scan by value."""
    values = sorted(set(values))
    parts = [F.col(column).isin(values[at : at + IN_KEYS]) for at in range(0, len(values), IN_KEYS)]
    return reduce(or_, parts) if parts else F.lit(False)


def lookup(table: DataFrame, key: str, values: Sequence) -> DataFrame:
    """The rows of a keyed table that have one of ``values``."""
    return table.filter(one_of(key, values))
