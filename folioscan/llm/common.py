"""Helpers that the training-data operators share: intermediate tables, sized joins, Arrow row maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_dir

#: White space of the contracts, as a character class body for Java and Python patterns.
WS = r"\x20\x09-\x0D"
#: The same characters as a string, for str.strip.
WS_CHARS = " \t\n\x0b\x0c\r"
#: Stands in for a null document id, so that such rows join and sort (before all others).
NULL_ID = -(2**63)
#: Rows of two longs up to which a table may be broadcast (about 16 MB); larger tables are shuffled.
BROADCAST_ROWS = 1_000_000

#: Rows that a Python worker holds as objects at once.
SLICE = 256


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sid(name: str = "doc_id") -> Column:
    """A document id that is never null."""
    return F.coalesce(F.col(quoted(name)).cast("long"), F.lit(NULL_ID))


def quoted(name: str) -> str:
    """A column's name for expressions, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def others(columns: Sequence[str], *names: str) -> list[str]:
    """The columns that are not called like one of ``names`` (case doesn't count, as in Spark)."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """Names of helper columns, changed until no column is called like them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sized_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``limit`` rows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def skew_safe_left_join(rows: DataFrame, groups: DataFrame, on: Sequence[str], count: str, share: int = 256) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row a key; ``count``: its number of rows, or a bound of it).

    Keys that hold more than 1/``share`` of the rows are at most ``share``; these are broadcast and so stay where
    they are. The rest is shuffled. Both inputs should be written tables: they are read twice.
    """
    least = F.lit(max(1000, groups.agg(F.sum(count)).first()[0] or 0) // share)
    values = [c for c in groups.columns if c not in on]
    hot = F.broadcast(groups.filter(F.col(count) > least).withColumn("__hot", F.lit(True)))
    marked = rows.join(hot, list(on), "left")
    near = marked.filter("__hot").drop("__hot")
    cold = groups.filter(F.col(count) <= least)
    far = marked.filter("__hot is null").drop("__hot", *values).join(cold, list(on), "left")
    return near.unionByName(far)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order. ``values`` is sorted in place (np.unique would build a hash table, far slower)."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


#: What workers keep from task to task, by the owner's name: functions that give it up.
KEPT: dict[str, Callable[[], None]] = {}


def release(owner: str = "") -> None:
    """Give memory of a finished task back, and what operators other than ``owner`` keep: workers live on, and other
    stages need the room."""
    for name, clear in KEPT.items():
        if name != owner:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list], Sequence]],
    column: str,
    outputs: Sequence[T.StructField],
    owner: str = "",
) -> DataFrame:
    """Append ``outputs`` computed from ``column`` batch by batch.

    ``make`` runs once in each task and returns a function from a list of values to one list (or Arrow array) an
    output; what ``owner`` keeps from task to task stays. Input columns named like an output (in any case) are replaced; all other columns pass through.
    """
    kept = others(df.columns, *[f.name for f in outputs])
    column = next((c for c in df.columns if c.lower() == column.lower()), column)
    read = kept if column in kept else [*kept, column]
    # Names with dots can't go through mapInArrow, so columns go by number.
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*[df.schema[c] for c in kept], *outputs])])
    kinds = [ARROW[f.dataType.simpleString()] for f in outputs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        apply = make()
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            made = apply(batch.column(read.index(column)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(read.index(c)) for c in kept], *[pa.array(x, k) for x, k in zip(made, kinds, strict=True)]],
                names=schema.names,
            )
        del apply
        release(owner)

    made = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(read)]).mapInArrow(run, schema)
    return made.toDF(*kept, *[f.name for f in outputs])


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "binary": pa.binary(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
}
_RUN = "struct<start:bigint,length:bigint,period:bigint>"
ARROW[_RUN] = pa.struct([pa.field(n, pa.int64()) for n in ("start", "length", "period")])
ARROW[f"array<{_RUN}>"] = pa.list_(ARROW[_RUN])
