"""Helpers shared by the operators: Arrow maps, per-process state, running sums over all rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinsift.session import materialise

PIECE_ROWS = 1000
#: White space of the word rule `[^\x20\x09-\x0D]+`, the characters that bytes.split() cuts at.
SPACES = " \t\n\x0b\x0c\r"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]],
                schema: StructType | str) -> DataFrame:
    """Map batches of columns (dicts of lists) to batches of columns.

    `fn` sees all batches of a task one after the other and yields dicts of lists or numpy
    arrays in the names of `schema`.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few rows at a time become Python objects: a task needs little beside its Arrow batch.
        pieces = (b.slice(at, PIECE_ROWS) for b in batches for at in range(0, b.num_rows, PIECE_ROWS))
        plain = ({n: p.column(i).to_pylist() for i, n in enumerate(p.schema.names)}
                 for p in pieces)
        for out in fn(plain):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type, from_pandas=False) for f in target],
                schema=target)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on, idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # of glibc
    if trim:
        trim(0)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null counts 0. Stays in the JVM."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return (F.when(trimmed == "", F.lit(0))
            .otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint"))


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Running totals (this row included) over all rows in `order`, without one task for all.

    Rows are range-partitioned; each range is summed on its own and the totals of the
    earlier ranges are added. Equal rows must not matter to the caller.
    """
    part = "__part"
    rows = materialise(
        df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ordered")
    inside = (W.Window.partitionBy(part).orderBy(*order)
              .rowsBetween(W.Window.unboundedPreceding, 0))
    totals = rows.groupBy(part).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.Window.orderBy(part).rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    out = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    return (out.join(offsets, part)
            .withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums})
            .drop(part, *[f"__before_{n}" for n in sums]))
