"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in Arrow batches of at most this many rows. The session keeps the setting: results are lazy
    and read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage is cut and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each piece has about max_bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def sieve(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that all values of ids' column pass and few others do, by a bit map of fixed size (2 MB, at most 262,144 longs
    on the driver). It only keeps rows from a shuffle; with very many ids it fills up and keeps none."""
    slot = F.shiftrightunsigned(F.xxhash64(column), 40)
    words = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({column}), 40) & 63 as int))")).alias("b"))
    bits = np.zeros(1 << 18, np.int64)
    for w, b in words.toLocalIterator():
        bits[w] = b
    held = ids.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    @F.arrow_udf("boolean")
    def maybe(hashes: pa.Array) -> pa.Array:
        at = (np.array(hashes).view(np.uint64) >> np.uint64(40)).astype(np.int64)
        return pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda c: maybe(F.xxhash64(c))


def without_ids(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """df without the rows whose id is in gone: only rows that may be among them are shuffled, not all texts."""
    maybe = sieve(gone, column)(F.col(column))
    return df.filter(~maybe).unionByName(df.filter(maybe).join(gone.select(column).distinct(), column, "left_anti").select(*df.columns))
