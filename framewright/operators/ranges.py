"""Work in the order of a key's rows without one task for each key: rows are dealt to ranges of key and order, which are written
once; each range tells what it does to a running state, in one row a key; those rows, no more than keys and ranges together, are
carried on in order; and each range then finishes its own rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from framewright.shared import written


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with _part, the number of their range, and _at, which grows with the order within it. parts: how many ranges, as many
    as the session has shuffle partitions (fewer of little data) unless told."""
    dealt = rows.repartitionByRange(*([parts] if parts else []), *keys, *order).sortWithinPartitions(*keys, *order)
    return written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")


def earlier(keys: list[str]) -> WindowSpec:
    """Over summaries of ranges: those of the key's ranges before this one."""
    return W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def within(keys: list[str], order: str = "_at") -> WindowSpec:
    """Over rows in ranges: those of the key in this range, in order."""
    return W.partitionBy(*keys, "_part").orderBy(order)


def with_carried(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their key's and range's summary; null keys are equal."""
    told = summaries.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), *[c for c in summaries.columns if c not in (*keys, "_part")])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = F.col("_part") == F.col("_of")
    for s in same:
        on = on & s
    return rows.join(told, on).drop("_of", *[f"_{k}" for k in keys])


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """rows with their zero-based place among their key's rows; equal rows have places in some order."""
    placed = in_ranges(rows, keys, order, parts)
    ranges = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0)) - F.col("_first")
    return with_carried(placed, ranges.select(*keys, "_part", start.alias("_start")), keys).withColumn(name, (F.col("_at") + F.col("_start")).cast("bigint")).drop("_start", "_part", "_at")


def first_missing(numbers: DataFrame, key: str, number: str, name: str) -> DataFrame:
    """For each key the least whole number from 0 on that isn't among its numbers. Numbers become bits of words of 64, full words
    the next level's numbers: three aggregates, each to as much as a 64th, until a row stands for 262,144 numbers in a row; then
    back from the first word that isn't full. Repeated and negative numbers don't matter."""
    levels, here = [], numbers.select(key, F.col(number).cast("bigint").alias("_i")).filter("_i >= 0")
    for _ in range(3):
        words = here.groupBy(key, F.shiftright("_i", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_i & 63 as int))")).alias("_bits"))
        levels.append(words)
        here = words.filter("_bits = -1").select(key, F.col("_w").alias("_i"))
    full = here.groupBy(key).agg(F.array_sort(F.collect_set("_i")).alias("_full"))
    prefix = F.size(F.filter(F.transform("_full", lambda x, i: x == i), lambda same: same))
    found = numbers.select(key).distinct().join(full, key, "left").select(key, F.coalesce(prefix, F.lit(0)).cast("bigint").alias("_w"))
    for words in reversed(levels):
        bits = F.coalesce("_bits", F.lit(0).cast("bigint"))
        ones = F.bit_count(F.expr("_bits & ~coalesce(try_add(_bits, 1L), shiftleft(1L, 63))"))  # the lowest ones in a row; a full word isn't the first to miss a number
        found = found.join(words, [key, "_w"], "left").withColumn("_bits", bits).select(key, (F.col("_w") * 64 + ones).alias("_w"))
    return found.withColumnRenamed("_w", name)


def latest(rows: DataFrame, keys: list[str], order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """rows with the key's latest value that isn't null, at or before each."""
    placed = in_ranges(rows, keys, [order], parts)
    some: Column = F.col(value).isNotNull()
    ranges = placed.groupBy(*keys, "_part").agg(F.max_by(value, F.when(some, F.col("_at"))).alias("_last"))
    ranges = ranges.select(*keys, "_part", F.last("_last", ignorenulls=True).over(earlier(keys)).alias("_before"))
    own = F.last(value, ignorenulls=True).over(within(keys))
    return with_carried(placed, ranges, keys).withColumn(name, F.coalesce(own, "_before")).drop("_before", "_part", "_at")


def cuts(catalog: DataFrame, key: str, count: str, size: int, most: int | None = None) -> list[tuple]:
    """Where parts of `size` numbers begin, but for the first, when all keys' numbers (from 0 up to their count) stand in order: one
    (key, number) for each part. most: how many parts there may be; where there would be more, a part is as many times as long as
    it takes. catalog: a row for each key."""
    placed = in_ranges(catalog.select(F.col(key).alias("_key"), F.col(count).cast("bigint").alias("_count")).filter("_key is not null and _count > 0"), [], ["_key"])
    ranges = placed.groupBy("_part").agg(F.sum("_count").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier([])), F.lit(0)))
    upto = F.sum("_count").over(within([])) + F.col("_before")
    spans = with_carried(placed, ranges.drop("_n"), []).select("_key", (upto - F.col("_count")).alias("_from"), upto.alias("_to"))
    if most and (total := ranges.agg(F.sum("_n")).first()[0]):
        size *= -(-total // (size * most))
    last = F.ceil(F.col("_to") / size).cast("bigint") - 1
    marks = spans.withColumn("_first", F.greatest(F.lit(1), F.ceil(F.col("_from") / size)).cast("bigint")).filter(F.col("_first") <= last)
    found = marks.select("_key", "_from", F.explode(F.sequence(F.col("_first"), last)).alias("_mark")).select("_key", (F.col("_mark") * size - F.col("_from")).alias("_number")).collect()  # one row a part
    return sorted((r[0], r[1]) for r in found)


def part_of(begins: list[tuple]) -> Callable[[Column, Column], Column]:
    """The part of a key and number: how many parts begin at or before them. Null ones are in the first."""

    @F.arrow_udf("int")
    def part(keys: pa.Array, numbers: pa.Array) -> pa.Array:
        return pa.array([0 if k is None or n is None else bisect_right(begins, (k, n)) for k, n in zip(keys.to_pylist(), numbers.to_pylist(), strict=True)], pa.int32())

    return part
