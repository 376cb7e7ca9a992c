"""Parity of two backends' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Keys, max_abs_diff, verdict (ok, fail, missing, length). left and right: keys and `output`, an array of
    doubles. NaN in a difference fails; outputs without a partner or of other length are told as such."""
    joined = left.select(*keys, F.col("output").alias("a")).join(right.select(*keys, F.col("output").alias("b")), keys, "full_outer")
    worst = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    both = joined.withColumn("max_abs_diff", F.when(F.size("a") == F.size("b"), worst))
    bad = (F.col("max_abs_diff") > tolerance) | F.isnan("max_abs_diff")
    return both.select(*keys, "max_abs_diff", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.size("a") != F.size("b"), "length").when(bad, "fail").otherwise("ok").alias("verdict"))


def worst(compared: DataFrame, *by: str) -> DataFrame:
    """The largest difference and whether everything agrees."""
    return compared.groupBy(*by).agg(F.count("*").alias("outputs"), F.max("max_abs_diff").alias("worst"), F.min(F.col("verdict") == "ok").alias("agree"), F.sum(F.when(F.col("verdict") != "ok", 1).otherwise(0)).cast("bigint").alias("differing"))
