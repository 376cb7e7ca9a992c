"""Per-frame timing: durations, warm-up, rates, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.scalar import clamp_warmup, instant_fps


def frame_dt(stamps: DataFrame, start: str | None = None) -> DataFrame:
    """run_id, frame_idx, dt in seconds between results of a run (run_id, frame_idx, ts); the first is measured from
    the column `start`, and is null without one."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    stamps = stamps.withColumn("_t", micros("ts"))
    before = F.lag("_t").over(W.partitionBy("run_id").orderBy("frame_idx"))
    return stamps.select("run_id", "frame_idx", ((F.col("_t") - F.coalesce(before, micros(start) if start else F.lit(None).cast("bigint"))) / 1e6).alias("dt"))


def fps_counters(timings: DataFrame, warmup: int = 0) -> DataFrame:
    """What a run's summary needs. The warm-up leaves at least one frame: with more frames than that it is a condition on the
    frame's index, else the last frame is what stays; so one partial aggregate is enough, without a window."""
    warmup = max(0, warmup)
    at = F.col("frame_idx")
    return timings.groupBy("run_id").agg(F.count("*").alias("frames"), F.sum("dt").alias("total_s"), F.sum(F.when(at >= warmup, F.col("dt")).otherwise(0.0)).alias("tail"), F.max_by("dt", "frame_idx").alias("last"))


def fps_of(counters: DataFrame, warmup: int = 0) -> DataFrame:
    """A1: the summary that fps_counters' counters stand for."""
    warmup = max(0, warmup)
    w = F.when(F.col("frames") > 1, clamp_warmup(F.lit(warmup), F.col("frames"))).otherwise(0).cast("bigint")
    told = counters.withColumn("warmup", w).withColumn("kept_frames", F.col("frames") - F.col("warmup"))
    kept = F.when(F.col("frames") == 1, F.col("total_s")).when(F.col("frames") > warmup, F.col("tail")).otherwise(F.col("last"))
    rate = lambda n, s: F.when(s > 0, n / s).otherwise(0.0)
    return told.select("run_id", "frames", "total_s", rate(F.col("frames"), F.col("total_s")).alias("avg_fps_all"), "warmup", "kept_frames", rate(F.col("kept_frames"), kept).alias("avg_fps_post_warmup"))


def fps_summary(timings: DataFrame, warmup: int = 0) -> DataFrame:
    """One row a run."""
    return fps_of(fps_counters(timings, warmup), warmup)


def with_empty_runs(summary: DataFrame, jobs: DataFrame) -> DataFrame:
    """A1 for runs without a frame: all zero."""
    return jobs.select("run_id").join(summary, "run_id", "left").fillna(0)


def exclude_warmup(timings: DataFrame, warmup: int) -> DataFrame:
    """The frames after the warm-up."""
    sized = timings.groupBy("run_id").agg(F.count("*").alias("_n"))
    return timings.join(sized, "run_id").filter(F.col("frame_idx") >= F.when(F.col("_n") > 1, clamp_warmup(F.lit(warmup), F.col("_n"))).otherwise(0)).drop("_n")


def fps_series(timings: DataFrame, warmup: int = 0) -> DataFrame:
    """The rate of each frame with the span of the warm-up and the line of the average, null where there is none."""
    told = fps_summary(timings, warmup).select("run_id", "warmup", "avg_fps_post_warmup")
    joined = timings.join(told, "run_id")
    avg = F.col("avg_fps_post_warmup")
    return joined.select("run_id", "frame_idx", instant_fps(F.col("dt")).alias("fps"), F.when(F.col("warmup") > 0, -0.5).alias("span_lo"), F.when(F.col("warmup") > 0, F.col("warmup") - 0.5).alias("span_hi"), F.when(avg > 0, avg).alias("avg_line"))


#: The sentences of the report.
REPORT = ("tracked %d frames in %.2fs (%.1f FPS all)", "avg %.1f FPS over %d frames (excluded first %d warm-up)")


def fps_report(summary: DataFrame) -> DataFrame:
    """run_id, line_no, line; no line for a run without frames, the second only after a warm-up."""
    some = summary.filter("frames > 0")
    first = F.format_string(REPORT[0], "frames", "total_s", "avg_fps_all")
    second = F.format_string(REPORT[1], "avg_fps_post_warmup", "kept_frames", "warmup")
    lines = F.filter(F.array(first, F.when(F.col("warmup") > 0, second)), lambda x: x.isNotNull())
    return some.select("run_id", F.posexplode(lines).alias("line_no", "line"))
