"""Frames and videos: indexing, catalogs, ranges, depth, joins of results with frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import default_fps, depth_to_uint8, frame_name
from framewright.operators.ranges import first_missing, ranked


def assign_frame_idx(frames: DataFrame, order: list[str], video: str = "video_id", parts: int | None = None) -> DataFrame:
    """The zero-based place in the given order (for files by name, as text), and the cache name of F2. All columns are
    written once, in ranges of the order, so that one long video spans tasks: give names, and join contents to them."""
    return ranked(frames, [video], order, "frame_idx", parts).withColumn("cache_name", frame_name(F.col("frame_idx")))


def first_frame(frames: DataFrame, video: str = "video_id") -> DataFrame:
    """O2: a partial aggregate instead of a sort."""
    others = [c for c in frames.columns if c not in (video, "frame_idx")]
    return frames.groupBy(video).agg(F.min(F.struct("frame_idx", *others)).alias("_f")).select(video, "_f.*")


def videos_without_frames(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """What the first frame can't be taken from."""
    return videos.join(frames.select("video_id"), "video_id", "left_anti")


def sequence_catalog(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Size of the first frame, given rate, number of frames."""
    return frames.groupBy("video_id").agg(F.min_by("width", "frame_idx").alias("width"), F.min_by("height", "frame_idx").alias("height"), F.count("*").alias("frame_count")).withColumn("fps", F.lit(fps))


def video_catalog(videos: DataFrame) -> DataFrame:
    """S4, P9"""
    return videos.withColumn("fps", default_fps(F.col("fps")))


def coverage(results: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """A5: how much of a video has results; flags a container that tells another number than was decoded."""
    counted = videos.select("video_id", "frame_count").join(results.groupBy("video_id").agg(F.count("*").alias("results")), "video_id", "left").join(frames.groupBy("video_id").agg(F.count("*").alias("decoded")), "video_id", "left")
    counted = counted.fillna(0, ["results", "decoded"])
    return counted.select("video_id", "frame_count", "decoded", "results", F.when(F.col("frame_count") > 0, F.col("results") / F.col("frame_count")).alias("share"), (F.col("decoded") != F.col("frame_count")).alias("mismatch"))


def frame_range(frames: DataFrame, pixels: str = "px") -> DataFrame:
    """Least and largest value over all pixels and channels."""
    return frames.withColumn("lo", F.array_min(pixels)).withColumn("hi", F.array_max(pixels))


#: Sample types of decoded frames, little-endian, by depth and whether they are real numbers.
SAMPLES = {(8, False): "u1", (16, False): "<u2", (32, False): "<i4", (32, True): "<f4", (64, True): "<f8"}


def samples_to_uint8(px: Column, bits: Column, is_float: Column) -> Column:
    """A6, P6 on whole frames of bytes: eight-bit ones stay, others spread over 0..255 by their own range."""

    @F.arrow_udf("binary")
    def reduced(frames: pa.Array, depths: pa.Array, reals: pa.Array) -> pa.Array:
        out = []
        for raw, depth, real in zip(frames.to_pylist(), depths.to_pylist(), reals.to_pylist(), strict=True):
            if raw is not None and depth != 8:
                v = np.frombuffer(raw, SAMPLES[depth, real]).astype(np.float64)
                lo, hi = (v.min(), v.max()) if len(v) else (0.0, 0.0)
                scaled = np.zeros(len(v)) if hi == lo else (v - lo) * 255.0 / (hi - lo)
                raw = (np.floor(scaled) if real else np.rint(scaled)).astype(np.uint8).tobytes()
            out.append(raw)
        return pa.array(out, pa.binary())

    return reduced(px, bits, is_float)


def to_uint8(frames: DataFrame, pixels: str = "px") -> DataFrame:
    """P6 on frames (px as an array, bits, is_float), in the JVM."""
    ranged = frame_range(frames, pixels)
    return ranged.withColumn("px8", F.transform(pixels, lambda v: depth_to_uint8(v, F.col("lo"), F.col("hi"), F.col("bits"), F.col("is_float"))))


def join_results(results: DataFrame, frames: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Results with their frames; frames without a result go, results without a mask stay."""
    joined = results.join(frames, ["video_id", "frame_idx"])
    return joined if masks is None else joined.join(masks, ["video_id", "frame_idx"], "left")


def first_gaps(frames: DataFrame) -> DataFrame:
    """video_id and _stop, the first index of each video that can't be read; from keys alone."""
    return first_missing(frames.select("video_id", "frame_idx"), "video_id", "frame_idx", "_stop")


def join_sequential(results: DataFrame, frames: DataFrame, frame_count: DataFrame | None = None) -> DataFrame:
    """Like reading a video forward: results count only before the first frame that can't be read.

    frame_count: video_id, frame_count, how many frames the results may ask for; without it as many as were read. The gap is found
    from frames' keys, and results are cut by it before they meet the frames, whose other columns move in that join alone."""
    kept = results.join(first_gaps(frames), "video_id").filter((F.col("frame_idx") < F.col("_stop")) & (F.col("frame_idx") >= 0)).drop("_stop")
    if frame_count is not None:
        kept = kept.join(frame_count, "video_id").filter(F.col("frame_idx") < F.col("frame_count")).drop("frame_count")
    return kept.join(frames, ["video_id", "frame_idx"])


def chronological(results: DataFrame) -> DataFrame:
    """O1: by video and frame."""
    return results.orderBy("video_id", "frame_idx")
