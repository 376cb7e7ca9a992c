"""The flagship: frames, prompts and a backend to rendered frames, annotations and timing, and all of it to a sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import colour_rgb, label_anchor_y, object_label
from framewright.operators.frames import samples_to_uint8, sequence_catalog
from framewright.operators.masks import bbox_of_runs
from framewright.operators.metrics import fps_summary
from framewright.operators.overlay import Stacks
from framewright.plans.backends import StepBackend, build_backend, run_steps
from framewright.shared import written
from framewright.sources.frames import FRAMES, decode_frames, frame_counts, in_order, netpbm, rgb_of, scan_frames
from framewright.sources.prompts import read_prompts

BOX = ("obj_id", "x1", "y1", "x2", "y2", "drawn", "label", "label_x", "label_y")


def stacked(masks: DataFrame, draw: Column | None = None) -> DataFrame:
    """For each frame that has a result its layers in the order in which they cover each other, each with runs,
    colour and box (null for an empty mask), and whether the box is drawn, with its label. One aggregate, of masks alone."""
    drawn = F.lit(True) if draw is None else F.coalesce(draw, F.lit(False))
    box = F.when(F.size("runs") > 0, bbox_of_runs(F.col("runs"), F.col("w")))
    rows = masks.select("video_id", "frame_idx", "obj_id", "runs", "w", box.alias("b"), (drawn & (F.size("runs") > 0)).alias("drawn"))
    shown = lambda c: F.when(F.col("drawn"), c)
    layer = F.struct("obj_id", "runs", colour_rgb(F.col("obj_id")).alias("colour"), "b.x1", "b.y1", "b.x2", "b.y2", "drawn", shown(object_label(F.col("obj_id"))).alias("label"), shown(F.col("b.x1")).alias("label_x"), shown(label_anchor_y(F.col("b.y1"))).alias("label_y"))
    return rows.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(layer)).alias("layers"), F.max("w").alias("w"))


def _drawn(batches: Iterator[pa.RecordBatch], alpha: float) -> Iterator[pa.RecordBatch]:
    """Rows in order, a frame's stack before its pixels: frames with their stacks; what has no counterpart goes."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        keys = list(zip(table["video_id"].to_pylist(), table["frame_idx"].to_pylist(), strict=True))
        places, frames, stack = [], [], None
        for i, (key, is_frame) in enumerate(zip(keys, table["is_frame"].to_pylist(), strict=True)):
            if not is_frame:
                stack = i
            elif stack is not None and keys[stack] == key:
                places.append(stack)
                frames.append(i)
        found = table.take(pa.array(places, pa.int64()))
        if places:
            layers, widths = found["layers"].combine_chunks(), found["w"].to_pylist()
            stacks = Stacks(layers.chunk(0) if isinstance(layers, pa.ChunkedArray) else layers)
            px = table["rgb"].take(pa.array(frames, pa.int64()))
            pixels = [None if p is None else stacks.blended(n, p, alpha, widths[n]) for n, p in enumerate(px.to_pylist())]
        else:
            pixels = []
        out = found.select([c for c in found.column_names if c not in ("is_frame", "rgb")]).append_column("rgb", pa.array(pixels, pa.binary()))
        yield from out.combine_chunks().to_batches()
        held = None if stack is None else pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.slice(stack, 1).combine_chunks().columns], schema=table.schema)


def rendered(frames: DataFrame, stacks: DataFrame, catalog: DataFrame, alpha: float = 0.5, size: int = FRAMES) -> DataFrame:
    """Frames (video_id, frame_idx, rgb) that have a stack, blended and with their boxes drawn, and all columns of the stacks.
    Pixels and stacks move once, to the part of their video and frame (in_order), where they meet; the result is in that order.
    Frames without a stack aren't rendered; a frame that is there twice is rendered twice."""
    stacks = stacks.withColumn("is_frame", F.lit(False))
    rows = stacks.unionByName(frames.select("video_id", "frame_idx", "rgb", F.lit(True).alias("is_frame")), allowMissingColumns=True)
    placed = in_order(rows, catalog, size, "is_frame")
    fields = [f for f in placed.schema if f.name not in ("is_frame", "rgb")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", rgb binary"
    return placed.mapInArrow(lambda batches: _drawn(batches, alpha), schema)


def annotate(frames: DataFrame, prompts: DataFrame | None, timings: DataFrame | None, backend: str = "prompted", *, inputs: dict | None = None, alpha: float = 0.5, draw: Column | None = None, warmup: int = 0, catalog: DataFrame | None = None, size: int = FRAMES) -> DataFrame:
    """A row for each frame that has a result, in order over all partitions: video_id, frame_idx, rgb (blended, with the outlines of
    drawn boxes), boxes (an array of struct by object, of masks with a pixel) and, with timings, the timing of its run.

    frames: video_id, frame_idx, rgb. timings: run_id (the video), frame_idx, dt. inputs: what the backend takes, else frames and prompts.
    catalog: video_id, frame_count; without one it is counted from the frames' keys. Masks are worked out once; what is known
    of a video joins the stacks before they meet the pixels."""
    masks = build_backend(backend)(**(inputs or {"frames": frames, "prompts": prompts}))
    stacks, timed = stacked(masks, draw), []
    if timings is not None:
        timed = ["frames", "avg_fps_all", "avg_fps_post_warmup"]
        stacks = stacks.join(fps_summary(timings, warmup).select(F.col("run_id").alias("video_id"), *timed), "video_id", "left")
    out = rendered(frames, stacks, frame_counts(frames) if catalog is None else catalog, alpha, size)
    boxes = F.transform(F.filter("layers", lambda b: b["x1"].isNotNull()), lambda b: F.struct(*[b[c].alias(c) for c in BOX], b["colour"][0].alias("r"), b["colour"][1].alias("g"), b["colour"][2].alias("b")))
    return out.select("video_id", "frame_idx", "rgb", boxes.alias("boxes"), *timed)


def run_files(
    spark: SparkSession, frames: str, prompts: str, backend: Callable[[], StepBackend], *, pattern: str = "*.tif*", decoder: Callable[[bytes], tuple] = netpbm,
    threshold: float = 0.0, alpha: float = 0.5, draw: Column | None = None, timings: DataFrame | None = None, warmup: int = 0, fps: float = 30.0, size: int = FRAMES,
    video: Callable[[Column], Column] = lambda name: name,
) -> DataFrame:
    """A run from files: annotate() over a folder of frame files for each video (video_id is its name) and a prompt file for each
    (its name without the suffix). video: what makes a video_id of that name, as videos stand in the order of their ids: folders
    named by numbers want a number, or 10 comes before 2. Frames are decoded and reduced to eight bits once and written; the backend sees them in order with
    frame.px8 (a byte for each sample), width, height and channels, and gives logits. Without a prompt or a frame it is an error."""
    files = scan_frames(spark, frames, pattern).withColumn("video_id", video(F.col("video_id")))
    rows = decode_frames(files, decoder, ["video_id", "frame_idx"])
    rows = written(rows.select("video_id", "frame_idx", "width", "height", "channels", samples_to_uint8(F.col("px"), F.col("bits"), F.col("is_float")).alias("px8")), "decoded")
    told = read_prompts(spark, prompts).withColumn("video_id", video(F.regexp_replace("file", r"\.[^.]*$", "")))
    catalog = sequence_catalog(rows, fps)
    logits = run_steps(rows, told, backend, ["px8", "width", "height", "channels"]).join(catalog.select("video_id", F.col("width").alias("w"), F.col("height").alias("h")), "video_id")
    seen = rows.select("video_id", "frame_idx", rgb_of(F.concat_ws("/", "video_id", "frame_idx"), F.col("px8"), F.col("channels")).alias("rgb"))
    return annotate(seen, told, timings, "logits", inputs={"logits": logits, "threshold": threshold}, alpha=alpha, draw=draw, warmup=warmup, catalog=catalog, size=size)


def write_run(run: DataFrame, path: str) -> None:
    """The sink: annotate()'s rows are in order, a file for each of its parts."""
    run.write.mode("overwrite").parquet(path)

