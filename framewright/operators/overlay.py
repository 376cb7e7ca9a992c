"""Masks blended over frames: a frame's bytes and its layers of run lengths meet in one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import colour_rgb
from framewright.operators.masks import composite_order


def blended(rgb: bytes, runs: list[tuple[np.ndarray, np.ndarray]], colours: list[np.ndarray], alpha: float, boxes: list | None = None, width: int = 0) -> bytes:
    """F6 on all pixels of a frame, layer after layer, each step cut to whole numbers; only the runs (starts and lengths of each layer)
    are touched. boxes: of each layer the box to draw after it is blended, or None."""
    px = np.frombuffer(rgb, np.uint8).reshape(-1, 3).copy()
    for i, ((starts, lengths), colour) in enumerate(zip(runs, colours, strict=True)):
        c = colour.astype(np.float64)
        for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            px[start : start + n] = np.floor(alpha * c + (1 - alpha) * px[start : start + n])
        if boxes and boxes[i] is not None and width:
            outline(px.reshape(-1, width, 3), boxes[i], colour)
    return px.tobytes()


def outline(image: np.ndarray, box: tuple[int, int, int, int], colour: np.ndarray) -> None:
    """Draws a box two pixels wide, as far as the image goes: its own edge and the pixels around that."""
    x1, y1, x2, y2 = box
    rows, columns = slice(max(0, y1 - 1), y2 + 2), slice(max(0, x1 - 1), x2 + 2)
    for y in (slice(max(0, y1 - 1), y1 + 1), slice(y2, y2 + 2)):
        image[y, columns] = colour
    for x in (slice(max(0, x1 - 1), x1 + 1), slice(x2, x2 + 2)):
        image[rows, x] = colour


class Stacks:
    """Layers of frames (lists of runs (start, len), colour and, if drawn, box), as numpy arrays over flat Arrow buffers."""

    def __init__(self, layers: pa.Array):
        flat = layers.flatten()
        self.first = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array(pc.list_value_length(layers), np.float64)).astype(np.int64))])
        runs = flat.field("runs")
        self.runs = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array(pc.list_value_length(runs), np.float64)).astype(np.int64))])
        cells = runs.flatten()
        self.start, self.len = np.asarray(cells.field("start")), np.asarray(cells.field("len"))
        self.colour = np.asarray(flat.field("colour").flatten()).reshape(-1, 3)
        names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
        self.boxes = list(zip(*(flat.field(c).to_pylist() for c in ("drawn", "x1", "y1", "x2", "y2")), strict=True)) if "x1" in names else None

    def blended(self, i: int, rgb: bytes, alpha: float, width: int = 0) -> bytes:
        at = range(self.first[i], self.first[i + 1])
        runs = [(self.start[self.runs[j] : self.runs[j + 1]], self.len[self.runs[j] : self.runs[j + 1]]) for j in at]
        boxes = [b[1:] if b[0] and b[1] is not None else None for b in self.boxes[at.start : at.stop]] if self.boxes else None
        return blended(rgb, runs, [self.colour[j] for j in at], alpha, boxes, width)


def blend_layers(rgb: Column, layers: Column, alpha: float = 0.5) -> Column:
    """binary: interleaved red, green, blue with the layers (runs, colour) on it, in their order. Time is in proportion to
    the pixels of the frame and its runs."""

    @F.arrow_udf("binary")
    def blend(frames: pa.Array, layers: pa.Array) -> pa.Array:
        stacks = Stacks(layers)
        return pa.array([None if f is None else stacks.blended(i, f, alpha) for i, f in enumerate(frames.to_pylist())], pa.binary())

    return blend(rgb, layers)


def overlay(frames: DataFrame, masks: DataFrame, alpha: float = 0.5, rank: str = "obj_id") -> DataFrame:
    """video_id, frame_idx, rgb (interleaved bytes over row-major positions) of frames (rgb); frames without a
    mask stay as they are."""
    layers = composite_order(masks, rank).withColumn("layers", F.transform("layers", lambda x: F.struct(x["runs"].alias("runs"), colour_rgb(x["obj_id"]).alias("colour"))))
    joined = frames.join(layers, ["video_id", "frame_idx"], "left")
    return joined.select("video_id", "frame_idx", F.when(F.col("layers").isNull(), F.col("rgb")).otherwise(blend_layers(F.col("rgb"), F.col("layers"), alpha)).alias("rgb"))
