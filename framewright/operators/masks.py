"""Masks: thresholding, run lengths, boxes. A mask is one row, so none of this shuffles or explodes pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import colour_rgb, label_anchor_y, object_label


def mask_threshold(logits: Column, threshold: float = 0.0) -> Column:
    """Strictly above the threshold, compared as float; NaN is below everything."""
    t = F.lit(threshold).cast("float")
    return F.transform(logits, lambda x: F.coalesce((x > t) & ~F.isnan(x), F.lit(False)))


def positions(mask: Column) -> Column:
    """Row-major positions of true pixels."""
    return F.filter(F.transform(mask, lambda x, i: F.when(x, i)), lambda p: p.isNotNull())


def runs(mask: Column) -> Column:
    """A boolean mask as run lengths over row-major positions."""
    size = F.size(mask)
    starts = F.filter(F.transform(mask, lambda x, i: F.when(x & ((i == 0) | ~F.coalesce(F.get(mask, i - 1), F.lit(False))), i)), lambda p: p.isNotNull())
    ends = F.filter(F.transform(mask, lambda x, i: F.when(x & ((i == size - 1) | ~F.coalesce(F.get(mask, i + 1), F.lit(False))), i)), lambda p: p.isNotNull())
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("len")))


def positions_of_runs(r: Column) -> Column:
    return F.flatten(F.transform(r, lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))


def drop_empty(df: DataFrame, runs_col: str = "runs") -> DataFrame:
    """P2"""
    return df.filter(F.size(runs_col) > 0)


def bbox_of_runs(r: Column, w: Column) -> Column:
    """A4: the tight inclusive box. A run over a row's end spans the whole width."""
    last = lambda x: x["start"] + x["len"] - 1
    row = lambda p: F.floor(p / w)
    over = lambda x: row(x["start"]) < row(last(x))
    return F.struct(
        F.array_min(F.transform(r, lambda x: F.when(over(x), 0).otherwise(x["start"] % w))).cast("int").alias("x1"),
        F.array_min(F.transform(r, lambda x: row(x["start"]))).cast("int").alias("y1"),
        F.array_max(F.transform(r, lambda x: F.when(over(x), w - 1).otherwise(last(x) % w))).cast("int").alias("x2"),
        F.array_max(F.transform(r, lambda x: row(last(x)))).cast("int").alias("y2"),
    )


def masks_of_logits(logits: DataFrame, threshold: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """UD4: video_id, frame_idx, obj_id, w, h, runs and the columns to keep; masks without a pixel stay, as results with an empty
    mask."""
    told = logits.withColumn("_mask", mask_threshold(F.col("logits"), threshold))  # a column: within runs() it would be worked out for each pixel
    return told.select("video_id", "frame_idx", "obj_id", "w", "h", *keep, runs(F.col("_mask")).alias("runs"))


def mask_boxes(masks: DataFrame) -> DataFrame:
    """The box of every mask that has a pixel."""
    area = F.aggregate("runs", F.lit(0), lambda n, x: n + x["len"])
    return drop_empty(masks).select("video_id", "frame_idx", "obj_id", area.cast("bigint").alias("area"), bbox_of_runs(F.col("runs"), F.col("w")).alias("b")).select("video_id", "frame_idx", "obj_id", "area", "b.*")


def mask_map(masks: DataFrame, order: str | None = None) -> DataFrame:
    """Per frame a map of object to mask; of repeated objects the last by `order`, else by the order of the rows, stays."""
    placed = masks.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
    one = placed.groupBy("video_id", "frame_idx", "obj_id").agg(F.max_by("runs", "_at").alias("runs"))
    return one.groupBy("video_id", "frame_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("obj_id", "runs")))).alias("masks"))


def annotations(masks: DataFrame, draw: Column | None = None) -> DataFrame:
    """A row for each box, with colour, and `drawn`: whether `draw` holds (it does without one). Only boxes that
    are drawn have a label and its anchor."""
    drawn = F.lit(True) if draw is None else F.coalesce(draw, F.lit(False))
    boxes = mask_boxes(masks).withColumn("drawn", drawn)
    colour, shown = colour_rgb(F.col("obj_id")), lambda c: F.when(F.col("drawn"), c)
    return boxes.select("video_id", "frame_idx", "obj_id", "x1", "y1", "x2", "y2", "drawn", shown(object_label(F.col("obj_id"))).alias("label"), shown(F.col("x1")).alias("label_x"), shown(label_anchor_y(F.col("y1"))).alias("label_y"), colour[0].alias("r"), colour[1].alias("g"), colour[2].alias("b"))


def composite_order(masks: DataFrame, rank: str = "obj_id") -> DataFrame:
    """O3: per frame the masks as an array in the order in which they cover each other."""
    return masks.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), "obj_id", "runs"))).alias("layers"))

