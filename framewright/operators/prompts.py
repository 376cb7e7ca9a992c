"""Prompts: reading, grouping, ids, click logs, registration order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.scalar import box_of_roi, get_or
from framewright.operators.ranges import in_ranges, ranked, with_carried, within
from framewright.schemas import PROMPT_FILE


def _whole(text: Column) -> Column:
    """'2', '3.9' and 3.9 to a whole number, cut towards 0."""
    return text.try_cast("double").cast("bigint")


def tidy_prompts(parsed: DataFrame, *keys: str) -> DataFrame:
    """Boxes and points of prompt files as one row each, in file order (boxes first). One pass: both lists
    become one array before it is exploded. A missing or null list is empty, frame_idx defaults to 0, label to 1."""
    boxes = F.transform(F.coalesce("boxes", F.array().cast("array<struct<obj_id:string,frame_idx:string,xyxy:array<double>>>")), lambda b: F.struct(F.lit("box").alias("kind"), b["obj_id"].alias("obj_id"), b["frame_idx"].alias("frame_idx"), b["xyxy"].alias("xyxy"), F.lit(None).cast("array<double>").alias("xy"), F.lit(None).cast("string").alias("label")))
    points = F.transform(F.coalesce("points", F.array().cast("array<struct<obj_id:string,frame_idx:string,xy:array<double>,label:string>>")), lambda p: F.struct(F.lit("point").alias("kind"), p["obj_id"].alias("obj_id"), p["frame_idx"].alias("frame_idx"), F.lit(None).cast("array<double>").alias("xyxy"), p["xy"].alias("xy"), get_or(p["label"], "1").alias("label")))
    rows = parsed.select(*keys, F.posexplode(F.concat(boxes, points)).alias("seq", "p"))
    return rows.select(*keys, "p.kind", _whole(F.col("p.obj_id")).alias("obj_id"), get_or(_whole(F.col("p.frame_idx")), 0).alias("frame_idx"), "p.xyxy", "p.xy", _whole(F.col("p.label")).cast("int").alias("label"), "seq")


def parse_prompts(texts: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """S3 on a column of JSON text; unknown keys are ignored."""
    return tidy_prompts(texts.select(*keys, F.from_json(json_col, PROMPT_FILE).alias("j")).select(*keys, "j.*"), *keys)


def union_prompts(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """U1 on two tables."""
    return boxes.unionByName(points, allowMissingColumns=True)


def union_ids(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """U2"""
    return boxes.select("video_id", "obj_id").union(points.select("video_id", "obj_id")).distinct()


def object_ids(prompts: DataFrame) -> DataFrame:
    """A3: the sorted ids of a video."""
    return prompts.groupBy("video_id").agg(F.array_sort(F.collect_set("obj_id")).alias("ids"))


def with_prompts(videos: DataFrame, prompts: DataFrame) -> DataFrame:
    """P5"""
    return videos.join(prompts.select("video_id"), "video_id", "left_semi")


def without_prompts(videos: DataFrame, prompts: DataFrame) -> DataFrame:
    """P5: what has to be rejected."""
    return videos.join(prompts.select("video_id"), "video_id", "left_anti")


def group_points(prompts: DataFrame) -> DataFrame:
    """A2: the points of an object on a frame as two arrays in file order, coordinates as float, labels as int."""
    grouped = prompts.filter("kind = 'point'").groupBy("video_id", "frame_idx", "obj_id").agg(F.array_sort(F.collect_list(F.struct("seq", "xy", "label"))).alias("p"))
    return grouped.select("video_id", "frame_idx", "obj_id", F.transform("p", lambda p: p["xy"].cast("array<float>")).alias("xy"), F.transform("p", lambda p: p["label"]).alias("labels"), F.col("p")[0]["seq"].alias("first_seq"))


def registration_order(prompts: DataFrame) -> DataFrame:
    """The calls in which prompts reach a backend: all boxes in file order, then groups of points as first seen. A later
    call replaces earlier ones of the same object and frame: `effective` is true for the last."""
    boxes = prompts.filter("kind = 'box'").select("video_id", "frame_idx", "obj_id", "kind", F.col("seq").alias("first_seq"))
    calls = boxes.unionByName(group_points(prompts).select("video_id", "frame_idx", "obj_id", F.lit("point").alias("kind"), "first_seq"))
    ranked = calls.withColumn("call", F.row_number().over(W.partitionBy("video_id").orderBy("kind", "first_seq")))
    last = F.max("call").over(W.partitionBy("video_id", "frame_idx", "obj_id"))
    return ranked.select("video_id", "call", "kind", "frame_idx", "obj_id", (F.col("call") == last).alias("effective"))


def roi_boxes(rois: DataFrame, start: int = 1) -> DataFrame:
    """Ids in draw order (video_id, ord, x, y, w, h), counting ROIs without an area, which then go."""
    numbered = ranked(rois, ["video_id"], ["ord"], "_place").withColumn("obj_id", F.lit(start).cast("bigint") + F.col("_place"))
    return numbered.filter("w <> 0 and h <> 0").select("video_id", "obj_id", F.lit(0).cast("bigint").alias("frame_idx"), box_of_roi(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("xyxy"))


def active_objects(log: DataFrame, start: int = 1, parts: int | None = None) -> DataFrame:
    """For each event (session, seq, action: left, right, next, digit, enter, escape; digit) the active object after it.

    A digit starts a segment; the active object is its digit (the start id before the first) plus the `next`s since. A session is
    dealt to ranges of seq: each tells its last digit and the `next`s after it, and begins with what those before it leave."""
    placed = in_ranges(log, ["session"], ["seq"], parts)
    is_digit, is_next = F.col("action") == "digit", F.col("action") == "next"
    rows = placed.withColumn("_segment", F.sum(F.when(is_digit, 1).otherwise(0)).over(within(["session"])))
    own = within(["session", "_segment"])
    rows = rows.withColumn("_base", F.max(F.when(is_digit, F.col("digit"))).over(own)).withColumn("_steps", F.sum(F.when(is_next, 1).otherwise(0)).over(own))
    # of each range what its last event leaves: a digit, if it has one, and the steps after it
    last = rows.groupBy("session", "_part").agg(F.max_by(F.struct("_base", "_steps"), "_at").alias("s")).select("session", "_part", "s.*")
    chain = last.withColumn("_number", F.sum(F.when(F.col("_base").isNotNull(), 1).otherwise(0)).over(W.partitionBy("session").orderBy("_part")))
    chain = chain.withColumn("_sum", F.sum("_steps").over(W.partitionBy("session", "_number").orderBy("_part"))).withColumn("_from", F.max("_base").over(W.partitionBy("session", "_number").orderBy("_part")))
    left = F.coalesce(F.lag(F.coalesce("_from", F.lit(start)) + F.col("_sum")).over(W.partitionBy("session").orderBy("_part")), F.lit(start))
    carried = with_carried(rows, chain.select("session", "_part", left.alias("_carried")), ["session"])
    return carried.withColumn("active", (F.coalesce("_base", "_carried") + F.col("_steps")).cast("bigint")).drop("_segment", "_base", "_steps", "_carried", "_part", "_at")


def terminated(log: DataFrame) -> DataFrame:
    """Events before the first enter or escape; an escape takes its whole session with it."""
    ends = log.filter(F.col("action").isin("enter", "escape")).groupBy("session").agg(F.min("seq").alias("_end"), F.min_by("action", "seq").alias("_how"))
    kept = log.join(ends, "session", "left").filter(F.col("_end").isNull() | ((F.col("seq") < F.col("_end")) & (F.col("_how") == "enter")))
    return kept.drop("_end", "_how")


def click_prompts(log: DataFrame, start: int = 1) -> DataFrame:
    """The points of a log (session, seq, action, digit, x, y): left clicks are foreground, right ones background."""
    points = active_objects(terminated(log), start).filter(F.col("action").isin("left", "right"))
    return points.select(F.col("session").alias("video_id"), F.col("active").alias("obj_id"), F.lit(0).cast("bigint").alias("frame_idx"), "x", "y", F.when(F.col("action") == "left", 1).otherwise(0).alias("label"), "seq")


def empty_sessions(log: DataFrame) -> DataFrame:
    """Sessions that end without a point, which is an error for whoever waits for one."""
    return log.select("session").distinct().join(click_prompts(log).select(F.col("video_id").alias("session")), "session", "left_anti")


def attach_prompts(frames: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompts on the frame that they name."""
    return frames.join(prompts, ["video_id", "frame_idx"], "left")
