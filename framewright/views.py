
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.scalar import bytes_of, gray_to_rgb
from framewright.operators.frames import to_uint8
from framewright.operators.metrics import frame_dt
from framewright.schemas import BACKENDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: str, b: int) -> Column:
    return F.expr(f"{a} div {b}")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grids: `embeddings`."""
    return table(spark, sf_dir, "embeddings").select(_div("vec_id", 100).alias("video_id"), (_div("vec_id", 5) % 20).alias("frame_idx"), (F.col("vec_id") % 5 + 1).alias("obj_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("embedding").alias("logits"))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one channel in two depths: 16-bit whole numbers (even videos' twins) and floats."""
    one = logits(spark, sf_dir).filter("obj_id = 1").select("video_id", "frame_idx", F.transform("logits", lambda x: x.cast("double")).alias("v"))
    whole = one.select("video_id", "frame_idx", F.lit(False).alias("is_float"), F.transform("v", lambda x: F.floor(x * 10000).cast("double")).alias("px"))
    real = one.select("video_id", "frame_idx", F.lit(True).alias("is_float"), F.col("v").alias("px"))
    return whole.unionByName(real).withColumn("bits", F.when(F.col("is_float"), 32).otherwise(16))


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames reduced to eight bits and three channels: rgb, interleaved bytes."""
    gray = to_uint8(raw_frames(spark, sf_dir).filter("not is_float"))
    return gray.select("video_id", "frame_idx", bytes_of(F.flatten(F.transform("px8", gray_to_rgb))).alias("rgb"))


def mask_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box prompt for each object of a video of `logits`, as many frames after the video's first as its number."""
    first = logits(spark, sf_dir).groupBy("video_id", "obj_id").agg(F.min("frame_idx").alias("first"))
    return first.select("video_id", F.lit("box").alias("kind"), "obj_id", (F.col("first") + F.col("obj_id")).alias("frame_idx"), F.lit(None).cast("array<double>").alias("xyxy"), F.lit(None).cast("array<double>").alias("xy"), F.lit(None).cast("int").alias("label"), F.col("obj_id").cast("int").alias("seq"))


def render_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds for each frame of `logits`."""
    one = logits(spark, sf_dir).filter("obj_id = 1")
    return one.select(F.col("video_id").alias("run_id"), "frame_idx", ((F.col("video_id") * 7 + F.col("frame_idx") * 3) % 5 / 1000 + 0.01).alias("dt"))


def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder for each user lists: a frame or, at every tenth k, another file for each event."""
    name = F.when(F.col("k") % 10 == 0, F.format_string("notes_%06d.txt", "seq")).when(F.col("k") % 2 == 0, F.format_string("frame_%06d.tif", "seq")).otherwise(F.format_string("frame_%06d.TIFF", "seq"))
    return events(spark, sf_dir).select(F.col("user_id").alias("video_id"), name.alias("name"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with k, and `seq`, the place within the user's events."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.withColumn("seq", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event of a user, numbered by its name; sizes vary."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("video_id"), F.format_string("frame_%06d.tiff", "seq").alias("name"), (F.col("k") % 3 + 640).cast("int").alias("width"), (F.col("k") % 2 + 480).cast("int").alias("height"), "ts", "value", "k")
    return rows.withColumn("frame_idx", F.regexp_extract("name", r"(\d+)", 1).cast("bigint"))


def event_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_dt(events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("seq").alias("frame_idx"), "ts"))


def timings(spark: SparkSession, sf_dir: str, per: int = 1000) -> DataFrame:
    """A run for each supplier: `lineitem`, a frame's seconds being its quantity over `per`."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.row_number().over(order) - 1).cast("bigint").alias("frame_idx"), (F.col("l_quantity") / per).alias("dt"))


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are left, views right, purchases next, signups a digit; errors from the fourth event on end the log."""
    kind, ends = F.col("event_type"), (F.col("event_type") == "error") & (F.col("seq") >= 4)
    action = F.when(kind == "click", "left").when(kind == "view", "right").when(kind == "purchase", "next").when(kind == "signup", "digit").when(ends & (F.col("k") % 5 == 0), "escape").when(ends, "enter").otherwise("other")
    return events(spark, sf_dir).select(F.col("user_id").alias("session"), "seq", "ts", action.alias("action"), F.when(kind == "signup", F.col("k") % 9 + 1).alias("digit"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt file for each user as JSON text: purchases are boxes, clicks and views points; some fields are left out, ids of
    points are text."""
    e, k = events(spark, sf_dir), F.col("k")
    box = F.struct((k % 5 + 1).alias("obj_id"), F.when(k % 2 == 1, k).alias("frame_idx"), F.array("value", k.cast("double"), F.col("value") + 10, k + 5.0).alias("xyxy"))
    point = F.struct((k % 5 + 1).cast("string").alias("obj_id"), F.when(k % 4 > 0, k % 10).alias("frame_idx"), F.array("value", k.cast("double")).alias("xy"), F.when(k % 3 > 0, k % 2).alias("label"))
    listed = lambda when, x: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", x.alias("x"))))), lambda s: s["x"])
    some = e.groupBy(F.col("user_id").alias("video_id")).agg(listed(F.col("event_type") == "purchase", box).alias("boxes"), listed(F.col("event_type").isin("click", "view"), point).alias("points"))
    return some.select("video_id", F.to_json(F.struct(F.lit("made up").alias("_comment"), F.when(F.size("boxes") > 0, F.col("boxes")).alias("boxes"), F.when(F.size("points") > 0, F.col("points")).alias("points"))).alias("text"))


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("user_id").alias("video_id"), F.col("seq").alias("ord"), F.col("k").alias("x"), (F.col("event_id") % 50).alias("y"), (F.col("k") % 4).alias("w"), (F.col("event_id") % 3).alias("h"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers: every third tells one frame more than there is and no rate."""
    odd = F.col("video_id") % 3 == 0
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("video_id")).agg(F.count("*").alias("n")).select("video_id", F.lit(640).alias("width"), F.lit(480).alias("height"), F.when(odd, 0.0).otherwise(24.0).alias("fps"), (F.col("n") + odd.cast("int")).alias("frame_count"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of runs: `customer`."""
    key = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("job_id"), F.lower("c_mktsegment").alias("tracker"), F.when(key % 13 == 0, "absent").when(key % 13 == 1, "building").alias("config"), F.when(key % 7 == 0, F.concat(F.lit("frames/"), key.cast("string"))).alias("frames_dir"),
        F.when(key % 11 != 0, F.concat(F.lit("in/clip."), key.cast("string"), pick(3, ".mp4", ".avi", ".MP4"))).alias("video_path"), pick(4, "auto", "jpg", "mp4", "auto").alias("video_mode"), (key % 2 == 0).alias("decoder"),
        pick(9, "bf16", "fp16", "fp32", "bfloat16", "float16", "float32", None, "bf16", "int8").alias("precision"), pick(4, "ckpt/a.pt", "/abs/b.pt", "", None).alias("checkpoint"), pick(5, "box", "point", "file", "box", "point").alias("prompt_mode"),
        F.when(key % 4 > 0, F.concat(F.lit("p"), key.cast("string"), F.lit(".json"))).alias("prompts_file"), (key % 6 == 0).alias("multi"),
    )


#: Backends for the stand-in jobs: one of them isn't supported, one has no engine but a plain twin, one no engine and is strict.
BACKEND_ROWS = [
    ("automobile", "automobile", True, "bf16", None, None, None, 0.0),
    ("building", "building", True, "fp16", False, False, "automobile", 0.0),
    ("furniture", None, False, "float32", None, None, None, 0.0),
    ("machinery", "machinery", True, "float32", False, True, "automobile", 0.0),
]


def backends(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BACKEND_ROWS, BACKENDS)


def outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two backends' outputs that differ a little, in places too much, and don't hold all the same keys."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("output"))
    shift = F.when(F.col("vec_id") % 7 == 0, 0.002).otherwise(0.0005)
    other = F.transform("output", lambda x: x + shift)
    other = F.when(F.col("vec_id") % 41 == 0, F.slice(other, 1, 60)).otherwise(other)
    return e.filter("vec_id % 47 <> 0"), e.filter("vec_id % 50 <> 0").select("vec_id", other.alias("output"))
