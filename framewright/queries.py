"""Registered queries of the engine's own operators, and their twins in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import views
from framewright.functions.scalar import PALETTE_BGR, PRECISIONS, byte_at, bytes_of, glob_match, slice_tail, suffix_lower, to_rgb
from framewright.operators import frames as fr
from framewright.operators import jobs, masks, metrics, overlay, parity, prompts
from framewright.plans import annotate as flagship
from framewright.plans.backends import StepBackend, build_backend, run_steps
from framewright.shared import fresh_path
from framewright.sources import frames as sources
from framewright.sources.prompts import write_prompt_files
from framewright.streaming import frames as streams

WARMUP = 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, places: int = 9):
    return F.round(c, places).alias(c)


_MASKS = """
WITH px AS (SELECT vec_id // 100 AS video_id, (vec_id // 5) % 20 AS frame_idx, vec_id % 5 + 1 AS obj_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings),
m AS (SELECT video_id, frame_idx, obj_id, pos, pos % 8 AS x, pos // 8 AS y FROM px WHERE v > 0 AND NOT isnan(v)),
"""
_BOXES = _MASKS + "b AS (SELECT video_id, frame_idx, obj_id, count(*) AS area, CAST(min(x) AS INT) AS x1, CAST(min(y) AS INT) AS y1, CAST(max(x) AS INT) AS x2, CAST(max(y) AS INT) AS y2 FROM m GROUP BY ALL)\n"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_backend("logits")(views.logits(spark, sf_dir))


@query(_BOXES + "SELECT * FROM b")
def mask_bbox(spark, sf_dir):
    """P1, P2, A4"""
    return masks.mask_boxes(_masks(spark, sf_dir))


@query(
    _MASKS
    + """s AS (SELECT *, pos - row_number() OVER (PARTITION BY video_id, frame_idx, obj_id ORDER BY pos) AS g FROM m),
r AS (SELECT video_id, frame_idx, obj_id, min(pos) AS start, count(*) AS n FROM s GROUP BY video_id, frame_idx, obj_id, g)
SELECT video_id, frame_idx, obj_id, string_agg(start || '+' || n, ' ' ORDER BY start) AS runs FROM r GROUP BY ALL"""
)
def mask_runs(spark, sf_dir):
    """P1 as run lengths"""
    text = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit("+"), x["len"].cast("string"))), " ")
    return masks.drop_empty(_masks(spark, sf_dir)).select("video_id", "frame_idx", "obj_id", text.alias("runs"))


@query(
    _MASKS
    + """a AS (SELECT video_id, frame_idx, obj_id, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT DISTINCT video_id, frame_idx, obj_id FROM px)
SELECT video_id, frame_idx, count(*) AS n_objects, string_agg(CAST(obj_id AS VARCHAR), ',' ORDER BY obj_id) AS objects, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY obj_id) AS areas
FROM f LEFT JOIN a USING (video_id, frame_idx, obj_id) GROUP BY ALL"""
)
def mask_map_objects(spark, sf_dir):
    """P1, A7, UD4: objects and areas of each frame's map"""
    m = masks.mask_map(_masks(spark, sf_dir))
    area = lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["len"])
    return m.select("video_id", "frame_idx", F.size("masks").cast("bigint").alias("n_objects"), F.array_join(F.map_keys("masks"), ",").alias("objects"), F.array_join(F.transform(F.map_values("masks"), area), ",").alias("areas"))


@query(
    """WITH l AS (SELECT vec_id // 100 AS video_id, (vec_id // 5) % 20 AS frame_idx, vec_id % 3 AS obj_id, vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS n FROM embeddings),
o AS (SELECT video_id, frame_idx, obj_id, arg_max(n, vec_id) AS n FROM l GROUP BY ALL)
SELECT video_id, frame_idx, string_agg(CAST(obj_id AS VARCHAR), ',' ORDER BY obj_id) AS objects, string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY obj_id) AS areas FROM o GROUP BY ALL"""
)
def mask_map_last(spark, sf_dir):
    """Of an object's several masks on a frame the last stays"""
    rows = views.logits(spark, sf_dir).withColumn("seq", F.col("video_id") * 100 + F.col("frame_idx") * 5 + F.col("obj_id") - 1)
    again = masks.masks_of_logits(rows.withColumn("obj_id", F.col("seq") % 3), keep=("seq",))
    m = masks.mask_map(again, "seq")
    area = lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["len"])
    return m.select("video_id", "frame_idx", F.array_join(F.map_keys("masks"), ",").alias("objects"), F.array_join(F.transform(F.map_values("masks"), area), ",").alias("areas"))


_PX8 = """
WITH v AS (SELECT vec_id // 100 AS video_id, (vec_id // 5) % 20 AS frame_idx, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings WHERE vec_id % 5 = 0),
raw AS (SELECT video_id, frame_idx, false AS is_float, pos, floor(v * 10000) AS v FROM v UNION ALL SELECT video_id, frame_idx, true, pos, v FROM v),
rg AS (SELECT *, min(v) OVER (PARTITION BY video_id, frame_idx, is_float) AS lo, max(v) OVER (PARTITION BY video_id, frame_idx, is_float) AS hi FROM raw),
px8 AS (SELECT *, CAST(CASE WHEN hi = lo THEN 0 WHEN is_float THEN floor((v - lo) * 255.0 / (hi - lo)) ELSE round_even((v - lo) * 255.0 / (hi - lo), 0) END AS INT) AS p FROM rg)
"""


@query(_PX8 + "SELECT video_id, frame_idx, is_float, lo, hi, string_agg(CAST(p AS VARCHAR), ',' ORDER BY pos) AS px FROM px8 GROUP BY ALL")
def depth_to_uint8(spark, sf_dir):
    """A6, P6"""
    return fr.to_uint8(views.raw_frames(spark, sf_dir)).select("video_id", "frame_idx", "is_float", "lo", "hi", F.array_join("px8", ",").alias("px"))


def _frame_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of folders, one a video, of 16-bit frames as files."""
    raw = views.raw_frames(spark, sf_dir).filter("not is_float")
    path = fresh_path(spark, "files")
    shifted = F.transform("px", lambda v: (v + 32768).cast("int"))  # samples of 16 bits aren't negative
    low_first = F.flatten(F.transform(shifted, lambda v: F.array(v % 256, F.floor(v / 256).cast("int"))))
    named = raw.select("video_id", F.format_string("frame_%06d.pgm", "frame_idx").alias("name"), bytes_of(low_first).alias("px"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), "bits")
    sources.write_frame_files(named, path)
    return path


def _reduced(files: DataFrame) -> DataFrame:
    """Decoded frames (video_id, frame_idx, width, height, bits) with px8, one byte a pixel."""
    decoded = sources.decode_frames(files, sources.netpbm, ["video_id", "frame_idx"])
    px8 = fr.samples_to_uint8(F.col("px"), F.col("bits"), F.col("is_float"))
    return decoded.select(F.col("video_id").cast("bigint").alias("video_id"), "frame_idx", "width", "height", "bits", px8.alias("px8"))


@query(_PX8 + "SELECT video_id, frame_idx, 8 AS width, 8 AS height, 16 AS bits, string_agg(CAST(p AS VARCHAR), ',' ORDER BY pos) AS px FROM px8 WHERE NOT is_float GROUP BY ALL")
def frame_files(spark, sf_dir):
    """Frames written as files, scanned by folder and name, decoded and reduced"""
    decoded = _reduced(sources.scan_frames(spark, f"{_frame_files(spark, sf_dir)}/*", "*.pgm"))
    values = F.transform(F.sequence(F.lit(0), F.octet_length("px8") - 1), lambda i: byte_at(F.col("px8"), i))
    return decoded.select("video_id", "frame_idx", "width", "height", "bits", F.array_join(values, ",").alias("px"))


@query(_PX8 + ", m AS (SELECT video_id, frame_idx, pos, p FROM px8 WHERE NOT is_float AND p > 128) SELECT video_id, frame_idx, 0::BIGINT AS obj_id, count(*) AS area, CAST(min(pos % 8) AS INT) AS x1, CAST(min(pos // 8) AS INT) AS y1, CAST(max(pos % 8) AS INT) AS x2, CAST(max(pos // 8) AS INT) AS y2 FROM m GROUP BY ALL")
def streamed_files(spark, sf_dir):
    """S1, S2, P6, A4 on a stream: frame files to decoded frames, to the box of their bright pixels"""
    rows = _reduced(sources.stream_frames(spark, f"{_frame_files(spark, sf_dir)}/*", "*.pgm"))
    bright = F.transform(F.sequence(F.lit(0), F.octet_length("px8") - 1), lambda i: byte_at(F.col("px8"), i) > 128)
    seen = rows.select("video_id", "frame_idx", F.lit(0).cast("bigint").alias("obj_id"), F.col("width").alias("w"), masks.runs(bright).alias("runs"))
    return streams.finish(masks.mask_boxes(seen))


_TIMES_100 = "CAST(floor(embedding[{}]::DOUBLE * 100) AS INT)"


@query(f"SELECT vec_id, vec_id % 4 AS skip, {_TIMES_100.format(3)} AS r, {_TIMES_100.format(2)} AS g, {_TIMES_100.format(1)} AS b, 64 - vec_id % 4 AS n, round(list_sum(list_transform(embedding[vec_id % 4 + 1 :], lambda x: x::DOUBLE)), 9) AS total FROM embeddings")
def pixel_order(spark, sf_dir):
    """Blue, green, red and alpha to red, green, blue; what is left of an array after its first values"""
    e = views.table(spark, sf_dir, "embeddings").withColumn("skip", F.col("vec_id") % 4)
    px = to_rgb(F.transform(F.slice("embedding", 1, 4), lambda v: F.floor(v.cast("double") * 100).cast("int")))
    tail = slice_tail(F.transform("embedding", lambda v: v.cast("double")), F.col("skip").cast("int"))
    return e.select("vec_id", "skip", px[0].alias("r"), px[1].alias("g"), px[2].alias("b"), F.size(tail).cast("bigint").alias("n"), F.round(F.aggregate(tail, F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


_LOGITS_SQL = "SELECT vec_id // 100 AS video_id, (vec_id // 5) % 20 AS frame_idx, vec_id % 5 + 1 AS obj_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings"


def _overlay_sql(when: str = "true", cte: str = "", drawn: str = "false", logits: str = _LOGITS_SQL) -> str:
    """Pixels of all frames, in s5. when: which masks count; drawn: on which frames the boxes are drawn, each after its mask."""
    flags = ", ".join(f"bool_or(obj_id = {o} AND v > 0 AND {when}) AS o{o}" for o in range(1, 6))
    edge = lambda o: ", ".join(f"{f}(pos {p}) FILTER (obj_id = {o} AND v > 0 AND {when}) AS {c}_{o}" for f, p, c in (("min", "% 8", "x1"), ("min", "// 8", "y1"), ("max", "% 8", "x2"), ("max", "// 8", "y2")))
    steps, last = [], "base"
    for o in range(1, 6):
        near = lambda at, a, b: f"{at} BETWEEN {a}_{o} - 1 AND {b}_{o} + 1"  # noqa: E731, B023
        on = lambda at, a, b: f"{at} IN ({a}_{o} - 1, {a}_{o}, {b}_{o}, {b}_{o} + 1)"  # noqa: E731, B023
        line = f"{drawn} AND {near('pos % 8', 'x1', 'x2')} AND {near('pos // 8', 'y1', 'y2')} AND ({on('pos % 8', 'x1', 'x2')} OR {on('pos // 8', 'y1', 'y2')})"
        cols = ", ".join(f"CASE WHEN {line} THEN {PALETTE_BGR[o - 1][2 - i]} WHEN o{o} THEN floor(0.5 * {PALETTE_BGR[o - 1][2 - i]} + (1 - 0.5) * {c}) ELSE {c} END AS {c}" for i, c in enumerate("rgb"))
        steps.append(f"s{o} AS (SELECT * REPLACE ({cols}) FROM {last})")
        last = f"s{o}"
    return (
        _PX8
        + f""", lg AS ({logits}),
{cte}fl AS (SELECT video_id, frame_idx, pos, {flags} FROM lg GROUP BY ALL),
bo AS (SELECT video_id, frame_idx, {", ".join(map(edge, range(1, 6)))} FROM lg GROUP BY ALL),
base AS (SELECT fl.*, bo.* EXCLUDE (video_id, frame_idx), CAST(p AS DOUBLE) AS r, CAST(p AS DOUBLE) AS g, CAST(p AS DOUBLE) AS b FROM px8 JOIN fl USING (video_id, frame_idx, pos) JOIN bo USING (video_id, frame_idx) WHERE NOT is_float),
"""
        + ",\n".join(steps)
    )


@query(_overlay_sql() + " SELECT video_id, frame_idx, CAST(pos AS INT) AS pos, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM s5")
def overlay_blend(spark, sf_dir):
    """J1, J5, O3, F6, F7"""
    out = overlay.overlay(views.rgb_frames(spark, sf_dir), _masks(spark, sf_dir))
    pixels = out.select("video_id", "frame_idx", "rgb", F.explode(F.sequence(F.lit(0), (F.octet_length("rgb") / 3).cast("int") - 1)).alias("pos"))
    return pixels.select("video_id", "frame_idx", "pos", *[byte_at(F.col("rgb"), F.col("pos") * 3 + i).alias(c) for i, c in enumerate("rgb")])


def _colour_sql(channel: int) -> str:
    return "CASE (obj_id - 1) % 6 " + " ".join(f"WHEN {i} THEN {c[2 - channel]}" for i, c in enumerate(PALETTE_BGR)) + " END"


_DRAWN = "video_id % 2 = 0"
_ANNOTATIONS = f"SELECT video_id, frame_idx, obj_id, x1, y1, x2, y2, {_DRAWN} AS drawn, CASE WHEN {_DRAWN} THEN 'id=' || obj_id END AS label, CASE WHEN {_DRAWN} THEN x1 END AS label_x, CASE WHEN {_DRAWN} THEN greatest(0, y1 - 6) END AS label_y, {_colour_sql(0)} AS r, {_colour_sql(1)} AS g, {_colour_sql(2)} AS b FROM b"


@query(_BOXES + _ANNOTATIONS)
def annotations(spark, sf_dir):
    """Boxes are drawn on videos of even number"""
    return masks.annotations(_masks(spark, sf_dir), F.expr(_DRAWN))


_PROMPTED = "pr AS (SELECT video_id, obj_id, min(frame_idx) + obj_id AS since FROM (SELECT DISTINCT video_id, frame_idx, obj_id FROM lg) GROUP BY video_id, obj_id),\n"
_RUN_SQL = (
    _overlay_sql("frame_idx >= (SELECT since FROM pr WHERE pr.video_id = lg.video_id AND pr.obj_id = lg.obj_id)", _PROMPTED, _DRAWN)
    + f""", res AS (SELECT DISTINCT lg.video_id, lg.frame_idx FROM lg JOIN pr USING (video_id, obj_id) WHERE lg.frame_idx >= since),
px AS (SELECT video_id, frame_idx, string_agg(printf('%02X%02X%02X', CAST(r AS INT), CAST(g AS INT), CAST(b AS INT)), '' ORDER BY pos) AS px FROM s5 JOIN res USING (video_id, frame_idx) GROUP BY ALL),
b AS (SELECT video_id, frame_idx, obj_id, min(pos % 8) AS x1, min(pos // 8) AS y1, max(pos % 8) AS x2, max(pos // 8) AS y2 FROM lg JOIN pr USING (video_id, obj_id) WHERE v > 0 AND frame_idx >= since GROUP BY ALL),
bx AS (SELECT video_id, frame_idx, string_agg(obj_id || ':' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || CASE WHEN {_DRAWN} THEN ' id=' || obj_id ELSE '' END, ' ' ORDER BY obj_id) AS boxes FROM b GROUP BY ALL),
tm AS (SELECT video_id, frame_idx, (video_id * 7 + frame_idx * 3) % 5 / 1000 + 0.01 AS dt FROM (SELECT DISTINCT video_id, frame_idx FROM lg WHERE obj_id = 1)),
fp AS (SELECT video_id, count(*) AS frames, round(count(*) / sum(dt), 6) AS avg_fps_all, round(count(*) FILTER (frame_idx >= least({WARMUP}, n - 1)) / sum(dt) FILTER (frame_idx >= least({WARMUP}, n - 1)), 6) AS avg_fps_post_warmup FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM tm) GROUP BY video_id)
SELECT video_id, frame_idx, row_number() OVER (ORDER BY video_id, frame_idx) - 1 AS place, px, coalesce(boxes, '') AS boxes, frames, avg_fps_all, avg_fps_post_warmup FROM px LEFT JOIN bx USING (video_id, frame_idx) LEFT JOIN fp USING (video_id)
"""
)


def _boxes_as_text() -> Column:
    text = lambda b: F.concat(b["obj_id"].cast("string"), F.lit(":"), F.concat_ws(",", b["x1"], b["y1"], b["x2"], b["y2"]), F.coalesce(F.concat(F.lit(" "), b["label"]), F.lit("")))
    return F.coalesce(F.array_join(F.transform("boxes", text), " "), F.lit("")).alias("boxes")


@query(_RUN_SQL)
def annotate(spark, sf_dir):
    """The flagship: prompts, frames and a backend to rendered pixels with outlines, boxes and timing, through the sink; place: where
    a row stands in the files"""
    told = views.mask_prompts(spark, sf_dir)
    run = flagship.annotate(views.rgb_frames(spark, sf_dir), told, views.render_timings(spark, sf_dir), inputs={"logits": views.logits(spark, sf_dir), "prompts": told}, draw=F.expr(_DRAWN), warmup=WARMUP, size=32)
    path = fresh_path(spark, "annotated")
    flagship.write_run(run, path)
    return sources.read_results(spark, path).select("video_id", "frame_idx", "place", F.hex("rgb").alias("px"), _boxes_as_text(), "frames", _r("avg_fps_all", 6), _r("avg_fps_post_warmup", 6))


class _Bright(StepBackend):
    """UD2: of each object the pixels over 128 within its box, from the frame of its prompt on."""

    def init(self, video_id, prompts):
        return [(int(p.obj_id), int(p.frame_idx), [int(v) for v in p.xyxy]) for p in prompts.itertuples()]

    def step(self, state, frame):
        out = []
        for obj_id, since, (x1, y1, x2, y2) in state:
            if frame.frame_idx >= since:
                inside = [x1 <= i % frame.width < x2 and y1 <= i // frame.width < y2 for i in range(len(frame.px8))]
                out.append((obj_id, [float(v - 128) if yes else -1.0 for v, yes in zip(frame.px8, inside, strict=True)]))
        return state, out


_FILES_SQL = (
    _overlay_sql(drawn="true", logits="SELECT video_id, frame_idx, o AS obj_id, CASE WHEN p > 128 AND pos % 8 >= o - 1 AND pos % 8 < o + 4 AND pos // 8 < o + 4 THEN 1 ELSE -1 END AS v, pos FROM px8, (VALUES (1), (2), (3)) t(o) WHERE NOT is_float AND frame_idx >= o")
    + """, px AS (SELECT video_id, frame_idx, string_agg(printf('%02X%02X%02X', CAST(r AS INT), CAST(g AS INT), CAST(b AS INT)), '' ORDER BY pos) AS px FROM s5 GROUP BY ALL),
b AS (SELECT video_id, frame_idx, obj_id, min(pos % 8) AS x1, min(pos // 8) AS y1, max(pos % 8) AS x2, max(pos // 8) AS y2 FROM lg WHERE v > 0 GROUP BY ALL),
bx AS (SELECT video_id, frame_idx, string_agg(obj_id || ':' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ' id=' || obj_id, ' ' ORDER BY obj_id) AS boxes FROM b GROUP BY ALL)
SELECT video_id, frame_idx, row_number() OVER (ORDER BY video_id, frame_idx) - 1 AS place, px, coalesce(boxes, '') AS boxes FROM px LEFT JOIN bx USING (video_id, frame_idx)"""
)


@query(_FILES_SQL)
def annotate_files(spark, sf_dir):
    """A whole run: a folder of frame files for each video and a prompt file for each, a backend that steps through the frames, and the
    ordered sink"""
    videos = views.logits(spark, sf_dir).select("video_id").distinct()
    box = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda o: F.struct(o.alias("obj_id"), o.alias("frame_idx"), F.array(o - 1, F.lit(0), o + 4, o + 4).alias("xyxy")))
    told = fresh_path(spark, "told")
    write_prompt_files(videos.select(F.concat("video_id", F.lit(".json")).alias("name"), F.to_json(F.struct(box.alias("boxes"))).alias("text")), told)
    run = flagship.run_files(spark, f"{_frame_files(spark, sf_dir)}/*", told, _Bright, pattern="*.pgm", size=40, video=lambda name: name.cast("bigint"))
    path = fresh_path(spark, "run")
    flagship.write_run(run, path)
    return sources.read_results(spark, path).select("video_id", "frame_idx", "place", F.hex("rgb").alias("px"), _boxes_as_text())


_TIMINGS = "WITH t AS MATERIALIZED (SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS frame_idx, l_quantity / 1000 AS dt FROM lineitem)"
_SUMMARY = (
    _TIMINGS
    + f""", n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM t),
w AS (SELECT *, CASE WHEN n > 1 THEN greatest(0, least({WARMUP}, n - 1)) ELSE 0 END AS w FROM n),
s AS (SELECT run_id, count(*) AS frames, sum(dt) AS total_s, CASE WHEN sum(dt) > 0 THEN count(*) / sum(dt) ELSE 0 END AS avg_fps_all, CAST(max(w) AS BIGINT) AS warmup, CAST(count(*) - max(w) AS BIGINT) AS kept_frames,
      CASE WHEN sum(CASE WHEN frame_idx >= w THEN dt END) > 0 THEN (count(*) - max(w)) / sum(CASE WHEN frame_idx >= w THEN dt END) ELSE 0 END AS avg_fps_post_warmup FROM w GROUP BY run_id)
"""
)


@query(_SUMMARY + "SELECT run_id, frames, round(total_s, 9) AS total_s, round(avg_fps_all, 9) AS avg_fps_all, warmup, kept_frames, round(avg_fps_post_warmup, 9) AS avg_fps_post_warmup FROM s")
def fps_summary(spark, sf_dir):
    """A1, W3, F5"""
    return metrics.fps_summary(views.timings(spark, sf_dir), WARMUP).select("run_id", "frames", _r("total_s"), _r("avg_fps_all"), "warmup", "kept_frames", _r("avg_fps_post_warmup"))


@query(
    _TIMINGS.replace(" MATERIALIZED", "")
    + f""", n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM t), w AS (SELECT *, CASE WHEN n > 1 THEN greatest(0, least({WARMUP}, n - 1)) ELSE 0 END AS w FROM n),
k AS (SELECT *, sum(CASE WHEN frame_idx >= w THEN dt END) OVER (PARTITION BY run_id) AS kept FROM w)
SELECT run_id, frame_idx, round(CASE WHEN dt > 0 THEN 1 / dt ELSE 0 END, 9) AS fps, CASE WHEN w > 0 THEN -0.5::DOUBLE END AS span_lo, CASE WHEN w > 0 THEN (w - 0.5)::DOUBLE END AS span_hi, CASE WHEN kept > 0 THEN round((n - w) / kept, 9) END AS avg_line FROM k"""
)
def fps_series(spark, sf_dir):
    """S10, P10"""
    return metrics.fps_series(views.timings(spark, sf_dir), WARMUP).select("run_id", "frame_idx", _r("fps"), F.col("span_lo").cast("double").alias("span_lo"), F.col("span_hi").cast("double").alias("span_hi"), _r("avg_line"))


@query(_SUMMARY.replace("l_quantity / 1000", "l_quantity / 997") + "SELECT run_id, 0 AS line_no, format('tracked {:d} frames in {:.2f}s ({:.1f} FPS all)', frames, total_s, avg_fps_all) AS line FROM s UNION ALL SELECT run_id, 1, format('avg {:.1f} FPS over {:d} frames (excluded first {:d} warm-up)', avg_fps_post_warmup, kept_frames, warmup) FROM s WHERE warmup > 0")
def fps_report(spark, sf_dir):
    """S9, F10; seconds that don't end in a 5 leave no doubt in rounding"""
    return metrics.fps_report(metrics.fps_summary(views.timings(spark, sf_dir, 997), WARMUP))


@query(_TIMINGS + f", n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM t) SELECT run_id, frame_idx, dt FROM n WHERE frame_idx >= CASE WHEN n > 1 THEN greatest(0, least({WARMUP}, n - 1)) ELSE 0 END")
def exclude_warmup(spark, sf_dir):
    """W3"""
    return metrics.exclude_warmup(views.timings(spark, sf_dir), WARMUP)


_EVENTS = """WITH e AS (SELECT *, CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)"""


@query(_EVENTS + " SELECT user_id AS run_id, seq AS frame_idx, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY seq)) / 1e6, 9) AS dt FROM e")
def frame_dt(spark, sf_dir):
    """W2"""
    return views.event_timings(spark, sf_dir).select("run_id", "frame_idx", _r("dt"))


_FRAMES = _EVENTS + ", f AS (SELECT user_id AS video_id, printf('frame_%06d.tiff', seq) AS name, row_number() OVER (PARTITION BY user_id ORDER BY printf('frame_%06d.tiff', seq)) - 1 AS frame_idx, CAST(k % 3 + 640 AS INT) AS width, CAST(k % 2 + 480 AS INT) AS height, k FROM e)"


@query(
    _EVENTS
    + """, n AS (SELECT user_id AS video_id, CASE WHEN k % 10 = 0 THEN printf('notes_%06d.txt', seq) WHEN k % 2 = 0 THEN printf('frame_%06d.tif', seq) ELSE printf('frame_%06d.TIFF', seq) END AS name FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY name) - 1 AS frame_idx FROM n WHERE lower(name) LIKE '%.tif%')
SELECT video_id, name, frame_idx, printf('%05d.jpg', frame_idx) AS cache_name, lower(regexp_extract(name, '\\.[^.]+$')) AS suffix FROM g"""
)
def frame_index(spark, sf_dir):
    """S1 on a listing, W1, O4, F1, F2, F4"""
    listed = views.frame_names(spark, sf_dir).filter(glob_match(F.lower("name"), "*.tif*"))
    return fr.assign_frame_idx(listed, ["name"]).select("video_id", "name", "frame_idx", "cache_name", suffix_lower(F.col("name")).alias("suffix"))


@query(_FRAMES + " SELECT video_id, frame_idx, name, width, height FROM f WHERE frame_idx = 0")
def first_frame(spark, sf_dir):
    """O2"""
    return fr.first_frame(views.frames(spark, sf_dir).select("video_id", "frame_idx", "name", "width", "height"))


@query(_FRAMES + " SELECT video_id, CAST(arg_min(width, frame_idx) AS INT) AS width, CAST(arg_min(height, frame_idx) AS INT) AS height, count(*) AS frame_count, 30.0::DOUBLE AS fps FROM f GROUP BY video_id")
def sequence_catalog(spark, sf_dir):
    """S5"""
    return fr.sequence_catalog(views.frames(spark, sf_dir))


@query(_EVENTS + " SELECT user_id AS video_id, 640 AS width, 480 AS height, CASE WHEN user_id % 3 = 0 THEN 30.0 ELSE 24.0 END::DOUBLE AS fps, count(*) + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS frame_count FROM e GROUP BY user_id")
def video_catalog(spark, sf_dir):
    """S4, P9"""
    return fr.video_catalog(views.videos(spark, sf_dir))


_PROMPTS = (
    _EVENTS
    + """, p AS (
SELECT user_id AS video_id, 'box' AS kind, CAST(k % 5 + 1 AS BIGINT) AS obj_id, CAST(CASE WHEN k % 2 = 1 THEN k ELSE 0 END AS BIGINT) AS frame_idx, value AS a, k::DOUBLE AS b, value + 10 AS c, k + 5.0::DOUBLE AS d, NULL::INT AS label, seq AS ord, 0 AS part FROM e WHERE event_type = 'purchase'
UNION ALL SELECT user_id, 'point', k % 5 + 1, CASE WHEN k % 4 > 0 THEN k % 10 ELSE 0 END, value, k::DOUBLE, NULL, NULL, CAST(CASE WHEN k % 3 > 0 THEN k % 2 ELSE 1 END AS INT), seq, 1 FROM e WHERE event_type IN ('click', 'view')),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY part, ord) - 1 AS INT) AS seq FROM p)
"""
)


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.parse_prompts(views.prompt_texts(spark, sf_dir), "text", "video_id")


@query(_PROMPTS + "SELECT video_id, kind, obj_id, frame_idx, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c, round(d, 9) AS d, label, seq FROM q")
def prompt_parse(spark, sf_dir):
    """S3, F11, U1"""
    at = lambda i: F.round(F.coalesce(F.get("xyxy", i), F.get("xy", i)), 9)
    return _prompts(spark, sf_dir).select("video_id", "kind", "obj_id", "frame_idx", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), at(3).alias("d"), "label", "seq")


@query(_PROMPTS + "SELECT video_id, frame_idx, obj_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY seq) AS labels, string_agg(CAST(CAST(b AS BIGINT) AS VARCHAR), ',' ORDER BY seq) AS ys, min(seq) AS first_seq FROM q WHERE kind = 'point' GROUP BY ALL")
def prompt_groups(spark, sf_dir):
    """A2"""
    g = prompts.group_points(_prompts(spark, sf_dir))
    return g.select("video_id", "frame_idx", "obj_id", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("xy", lambda p: p[1].cast("bigint")), ",").alias("ys"), "first_seq")


@query(_PROMPTS + "SELECT video_id, string_agg(CAST(obj_id AS VARCHAR), ',' ORDER BY obj_id) AS ids FROM (SELECT DISTINCT video_id, obj_id FROM q) GROUP BY ALL")
def object_ids(spark, sf_dir):
    """A3"""
    return prompts.object_ids(_prompts(spark, sf_dir)).select("video_id", F.array_join("ids", ",").alias("ids"))


@query(_PROMPTS + "SELECT video_id, obj_id FROM q WHERE kind = 'box' UNION SELECT video_id, obj_id FROM q WHERE kind = 'point'")
def union_ids(spark, sf_dir):
    """U2"""
    p = _prompts(spark, sf_dir)
    return prompts.union_ids(p.filter("kind = 'box'"), p.filter("kind = 'point'"))


@query(_PROMPTS + ", u AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS video_id, EXISTS (SELECT 1 FROM q WHERE q.video_id = user_id AND kind = 'box') AS prompted FROM u")
def prompts_nonempty(spark, sf_dir):
    """P5 for boxes: videos with and without any"""
    v, p = views.videos(spark, sf_dir).select("video_id"), _prompts(spark, sf_dir).filter("kind = 'box'")
    return prompts.with_prompts(v, p).withColumn("prompted", F.lit(True)).unionByName(prompts.without_prompts(v, p).withColumn("prompted", F.lit(False)))


@query(_EVENTS + ", r AS (SELECT user_id AS video_id, k AS x, event_id % 50 AS y, k % 4 AS w, event_id % 3 AS h, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS obj_id FROM e WHERE event_type = 'purchase') SELECT video_id, CAST(obj_id AS BIGINT) AS obj_id, 0::BIGINT AS frame_idx, x::DOUBLE AS x1, y::DOUBLE AS y1, (x + w)::DOUBLE AS x2, (y + h)::DOUBLE AS y2 FROM r WHERE w <> 0 AND h <> 0")
def roi_boxes(spark, sf_dir):
    """W6, P3, P4"""
    return prompts.roi_boxes(views.rois(spark, sf_dir)).select("video_id", "obj_id", "frame_idx", *[F.col("xyxy")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


_CLICKS = (
    _EVENTS
    + """, l AS (SELECT user_id AS session, seq, value AS x, k::DOUBLE AS y, CASE WHEN event_type = 'signup' THEN k % 9 + 1 END AS digit,
CASE event_type WHEN 'click' THEN 'left' WHEN 'view' THEN 'right' WHEN 'purchase' THEN 'next' WHEN 'signup' THEN 'digit' ELSE CASE WHEN seq >= 4 AND k % 5 = 0 THEN 'escape' WHEN seq >= 4 THEN 'enter' ELSE 'other' END END AS action FROM e),
t AS (SELECT session, min(seq) AS stop, arg_min(action, seq) AS how FROM l WHERE action IN ('enter', 'escape') GROUP BY session),
kept AS (SELECT l.* FROM l LEFT JOIN t USING (session) WHERE stop IS NULL OR (seq < stop AND how = 'enter')),
g AS (SELECT *, sum(CASE WHEN action = 'digit' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS seg FROM kept),
a AS (SELECT *, coalesce(max(digit) OVER (PARTITION BY session, seg ORDER BY seq), 1) + sum(CASE WHEN action = 'next' THEN 1 ELSE 0 END) OVER (PARTITION BY session, seg ORDER BY seq) AS active FROM g)
"""
)
_POINTS = _CLICKS + "SELECT session AS video_id, CAST(active AS BIGINT) AS obj_id, 0::BIGINT AS frame_idx, x, y, CASE WHEN action = 'left' THEN 1 ELSE 0 END AS label, seq FROM a WHERE action IN ('left', 'right')"


@query(_POINTS)
def click_prompts(spark, sf_dir):
    """W4, W5"""
    return prompts.click_prompts(views.click_log(spark, sf_dir))


@query(_PROMPTS + """, c AS (SELECT video_id, frame_idx, obj_id, kind, seq AS first_seq FROM q WHERE kind = 'box' UNION ALL SELECT video_id, frame_idx, obj_id, kind, min(seq) FROM q WHERE kind = 'point' GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY kind, first_seq) AS INT) AS call FROM c)
SELECT video_id, call, kind, frame_idx, obj_id, call = max(call) OVER (PARTITION BY video_id, frame_idx, obj_id) AS effective FROM r""")
def registration_order(spark, sf_dir):
    """W7"""
    return prompts.registration_order(_prompts(spark, sf_dir))


_ALIASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PRECISIONS.items())
_JOBS = f"""
WITH j AS (SELECT c_custkey AS job_id, lower(c_mktsegment) AS tracker, CASE WHEN c_custkey % 13 = 0 THEN 'absent' WHEN c_custkey % 13 = 1 THEN 'building' END AS config, CASE WHEN c_custkey % 7 = 0 THEN 'frames/' || c_custkey END AS frames_dir,
CASE WHEN c_custkey % 11 <> 0 THEN 'in/clip.' || c_custkey || ['.mp4', '.avi', '.MP4'][c_custkey % 3 + 1] END AS video_path, ['auto', 'jpg', 'mp4', 'auto'][c_custkey % 4 + 1] AS video_mode, c_custkey % 2 = 0 AS decoder,
['bf16', 'fp16', 'fp32', 'bfloat16', 'float16', 'float32', NULL, 'bf16', 'int8'][c_custkey % 9 + 1] AS precision, ['ckpt/a.pt', '/abs/b.pt', '', NULL][c_custkey % 4 + 1] AS checkpoint, ['box', 'point', 'file', 'box', 'point'][c_custkey % 5 + 1] AS prompt_mode,
CASE WHEN c_custkey % 4 > 0 THEN 'p' || c_custkey || '.json' END AS prompts_file, c_custkey % 6 = 0 AS multi FROM customer),
b(name, config, supported, own, engine_ok, strict, fallback) AS (VALUES ('automobile', 'automobile', true, 'bf16', NULL, NULL, NULL), ('building', 'building', true, 'fp16', false, false, 'automobile'), ('furniture', NULL, false, 'float32', NULL, NULL, NULL), ('machinery', 'machinery', true, 'float32', false, true, 'automobile')),
x AS (SELECT j.*, b.name, b.supported, b.engine_ok, b.strict, b.fallback, coalesce(j.config, j.tracker) AS used, CASE coalesce(j.precision, b.own) {_ALIASES} ELSE coalesce(j.precision, b.own) END AS prec,
lower(CASE WHEN regexp_matches(video_path, '[^./]\\.[^./]+$') THEN '.' || regexp_extract(video_path, '\\.([^./]+)$', 1) ELSE '' END) AS suffix FROM j LEFT JOIN b ON j.tracker = b.name),
y AS (SELECT *, CASE WHEN used NOT IN (SELECT config FROM b WHERE config IS NOT NULL) THEN 'no config ' || used WHEN name IS NULL THEN 'unknown backend ' || tracker
WHEN prec NOT IN ('bfloat16', 'float16', 'float32') THEN 'unsupported precision ' || coalesce(precision, prec)
WHEN prompt_mode = 'file' AND coalesce(prompts_file, '') = '' THEN 'file mode needs a prompt file'
WHEN frames_dir IS NULL AND video_path IS NULL THEN 'needs a video or a frame directory'
WHEN frames_dir IS NULL AND video_mode = 'mp4' AND suffix <> '.mp4' THEN 'only .mp4 files can be read as mp4, not ' || suffix
WHEN frames_dir IS NULL AND video_mode = 'mp4' AND NOT decoder THEN 'mp4 mode needs a decoder'
WHEN NOT supported THEN 'backend not supported: ' || tracker WHEN engine_ok = false AND strict THEN 'engine unavailable for ' || tracker END AS error FROM x)
"""


@query(
    _JOBS
    + """SELECT job_id, CASE WHEN error IS NULL THEN CASE WHEN frames_dir IS NOT NULL THEN 'frames' ELSE 'video' END END AS source,
CASE WHEN error IS NULL AND frames_dir IS NULL THEN CASE WHEN video_mode = 'jpg' THEN 'jpg' WHEN suffix = '.mp4' AND decoder THEN 'mp4' ELSE 'jpg' END END AS mode,
CASE WHEN error IS NULL THEN CASE WHEN engine_ok = false AND NOT strict THEN fallback ELSE tracker END END AS backend, CASE WHEN error IS NULL THEN prec END AS precision,
CASE WHEN error IS NULL THEN CASE WHEN checkpoint = '' OR starts_with(checkpoint, '/') THEN checkpoint ELSE '/srv/run/' || checkpoint END END AS checkpoint,
CASE WHEN error IS NULL THEN CASE WHEN prompt_mode = 'file' THEN prompts_file WHEN multi THEN prompt_mode || ' (multi)' ELSE prompt_mode END END AS prompt_source, error FROM y"""
)
def job_resolution(spark, sf_dir):
    """P7, P8, P11-P14, F1, J4, S6, UD5"""
    return jobs.resolve(views.jobs(spark, sf_dir), views.backends(spark))


@query("SELECT c_custkey AS job_id, lower(c_mktsegment) AS tracker, 'automobile,building,furniture,machinery' AS known FROM customer WHERE lower(c_mktsegment) NOT IN ('automobile', 'building', 'furniture', 'machinery')")
def unknown_backends(spark, sf_dir):
    """J4"""
    b = views.backends(spark)
    names = F.lit(",".join(jobs.known_backends(b).first().known))
    return jobs.unknown_backends(views.jobs(spark, sf_dir), b).select("job_id", "tracker", names.alias("known"))


_CARRY = (
    _EVENTS
    + """, b AS (SELECT user_id AS video_id, seq AS frame_idx, CAST(k % 3 + 1 AS BIGINT) AS obj_id, value AS x, k::DOUBLE AS y FROM e WHERE event_type = 'purchase'),
o AS (SELECT DISTINCT video_id, obj_id FROM b), g AS (SELECT e.user_id AS video_id, e.seq AS frame_idx, o.obj_id FROM e JOIN o ON o.video_id = e.user_id)
"""
)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box prompt on its own frame for each purchase."""
    e = views.events(spark, sf_dir).filter("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("video_id"), F.col("seq").alias("frame_idx"), F.lit("box").alias("kind"), (F.col("k") % 3 + 1).cast("bigint").alias("obj_id"), F.array("value", F.col("k").cast("double")).alias("xyxy"), F.lit(None).cast("array<double>").alias("xy"), F.lit(None).cast("int").alias("label"), F.col("seq").cast("int").alias("seq"))


@query(_CARRY + "SELECT g.video_id, g.frame_idx, g.obj_id, last_value(b.x IGNORE NULLS) OVER w AS x, last_value(b.y IGNORE NULLS) OVER w AS y FROM g LEFT JOIN b USING (video_id, frame_idx, obj_id) WINDOW w AS (PARTITION BY g.video_id, g.obj_id ORDER BY g.frame_idx ROWS UNBOUNDED PRECEDING)")
def carry_forward(spark, sf_dir):
    """UD3"""
    out = build_backend("carry")(views.frames(spark, sf_dir), _boxes(spark, sf_dir))
    return out.select("video_id", "frame_idx", "obj_id", F.col("xyxy")[0].alias("x"), F.col("xyxy")[1].alias("y"))


@query(_CARRY + "SELECT e.user_id AS video_id, e.seq AS frame_idx, b.obj_id, b.x, b.y FROM e LEFT JOIN b ON b.video_id = e.user_id AND b.frame_idx = e.seq")
def attach_prompts(spark, sf_dir):
    """J3"""
    out = prompts.attach_prompts(views.frames(spark, sf_dir).select("video_id", "frame_idx"), _boxes(spark, sf_dir))
    return out.select("video_id", "frame_idx", "obj_id", F.col("xyxy")[0].alias("x"), F.col("xyxy")[1].alias("y"))


_JOINED = _FRAMES + ", decoded AS (SELECT * FROM f WHERE k <> 50), results AS (SELECT video_id, frame_idx FROM f WHERE k % 3 <> 0)"


def _decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = views.frames(spark, sf_dir)
    return f.filter("k <> 50").select("video_id", "frame_idx", "name"), f.filter("k % 3 <> 0").select("video_id", "frame_idx")


@query(_JOINED + " SELECT video_id, frame_idx, name FROM results JOIN decoded USING (video_id, frame_idx)")
def join_results(spark, sf_dir):
    """J1"""
    decoded, results = _decoded(spark, sf_dir)
    return fr.join_results(results, decoded)


@query(_JOINED + ", gap AS (SELECT video_id, min(frame_idx) AS stop FROM f WHERE k = 50 GROUP BY video_id) SELECT video_id, frame_idx, name FROM results JOIN decoded USING (video_id, frame_idx) LEFT JOIN gap USING (video_id) WHERE stop IS NULL OR frame_idx < stop")
def sequential_join(spark, sf_dir):
    """J2"""
    decoded, results = _decoded(spark, sf_dir)
    return fr.join_sequential(results, decoded)


@query(_JOINED + """, v AS (SELECT video_id, count(*) + CASE WHEN video_id % 3 = 0 THEN 1 ELSE 0 END AS frame_count FROM f GROUP BY video_id)
SELECT video_id, frame_count, coalesce(d.n, 0) AS decoded, coalesce(r.n, 0) AS results, round(coalesce(r.n, 0) / frame_count, 9) AS share, coalesce(d.n, 0) <> frame_count AS mismatch
FROM v LEFT JOIN (SELECT video_id, count(*) AS n FROM decoded GROUP BY ALL) d USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n FROM results GROUP BY ALL) r USING (video_id)""")
def coverage(spark, sf_dir):
    """A5"""
    decoded, results = _decoded(spark, sf_dir)
    return fr.coverage(results, decoded, views.videos(spark, sf_dir)).withColumn("share", F.round("share", 9))


_PARITY = """
WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos, len(embedding) AS n FROM embeddings WHERE vec_id % 47 <> 0),
b AS (SELECT vec_id, unnest(embedding)::DOUBLE + CASE WHEN vec_id % 7 = 0 THEN 0.002 ELSE 0.0005 END AS y, unnest(range(0, len(embedding))) AS pos, CASE WHEN vec_id % 41 = 0 THEN 60 ELSE len(embedding) END AS n FROM embeddings WHERE vec_id % 50 <> 0),
k AS (SELECT vec_id, a.n AS na, b.n AS nb FROM (SELECT DISTINCT vec_id, n FROM a) a FULL JOIN (SELECT DISTINCT vec_id, n FROM b) b USING (vec_id)),
d AS (SELECT vec_id, max(abs(x - y)) AS worst FROM a JOIN b USING (vec_id, pos) GROUP BY vec_id),
c AS (SELECT vec_id, CASE WHEN na = nb THEN worst END AS max_abs_diff, CASE WHEN na IS NULL OR nb IS NULL THEN 'missing' WHEN na <> nb THEN 'length' WHEN worst > 1e-3 THEN 'fail' ELSE 'ok' END AS verdict FROM k LEFT JOIN d USING (vec_id))
"""


@query(_PARITY + "SELECT vec_id, round(max_abs_diff, 12) AS max_abs_diff, verdict FROM c")
def parity_compare(spark, sf_dir):
    """J6"""
    return parity.compare(*views.outputs(spark, sf_dir), ["vec_id"]).withColumn("max_abs_diff", F.round("max_abs_diff", 12))


@query(_PARITY + "SELECT vec_id // 100 AS video_id, count(*) AS outputs, round(max(max_abs_diff), 12) AS worst, bool_and(verdict = 'ok') AS agree, count(*) FILTER (verdict <> 'ok') AS differing FROM c GROUP BY 1")
def parity_worst(spark, sf_dir):
    """A8"""
    compared = parity.compare(*views.outputs(spark, sf_dir), ["vec_id"]).withColumn("video_id", F.expr("vec_id div 100"))
    return parity.worst(compared, "video_id").withColumn("worst", F.round("worst", 12))


@query(_FRAMES + " SELECT video_id, frame_idx, name, width, height, printf('%05d.jpg', frame_idx) AS cache_name FROM f")
def write_frames(spark, sf_dir):
    """Written in the order of video and index and read back"""
    path = fresh_path(spark, "frames")
    small = views.frames(spark, sf_dir).select("video_id", "frame_idx", "name", "width", "height")
    sources.write_frames(small, path)
    return spark.read.parquet(path).select("video_id", "frame_idx", "name", "width", "height", "cache_name")


@query(_FRAMES + " SELECT video_id, frame_idx, name, width, height, width <> 640 OR height <> 480 AS size_mismatch, row_number() OVER (ORDER BY video_id, frame_idx) - 1 AS place FROM f")
def write_results(spark, sf_dir):
    """Flagged, written in order and read back; place: where a row stands in the files"""
    path, catalog = fresh_path(spark, "results"), views.videos(spark, sf_dir)
    sources.write_results(sources.with_size_mismatch(views.frames(spark, sf_dir).select("video_id", "frame_idx", "name", "width", "height"), catalog), path, catalog, 500)
    return sources.read_results(spark, path)


class _Smooth(StepBackend):
    """UD2: logits that follow the frames half way, for each object from the frame of its prompt on."""

    def init(self, video_id, prompts):
        return dict(zip(prompts.obj_id.tolist(), prompts.frame_idx.tolist(), strict=True)), {}

    def step(self, state, frame):
        since, held = state
        for o in sorted(o for o, first in since.items() if first <= frame.frame_idx):
            held[o] = [float((a + b) // 2) for a, b in zip(held[o], frame.px, strict=True)] if o in held else list(map(float, frame.px))
        return state, [(int(o), v) for o, v in held.items()]


@query(
    """WITH RECURSIVE v AS (SELECT vec_id // 100 AS video_id, (vec_id // 5) % 20 AS frame_idx, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings WHERE vec_id % 5 = 0),
x AS (SELECT video_id, frame_idx, pos, CAST(floor(v * 10000) AS BIGINT) AS x, row_number() OVER (PARTITION BY video_id, pos ORDER BY frame_idx) AS place FROM v),
o AS (SELECT DISTINCT vec_id // 100 AS video_id, vec_id % 5 + 1 AS obj_id, min((vec_id // 5) % 20) OVER (PARTITION BY vec_id // 100, vec_id % 5) + vec_id % 5 + 1 AS since FROM embeddings),
f AS (SELECT o.video_id, o.obj_id, min(place) AS place FROM o JOIN x ON x.video_id = o.video_id AND frame_idx >= since GROUP BY ALL),
r AS (SELECT x.video_id, f.obj_id, x.place, x.frame_idx, x.pos, x.x AS s FROM x JOIN f ON f.video_id = x.video_id AND f.place = x.place
UNION ALL SELECT r.video_id, r.obj_id, x.place, x.frame_idx, x.pos, CAST(floor((r.s + x.x) / 2.0) AS BIGINT) FROM r JOIN x ON x.video_id = r.video_id AND x.pos = r.pos AND x.place = r.place + 1)
SELECT video_id, frame_idx, obj_id, CAST(sum(s) AS BIGINT) AS total, count(*) FILTER (s > 0) AS above FROM r GROUP BY ALL"""
)
def step_backend(spark, sf_dir):
    """UD1, UD2"""
    rows = views.raw_frames(spark, sf_dir).filter("not is_float").select("video_id", "frame_idx", "px")
    out = run_steps(rows, views.mask_prompts(spark, sf_dir), _Smooth, ["px"])
    return out.select("video_id", "frame_idx", "obj_id", F.aggregate("logits", F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("total"), F.size(F.filter("logits", lambda v: v > 0)).cast("bigint").alias("above"))


_STEPPED = _CARRY + ", s AS (SELECT g.video_id, g.frame_idx, g.obj_id, last_value(b.x IGNORE NULLS) OVER w AS x, last_value(b.y IGNORE NULLS) OVER w AS y FROM g LEFT JOIN b USING (video_id, frame_idx, obj_id) WINDOW w AS (PARTITION BY g.video_id, g.obj_id ORDER BY g.frame_idx ROWS UNBOUNDED PRECEDING))"


#: Rows are dealt out in no order of time: no row is late, no video or session idle.
_LATE, _IDLE = "3650 days", 3650 * 86_400_000


def _written_stream(spark: SparkSession, df: DataFrame, files: int = 6) -> DataFrame:
    """A table as files in the shared folder, its rows dealt out to them in turn, read as a stream of two files a batch."""
    path = fresh_path(spark, "arriving")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query(_STEPPED + ", m AS (SELECT user_id AS video_id, seq AS frame_idx FROM e) SELECT m.video_id, m.frame_idx, s.obj_id, s.x, s.y FROM m LEFT JOIN (SELECT * FROM s WHERE x IS NOT NULL) s USING (video_id, frame_idx)")
def propagate_stream(spark, sf_dir):
    """ST1-ST3: frames in any order of arrival; prompts are the first state of their videos"""
    f = views.frames(spark, sf_dir).select("video_id", "frame_idx", F.col("ts").cast("timestamp").alias("ts"))
    last = f.groupBy("video_id").agg(F.max("frame_idx").alias("last"))
    rows = f.join(last, "video_id").select("video_id", "frame_idx", "ts", (F.col("frame_idx") == F.col("last")).alias("ended"))
    out = streams.finish(streams.propagate_stream(_written_stream(spark, rows), _boxes(spark, sf_dir), _LATE, _IDLE))
    return out.select("video_id", "frame_idx", "obj_id", F.get("xyxy", 0).alias("x"), F.get("xyxy", 1).alias("y"))


@query(_CLICKS + "SELECT session, seq, CAST(active AS BIGINT) AS obj_id, CASE WHEN action = 'left' THEN 1 ELSE 0 END AS label FROM a WHERE action IN ('left', 'right')")
def active_object_stream(spark, sf_dir):
    """ST4: a session's events are spread over three batches at least"""
    log = views.click_log(spark, sf_dir).select("session", "seq", F.col("ts").cast("timestamp").alias("ts"), "action", "digit")
    out = streams.finish(streams.active_object_stream(_written_stream(spark, log), 1, _LATE, _IDLE))
    gone = out.filter("action = 'escape'").select("session")
    return out.filter("obj_id is not null").join(gone, "session", "left_anti").select("session", "seq", "obj_id", "label")


@query(_SUMMARY + "SELECT run_id, frames, round(total_s, 9) AS total_s, round(avg_fps_all, 9) AS avg_fps_all, warmup, kept_frames, round(avg_fps_post_warmup, 9) AS avg_fps_post_warmup FROM s")
def fps_stream(spark, sf_dir):
    """ST5: each batch writes the runs that it touched"""
    counters = streams.finish(streams.fps_stream(_written_stream(spark, views.timings(spark, sf_dir)), WARMUP), ["run_id"])
    return metrics.fps_of(counters, WARMUP).select("run_id", "frames", _r("total_s"), _r("avg_fps_all"), "warmup", "kept_frames", _r("avg_fps_post_warmup"))
