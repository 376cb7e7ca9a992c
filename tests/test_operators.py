"""Small cases: prompts, registry, modes, frame sequences, masks, metrics, parity."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import scalar
from framewright.operators import frames as fr
from framewright.operators import jobs, masks, metrics, overlay, parity, prompts
from framewright.plans import backends
from framewright.sources import frames as sources
from framewright.sources.prompts import read_prompts

quick = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def timings(spark, dts):
    return spark.createDataFrame([(1, i, float(d)) for i, d in enumerate(dts)], "run_id bigint, frame_idx bigint, dt double")


# Prompts


def test_object_ids_over_boxes_and_points(spark):
    boxes = spark.createDataFrame([(7, "box", 1, 0, [0.0, 0.0, 10.0, 10.0])], "video_id bigint, kind string, obj_id bigint, frame_idx bigint, xyxy array<double>")
    points = spark.createDataFrame([(7, "point", 2, 0, [5.0, 5.0], 1)], "video_id bigint, kind string, obj_id bigint, frame_idx bigint, xy array<double>, label int")
    both = prompts.union_prompts(boxes, points)
    assert prompts.object_ids(both).first().ids == [1, 2]
    assert sorted(r.obj_id for r in prompts.union_ids(boxes, points).collect()) == [1, 2]


def test_prompt_file_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_comment": "x", "boxes": [{"obj_id": 1, "frame_idx": 0, "xyxy": [1, 2, 3, 4]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"points": [{"obj_id": "2", "xy": [5, 6]}, {"obj_id": 3.9, "frame_idx": 4, "xy": [7, 8], "label": 0}], "boxes": None}))
    got = {(r.file, r.seq): r for r in read_prompts(spark, str(tmp_path)).collect()}
    assert got["a.json", 0].xyxy == [1.0, 2.0, 3.0, 4.0]
    assert (got["b.json", 0].obj_id, got["b.json", 0].frame_idx, got["b.json", 0].label) == (2, 0, 1)
    assert (got["b.json", 1].obj_id, got["b.json", 1].frame_idx, got["b.json", 1].label) == (3, 4, 0)


def test_no_prompts_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    with pytest.raises(ValueError):
        read_prompts(spark, str(tmp_path))


def test_click_log(spark):
    log = [(1, "left"), (1, "next"), (1, "right"), (1, "digit"), (1, "left"), (1, "enter"), (1, "left"), (2, "left"), (2, "escape"), (3, "right")]
    rows = [(s, i, a, 5 if a == "digit" else None, float(i), 0.0) for i, (s, a) in enumerate(log)]
    df = spark.createDataFrame(rows, "session bigint, seq bigint, action string, digit int, x double, y double")
    got = sorted((r.video_id, r.obj_id, r.label) for r in prompts.click_prompts(df).collect())
    assert got == [(1, 1, 1), (1, 2, 0), (1, 5, 1), (3, 1, 0)]
    assert [r.session for r in prompts.empty_sessions(df).collect()] == [2]


def test_rois_keep_their_places(spark):
    df = spark.createDataFrame([(1, 0, 1, 2, 3, 4), (1, 1, 1, 1, 0, 5), (1, 2, 5, 5, 2, 2)], "video_id bigint, ord bigint, x int, y int, w int, h int")
    assert sorted((r.obj_id, r.xyxy) for r in prompts.roi_boxes(df).collect()) == [(1, [1.0, 2.0, 4.0, 6.0]), (3, [5.0, 5.0, 7.0, 7.0])]


# Registry and jobs


def test_registry():
    assert {"carry", "logits", "unsupported"} <= set(backends.available_backends())
    with pytest.raises(KeyError, match="carry"):
        backends.build_backend("nobody")
    with pytest.raises(NotImplementedError):
        backends.build_backend("unsupported")()


def test_precisions(spark):
    full, error = scalar.normalise_precision(F.lit("bf16"))
    assert one(spark, full) == "bfloat16" and one(spark, error) is None
    assert "int8" in one(spark, scalar.normalise_precision(F.lit("int8"))[1])


@pytest.mark.parametrize(("path", "mode", "decoder", "expected"), [("foo.mp4", "jpg", True, "jpg"), ("foo.avi", "mp4", True, None), ("foo.mp4", "auto", False, "jpg"), ("foo.MP4", "auto", True, "mp4"), ("foo.mp4", "mp4", False, None), ("x/.mp4", "auto", True, "jpg")])
def test_video_mode(spark, path, mode, decoder, expected):
    got, error = jobs.video_mode(F.lit(mode), F.lit(path), F.lit(decoder))
    assert one(spark, got) == expected and (one(spark, error) is None) == (expected is not None)


def test_fallback(spark):
    missing = jobs.fallback(F.lit("fast"), F.lit(False), F.lit(False), F.lit("plain"))
    strict = jobs.fallback(F.lit("fast"), F.lit(False), F.lit(True), F.lit("plain"))
    assert one(spark, missing[0]) == "plain" and one(spark, missing[1]) is None
    assert one(spark, strict[0]) is None and "fast" in one(spark, strict[1])


# Frames


def test_frame_sequence(spark, tmp_path):
    seq = tmp_path / "clip"
    seq.mkdir()
    for i in range(4):
        (seq / f"frame_{i:06d}.tiff").write_bytes(bytes([i]))
    (seq / "notes.txt").write_text("x")
    files = sources.scan_frames(spark, str(seq))
    assert [(r.frame_idx, r.name, r.cache_name) for r in files.orderBy("frame_idx").collect()][1] == (1, "frame_000001.tiff", "00001.jpg")

    def decoder(content):
        v = content[0] * 1000 + 100
        return [v] * 48 + [v * 2] * 48, 12, 8, 1, 16, False

    px = sources.decode_frames(files, decoder, ["video_id", "frame_idx"])
    out = px.withColumn("px8", fr.samples_to_uint8(F.col("px"), F.col("bits"), F.col("is_float"))).filter("frame_idx = 1").first()
    assert len(out.px) == 192 and len(out.px8) == 96 and set(out.px8) == {0, 255}
    told = fr.sequence_catalog(px, 24.0).first()
    assert (told.width, told.height, told.frame_count, told.fps) == (12, 8, 4, 24.0)
    assert fr.first_frame(px.select("video_id", "frame_idx", "width")).first().frame_idx == 0


def test_no_frames_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="match"):
        sources.scan_frames(spark, str(tmp_path))


@pytest.mark.parametrize(("v", "lo", "hi", "bits", "real", "expected"), [(7, 0, 255, 8, False, 7), (5, 5, 5, 16, False, 0), (1, 0, 2, 16, False, 128), (1, 0, 2, 32, True, 127), (3, 0, 510, 16, False, 2), (1, 0, 510, 16, False, 0)])
def test_depth(spark, v, lo, hi, bits, real, expected):
    lit = lambda x: F.lit(float(x))
    assert one(spark, scalar.depth_to_uint8(lit(v), lit(lo), lit(hi), F.lit(bits), F.lit(real))) == expected


def test_sequential_join_stops_at_a_gap(spark):
    frames = spark.createDataFrame([(1, i) for i in (0, 1, 3, 4)] + [(2, 1), (2, 2)], "video_id bigint, frame_idx bigint")
    results = spark.createDataFrame([(1, i) for i in (0, 1, 3)] + [(2, 1)], "video_id bigint, frame_idx bigint")
    counts = spark.createDataFrame([(1, 5), (2, 3)], "video_id bigint, frame_count bigint")
    assert sorted((r.video_id, r.frame_idx) for r in fr.join_sequential(results, frames, counts).collect()) == [(1, 0), (1, 1)]
    assert fr.join_results(results, frames).count() == 4


# Masks


@quick
@given(st.lists(st.booleans(), min_size=1, max_size=30), st.integers(1, 7))
def test_runs_and_box(spark, mask, width):
    df = spark.createDataFrame([(mask, width)], "m array<boolean>, w int")
    got = df.select(masks.runs(F.col("m")).alias("r"), "w").select(masks.positions_of_runs(F.col("r")).alias("p"), masks.bbox_of_runs(F.col("r"), F.col("w")).alias("b")).first()
    at = [i for i, x in enumerate(mask) if x]
    assert got.p == at
    if at:
        assert tuple(got.b) == (min(i % width for i in at), min(i // width for i in at), max(i % width for i in at), max(i // width for i in at))


def test_threshold_is_strict_and_nan_is_below(spark):
    df = spark.createDataFrame([([0.0, 0.1, float("nan"), -1.0, None],)], "x array<float>")
    assert df.select(masks.mask_threshold(F.col("x")).alias("m")).first().m == [False, True, False, False, False]


def test_palette_is_reversed_and_repeats(spark):
    assert one(spark, scalar.colour_rgb(F.lit(1))) == [56, 56, 255]
    assert one(spark, scalar.colour_rgb(F.lit(7))) == one(spark, scalar.colour_rgb(F.lit(1)))
    assert one(spark, scalar.colour_rgb(F.lit(0))) == one(spark, scalar.colour_rgb(F.lit(6)))


@quick
@given(st.integers(0, 255), st.lists(st.integers(0, 255), max_size=4), st.floats(0, 1))
def test_blend_stays_in_range(spark, px, colours, alpha):
    got = one(spark, scalar.blend(F.lit(px), F.array(*[F.lit(c) for c in colours]).cast("array<int>"), alpha))
    expected = px
    for c in colours:
        expected = int(alpha * c + (1 - alpha) * expected)
    assert got == expected and 0 <= got <= 255


def test_overlay(spark):
    black = spark.createDataFrame([(1, i, bytes(18)) for i in range(2)], "video_id bigint, frame_idx bigint, rgb binary")
    m = spark.createDataFrame([(1, 0, 1, [(1, 2)]), (1, 0, 2, [(2, 2)])], "video_id bigint, frame_idx bigint, obj_id bigint, runs array<struct<start:int,len:int>>")
    out = {r.frame_idx: r for r in overlay.overlay(black, m).collect()}
    assert out[1].rgb == bytes(18)
    assert list(out[0].rgb[2::3]) == [0, 127, 91, 28, 0, 0] and list(out[0].rgb[1::3]) == [0, 28, 141, 127, 0, 0]


@quick
@given(st.lists(st.integers(0, 255), min_size=3, max_size=60), st.lists(st.tuples(st.integers(1, 9), st.integers(0, 8), st.integers(1, 9)), max_size=4), st.floats(0, 1))
def test_blending_a_frame_is_blending_its_pixels(spark, values, layers, alpha):
    rgb = bytes(values[: len(values) // 3 * 3])
    n = len(rgb) // 3
    layers = [{"runs": [{"start": s, "len": min(k, n - s)}], "colour": one(spark, scalar.colour_rgb(F.lit(o)))} for o, s, k in layers if s < n]
    runs = [(np.array([x["runs"][0]["start"]]), np.array([x["runs"][0]["len"]])) for x in layers]
    got = overlay.blended(rgb, runs, [np.array(x["colour"]) for x in layers], alpha)
    for p in range(n):
        for c in range(3):
            v = rgb[3 * p + c]
            for x in layers:
                if x["runs"][0]["start"] <= p < x["runs"][0]["start"] + x["runs"][0]["len"]:
                    v = int(alpha * x["colour"][c] + (1 - alpha) * v)
            assert got[3 * p + c] == v


def test_of_repeated_masks_the_last_stays(spark):
    rows = [(1, 0, 7, [(0, 9)], 1), (1, 0, 7, [(5, 1)], 3), (1, 0, 7, [(2, 4)], 2), (1, 0, 8, [], 0)]
    m = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, obj_id bigint, runs array<struct<start:int,len:int>>, at int").coalesce(1)
    told = masks.mask_map(m, "at").first().masks
    assert [tuple(x) for x in told[7]] == [(5, 1)] and told[8] == []
    assert [tuple(x) for x in masks.mask_map(m.drop("at")).first().masks[7]] == [(2, 4)]


def test_boxes_that_are_not_drawn(spark):
    m = spark.createDataFrame([(v, 0, 1, 4, 4, [(9, 2)]) for v in (1, 2)], "video_id bigint, frame_idx bigint, obj_id bigint, w int, h int, runs array<struct<start:int,len:int>>")
    got = {r.video_id: r for r in masks.annotations(m, F.col("video_id") == 2).collect()}
    assert (got[1].drawn, got[1].label, got[2].drawn, got[2].label, got[2].label_y) == (False, None, True, "id=1", 0)
    assert got[1].x1 == got[2].x1 == 1
    assert {r.drawn for r in masks.annotations(m).collect()} == {True}


def test_results_without_a_mask_stay(spark):
    frames = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "video_id bigint, frame_idx bigint")
    found = spark.createDataFrame([(1, 1, "m")], "video_id bigint, frame_idx bigint, mask string")
    got = fr.join_results(frames.filter("frame_idx < 2"), frames, found).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.mask) for r in got] == [(0, None), (1, "m")]


def test_names_sort_as_text(spark):
    df = spark.createDataFrame([(1, f"frame_{i:05d}.tif") for i in (99999, 100000, 2)], "video_id bigint, name string")
    assert [r.name for r in fr.assign_frame_idx(df, ["name"]).orderBy("frame_idx").collect()] == ["frame_00002.tif", "frame_100000.tif", "frame_99999.tif"]


def test_first_duration_is_from_the_start(spark):
    df = spark.sql("select 1L run_id, id frame_idx, timestamp_micros(1000000 * (id + 1) * (id + 1)) ts, timestamp_micros(500000) s from range(3)")
    assert [r.dt for r in metrics.frame_dt(df, "s").orderBy("frame_idx").collect()] == [0.5, 3.0, 5.0]


def test_netpbm_round_trip(spark, tmp_path):
    px = [bytes(range(24)), bytes([0, 1, 255, 3] * 6)]
    df = spark.createDataFrame([(1, "frame_0.ppm", px[0], 4, 2, 3, 8), (1, "frame_1.pgm", px[1], 4, 3, 1, 16)], "video_id bigint, name string, px binary, width int, height int, channels int, bits int")
    path = f"file://{tmp_path}/f"
    sources.write_frame_files(df, path)
    sources.write_frame_files(df, path)
    got = sources.decode_frames(sources.scan_frames(spark, f"{path}/*", "*.p?m"), sources.netpbm, ["frame_idx"]).orderBy("frame_idx").collect()
    assert [(bytes(r.px), r.width, r.height, r.channels, r.bits) for r in got] == [(px[0], 4, 2, 3, 8), (px[1], 4, 3, 1, 16)]
    (tmp_path / "f/1/frame_2.pgm").write_bytes(b"junk")
    with pytest.raises(Exception, match="netpbm"):
        sources.decode_frames(sources.scan_frames(spark, f"{path}/*", "*.p?m"), sources.netpbm, ["frame_idx"]).collect()


# Metrics


def test_warmup_is_left_out(spark):
    s = metrics.fps_summary(timings(spark, [1.0, 0.1, 0.1, 0.1, 0.1]), 1).first()
    assert (s.frames, s.warmup, s.kept_frames) == (5, 1, 4)
    assert s.avg_fps_post_warmup == pytest.approx(10.0) and s.avg_fps_all < s.avg_fps_post_warmup


@pytest.mark.parametrize(("dts", "warmup", "w", "kept"), [([0.1] * 3, 0, 0, 3), ([0.1] * 3, 99, 2, 1), ([0.5], 5, 0, 1), ([0.0, 0.0], 1, 1, 1), ([0.1] * 4, -2, 0, 4)])
def test_warmup_is_clamped(spark, dts, warmup, w, kept):
    s = metrics.fps_summary(timings(spark, dts), warmup).first()
    assert (s.warmup, s.kept_frames) == (w, kept)
    assert metrics.exclude_warmup(timings(spark, dts), warmup).count() == kept


def test_report(spark):
    lines = [r.line for r in metrics.fps_report(metrics.fps_summary(timings(spark, [1.0, 0.1, 0.1]), 1)).orderBy("line_no").collect()]
    assert lines == ["tracked 3 frames in 1.20s (2.5 FPS all)", "avg 10.0 FPS over 2 frames (excluded first 1 warm-up)"]
    empty = metrics.with_empty_runs(metrics.fps_summary(timings(spark, [])), spark.createDataFrame([(9,)], "run_id bigint"))
    assert empty.first().frames == 0 and metrics.fps_report(empty).count() == 0


# Backends and parity


def test_step_backend_sees_prompts_before_frames(spark):
    class Count(backends.StepBackend):
        def init(self, video_id, told):
            return len(told)

        def step(self, state, frame):
            return state + 1, [(1, [float(state)])]

    f = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "video_id bigint, frame_idx bigint, name string")
    p = spark.createDataFrame([(1, "box", 1, 5, [0.0], None, None, 0)], "video_id bigint, kind string, obj_id bigint, frame_idx bigint, xyxy array<double>, xy array<double>, label int, seq int")
    got = sorted((r.video_id, r.frame_idx, r.logits) for r in backends.run_steps(f, p, Count, ["name"]).collect())
    assert got == [(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [0.0])]


def test_a_worker_builds_a_model_once():
    from pyspark import cloudpickle

    pickled = cloudpickle.dumps(list)
    assert backends._model(pickled) is backends._model(pickled)


def test_prompted_objects_start_at_their_prompts(spark):
    rows = [(1, f, o, 1, 1, [1.0]) for f in range(3) for o in (1, 2, 3)]
    logits = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, obj_id bigint, w int, h int, logits array<float>")
    told = spark.createDataFrame([(1, 1, 2), (1, 1, 1), (1, 2, 0)], "video_id bigint, obj_id bigint, frame_idx bigint")
    got = sorted((r.frame_idx, r.obj_id) for r in backends.build_backend("prompted")(logits, told).collect())
    assert got == [(0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_registered_backends_as_a_table(spark):
    wanted = spark.createDataFrame([("carry",), ("nobody",)], "tracker string")
    assert [r.tracker for r in jobs.unknown_backends(wanted, backends.backends_table(spark)).collect()] == ["nobody"]


def test_parity(spark):
    left = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan")]), (4, [1.0]), (5, [0.0])], "k int, output array<double>")
    right = spark.createDataFrame([(1, [1.0, 2.0005]), (2, [1.0, 2.0]), (3, [1.0]), (5, [0.1])], "k int, output array<double>")
    c = parity.compare(left, right, ["k"])
    assert {r.k: r.verdict for r in c.collect()} == {1: "ok", 2: "length", 3: "fail", 4: "missing", 5: "fail"}
    assert parity.worst(c).first().agree is False


def test_images(spark, tmp_path):
    row = bytes([30, 20, 10] * 3) + bytes(3)  # blue first, rows end on four bytes
    header = b"BM" + struct.pack("<IHHI", 54 + 24, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, 24, 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(header + row * 2)
    r = sources.read_images(spark, str(tmp_path)).first()
    assert (r.width, r.height, r.channels, bytes(r.rgb)) == (3, 2, 3, bytes([10, 20, 30] * 6))
    (tmp_path / "b.bmp").write_bytes(b"BM, but nothing else")
    with pytest.raises(Exception, match="can't be read"):
        sources.read_images(spark, str(tmp_path)).collect()


def test_streamed_frames(spark, tmp_path):
    clip = tmp_path / "clip"
    clip.mkdir()
    for i in (2, 0, 1):
        (clip / f"frame_{i:06d}.tif").write_bytes(b"x")
    from framewright.streaming.frames import finish

    got = finish(sources.stream_frames(spark, str(clip)))
    assert sorted((r.video_id, r.frame_idx) for r in got.collect()) == [("clip", 0), ("clip", 1), ("clip", 2)]


def test_writing_by_video(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"video_id": [1, 1, 2], "frame_idx": [0, 1, 0]}))
    sources.write_frames(df, str(tmp_path / "f"))
    got = spark.read.parquet(str(tmp_path / "f"))
    assert sorted((r.video_id, r.frame_idx, r.cache_name) for r in got.collect()) == [(1, 0, "00000.jpg"), (1, 1, "00001.jpg"), (2, 0, "00000.jpg")]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from framewright import shared

    class Java:
        def sc(self):
            return self

        getCheckpointDir = sc
        isDefined = lambda self: False

    class Context:
        master, _jsc = "spark://host:7077", Java()

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())
