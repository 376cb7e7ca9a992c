"""What is worked out by ranges equals what a window over each key gives, and a long key spans tasks."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import frames as fr
from framewright.operators import overlay, prompts, ranges
from framewright.plans import annotate as flagship
from framewright.plans.backends import build_backend
from framewright.sources import frames as sources


def keyed(spark, n=3000, keys=9):
    """Rows of keys of which one has half, with repeated and null values."""
    draw = random.Random(n)
    rows = [(draw.choice([0] * keys + list(range(keys)) + [None]), draw.randrange(n), draw.choice([None, None, float(i)])) for i in range(n)]
    return spark.createDataFrame(rows, "k bigint, o bigint, v double")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("parts", [None, 1, 40])
def test_places(spark, parts):
    df = keyed(spark).distinct().dropDuplicates(["k", "o"])
    plain = df.withColumn("at", (F.row_number().over(W.partitionBy("k").orderBy("o")) - 1).cast("bigint"))
    assert rows_of(ranges.ranked(df, ["k"], ["o"], "at", parts).select(*plain.columns)) == rows_of(plain)


def test_equal_rows_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, 5)] * 70 + [(2, 5)] * 3, "k bigint, o bigint")
    got = ranges.ranked(df, ["k"], ["o"], "at", 8).groupBy("k").agg(F.array_sort(F.collect_list("at")).alias("a")).collect()
    assert {r.k: r.a for r in got} == {1: list(range(70)), 2: [0, 1, 2]}
    assert ranges.ranked(df.filter("k = 7"), ["k"], ["o"], "at").count() == 0


def test_a_hot_key_spans_ranges(spark):
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    placed = ranges.in_ranges(df, ["k"], ["o"], 20)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 10_000
    assert ranges.ranked(df, ["k"], ["o"], "at", 20).filter("at <> o").count() == 0


@pytest.mark.parametrize("parts", [1, 30])
def test_latest_values(spark, parts):
    df = keyed(spark, 1500).dropDuplicates(["k", "o"])
    plain = df.withColumn("last", F.last("v", ignorenulls=True).over(W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, 0)))
    assert rows_of(ranges.latest(df, ["k"], "o", "v", "last", parts).select(*plain.columns)) == rows_of(plain)


@pytest.mark.parametrize("parts", [1, 25])
def test_active_objects_by_ranges(spark, parts):
    draw, rows = random.Random(parts), []
    for session, n in ((1, 900), (2, 40), (3, 1), (4, 300)):
        for seq in range(n):
            action = draw.choice(["left", "right", "other"] + ["next"] * 2 + ["digit"] * (session != 4 and draw.random() < 0.1))
            rows.append((session, seq, action, draw.randint(1, 9) if action == "digit" else None))
    log = spark.createDataFrame(rows, "session bigint, seq bigint, action string, digit int")
    expected, active = [], {}
    for session, seq, action, digit in rows:
        before = active.get(session, 6)
        active[session] = digit if action == "digit" else before + (action == "next")
        expected.append((session, seq, active[session]))
    assert sorted((r.session, r.seq, r.active) for r in prompts.active_objects(log, 6, parts).collect()) == sorted(expected)


def test_first_missing_numbers(spark):
    draw = random.Random(4)
    sets = {1: list(range(5)), 2: [1, 2], 3: list(range(64)), 4: list(range(63)), 5: [*range(4096), *range(4097, 5000)], 6: [*range(300_000)], 7: [-1, 0, 0, 1, 3], 8: [*range(262_144)], 9: [*range(262_143), 262_144], 10: [*range(700)] + draw.sample(range(701, 9000), 3000)}
    df = spark.createDataFrame(pd.DataFrame([(k, i) for k, v in sets.items() for i in v], columns=["k", "i"])).unionByName(spark.createDataFrame([(11, None)], "k bigint, i bigint"))
    got = {r.k: r.stop for r in ranges.first_missing(df, "k", "i", "stop").collect()}
    got.setdefault(11, 0)
    assert got == {k: min(set(range(400_000)) - set(v)) for k, v in sets.items()} | {11: 0}


def test_sequential_join_moves_pixels_once(spark):
    frames = spark.createDataFrame([(1, i, bytes(9)) for i in range(6) if i != 4], "video_id bigint, frame_idx bigint, rgb binary")
    results = spark.createDataFrame([(1, i) for i in (0, 3, 5, -1)], "video_id bigint, frame_idx bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = fr.join_sequential(results, frames)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        moved = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
        pixels = [line for line in plan.splitlines() if "rgb" in line and "Exchange" in line]
        assert moved and len(pixels) <= 1
        assert sorted(r.frame_idx for r in joined.collect()) == [0, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_contents_meet_their_index_by_path(spark, tmp_path):
    for video, names in (("a", ["f10.tif", "f2.tif", "f0.tiff", "x.txt"]), ("b", ["f7.tif"])):
        (tmp_path / video).mkdir()
        for name in names:
            (tmp_path / video / name).write_bytes(name.encode())
    files = sources.scan_frames(spark, f"{tmp_path}/*")
    assert sorted((r.video_id, r.frame_idx, r.name, bytes(r.content).decode()) for r in files.collect()) == [("a", 0, "f0.tiff", "f0.tiff"), ("a", 1, "f10.tif", "f10.tif"), ("a", 2, "f2.tif", "f2.tif"), ("b", 0, "f7.tif", "f7.tif")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sources.scan_frames(spark, f"{tmp_path}/*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "content" in plan and not [x for x in plan.splitlines() if "Window" in x and "content" in x]
    scan = next(i for i, x in enumerate(plan.splitlines()) if "binaryFile" in x and "content" in x)
    above = [x for x in plan.splitlines()[:scan] if "hashpartitioning" in x]
    assert "hashpartitioning(path" in above[-1]  # where contents go
    numbered = sources.scan_frames(spark, f"{tmp_path}/*", numbered=True)
    assert sorted((r.video_id, r.frame_idx) for r in numbered.collect()) == [("a", 0), ("a", 2), ("a", 10), ("b", 7)]


def test_batch_and_stream_number_files_alike(spark, tmp_path):
    from framewright.streaming.frames import finish

    (tmp_path / "a").mkdir()
    for i in (3, 100, 7):
        (tmp_path / "a" / f"frame_{i:06d}.tif").write_bytes(b"x")
    batch = sources.scan_frames(spark, f"{tmp_path}/*", numbered=True)
    stream = finish(sources.stream_frames(spark, f"{tmp_path}/*"))
    assert sorted((r.name, r.frame_idx) for r in batch.collect()) == sorted((r.name, r.frame_idx) for r in stream.collect())


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_parts_begin_where_the_catalog_says(spark, size):
    counts = {"b": 20, "a": 3, "c": 1, "z": 40, "none": 0}
    catalog = spark.createDataFrame([*counts.items(), (None, 4)], "video string, n bigint")
    begins = ranges.cuts(catalog, "video", "n", size)
    numbers = [(k, i) for k in sorted(counts) for i in range(counts[k])]
    assert begins == [numbers[i] for i in range(size, len(numbers), size)]
    rows = spark.createDataFrame([*numbers, (None, 1), ("a", None)], "k string, i bigint")
    got = {(r.k, r.i): r.p for r in rows.withColumn("p", ranges.part_of(begins)(F.col("k"), F.col("i"))).collect()}
    assert got == {x: i // size for i, x in enumerate(numbers)} | {(None, 1): 0, ("a", None): 0}


def test_results_are_in_order_over_files(spark, tmp_path):
    draw = random.Random(1)
    rows = [(v, i, bytes([v])) for v, n in ((3, 50), (1, 7), (2, 1), (9, 120)) for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, rgb binary").repartition(5)
    for catalog in (None, sources.frame_counts(df)):
        sources.write_results(df, str(tmp_path / "out"), catalog, 16)
        got = sources.read_results(spark, str(tmp_path / "out")).orderBy("place").collect()
        assert [(r.video_id, r.frame_idx) for r in got] == sorted((v, i) for v, i, _ in rows)
        assert len(list((tmp_path / "out").glob("*.parquet"))) == 12  # 178 frames by 16
    assert "RangePartitioning" not in sources.in_order(df, sources.frame_counts(df))._jdf.queryExecution().executedPlan().toString()


def test_pixels_move_once_and_masks_are_thresholded_once(spark):
    frames = spark.createDataFrame([(1, i, bytes(12)) for i in range(4)], "video_id bigint, frame_idx bigint, rgb binary")
    logits = spark.createDataFrame([(1, i, o, 2, 2, [1.0, -1.0, float(o), -1.0]) for i in (0, 2, 3) for o in (2, 1)] + [(1, 1, 1, 2, 2, [-1.0] * 4)], "video_id bigint, frame_idx bigint, obj_id bigint, w int, h int, logits array<float>")
    timings = spark.createDataFrame([(1, i, 0.5) for i in range(4)], "run_id bigint, frame_idx bigint, dt double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = flagship.annotate(frames, None, timings, "logits", inputs={"logits": logits}, draw=F.col("video_id") == 2, size=2)
        plan = run._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange" in line and "PassThrough" in line for line in plan.splitlines()) <= 1
    assert plan.count("isnan(") <= 2  # of one projection
    got = {r.frame_idx: r for r in run.collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[1].rgb == bytes(12) and got[1].boxes == [] and got[0].avg_fps_all == 2.0
    plain = overlay.overlay(frames, build_backend("logits")(logits))
    assert {r.frame_idx: r.rgb for r in plain.collect()} == {i: r.rgb for i, r in got.items()}
    assert [(b.obj_id, b.x1, b.y1, b.x2, b.y2, b.label) for b in got[0].boxes] == [(1, 0, 0, 0, 1, None), (2, 0, 0, 0, 1, None)]


def test_frames_without_a_result_and_repeated_frames(spark):
    frames = spark.createDataFrame([(1, 0, bytes(3)), (1, 1, bytes(3)), (1, 1, bytes([9] * 3)), (2, 0, None)], "video_id bigint, frame_idx bigint, rgb binary")
    masks = spark.createDataFrame([(1, 1, 1, 1, 1, [(0, 1)]), (2, 0, 1, 1, 1, [(0, 1)]), (7, 7, 1, 1, 1, [(0, 1)])], "video_id bigint, frame_idx bigint, obj_id bigint, w int, h int, runs array<struct<start:int,len:int>>")
    out = flagship.rendered(frames, flagship.stacked(masks, F.lit(False)), sources.frame_counts(frames), 1.0).collect()
    assert sorted((r.video_id, r.frame_idx, r.rgb and bytes(r.rgb)) for r in out if r.rgb) == [(1, 1, bytes([56, 56, 255]))] * 2
    assert [(r.video_id, r.frame_idx) for r in out if not r.rgb] == [(2, 0)]


def test_outlines():
    image = np.zeros((7, 8, 3), np.uint8)
    overlay.outline(image, (2, 2, 5, 4), np.array([1, 2, 3], np.uint8))
    drawn = {(x, y) for y in range(7) for x in range(8) if image[y, x].any()}
    assert drawn == {(x, y) for y in range(1, 6) for x in range(1, 7)} - {(3, 3), (4, 3)}
    edge = np.zeros((3, 3, 3), np.uint8)
    overlay.outline(edge, (0, 0, 2, 2), np.array([1, 1, 1], np.uint8))
    assert not edge[1, 1].any() and edge.any(2).sum() == 8


def test_files_of_frames_grow_with_frames_and_not_with_videos(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("video_id"), F.lit(0).cast("bigint").alias("frame_idx"))
    sources.write_frames(df, str(tmp_path / "f"))
    assert len(list((tmp_path / "f").rglob("*.parquet"))) <= 8
    got = spark.read.parquet(str(tmp_path / "f"))
    assert sorted((r.video_id, r.frame_idx, r.cache_name) for r in got.collect()) == [(i, 0, "00000.jpg") for i in range(2000)]


def test_parts_are_bounded_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "PARTS", 5)
    df = spark.range(178).select((F.col("id") % 3).alias("video_id"), F.expr("id div 3").alias("frame_idx")).repartition(4)
    sources.write_results(df, str(tmp_path / "out"), None, 16)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 4  # parts of 48 frames
    got = sources.read_results(spark, str(tmp_path / "out")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(178)) and [(r.video_id, r.frame_idx) for r in got] == sorted((i % 3, i // 3) for i in range(178))
