"""Stateful streams, a file a batch, in a given order of arrival."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright.streaming import frames as streams

PROMPTS = "video_id bigint, kind string, obj_id bigint, frame_idx bigint, xyxy array<double>, seq int"


@pytest.fixture
def arriving(spark, tmp_path):
    def made(batches: list[list[tuple]], schema: str):
        folder = tmp_path / "in"
        folder.mkdir()
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))
            path = folder / f"{i:03d}.parquet"
            pq.write_table(df.toArrow(), path)
            os.utime(path, (1_000_000 + 100 * i,) * 2)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return made


def run(stream, tmp_path):
    """Rows of each batch in their order, and how many entries the state has at last."""
    batches = {}
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
    query = writer.foreachBatch(lambda df, n: batches.__setitem__(n, [tuple(r) for r in df.collect()])).start()
    query.awaitTermination()
    return [r for n in sorted(batches) for r in batches[n]], query.lastProgress.stateOperators[0].numRowsTotal, [len(batches[n]) for n in sorted(batches)]


FRAMES = "video_id bigint, frame_idx bigint, ts bigint, ended boolean"


def test_late_frames_and_prompts_that_never_pass_through_the_stream(spark, arriving, tmp_path):
    prompts = spark.createDataFrame([(1, "box", 5, 1, [1.0], 0), (1, "box", 5, 3, [3.0], 1), (1, "box", 6, 3, [6.0], 2), (1, "box", 6, 3, [7.0], 3), (1, "point", 9, 0, None, 4), (8, "box", 1, 0, [0.0], 0)], PROMPTS)
    frames = arriving([[(1, 3, 13, False), (1, 0, 10, False)], [(1, 4, 14, True), (2, 0, 14, False), (1, 0, 14, False)], [(1, 1, 11, False)], [(1, 2, 12, False), (2, 1, 15, True), (1, 3, 15, False)]], FRAMES)
    rows, left, _ = run(streams.propagate_stream(frames, prompts), tmp_path)
    assert [r[1:] for r in rows if r[0] == 1] == [(0, None, None), (1, 5, [1.0]), (2, 5, [1.0]), (3, 5, [3.0]), (3, 6, [7.0]), (4, 5, [3.0]), (4, 6, [7.0])]
    assert [r[1:] for r in rows if r[0] == 2] == [(0, None, None), (1, None, None)]
    assert left <= 1 + 3  # of videos 1 and 2 nothing but what a repeated frame of 1 left; the prompt of video 8, whose frames are to come


def test_a_silent_video_goes_by_the_watermark(spark, arriving, tmp_path):
    prompts = spark.createDataFrame([(1, "box", 5, 2, [2.0], 0)], PROMPTS)
    frames = arriving([[(1, 0, 10, False), (1, 3, 13, False), (2, 0, 10, False)], [(2, 1, 40, False)], [(2, 2, 200, False)], [(2, 3, 230, True)]], FRAMES)
    rows, left, sizes = run(streams.propagate_stream(frames, prompts, "5 seconds", 60_000), tmp_path)
    assert [r[1:] for r in rows if r[0] == 1] == [(0, None, None), (3, 5, [2.0])]  # frame 3 over the gap, with what was prompted in it
    assert [r[1] for r in rows if r[0] == 2] == [0, 1, 2, 3]
    assert sizes[:4] == [2, 1, 1, 2] and left == 0  # video 1 ended in the batch whose watermark had passed it, within the run


def test_frames_that_are_too_late_are_dropped(spark, arriving, tmp_path):
    frames = arriving([[(1, 0, 10, False)], [(1, 2, 500, False)], [(1, 3, 501, False)], [(1, 1, 20, False)]], FRAMES)
    rows, _, _ = run(streams.propagate_stream(frames, spark.createDataFrame([], PROMPTS), "5 seconds", 1000_000), tmp_path)
    assert [r[1] for r in rows] == [0]


CLICKS = "session bigint, seq bigint, ts bigint, action string, digit int"


def test_clicks_wait_for_earlier_ones(spark, arriving, tmp_path):
    log = arriving([[(9, 0, 10, "left", None), (9, 3, 13, "right", None)], [(9, 1, 11, "next", None), (9, 2, 12, "digit", 7)], [(9, 5, 15, "left", None), (4, 0, 15, "next", None)], [(4, 1, 300, "left", None)]], CLICKS)
    rows, left, _ = run(streams.active_object_stream(log, 4, "5 seconds", 60_000), tmp_path)
    assert [r for r in rows if r[0] == 9] == [(9, 0, 4, 1, "left"), (9, 3, 7, 0, "right"), (9, 5, 7, 1, "left")]  # the last when session 9 was idle
    assert [r for r in rows if r[0] == 4] == [(4, 1, 5, 1, "left")] or not [r for r in rows if r[0] == 4]
    assert left <= 3


def test_an_ended_session_is_remembered_until_its_timer(spark, arriving, tmp_path):
    log = arriving([[(9, 0, 10, "left", None), (9, 1, 11, "enter", None), (9, 3, 12, "left", None)], [(9, 2, 12, "left", None)], [(1, 0, 200, "left", None)], [(1, 1, 201, "escape", None)], [(2, 0, 900, "other", None)]], CLICKS)
    rows, left, _ = run(streams.active_object_stream(log, 1, "5 seconds", 60_000), tmp_path)
    assert sorted(r for r in rows if r[0] == 9) == [(9, 0, 1, 1, "left"), (9, 1, None, None, "enter")]
    assert [r[4] for r in rows if r[0] == 1] == ["left", "escape"]
    assert left <= 3  # sessions 9 and 1 are gone; session 2 has its place and its timer


def test_a_batch_writes_the_runs_that_it_touched(spark, tmp_path, arriving):
    timings = arriving([[(1, 0, 0, 0.5), (2, 0, 0, 0.25)], [(2, 1, 0, 0.75)], [(3, 0, 0, 1.0), (2, 2, 0, 1.0)]], "run_id bigint, frame_idx bigint, ts bigint, dt double")
    counted = streams.fps_stream(timings, 1)
    rows, _, sizes = run_update(counted, tmp_path)
    assert sizes == [2, 1, 2]
    got = streams.finish(counted, ["run_id"])
    assert sorted((r.run_id, r.frames, r.total_s) for r in got.collect()) == [(1, 1, 0.5), (2, 3, 2.0), (3, 1, 1.0)]


def run_update(stream, tmp_path):
    sizes = {}
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "update")).outputMode("update").trigger(availableNow=True).foreachBatch(lambda df, n: sizes.__setitem__(n, df.count())).start()
    query.awaitTermination()
    return None, None, [sizes[n] for n in sorted(sizes) if sizes[n]]


def test_the_latest_row_of_a_key_counts(spark):
    rows = spark.createDataFrame(pd.DataFrame({"k": [1, 1, 2], "v": ["a", "b", "c"], "_batch": [0, 4, 2]}))
    assert sorted((r.k, r.v) for r in streams.latest(rows, ["k"]).collect()) == [(1, "b"), (2, "c")]


def test_what_waits_takes_few_entries(spark, arriving, tmp_path):
    frames = arriving([[(1, i, 10, False) for i in range(1, 700)]], FRAMES)
    rows, left, _ = run(streams.propagate_stream(frames, spark.createDataFrame([], PROMPTS)), tmp_path)
    assert rows == [] and left <= 8
