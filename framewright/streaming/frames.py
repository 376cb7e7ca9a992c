"""Structured Streaming forms of the stateful operators. Each runs over what is there and stops (availableNow) in finish().

The stateful ones keep what waits in blocks of frame or event numbers, so that an arrival touches its own block only and a batch
makes a few calls to the state for a key, however many rows it brings, and event-time timers, so that state goes by the watermark. Rows that come later than `late` behind the newest are dropped by the watermark, as in
any Spark stream. The state store is RocksDB, which `stateful` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewright.operators.metrics import fps_counters
from framewright.shared import fresh_path

#: Rows of a result at a time.
CHUNK = 10_000
#: Numbers whose rows wait in one entry of a state.
BLOCK = 256
#: Groups of keys in a stateful stream; a checkpoint fixes it.
BUCKETS = 1024


def stateful(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def finish(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs a streaming DataFrame over the input that is there, and reads what it wrote. With keys it runs in update mode: each
    batch writes just the rows of the keys that it touched, under its own number, and of a key the latest row counts."""
    spark = stream.sparkSession
    root = fresh_path(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if keys is None:
        writer.outputMode("append").format("parquet").option("path", f"{root}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def upsert(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/_batch={batch}")  # a batch that is run again replaces its own rows

    writer.outputMode("update").foreachBatch(upsert).start().awaitTermination()
    return latest(upserts(stream, f"{root}/out"), keys)


def upserts(stream: DataFrame, path: str) -> DataFrame:
    """All rows that batches in update mode have written, with the number of the batch."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.sparkSession.read.schema(f"{kinds}, _batch bigint").option("basePath", path).parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the latest batch: a partial aggregate."""
    others = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row")).select(*keys, "_row.*")


class _Ordered(StatefulProcessor):
    """Rows of a key by number, in their order: early ones wait in blocks of BLOCK numbers, until the missing ones have come or the
    key's timer fires, `idle_ms` of event time after its newest row; then what waits counts over the gaps, and all state goes.

    Every group of rows costs a frame of pandas, and every call to the state a round trip to the JVM. The groups are therefore
    buckets of keys (bucket_of), and a key's place, with the rows that wait in the block whose turn it is, is one value, read and
    written once a batch; of later blocks only those are touched that rows arrive for. A bucket has one timer, for the key that is
    silent the longest, which stays where it is until it fires and is then set again for the keys that are left."""

    waits: str  # what is kept of a row that waits: fields of a struct
    kept: str  # what is kept of a key besides: columns
    columns: list[str]  # of the result

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = f"waiting array<struct<number:bigint,{self.waits}>>"
        self.alarm = handle.getValueState("alarm", "timer bigint, keys bigint")
        self.places = handle.getMapState("places", "key bigint", f"following bigint, blocks bigint, until bigint, done boolean, {waiting}, {self.kept}")
        self.ahead = handle.getMapState("ahead", "key bigint, block bigint", waiting)
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """More states."""

    def rows(self, pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, tuple]]:
        """Key, number and time of each row, and what is kept of it."""
        raise NotImplementedError

    def begin(self, key: int, following: int, own: tuple | None, gaps: bool = False) -> None:
        """Before rows of a key count: the number whose turn it is, what own() gave last, and whether numbers may be left out."""
        raise NotImplementedError

    def count(self, key: int, number: int, row: tuple) -> tuple[list[tuple], bool]:
        """Result rows of the row whose turn it is, and whether its key ends with it."""
        raise NotImplementedError

    def own(self, key: int, following: int) -> tuple:
        """What is kept of the key, as the columns of `kept`, after all before `following` has counted."""
        raise NotImplementedError

    def forget(self, key: int, ended: bool) -> bool:
        """Drops the key's states of prepare(); returns whether an ended key must be remembered until its timer fires."""
        raise NotImplementedError

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns)

    def _block(self, key: int, block: int) -> dict[int, tuple]:
        """The rows that wait in a later block."""
        found = self.ahead.getValue((key, block))
        return {} if found is None else _by_number(found[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        timer, keys = self.alarm.get() or (None, 0)
        first, out = timer, []
        for pdf in rows:
            arrived: dict[int, dict[int, tuple]] = {}
            newest: dict[int, int] = {}
            for k, n, at, row in self.rows(pdf):
                arrived.setdefault(k, {})[n] = row
                newest[k] = max(newest.get(k, watermark), at)
            for k, new in arrived.items():
                until, more = None, 0
                for found, until, more in self._arrive(k, new, newest[k] + self.idle_ms):
                    out += found
                    if len(out) >= CHUNK:
                        yield self._frame(out)
                        out = []
                keys += more
                if until is not None:
                    first = until if first is None else min(first, until)
        if not keys:
            first = None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if keys:
            self.alarm.update((first, keys))
        elif timer is not None:
            self.alarm.clear()
        if out:
            yield self._frame(out)

    def _arrive(self, key: int, arrived: dict[int, tuple], until: int) -> Iterator[tuple[list[tuple], int | None, int]]:
        """Rows of the result; with the last ones when the key's time is over, if it is kept, and whether there is a key more or less."""
        found = self.places.getValue((key,))
        following, blocks, before, done, held, *own = found or (0, 0, until, False, ())
        until, ended, waiting = max(until, before), done, _by_number(held)
        arrived = {} if done else {n: row for n, row in arrived.items() if n >= following}  # a number that has counted doesn't again
        self.begin(key, following, own or None)
        out = []
        while not done:
            row, early = arrived.pop(following, None), waiting.pop(following, None)
            if row is None and early is None:
                break
            some, done = self.count(key, following, early if row is None else row)
            out += some
            following += 1
            if blocks and following % BLOCK == 0 and (waiting := self._block(key, following // BLOCK)):
                self.ahead.removeKey((key, following // BLOCK))
                blocks -= 1
            if len(out) >= CHUNK:
                yield out, None, 0
                out = []
        remembered = True
        if done and not ended:
            if blocks:
                self._drop(key)
            blocks, waiting, remembered = 0, {}, self.forget(key, True)
        elif not done:
            later: dict[int, dict[int, tuple]] = {}
            for n, row in arrived.items():
                if n // BLOCK == following // BLOCK:
                    waiting[n] = row
                else:
                    later.setdefault(n // BLOCK, {})[n] = row
            for block, new in later.items():
                known = self._block(key, block) if blocks else {}
                blocks += not known
                self.ahead.updateValue((key, block), ([(n, *row) for n, row in (known | new).items()],))
        if remembered:
            self.places.updateValue((key,), (following, blocks, until, done, [(n, *row) for n, row in waiting.items()], *self.own(key, following)))
        elif found is not None:
            self.places.removeKey((key,))
        yield out, until if remembered else None, int(remembered) - int(found is not None)

    def _drop(self, key: int) -> None:
        for at in [k for k in self.ahead.keys() if k[0] == key]:
            self.ahead.removeKey(tuple(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, first, keys, over, out = timerValues.getCurrentWatermarkInMs(), None, 0, [], []
        for k, place in self.places.iterator():
            if place[2] <= watermark:
                over.append(k[0])
            else:
                first, keys = place[2] if first is None else min(first, place[2]), keys + 1
        for k in over:
            following, blocks, _, done, held, *own = self.places.getValue((k,))
            self.begin(k, following, own, True)
            for block in [None, *(sorted(b for a, b in self.ahead.keys() if a == k) if blocks else [])]:
                waiting = _by_number(held) if block is None else self._block(k, block)
                for n in sorted(waiting):
                    if done:
                        break
                    some, done = self.count(k, n, waiting[n])
                    out += some
                    if len(out) >= CHUNK:
                        yield self._frame(out)
                        out = []
            if blocks:
                self._drop(k)
            self.forget(k, False)
            self.places.removeKey((k,))
        if keys:
            self.handle.registerTimer(first)
            self.alarm.update((first, keys))
        else:
            self.alarm.clear()
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def bucket_of(key: str) -> Column:
    """The group of a key's rows in a stateful stream."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def _ms() -> Column:
    return F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms")


def _by_number(rows: list[tuple] | None) -> dict[int, tuple]:
    return {r[0]: tuple(r[1:]) for r in rows or ()}


class _Propagate(_Ordered):
    waits, kept, columns = "ended:boolean", "objs array<bigint>, xyxys array<array<double>>", ["video_id", "frame_idx", "obj_id", "xyxy"]

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.prompts = handle.getMapState("prompts", "key bigint, block bigint", "frames array<bigint>, objs array<bigint>, xyxys array<array<double>>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for video, block, frames, objs, xyxys in zip(*(initialState[c].tolist() for c in ("video_id", "block", "frames", "objs", "xyxys")), strict=True):
            self.prompts.updateValue((video, block), ([int(f) for f in frames], [int(o) for o in objs], [[float(v) for v in box] for box in xyxys]))

    def rows(self, pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, tuple]]:
        return ((k, n, at, (e,)) for k, n, at, e in zip(*(pdf[c].tolist() for c in ("video_id", "frame_idx", "ms", "ended")), strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.told = None
        yield from super().handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.told = None
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def _blocks(self, key: int) -> set[int]:
        """The blocks with prompts of a video; those of a bucket are read once a batch."""
        if self.told is None:
            self.told = {}
            for k, block in self.prompts.keys():
                self.told.setdefault(k, set()).add(block)
        return self.told.get(key, set())

    def begin(self, key: int, following: int, own: tuple | None, gaps: bool = False) -> None:
        self.boxes = {o: list(box) for o, box in zip(*own, strict=True)} if own else {}
        self.since, self.block, self.due = following, None, []  # of the block whose turn it is the boxes that are still due, the next one last
        self.todo = sorted(self._blocks(key)) if gaps else None

    def _read(self, key: int, block: int) -> None:
        if told := self.prompts.getValue((key, block)):
            due = [x for x in zip(*told, strict=True) if x[0] >= self.since or not self.since]
            self.due = sorted(due, key=lambda x: -x[0]) + self.due

    def _leave(self, key: int, block: int) -> None:
        if block in self._blocks(key):
            self._blocks(key).remove(block)
            self.prompts.removeKey((key, block))

    def count(self, key: int, number: int, row: tuple) -> tuple[list[tuple], bool]:
        block = number // BLOCK
        if self.todo is None and block != self.block:
            if self.block is not None:
                self._leave(key, self.block)
            if block in self._blocks(key):
                self._read(key, block)
            self.block = block
        while self.todo and self.todo[0] <= block:
            self._read(key, self.todo.pop(0))
        while self.due and self.due[-1][0] <= number:  # prompts of frames up to this one
            _, o, box = self.due.pop()
            self.boxes[o] = list(box)
        return [(key, number, o, self.boxes[o]) for o in sorted(self.boxes)] or [(key, number, None, None)], row[0]

    def own(self, key: int, following: int) -> tuple:
        if self.block is not None and self.block != following // BLOCK:
            self._leave(key, self.block)
        return list(self.boxes), list(self.boxes.values())

    def forget(self, key: int, ended: bool) -> bool:
        for block in list(self._blocks(key)):
            self._leave(key, block)
        return False


def propagate_stream(frames: DataFrame, prompts: DataFrame, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """ST1-ST3: frames (video_id, frame_idx, ts, ended: true on a video's last) in any order of arrival to one result for each frame
    and object, in frame order: the object's latest box at or before it (a frame before any box has one result without an
    object). prompts (as tidy_prompts gives them, with video_id) are a batch table: the boxes in it are the state with which
    their videos begin, and never pass through the stream.

    Frames that come too early wait in the state; one whose number has had its result is ignored. At its end a video's state
    goes, and so it does idle_ms of event time after its newest frame: what waits is then given out over the gaps."""
    stateful(frames.sparkSession)
    boxes = prompts.filter("kind = 'box'").groupBy("video_id", "frame_idx", "obj_id").agg(F.max_by("xyxy", "seq").alias("xyxy"))
    each = boxes.groupBy("video_id", F.expr(f"greatest(frame_idx, 0) div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("frame_idx", "obj_id", "xyxy")).alias("b"))
    first = each.select(bucket_of("video_id"), "video_id", "block", F.col("b.frame_idx").alias("frames"), F.col("b.obj_id").alias("objs"), F.col("b.xyxy").alias("xyxys"))
    rows = frames.select(bucket_of("video_id"), "video_id", "frame_idx", "ts", _ms(), "ended").withWatermark("ts", late)
    schema = "video_id bigint, frame_idx bigint, obj_id bigint, xyxy array<double>"
    return rows.groupBy("bucket").transformWithStateInPandas(_Propagate(idle_ms), schema, "append", "EventTime", initialState=first.groupBy("bucket"))


class _Clicks(_Ordered):
    waits, kept, columns = "action:string,digit:int", "active bigint", ["session", "seq", "obj_id", "label", "action"]

    def __init__(self, start: int, idle_ms: int):
        super().__init__(idle_ms)
        self.start = start

    def rows(self, pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, tuple]]:
        cells = zip(*(pdf[c].tolist() for c in ("session", "seq", "ms", "action", "digit")), strict=True)
        return ((k, n, at, (a, None if pd.isna(d) else int(d))) for k, n, at, a, d in cells)

    def begin(self, key: int, following: int, own: tuple | None, gaps: bool = False) -> None:
        self.active = own[0] if own else self.start

    def count(self, key: int, number: int, row: tuple) -> tuple[list[tuple], bool]:
        action, digit = row
        if action in ("enter", "escape"):
            return [(key, number, None, None, action)], True
        if action == "digit":
            self.active = digit
        elif action == "next":
            self.active += 1
        elif action in ("left", "right"):
            return [(key, number, self.active, int(action == "left"), action)], False
        return [], False

    def own(self, key: int, following: int) -> tuple:
        return (self.active,)

    def forget(self, key: int, ended: bool) -> bool:
        return ended  # later events of an ended session must find that it has ended


def active_object_stream(log: DataFrame, start: int = 1, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """ST4: the points of click logs (session, seq from 0 without gaps, ts, action, digit), and the event that ended each; a reader
    drops sessions that end by escape. Events count in the order of seq, whichever batch they come in: early ones wait in
    the state. Of an ended session only that it ended is kept, until idle_ms of event time after its newest event; one that
    hasn't ended by then is dropped after what waits has counted."""
    stateful(log.sparkSession)
    rows = log.select(bucket_of("session"), "session", "seq", "ts", _ms(), "action", "digit").withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(_Clicks(start, idle_ms), "session bigint, seq bigint, obj_id bigint, label int, action string", "append", "EventTime")


def fps_stream(timings: DataFrame, warmup: int = 0) -> DataFrame:
    """ST5: running counters of fps_summary, one row a run, for update mode; metrics.fps_of finishes them."""
    return fps_counters(timings, warmup)
