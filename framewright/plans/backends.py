"""Backends: named ways to get from frames and prompts to masks or boxes."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.masks import masks_of_logits
from framewright.operators.ranges import latest
from framewright.schemas import BACKENDS

Backend = Callable[..., DataFrame]
_REGISTRY: dict[str, Backend] = {}


def register_backend(name: str) -> Callable[[Backend], Backend]:
    """UD1: a decorator; a name that is registered again is replaced."""

    def add(backend: Backend) -> Backend:
        _REGISTRY[name] = backend
        return backend

    return add


def available_backends() -> list[str]:
    return sorted(_REGISTRY)


def build_backend(name: str) -> Backend:
    if name not in _REGISTRY:
        raise KeyError(f"unknown backend {name}; known are {', '.join(available_backends())}")
    return _REGISTRY[name]


def backends_table(spark: SparkSession) -> DataFrame:
    """The registry as a table to join jobs with."""
    return spark.createDataFrame([(n, n, n != "unsupported", "float32", None, None, None, 0.0) for n in available_backends()], BACKENDS)


@register_backend("logits")
def logits_backend(logits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """UD4: masks from logits that a model left behind."""
    return masks_of_logits(logits, threshold)


@register_backend("carry")
def carry_backend(frames: DataFrame, prompts: DataFrame) -> DataFrame:
    """UD3: for each frame and object of a video the object's latest box at or before that frame. A repeated box of one
    frame and object: the last in file order."""
    boxes = prompts.filter("kind = 'box'").groupBy("video_id", "frame_idx", "obj_id").agg(F.max_by("xyxy", "seq").alias("xyxy"))
    objects = boxes.select("video_id", "obj_id").distinct()
    grid = frames.select("video_id", "frame_idx").join(objects, "video_id")
    rows = grid.join(boxes, ["video_id", "frame_idx", "obj_id"], "left").withColumnRenamed("xyxy", "_box")
    return latest(rows, ["video_id", "obj_id"], "frame_idx", "_box", "xyxy").select("video_id", "frame_idx", "obj_id", "xyxy")


@register_backend("unsupported")
def unsupported_backend(*_args, **_kwargs) -> DataFrame:
    """UD5: there, but not to be used."""
    raise NotImplementedError("this backend isn't supported")


@register_backend("prompted")
def prompted_backend(logits: DataFrame, prompts: DataFrame, threshold: float = 0.0) -> DataFrame:
    """UD4 with prompts: masks of the prompted objects, each from the first frame that it is prompted on."""
    first = prompts.groupBy("video_id", "obj_id").agg(F.min("frame_idx").alias("_from"))
    return masks_of_logits(logits.join(first, ["video_id", "obj_id"]).filter("frame_idx >= _from"), threshold)


class StepBackend(ABC):
    """UD2: a model that sees the frames of one video in order. Each Python worker builds it once and keeps it for the tasks
    that follow."""

    @abstractmethod
    def init(self, video_id: int, prompts: pd.DataFrame) -> object:
        """A video's first state from its prompts."""

    @abstractmethod
    def step(self, state: object, frame: object) -> tuple[object, list[tuple[int, list[float]]]]:
        """The next state, and object ids with logits. frame: a named tuple of video_id, frame_idx and the frame's columns."""

    def reset(self, state: object) -> None:
        """ST3: lets go of a state; called also after an error."""


@lru_cache(4)
def _model(pickled: bytes) -> StepBackend:
    """A worker's own model; the same backend isn't built again."""
    return cloudpickle.loads(pickled)()


def run_steps(frames: DataFrame, prompts: DataFrame, backend: Callable[[], StepBackend], frame_cols: list[str]) -> DataFrame:
    """UD2: video_id, frame_idx, obj_id, logits. Frames of a video pass through one task in order, a batch at a time, with a
    video's prompts before its frames; memory holds one Arrow batch and the state, however long the video is."""
    told_cols = ["obj_id", "kind", "xyxy", "xy", "label", "seq"]
    told = prompts.select("video_id", "frame_idx", F.lit(False).alias("is_frame"), *told_cols)
    rows = frames.select("video_id", "frame_idx", F.lit(True).alias("is_frame"), *frame_cols)
    mixed = told.unionByName(rows, allowMissingColumns=True).repartition("video_id").sortWithinPartitions("video_id", "is_frame", "frame_idx", "seq")
    pickled = cloudpickle.dumps(backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, state, now, held = _model(pickled), None, None, []
        begun = False
        try:
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    if row.video_id != now:
                        if begun:
                            model.reset(state)
                        now, held, begun = row.video_id, [], False
                    if not row.is_frame:
                        held.append(row)
                        continue
                    if not begun:
                        state, begun = model.init(now, pd.DataFrame(held, columns=pdf.columns)), True
                    state, found = model.step(state, row)
                    out += [(now, row.frame_idx, o, v) for o, v in found]
                yield pd.DataFrame(out, columns=["video_id", "frame_idx", "obj_id", "logits"])
        finally:
            if begun:
                model.reset(state)

    return mixed.mapInPandas(run, f"video_id {frames.schema['video_id'].dataType.simpleString()}, frame_idx bigint, obj_id bigint, logits array<double>")
