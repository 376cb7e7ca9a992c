"""Prompt files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.prompts import tidy_prompts
from framewright.schemas import PROMPT_FILE
from framewright.sources.frames import write_files


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON file for each video: file, kind, obj_id, frame_idx, xyxy, xy, label, seq. No prompt at all is an error; files
    without one are found by without_prompts."""
    parsed = spark.read.schema(PROMPT_FILE).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    prompts = tidy_prompts(parsed, "file")
    if not prompts.limit(1).count():
        raise ValueError(f"no prompts in {path}")
    return prompts


def write_prompt_files(texts: DataFrame, path: str) -> None:
    """A prompt file for each row: name and text (JSON)."""
    write_files(texts.select("name", "text"), path, lambda r: ("", r.name, r.text.encode()))
