"""Jobs: settings of runs, checked and resolved in bulk; what would stop a run becomes its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import normalise_precision, resolve_path, suffix_lower


def video_mode(mode: Column, path: Column, decoder: Column) -> tuple[Column, Column]:
    """Jpg as told; mp4 needs the suffix, then the decoder; else mp4 if both are there."""
    suffix = suffix_lower(path)
    error = F.when((mode == "mp4") & (suffix != ".mp4"), F.concat(F.lit("only .mp4 files can be read as mp4, not "), suffix)).when((mode == "mp4") & ~decoder, "mp4 mode needs a decoder")
    return F.when(error.isNotNull(), None).when(mode == "jpg", "jpg").when((suffix == ".mp4") & decoder, "mp4").otherwise("jpg"), error


def source(frames_dir: Column, video_path: Column) -> tuple[Column, Column]:
    """Frames before video; neither is an error."""
    kind = F.when(frames_dir.isNotNull(), "frames").when(video_path.isNotNull(), "video")
    return kind, F.when(kind.isNull(), "needs a video or a frame directory")


def fallback(name: Column, engine_ok: Column, strict: Column, other: Column) -> tuple[Column, Column]:
    """A backend whose engine can't be used gives way to its plain one, or stops if strict."""
    broken = F.coalesce(~engine_ok, F.lit(False))
    return F.when(broken & ~strict, other).when(~broken, name), F.when(broken & strict, F.concat(F.lit("engine unavailable for "), name))


def prompt_source(mode: Column, file: Column, multi: Column) -> tuple[Column, Column]:
    """P14"""
    error = F.when(~mode.isin("box", "point", "file"), F.concat(F.lit("unknown prompt mode "), mode)).when((mode == "file") & (file.isNull() | (file == "")), "file mode needs a prompt file")
    kind = F.when(error.isNotNull(), None).when(mode == "file", file).when(multi, F.concat(mode, F.lit(" (multi)"))).otherwise(mode)
    return kind, error


def known_backends(backends: DataFrame) -> DataFrame:
    """All names, sorted, in one row."""
    return backends.agg(F.sort_array(F.collect_set("name")).alias("known"))


def unknown_backends(jobs: DataFrame, backends: DataFrame) -> DataFrame:
    """Jobs whose backend no one registered."""
    return jobs.join(backends.select(F.col("name").alias("tracker")), "tracker", "left_anti")


def resolve(jobs: DataFrame, backends: DataFrame, root: str = "/srv/run") -> DataFrame:
    """P7, P8, P11-P14, J4, S6, UD5: job_id, source, mode, backend, precision, checkpoint, prompt_source, error.

    jobs: job_id, tracker, config, frames_dir, video_path, video_mode, decoder, precision, checkpoint, prompt_mode,
    prompts_file, multi. The config of a job is its override or the tracker's own name; the first error counts."""
    chosen = backends.select(F.col("name").alias("tracker"), F.lit(True).alias("known"), "supported", "engine_ok", "strict", "fallback", F.col("precision").alias("own_precision"))
    configs = backends.filter("config is not null").select(F.col("config").alias("used"), F.lit(True).alias("configured")).distinct()
    joined = jobs.withColumn("used", F.coalesce("config", "tracker")).join(configs, "used", "left").join(chosen, "tracker", "left")
    src, src_error = source(F.col("frames_dir"), F.col("video_path"))
    mode, mode_error = video_mode(F.col("video_mode"), F.col("video_path"), F.col("decoder"))
    by_video = src == "video"
    backend, backend_error = fallback(F.col("tracker"), F.col("engine_ok"), F.col("strict"), F.col("fallback"))
    precision, precision_error = normalise_precision(F.coalesce("precision", "own_precision"))
    prompts, prompt_error = prompt_source(F.col("prompt_mode"), F.col("prompts_file"), F.col("multi"))
    error = F.coalesce(
        F.when(F.col("configured").isNull(), F.concat(F.lit("no config "), F.col("used"))), F.when(F.col("known").isNull(), F.concat(F.lit("unknown backend "), F.col("tracker"))), precision_error, prompt_error, src_error,
        F.when(by_video, mode_error), F.when(~F.col("supported"), F.concat(F.lit("backend not supported: "), F.col("tracker"))), backend_error,
    )
    ok = error.isNull()
    return joined.select("job_id", F.when(ok, src).alias("source"), F.when(ok & by_video, mode).alias("mode"), F.when(ok, backend).alias("backend"), F.when(ok, precision).alias("precision"), F.when(ok, resolve_path(F.col("checkpoint"), root)).alias("checkpoint"), F.when(ok, prompts).alias("prompt_source"), error.alias("error"))
