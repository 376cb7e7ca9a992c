"""Scalar functions as Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of objects 1 to 6, as blue, green, red; later objects start over.
PALETTE_BGR = [(255, 56, 56), (56, 255, 56), (56, 56, 255), (255, 255, 56), (255, 56, 255), (56, 255, 255)]
#: Names of number formats and their short forms.
PRECISIONS = {"bf16": "bfloat16", "fp16": "float16", "fp32": "float32"}


def suffix_lower(path: Column) -> Column:
    """the file suffix in lower case, '' without one (a leading dot starts no suffix)."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))


def frame_name(index: Column) -> Column:
    """00000.jpg and so on."""
    return F.format_string("%05d.jpg", index)


def glob_match(name: Column, pattern: str = "*.tif*") -> Column:
    """shell-style matching of * and ? on a catalog column."""
    return name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in pattern) + "$")


def clamp_warmup(warmup: Column, frames: Column) -> Column:
    """the warm-up that leaves at least one frame."""
    return F.greatest(F.lit(0), F.least(warmup, frames - 1))


def object_label(obj_id: Column) -> Column:
    """the text next to a box."""
    return F.concat(F.lit("id="), obj_id.cast("string"))


def label_anchor_y(y1: Column) -> Column:
    """six pixels over the box, within the frame."""
    return F.greatest(F.lit(0), y1 - 6)


def colour_rgb(obj_id: Column) -> Column:
    """array(r, g, b) of an object; ids repeat the palette, negative ones as Python's modulo does."""
    palette = F.array(*[F.array(*[F.lit(v) for v in reversed(c)]) for c in PALETTE_BGR])
    return F.element_at(palette, (F.pmod(obj_id - 1, F.lit(len(PALETTE_BGR))) + 1).cast("int"))


def gray_to_rgb(v: Column) -> Column:
    """F7"""
    return F.array(v, v, v)


def bytes_of(values: Column) -> Column:
    """binary: an array of whole numbers from 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def byte_at(data: Column, place: Column) -> Column:
    """The byte at a place (from 0) as a number."""
    return F.conv(F.hex(F.substring(data, place + 1, F.lit(1))), 16, 10).cast("int")


def to_rgb(pixel: Column) -> Column:
    """F8: blue, green, red (and alpha, which goes) to red, green, blue."""
    return F.reverse(F.slice(pixel, 1, 3))


def slice_tail(values: Column, skip: Column) -> Column:
    """an array without its first values."""
    return F.slice(values, skip + 1, F.size(values))


def blend(pixel: Column, colours: Column, alpha: float = 0.5) -> Column:
    """one channel under the colours of the masks on it, in their order; every step is cut to a whole number."""
    return F.aggregate(colours, pixel.cast("double"), lambda below, c: F.floor(F.lit(alpha) * c + F.lit(1 - alpha) * below).cast("double")).cast("int")


def instant_fps(dt: Column) -> Column:
    """P10"""
    return F.when(dt > 0, 1 / dt).otherwise(0.0)


def default_fps(fps: Column) -> Column:
    """0 and null are 30."""
    return F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(30.0))


def box_of_roi(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corner and size to two corners."""
    return F.array(x.cast("double"), y.cast("double"), (x + w).cast("double"), (y + h).cast("double"))


def depth_to_uint8(v: Column, lo: Column, hi: Column, bits: Column, is_float: Column) -> Column:
    """Eight-bit values stay, others spread over 0..255 by the frame's own range: whole numbers rounded half to even,
    real ones cut, a frame of one value all 0."""
    scaled = (v - lo) * 255.0 / (hi - lo)
    return F.when(bits == 8, v).when(hi == lo, 0).when(is_float, F.floor(scaled)).otherwise(F.rint(scaled)).cast("int")


def normalise_precision(name: Column) -> tuple[Column, Column]:
    """The full name, and an error if there is none."""
    full = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECISIONS.items() for x in kv]), name), name)
    return full, F.when(~full.isin(*PRECISIONS.values()), F.concat(F.lit("unsupported precision "), name))


def resolve_path(path: Column, root: str) -> Column:
    """Relative paths under root; null and '' stay."""
    return F.when((path.isNull()) | (path == "") | path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root), path))


def get_or(value: Column, default) -> Column:
    """a JSON field or its default."""
    return F.coalesce(value, F.lit(default))
