"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the byte n-grams, n = 1 to 3, that both hold (A-Z lower-cased;
a letter beyond ASCII is two or more bytes), over the n-grams of the landmark texts, and is normalised to 1 for equal
texts. Landmarks drawn from each language give the Nyström map z(x) = K(x, landmarks) K(landmarks, landmarks)^(-1/2);
on it one-versus-rest ridge regression with targets +1 and -1 is solved in closed form. Texts are scored in batches
by matrix products, each over all its bytes.

The classifier is fitted on a bounded sample: at most `max_rows` labelled rows of at most `max_bytes` each, spread evenly over
the languages by a hash of their ids. Everything else covers all rows and whole texts.

Edge cases: a text that is null or has no letter is `und` with score 0; rows without a language don't train; without
any training rows all are `und`; ties go to the language that sorts first; repeated rows are judged alike; a very long
text is judged whole, alone; other columns pass through and columns
named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm._words import utf8

_LETTER = regex.compile(r"\p{L}")
_CHUNK = 128


def _codes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, and the texts they are in."""
    n = int(at[-1])
    b = buf[: n + 2].astype(np.int32)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # bytes up to the end of the text
    two, three = left > 1, left > 2
    codes = [b[:n], 256 + (b[:n] << 8 | b[1 : n + 1])[two], 65792 + (b[:n] << 16 | b[1 : n + 1] << 8 | b[2 : n + 2])[three]]
    return np.concatenate(codes), np.concatenate([doc, doc[two], doc[three]])


@dataclass
class KernelModel:
    """What a fitted model needs; its size is bounded by the landmarks' number and n-grams."""

    langs: list[str]
    grams: np.ndarray  # sorted codes of the landmarks' n-grams
    held: np.ndarray  # n-grams x landmarks, 1 where present, over the root of the landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_place"}  # a table of 67 MB that each worker makes for itself

    def kernel(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts x landmarks."""
        if not hasattr(self, "_place"):
            self._place = np.full(65792 + (1 << 24), -1, np.int32)
            self._place[self.grams] = np.arange(len(self.grams))
        out = np.zeros((len(at) - 1, self.held.shape[1]), np.float32)
        lo = 0
        while lo < len(at) - 1:  # as many texts as make a matrix of moderate size
            hi = min(lo + _CHUNK, max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), "right")) - 1), len(at) - 1)
            codes, doc = _codes(buf[at[lo] : at[hi] + 8], at[lo : hi + 1] - at[lo])
            col = self._place[codes]
            x = np.zeros((hi - lo, len(self.grams)), np.float32)
            x[doc[col >= 0], col[col >= 0]] = 1
            size = x.sum(1, keepdims=True)
            out[lo:hi] = (x @ self.held) / np.sqrt(np.maximum(size, 1))
            lo = hi
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        buf, at = utf8(texts)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        scores = self.kernel(buf, at) @ self.weights
        best = scores.argmax(1)
        sure = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1).tolist()
        letters = [bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()]
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [s if ok else 0.0 for s, ok in zip(sure, letters, strict=True)]


def _sample(labelled: DataFrame, id_col: str, lang_col: str, max_rows: int) -> list[tuple[str, str]]:
    counts = dict(labelled.groupBy(lang_col).count().collect())
    if not counts:
        return []
    share = max(1, max_rows // len(counts))
    unit = 1 << 20
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen |= (F.col(lang_col) == lang) & (F.pmod(F.xxhash64(F.col(id_col)), F.lit(unit)) < int(unit * min(1.0, share / n)))
    rows = labelled.filter(chosen).select(F.col(lang_col).cast("string"), "text").limit(2 * max_rows).collect()
    seen: dict[str, int] = {}
    out = []
    for lang, text in sorted(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= share:
            out.append((lang, text))
    return out


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 1200, max_bytes: int = 1 << 16, landmarks: int = 96, ridge: float = 0.1) -> KernelModel:
    """labelled: rows to learn from. The sample of max_rows texts of max_bytes at most is gathered on the driver."""
    rows = _sample(_usable(labelled, id_col, text_col, lang_col, max_bytes), id_col, lang_col, max_rows)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return KernelModel([], np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32))
    each = max(2, landmarks // len(langs))
    chosen: list[str] = []
    for lang in langs:
        own = [t for x, t in rows if x == lang]
        chosen += own[:: max(1, len(own) // each)][:each]
    codes, doc = _codes(*utf8(pa.array(chosen)))
    pairs = np.unique(codes.astype(np.int64) * len(chosen) + doc)
    grams, col = np.unique(pairs // len(chosen), return_inverse=True)
    held = np.zeros((len(grams), len(chosen)), np.float32)
    held[col, pairs % len(chosen)] = 1
    held /= np.sqrt(held.sum(0, keepdims=True))
    values, vectors = np.linalg.eigh((held.T @ held).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    model = KernelModel(langs, grams, held, root)
    z = model.kernel(*utf8(pa.array([t for _, t in rows]))) @ root
    y = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(langs)[None], 1.0, -1.0)
    weight = np.sqrt(1 / np.array([sum(lang == x for x, _ in rows) for lang, _ in rows]))[:, None]  # each language counts alike
    zw = z * weight
    w = np.linalg.solve(zw.T @ zw + ridge / len(rows) * np.eye(z.shape[1]), zw.T @ (y * weight))
    return KernelModel(langs, grams, held, (root @ w).astype(np.float32))


#: Up to so many bytes a text is judged with those of its size: short ones score lower.
SIZES = [64, 256]


def _usable(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, max_bytes: int) -> DataFrame:
    labelled = labelled.filter(F.octet_length(F.col(text_col).cast("string")) <= max_bytes)
    return labelled.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.col(lang_col)).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col("text").rlike(r"\p{L}"))


def least_scores(model: KernelModel, held_out: DataFrame, *, text_col: str = "text", lang_col: str = "lang", share: float = 0.0001) -> list[float]:
    """For each class of SIZES (and what is longer) a low threshold of the score: 0.95 times the quantile `share` of the scores of all
    labelled rows that the model hasn't seen, at most 0.5 (where the best language is as likely not it); 0 without such rows.
    One pass over them, with quantiles of bounded size; no row goes to the driver."""
    rows = held_out.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text")
    kind = sum((F.when(size >= most, 1).otherwise(0) for most in SIZES), F.lit(0))
    found = with_language(rows.withColumn("_kind", kind), model).groupBy("_kind").agg(F.percentile_approx("score", share, 100_000).alias("low")).collect()  # a row a class
    low = {r["_kind"]: r["low"] for r in found}
    return [min(0.5, 0.95 * low[i]) if i in low else 0.0 for i in range(len(SIZES) + 1)]


def predicted(text: Column, model: KernelModel, spark) -> Column:
    """struct<lang_pred:string,score:double>"""
    shared = spark.sparkContext.broadcast(model)  # bounded: at most the landmarks' n-grams times the landmarks

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judged(texts: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return judged(text.cast("string"))


def with_language(df: DataFrame, model: KernelModel, *, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "_judged")]
    return df.withColumn("_judged", predicted(F.col(text_col), model, df.sparkSession)).select(*kept, "_judged.*")
