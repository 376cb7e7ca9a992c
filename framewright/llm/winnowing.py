"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits, a-z (A-Z lower-cased) and non-ASCII characters. A window is `span` consecutive
words of a benchmark item, or the whole item if it is shorter. Of each `span - k + 1` consecutive k-grams the one
with the least hash is kept, so that equal windows keep an equal k-gram; training and test fingerprints meet in a
hash join and each meeting is extended word by word in both directions. A word of a document is hit if it lies in
an occurrence of a window. Items shorter than `span` have one fingerprint, of the whole item, and the documents'
n-grams of just those lengths are looked up.

A bit map of fixed size (2 MB) of the items' fingerprints keeps other fingerprints from being shuffled; with very
many items it fills up and only saves less. No side of the join is broadcast by request.

Edge cases: a null or empty text has no words and isn't contaminated; items without words are left out; item_ids
count once however often an item is repeated; every row of the documents gives one of its own, whether its doc_id is
null or occurs again; items with a null id are ids of no one and left out of item_ids, their hits count; a long text is
read whole, a very long one alone; other columns, whatever their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm._common import slices
from framewright.llm._words import LETTERS, Words, grams

_BITS = 24
_CAND = "array<struct<h:bigint,need:int,pos:int,lead:int,ctx:array<string>>>"


def winnow(h: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Indexes of k-grams that are least in some run of w k-grams inside one text; first: word offsets of texts.

    h has the k-grams of all words of the batch. Ties keep each of the equal ones."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = h[:n].copy()
    for i in range(1, w):
        np.minimum(least, h[i : i + n], out=least)
    whole = np.zeros(n, bool)  # runs inside one text
    last = first[1:] - (w + k - 1)
    edge = np.zeros(n + 1, np.int64)
    ok = last >= first[:-1]
    np.add.at(edge, first[:-1][ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    whole = np.cumsum(edge[:n]) > 0
    keep = np.zeros(len(h), bool)
    for i in range(w):
        keep[i : i + n] |= whole & (h[i : i + n] == least)
    return np.flatnonzero(keep)


def _rows(words: Words, i: int, at: np.ndarray, h: np.ndarray, need: int, k: int) -> list[dict]:
    """A fingerprint with the words around it that a window through it can reach."""
    a, b, out = words.first[i], words.first[i + 1], []
    for p in at:
        lo, hi = max(a, p - (need - k)), min(b, p + need)
        out.append({"h": int(h[p].astype(np.int64)), "need": need, "pos": int(p - a), "lead": int(p - lo), "ctx": words.strings(lo, hi)})
    return out


def _scan(id_col: str, text_col: str, span: int, k: int, short: list[int], bits):
    """A mapInArrow function: id, n_words, fingerprints. bits: of items' fingerprints, or None to fingerprint items."""
    w = span - k + 1

    def run(batches):
        held = None if bits is None else np.unpackbits(bits.value, bitorder="little").view(bool)
        for batch in slices(batches, text_col):
            words = Words(batch.column(text_col), LETTERS)
            hashes, counts = words.hashes(), words.counts()
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for need, kk in [(span, k), *((n, n) for n in short)]:
                h = grams(hashes, kk)
                if need == span:
                    at = winnow(h, words.first, kk, w)
                else:
                    fits = np.repeat(words.first[1:] - kk, counts)[: len(h)]
                    at = np.flatnonzero(np.arange(len(h)) <= fits)
                    if held is None:  # an item shorter than the span is one window
                        at = at[np.repeat(counts, counts)[at] == kk]
                if held is not None:
                    at = at[held[(h[at] >> np.uint64(64 - _BITS)).astype(np.int64)]]
                doc = np.searchsorted(words.first, at, "right") - 1
                for i in np.unique(doc):
                    found[i] += _rows(words, i, at[doc == i] if len(at) < 64 else at[np.searchsorted(doc, i) : np.searchsorted(doc, i, "right")], h, need, kk)
            typ = pa.list_(pa.struct([("h", pa.int64()), ("need", pa.int32()), ("pos", pa.int32()), ("lead", pa.int32()), ("ctx", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(found, typ)], names=["id", "n_words", "cands"])

    return run


def _scanned(df: DataFrame, id_col: str, text_col: str, *args) -> DataFrame:
    picked = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_scan("id", "text", *args), f"id bigint, n_words bigint, cands {_CAND}")


def _bit_map(prints: DataFrame):
    """2 ** 24 bits, set at the items' fingerprints: at most 262,144 longs reach the driver, whatever the items are."""
    slot = F.shiftrightunsigned("h", 64 - _BITS)
    words = prints.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - _BITS}) & 63 as int))")).alias("b"))
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    for w, b in words.toLocalIterator():
        bits[w] = b
    return prints.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """Per document: id_col, n_words, n_hit, item_ids (sorted as strings), spans (of hit words, [start, stop))."""
    sized = _scanned(items, item_col, text_col, span, k, list(range(1, span)), None).filter("n_words > 0")
    short = [r[0] for r in sized.filter(F.col("n_words") < span).select("n_words").distinct().collect()]  # at most span - 1 lengths
    prints = sized.select(F.col("id").alias("item"), F.explode("cands").alias("c")).select("item", *[F.col(f"c.{x}").alias(x) for x in ("h", "need", "lead", "ctx")]).distinct()
    scanned = _scanned(docs, id_col, text_col, span, k, sorted(short), _bit_map(prints))
    # Documents without a candidate meet no item; a key of their own keeps them from meeting in one task.
    scanned = scanned.withColumn("row", F.monotonically_increasing_id())
    cands = scanned.select("row", "id", "n_words", F.explode_outer("cands").alias("c")).select("row", "id", "n_words", "c.need", "c.pos", "c.lead", "c.ctx", F.coalesce("c.h", F.xxhash64("row")).alias("h"))
    met = cands.alias("d").join(prints.alias("i"), "h", "left")
    size = F.when(F.col("d.need") == span, k).otherwise(F.col("d.need"))
    left = F.expr("coalesce(array_max(filter(sequence(0, least(d.lead, i.lead)), j -> slice(d.ctx, d.lead - j + 1, j) = slice(i.ctx, i.lead - j + 1, j))), 0)")
    right = F.expr("coalesce(array_max(filter(sequence(0, least(size(d.ctx) - d.lead, size(i.ctx) - i.lead)), j -> slice(d.ctx, d.lead + 1, j) = slice(i.ctx, i.lead + 1, j))), 0)")
    met = met.select("row", "id", "n_words", "item", "d.pos", "d.need", left.alias("l"), right.alias("r"), size.alias("k"), (F.col("d.need") == F.col("i.need")).alias("same"))
    hit = F.col("same") & (F.col("r") >= F.col("k")) & (F.col("l") + F.col("r") >= F.col("need"))
    per = met.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b")))).alias("s"),
        F.sort_array(F.collect_set(F.when(hit, F.col("item").cast("string")))).alias("item_ids"),
    )
    # Overlapping spans, in order of start, counted once.
    merged = F.expr("aggregate(sort_array(s), array(named_struct('a', -1, 'b', -1)), (acc, x) -> if(x.a <= element_at(acc, -1).b, concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))), concat(acc, array(x))), acc -> slice(acc, 2, size(acc)))")
    return per.select(F.col("id").alias(id_col), "n_words", "item_ids", merged.alias("spans")).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.b - x.a)"))
