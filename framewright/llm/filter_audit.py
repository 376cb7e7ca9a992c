"""How filters of documents interact: for every order of applying them, what each removes, what others removed before it and what it
alone would have caught, with Shapley values.

Each document's failures are one bit each; counts of bit combinations, a few for each part of the corpus, tell the rest. Copies are found
by an existential self-join: left-semi on the text's hash, the exact text and a smaller id. Its right side is reduced to the least
id of each text before it moves, only rows whose hash several ids share take part, and a text that is everywhere is dealt out by salts
on the left and repeated for each on the right. Texts move for that join alone; all else are ids and bits.

Null texts are empty, and so copies of empty ones; rows with a null id are never copies and no row's originals; a repeated row
counts as often as it is there, and isn't a copy of itself; a null source is the part ''; documents without a label are neither good
nor toxic, one with several labels is what any of them says; empty tables give no row; other columns aren't read.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm._common import materialise, sieve

#: Groups of copies are split into parts of this many rows, or of this share of all rows if that is more.
SPLIT_ROWS, SPLIT_SHARE = 100, 2048


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(words(text)) < least


def repetitive(text: Column, percent: int = 50) -> Column:
    """Fewer different words than so many percent of all."""
    w = words(text)
    return 100 * F.size(F.array_distinct(w)).cast("bigint") < percent * F.size(w).cast("bigint")


def shouting(text: Column, percent: int = 2) -> Column:
    """More letters A-Z than so many percent of all characters."""
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") > percent * F.length(text).cast("bigint")


def has_symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


FILTERS = {"A": few_words, "B": repetitive, "C": shouting, "D": has_symbols}


def copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text: not null, hash: a whole number from the text) whose text a row with a smaller id has."""
    total = docs.count()
    groups = docs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = materialise(groups.filter("least < most").select("hash", "n"), "shared")
    part = max(SPLIT_ROWS, math.ceil(total / SPLIT_SHARE))
    hot = shared.filter(F.col("n") > part).select("hash", F.ceil(F.col("n") / part).cast("int").alias("salts"))  # SPLIT_SHARE rows at most
    some = docs.filter(sieve(shared, "hash")(F.col("hash"))).join(F.broadcast(hot), "hash", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    first = some.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("least"))
    first = first.select("hash", "text", "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = some.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    same = (left["hash"] == first["hash"]) & (left["salt"] == first["salt"]) & (left["text"] == first["text"]) & (first["least"] < left["doc_id"])
    return left.join(first, same, "left_semi").drop("salt", "salts")


def combinations(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """part, bits (bit i: fails the i-th filter; the last bit, beyond filters: is a copy), n, good, toxic: documents of docs (doc_id,
    text, source) by the filters that they fail. labels: doc_id, quality, toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))
    bits = sum((F.when(fails(F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    failed = rows.select("doc_id", "hash", "part", bits.alias("bits"), F.lit(1).cast("bigint").alias("n"))
    copied = copies(rows).select("doc_id", "hash", "part", F.lit(1 << len(filters)).alias("bits"), F.lit(0).cast("bigint").alias("n"))
    each = failed.unionByName(copied).groupBy("doc_id", "hash", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    each = each.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    told = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return each.join(told, "doc_id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(combined: DataFrame, names: str) -> DataFrame:
    """From combinations(): part, filter_order (every order of names, a letter for each bit), step (from 1) and the counts of the
    filter that stands there: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "bit": 1 << names.index(letter), "before": sum(1 << names.index(x) for x in order[:i])}
        for order in itertools.permutations(names) for i, letter in enumerate(order)
    ]
    orders = math.factorial(len(names))
    parts = combined.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # at most 2 ** len(names)
    spec = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = parts.withColumn("s", F.explode(spec)).select("part", "c", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(value, when) -> Column:
        return F.aggregate(F.filter("c", when), F.lit(0).cast("bigint"), lambda a, x: a + value(x))

    fails, earlier = lambda x: x["bits"].bitwiseAND(bit) != 0, lambda x: x["bits"].bitwiseAND(before) != 0
    removed = lambda x: fails(x) & ~earlier(x)
    n = lambda x: x["n"]
    return rows.select(
        "part", "filter_order", "step", total(n, lambda x: ~fails(x) & ~earlier(x)).alias("kept"), total(n, removed).alias("removed"),
        total(n, lambda x: fails(x) & earlier(x)).alias("redundant"), total(n, lambda x: x["bits"] == bit).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"), total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(lambda x: x["n"] * F.floor(F.lit(orders) / F.bit_count(x["bits"])).cast("bigint"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, copy: str = "E") -> DataFrame:
    """interactions() of the filters, by letter, and of being a copy."""
    return interactions(materialise(combinations(docs, labels, filters), "combinations"), "".join(filters) + copy)
