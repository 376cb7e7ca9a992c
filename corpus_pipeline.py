"""A corpus pipeline over `documents`: stages that each keep what the one before kept, less what they decide against.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows with a null doc_id are never matched by a decision
about another row and stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import aho_bpe, metric_join, string_kernel, winnowing
from framewright.llm._common import materialise, small_batches, table, without_ids
from framewright.shared import fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be recognised go: those without a letter, and those whose score is below what
    held-out labelled documents of their size reach (string_kernel.least_scores). Where no language can be learned (no label, or
    no row) all that have a letter stay. Null and empty texts go; rows with a null id, which don't train, and repeated rows
    are judged as any other; columns whose names clash with those made here come out as they were."""
    small_batches(spark)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    model = string_kernel.fit(docs.filter(~held_out))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = string_kernel.least_scores(model, docs.filter(held_out))
    size, needed = F.octet_length("text"), F.lit(least[-1])
    for most, score in reversed(list(zip(string_kernel.SIZES, least, strict=False))):
        needed = F.when(size < most, score).otherwise(needed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), needed.alias("needed"), F.col("text"))  # whatever the columns' names are
    return string_kernel.with_language(rows, model).filter("lang_pred <> 'und' and score >= needed").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the one with the least id stays. Rows that
    share this id all stay, as do null and empty texts, which link with nothing, and rows with a null id; an empty table
    stays empty, and no column's name matters but doc_id and text."""
    small_batches(spark)
    found = metric_join.near_duplicates(docs, k=5, share=80)
    return without_ids(docs, materialise(found.filter("doc_id <> component_id").select("doc_id"), "copies"), "doc_id")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all of a shorter one) go, with all rows of their id; null
    and empty texts hold none and stay, as do rows with a null id; without documents or items nothing goes."""
    small_batches(spark)
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, materialise(found.filter("n_hit > 0").select("doc_id"), "leaks"), "doc_id")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, with digests of the ids and of what they decode to, a row for each row: null and empty texts
    have no ids, repeated rows the same; of other columns lang and source are kept."""
    small_batches(spark)
    return aho_bpe.with_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: Language scores and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
