"""The registered queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import (
    addressable,
    codec,
    hilbert,
    importance,
    leaks,
    near,
    packing,
    private,
    repeats,
    rules,
    separators,
    spelling,
    target,
)
from sessionlake.llm.common import table
from sessionlake.llm.statements import SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_hashing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = repeats.without_repeats(docs, repeats.NESTED)
    written = F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"]))
    return found.select(
        "doc_id", "text", F.size("removed").alias("n_removed"), F.array_join(written, ",").alias("removed"),
        F.array_join(F.transform("first_ids", lambda i: i.cast("string")), ",").alias("first_ids"),
    )


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op3_anchor_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return private.report(table(spark, folder, "documents"))


def op4_hilbert_curve(spark: SparkSession, folder: str) -> DataFrame:
    placed = hilbert.placed(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op5_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.cleaned(table(spark, folder, "documents").select("doc_id", "text", "source"))
    written = F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"]))
    return found.select("verdict.*", "text").withColumn("removed", F.array_join(written, ","))


def op6_benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_addressable_codes(spark: SparkSession, folder: str) -> DataFrame:
    return addressable.read_codes(addressable.write_codes(table(spark, folder, "documents")))


def op8_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    return separators.counts(separators.write_flat(table(spark, folder, "documents")))


def op9_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return importance.resample(documents, labels)[0]


def op10_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "kept")


def op11_reduced_alphabet(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(spelling.counted(table(spark, folder, "documents"), slip=199))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return codec.digests(codec.decoded(codec.encoded(table(spark, folder, "documents"))))


def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = target.drawn(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_line_hashing, op2_best_fit_packing, op3_anchor_expansion, op4_hilbert_curve,
        op5_line_frequency, op6_benchmark_windows, op7_addressable_codes, op8_separator_scan,
        op9_importance_resampling, op10_probminhash, op11_reduced_alphabet,
        op12_byte_bpe, op13_target_resampling,
    )
}

__all__ = ["QUERIES", "SQL"]
