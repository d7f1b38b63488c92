"""Queries of the ten training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkspan.llm import copies, encoding, leaks, neardup, quantiles, repetition, sampling, sentences, splits, truncation
from inkspan.session import table

ESSAYS = "train_v2_drcat_02"
Query = Callable[[SparkSession, str], DataFrame]


def _essays(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, ESSAYS)


def _measures(s: SparkSession, d: str) -> DataFrame:
    return quantiles.measures(table(s, d, "sentence_features"), table(s, d, "signal_evidence"), _essays(s, d))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: copies.found(_essays(s, d), "row_id", "text"),
        "p1_records": lambda s, d: copies.collapse(_essays(s, d), "row_id", "text"),
        "p2_found": lambda s, d: repetition.found(_essays(s, d), "row_id", "text"),
        "p2_shares": lambda s, d: repetition.shares(_essays(s, d), "row_id", "text"),
        "p2_bands": lambda s, d: repetition.repetition(_essays(s, d), "row_id", "text"),
        "p3_found": lambda s, d: sentences.found(_essays(s, d), table(s, d, "sentence")),
        "p4_found": lambda s, d: splits.found(_essays(s, d), "row_id", "prompt_name", "split", table(s, d, "split_manifest")),
        "p4_splits": lambda s, d: splits.assign_splits(_essays(s, d), "row_id", "prompt_name", splits.manifest_ratios(table(s, d, "split_manifest"))),
        "p4_forest": lambda s, d: splits.forest_report(_essays(s, d), "prompt_name"),
        "p4_checks": lambda s, d: splits.checks(_essays(s, d), "row_id", "prompt_name", splits.manifest_ratios(table(s, d, "split_manifest"))),
        "p4_report": lambda s, d: splits.report(_essays(s, d), "row_id", "prompt_name", splits.manifest_ratios(table(s, d, "split_manifest"))),
        "p5_found": lambda s, d: neardup.found(_essays(s, d), "row_id", "text"),
        "p5_classes": lambda s, d: neardup.classes(_essays(s, d), "row_id", "text"),
        "p6_percentiles": lambda s, d: quantiles.group_percentiles(_measures(s, d)),
        "p6_combined": lambda s, d: quantiles.combined_percentiles(_measures(s, d)),
        "p7_found": lambda s, d: sampling.found(_essays(s, d), table(s, d, "sample_target")),
        "p7_report": lambda s, d: sampling.plan_report(_essays(s, d), table(s, d, "sample_target")),
        "p7_sample": lambda s, d: sampling.draw(_essays(s, d), table(s, d, "sample_target"), "row_id"),
        "p8_ids": lambda s, d: encoding.encode_corpus(table(s, d, "documents"), "doc_id", "text"),
        "p9_found": lambda s, d: leaks.found(table(s, d, "documents"), "doc_id", "text", table(s, d, "eval_item"), "item_id", "text"),
        "p9_items": lambda s, d: leaks.leaked_items(
            leaks.found(table(s, d, "documents"), "doc_id", "text", table(s, d, "eval_item"), "item_id", "text"), table(s, d, "eval_item"), "item_id"),
        "p9_proximity": lambda s, d: leaks.proximity(table(s, d, "documents"), "doc_id", "text", table(s, d, "eval_item"), "item_id", "text"),
        "p10_found": lambda s, d: truncation.found(table(s, d, "documents")),
        "p10_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
    }
