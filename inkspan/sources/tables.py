"""Sources and sinks: CSV, Parquet, JSON lines, text files with upload rules, JSON artefacts."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = int(os.environ.get("INKSPAN_MAX_UPLOAD_BYTES", 1_000_000))
MAX_CHARS = 100_000


def read_corpus_csv(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"').withColumnsRenamed(rename or {})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_texts(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Text files as ``(accepted: path, text; rejected: path, reason)``: .txt, size limit, strict UTF-8, not blank, length limit."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    t = F.try_validate_utf8(F.decode("content", F.lit("UTF-8"))) if not hasattr(F, "is_valid_utf8") else F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    r = f.withColumn("text", t).withColumn(
        "reason", F.when(~F.lower("path").endswith(".txt"), "extension").when(F.col("length") > max_bytes, "size").when(F.col("text").isNull(), "encoding")
        .when(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == "", "blank").when(F.length("text") > MAX_CHARS, "length"))
    return r.filter("reason is null").select("path", "text"), r.filter("reason is not null").select("path", "reason")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row result as a JSON file."""
    row = df.limit(1).first()
    with open(path, "w") as f:
        json.dump(row.asDict(recursive=True) if row else {}, f, sort_keys=True, default=str)


def health(paths: dict[str, str]) -> dict[str, object]:
    missing = sorted(k for k, p in paths.items() if not os.path.exists(p))
    return {"status": "degraded" if missing else "ok", "missing": missing}
