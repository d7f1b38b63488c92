"""Problem 1: records that differ only in formatting or in the order of their fields.

Dictionary encoding: each distinct raw field value is canonicalised once and gets an integer id, bodies are
encoded by the digest of their canonical form, and the compact tuples (body id, sorted field ids) are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import digest, reduced
from inkspan.session import materialize

# The labels of opening fields.
FIELD_LABELS = ("name", "grade", "topic", "date", "class", "teacher")
_LABEL = r"(?:" + "|".join(FIELD_LABELS) + r")[^\S\n]*[:：]"
_FIRST_PARA = r"(?s)^(.*?)\n[\s&&[^\n]]*\n"


def _split(text: Column) -> tuple[Column, Column]:
    """(array of raw opening fields, raw body)."""
    t = F.regexp_replace(text, r"^[\s\p{Z}\p{Cf}]+", "")
    head = F.regexp_extract(t, _FIRST_PARA, 1)
    clean = F.regexp_replace(head, r"\p{Cf}", "")
    has = clean.rlike(r"(?i)^" + _LABEL)
    fields = F.when(has, F.split(clean, r"(?i)(?<![\p{L}\p{M}\p{N}])(?=" + _LABEL + ")")).otherwise(F.array().cast("array<string>"))
    body = F.when(has, F.substring(t, F.length(head) + F.lit(1), F.length(t))).otherwise(t)
    return F.filter(fields, lambda x: F.trim(x) != ""), body


def _ids(values: DataFrame, key: str, name: str) -> DataFrame:
    """A dictionary ``key -> id``. It is written before use: ids given while running would not survive a rerun."""
    return materialize(values.select(key).distinct().withColumn("id", F.monotonically_increasing_id()), name)


def encode(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, body_id, field_ids``: each record as a compact tuple of integers."""
    t = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt")).filter(F.length(reduced("txt")) > 0)
    fields, body = _split(F.col("txt"))
    rec = materialize(t.select("rid", fields.alias("raw"), digest(reduced(body)).alias("dig")), "p1-records")
    bodies = _ids(rec, "dig", "p1-bodies").withColumnRenamed("id", "body_id")
    # Fields: canonicalise each distinct raw value once, then number the distinct canonical values.
    pos = rec.filter(F.size("raw") > 0).select("rid", "dig", F.explode("raw").alias("raw"))
    raw = materialize(pos.select("raw").distinct().withColumn("canon", reduced("raw")), "p1-raw")
    canon = _ids(raw, "canon", "p1-fields")
    lookup = raw.join(canon, "canon").select("raw", F.col("id").alias("fid"))
    sets = pos.join(lookup, "raw").groupBy("rid", "dig").agg(F.array_sort(F.collect_set("fid")).alias("field_ids"))
    plain = rec.filter(F.size("raw") == 0).select("rid", "dig", F.array().cast("array<bigint>").alias("field_ids"))
    return plain.unionByName(sets).join(bodies, "dig").select(F.col("rid").alias(id_col), "body_id", "field_ids")


def copy_groups(tuples: DataFrame, id_col: str) -> DataFrame:
    """``body_id, field_ids, first, n_copies``: one row per record, however often it is repeated."""
    return tuples.groupBy("body_id", "field_ids").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n_copies"))


def collapse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per record: ``first_<id>`` (its least id) and ``n_copies``.

    Null texts and texts without any letter, mark or digit are no records. Rows repeated under one id
    count as copies. A header that names the same field twice is a set: the order and repeats don't matter.
    """
    g = copy_groups(encode(df, id_col, text_col), id_col)
    return g.select(F.col("first").alias(f"first_{id_col}"), "n_copies")


def found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``first_<id>, id``: each copy beyond the least id of its group.

    The rows meet their group by a join on the tuple; a tuple that holds a large share of all rows is split
    by the adaptive skew join, as the group's side has one row per tuple.
    """
    t = materialize(encode(df, id_col, text_col), "p1-tuples")
    g = copy_groups(t, id_col).filter("n_copies > 1")
    j = t.join(g, ["body_id", "field_ids"]).filter(F.col(id_col) > F.col("first"))
    return j.select(F.col("first").alias(f"first_{id_col}"), id_col)
