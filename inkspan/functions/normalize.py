"""Length-preserving normalisation, segmentation and tokenisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Characters that are replaced one by one, as code points.
TO_APOSTROPHE = (0x2018, 0x2019, 0x201A, 0x201B, 0x2032, 0x00B4, 0x0060)
TO_QUOTE = (0x201C, 0x201D, 0x201E, 0x201F, 0x2033)
TO_HYPHEN = (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212)
TO_SPACE = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD)
TO_NEWLINE = (0x2028, 0x2029, 0x000D)
TABLE_FROM = "".join(map(chr, TO_APOSTROPHE + TO_QUOTE + TO_HYPHEN + TO_SPACE + TO_NEWLINE))
TABLE_TO = "'" * len(TO_APOSTROPHE) + '"' * len(TO_QUOTE) + "-" * len(TO_HYPHEN) + " " * len(TO_SPACE) + "\n" * len(TO_NEWLINE)
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"
# Patterns of paragraphs, sentences and words; abbreviations after which a sentence goes on.
PARAGRAPH_BREAK = r"\n[ \t]*\n[ \t\n\x0b\f\r]*"
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"
ABBREVIATION = r"(^|[^A-Za-z])(Dr|Mr|Mrs|Ms|Prof|St|Sr|Jr|vs|approx)\."
DECIMAL = r"([0-9])\.([0-9])"
WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"
PUNCTUATION = r"[^\p{L}\p{N}\s]+"
BLANKS = " \t\n\x0b\f\r"
MIN_SCORABLE_TOKENS = 5


def normalize(c: Column | str) -> Column:
    """Same length as the input: CR LF becomes blank and LF, typographic characters their plain ones, controls blanks."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.translate(F.replace(c, F.lit("\r\n"), F.lit(" \n")), TABLE_FROM, TABLE_TO)
    return F.regexp_replace(t, CONTROLS, " ")


def canonical(c: Column | str) -> Column:
    """White space runs become one blank; case is kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]+", " "))


def content_id(c: Column | str) -> Column:
    return F.substring(F.sha2(canonical(c), 256), 1, 16)


def word_count(c: Column | str) -> Column:
    """Words by white space; 0 for blank texts."""
    t = canonical(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def words(c: Column) -> Column:
    """Lower-cased word forms."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def paragraphs(df: DataFrame, id_col: str = "essay_id", text_col: str = "text") -> DataFrame:
    """``id, para_idx, para, para_start``: trimmed non-empty paragraphs of the normalised text with their offsets."""
    n = normalize(text_col)
    tiles = F.regexp_extract_all(n, F.lit(rf"(?s).+?(?:{PARAGRAPH_BREAK}|\z)"), F.lit(0))
    p = df.select(F.col(id_col), F.posexplode(tiles).alias("k", "tile"))
    w = W.partitionBy(id_col).orderBy("k")
    p = p.withColumn("at", F.coalesce(F.sum(F.length("tile")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    p = p.withColumn("para", F.trim(F.col("tile"), F.lit(BLANKS))).filter("para <> ''")
    lead = F.length("tile") - F.length(F.ltrim(F.col("tile"), F.lit(BLANKS)))
    return p.select(id_col, (F.row_number().over(w) - 1).alias("para_idx"), "para", (F.col("at") + lead).cast("int").alias("para_start"))


def sentences(df: DataFrame, id_col: str = "essay_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: ``id, sent_idx, para_idx, text, start_char, end_char, token_count, is_scorable``.

    Within a paragraph a sentence ends with its run of terminal marks, except behind the listed abbreviations and
    inside decimals. Offsets are code points of the normalised text, end excluded. One shuffle by id serves all.
    """
    p = paragraphs(df, id_col, text_col)
    shielded = F.regexp_replace(F.regexp_replace("para", ABBREVIATION, "$1$2\u0001"), DECIMAL, "$1\u0001$2")
    s = p.select(id_col, "para_idx", "para_start", F.posexplode(F.regexp_extract_all(shielded, F.lit(SENTENCE), F.lit(0))).alias("k", "tile"))
    w = W.partitionBy(id_col, "para_idx").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("at", F.col("para_start") + F.coalesce(F.sum(F.length("tile")).over(w), F.lit(0)))
    s = s.withColumn("text", F.replace(F.trim(F.col("tile"), F.lit(BLANKS)), F.lit("\u0001"), F.lit("."))).filter("text <> ''")
    s = s.withColumn("start_char", (F.col("at") + F.length("tile") - F.length(F.ltrim(F.col("tile"), F.lit(BLANKS)))).cast("int"))
    n = F.size(words(F.col("text")))
    return s.select(
        id_col, (F.row_number().over(W.partitionBy(id_col).orderBy("para_idx", "k")) - 1).alias("sent_idx"), "para_idx", "text", "start_char",
        (F.col("start_char") + F.length("text")).alias("end_char"), n.alias("token_count"), (n >= MIN_SCORABLE_TOKENS).alias("is_scorable"))


def first_sentences(sent: DataFrame, n: int, id_col: str = "essay_id") -> DataFrame:
    """The first n sentences joined by a blank, for texts that have as many."""
    g = sent.filter(F.col("sent_idx") < n).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("sent_idx", "text"))).alias("s"))
    return g.filter(F.size("s") == n).select(id_col, F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))
