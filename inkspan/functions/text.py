"""Text expressions shared by the operators; all run on the JVM inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as part of a word, and the characters that never do.
NOT_LMN = r"[^\p{L}\p{M}\p{N}]+"
APOSTROPHES = "\'\u2018\u2019`\u00b4\u02bc"
INVISIBLE = "\u200b\u200c\u200d\u2060\u00ad\ufeff"


def reduced(c: Column | str) -> Column:
    """Lower-cased text with only letters, marks and digits left; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), NOT_LMN, "")


def spaced(c: Column | str) -> Column:
    """Lower-cased text in which each run of other characters is one space, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), NOT_LMN, " "))


def word_string(c: Column | str) -> Column:
    """The words of a text, separated by single spaces, after apostrophes and invisible characters are removed."""
    c = F.col(c) if isinstance(c, str) else c
    return spaced(F.regexp_replace(c, f"[{APOSTROPHES}{INVISIBLE}]", ""))


def name_key(c: Column | str) -> Column:
    """Names compare by reduced form; null and blank names give the empty string."""
    return F.coalesce(reduced(c), F.lit(""))


def digest(c: Column) -> Column:
    """16 bytes of SHA-256."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
