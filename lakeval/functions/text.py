"""Text normalisation and word functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: What counts as a word character, and the order of characters that case folding widens.
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def normalized(c: Column) -> Column:
    """Key for duplicates, labels and groups of text that is NFKC already: white space collapsed, ends
    trimmed, case folded. ``normalized_any`` is the general form."""
    return F.replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


@pandas_udf(T.StringType())
def normalized_any(c: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, ends trimmed, full case folding; null stays null."""
    return c.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def words(c: Column) -> Column:
    """Case-folded runs of letters, digits and underscores."""
    return F.regexp_extract_all(normalized(c), F.lit(WORD), F.lit(0))


def row_key(given: Column, wanted: Column) -> Column:
    """``r-`` and 12 hexadecimal digits of the sha256 of input, NUL and output."""
    return F.concat(F.lit("r-"), F.left(F.sha2(F.concat(given, F.char(F.lit(0)), wanted), 256), F.lit(12)))


def slug(c: Column) -> Column:
    """Safe for a file name: everything but letters, digits, dot, dash and underscore becomes a dash."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-")


def cell_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
