"""Column expressions on text, and the one function that Spark lacks (NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"[\s\p{Z}]"


def utrim(x: Column) -> Column:
    """Trims Unicode white space, ideographic spaces included."""
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")


def compact(x: Column) -> Column:
    return F.regexp_replace(x, rf"{BLANK}+", "")


def visible_length(x: Column) -> Column:
    return F.length(compact(x))


def blank(x: Column) -> Column:
    return F.coalesce(compact(x), F.lit("")) == ""


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def to_int(x: Column) -> Column:
    """A number as an integer; what isn't one becomes 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0)).cast("int")


def wrapped(x: Column, width: int) -> Column:
    return F.regexp_replace(x, rf"(.{{{width}}})(?=.)", "$1\n")


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(x: Column) -> Column:
    """NFKC form; plain ASCII never leaves the JVM."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), _nfkc(x)).otherwise(x)


def evidence_found(evidence: Column, text: Column) -> Column:
    """Whether evidence occurs in the text, white space aside; blank evidence doesn't."""
    return ~blank(evidence) & (F.contains(text, utrim(evidence)) | F.contains(compact(text), compact(evidence)))


def first_of(*values: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(utrim(v), F.lit("")) for v in values])


def trimmed(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns named, trimmed of Unicode white space; null becomes empty."""
    return df.withColumns({c: utrim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns})
