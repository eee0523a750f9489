"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words a yes/no column may hold, and the signs a written number may carry.
TRUE_WORDS = ["yes", "true", "y", "t", "1", "1.0"]
FALSE_WORDS = ["no", "false", "n", "f", "0", "0.0"]
NUMBER_DECORATION = r"[$,€£¥%\s]"

NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
EDGE_SPACE = r"^\s+|\s+$"

HASH_BITS = 60
HASH_SPACE = float(1 << HASH_BITS)


def c(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def q(name: str) -> str:
    """A column name quoted for SQL text.

    Expressions over many columns are built as SQL text: parsing one string on the JVM costs far
    less than building the same tree call by call from Python.
    """
    return "`" + name.replace("`", "``") + "`"


def lit_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lit_double(value: float) -> str:
    if math.isnan(value):
        return "double('NaN')"
    if math.isinf(value):
        return f"double('{'-' if value < 0 else ''}Infinity')"
    return f"{float(value)!r}D"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_fraction(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN read as missing, so that NaN and null behave alike."""
    return F.when(~F.isnan(c(name)), c(name)) if is_fraction(dtype) else c(name)


def as_double(df: DataFrame, name: str) -> Column:
    return present(name, df.schema[name].dataType).cast("double")


def present_sql(name: str, dtype: T.DataType) -> str:
    """``present`` as SQL text."""
    return f"if(isnan({q(name)}), null, {q(name)})" if is_fraction(dtype) else q(name)


def double_sql(df: DataFrame, name: str) -> str:
    """``as_double`` as SQL text."""
    return f"cast({present_sql(name, df.schema[name].dataType)} AS double)"


def missing_sql(name: str, dtype: T.DataType) -> str:
    missing = f"{q(name)} IS NULL"
    return f"({missing} OR isnan({q(name)}))" if is_fraction(dtype) else f"({missing})"


def count_sql(cond: str) -> str:
    return f"count_if({cond})"


def is_missing(name: str, dtype: T.DataType) -> Column:
    return c(name).isNull() | F.isnan(c(name)) if is_fraction(dtype) else c(name).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating-point column."""
    if not any(is_fraction(f.dataType) for f in df.schema):
        return df
    return df.select([present(f.name, f.dataType).alias(f.name) for f in df.schema])


def key_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """A 60-bit number from md5 of the key columns: the same in any engine and on any rerun."""
    text = F.concat_ws("|", *[c(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def key_uniform(keys: Sequence[str], seed: int = 42) -> Column:
    """``key_hash`` scaled to [0, 1)."""
    return key_hash(keys, seed).cast("double") / F.lit(HASH_SPACE)


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns and their null flags.

    Spark's hash passes over nulls, so (null, 1) and (1, null) need the flags to differ.
    Together the two have 128 bits: equal fingerprints mean equal rows.
    """
    cols = [c(name) for name in df.columns]
    flags = [col.isNull() for col in cols]
    return [
        F.xxhash64(*cols, *flags).alias("h1"),
        F.xxhash64(F.lit("second"), *flags, *cols[::-1]).alias("h2"),
    ]


def parse_number(col: Column) -> Column:
    """A written number such as ``$ 1,234`` or ``12%`` as a double; null when it is none."""
    bare = F.regexp_replace(col, NUMBER_DECORATION, "")
    return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))


def parse_boolean(col: Column) -> Column:
    """1 or 0 for a yes/no word in any case, else null."""
    word = F.lower(col)
    return F.when(word.isin(TRUE_WORDS), F.lit(1)).when(word.isin(FALSE_WORDS), F.lit(0))


def looks_like_date(col: Column) -> Column:
    """Whether a string reads as a date or a timestamp in one of the usual written forms."""
    value = F.trim(col)
    iso = value.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?([ T].*)?$") & value.try_cast("timestamp").isNotNull()
    forms = {
        r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$": ["y/M/d"],
        r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$": ["M/d/y", "d/M/y"],
        r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$": ["M-d-y", "d-M-y"],
        r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$": ["MMM d, y"],
    }
    tests = [
        value.rlike(pattern) & F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats]).isNotNull()
        for pattern, formats in forms.items()
    ]
    found = iso
    for test in tests:
        found = found | test
    return F.coalesce(found, F.lit(False))


def strip_text(col: Column) -> Column:
    """Drop white space of any kind at both ends; null stays null."""
    return F.regexp_replace(col, EDGE_SPACE, "")


def clamp(col: Column, low: float | None, high: float | None) -> Column:
    """Clip to [low, high]; null stays null."""
    out = col
    if low is not None:
        out = F.when(col < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(col > F.lit(high), F.lit(high)).otherwise(out)
    return out


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def even_edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def safe_divide(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def inline_sql(rows: Sequence[str]) -> str:
    """Several rows from one: ``inline`` over an array of structs given as SQL text."""
    return f"inline(array({', '.join(rows)}))"
