"""Values decoded from paths: numeric inference, text forms, type-strict comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that are their own number's shortest form.
INTEGER = r"^(0|-?[1-9][0-9]{0,17})$"
DECIMAL = r"^-?(0|[1-9][0-9]*)\.([0-9]*[1-9]|0)$"


def is_integer(value: Column) -> Column:
    return value.rlike(INTEGER)


def is_number(value: Column) -> Column:
    """Whole or fractional, in canonical form, of at most 15 digits and not below 0.0001 in size."""
    digits = F.length(F.regexp_replace(F.regexp_replace(value, "[-.]", ""), "^0+", ""))
    small = value.rlike(r"^-?0\.0000")
    few = F.length(value) <= F.when(value.startswith("-"), 16).otherwise(15)
    return F.when(is_integer(value), few).otherwise(value.rlike(DECIMAL) & (digits <= 15) & ~small)


def numeric_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """``bigint``, ``double`` or ``string`` for each text column: one aggregation over all of them.

    A column becomes numeric only if every value is; nulls and empty columns stay text.
    """
    if not columns:
        return {}
    tests = []
    for c in columns:
        tests += [F.every(F.coalesce(is_integer(F.col(c)), F.lit(False))).alias(f"i_{c}"), F.every(F.coalesce(is_number(F.col(c)), F.lit(False))).alias(f"n_{c}")]
    row = df.agg(*tests).first()
    return {c: "bigint" if row[f"i_{c}"] else "double" if row[f"n_{c}"] else "string" for c in columns}


def infer_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    types = numeric_types(df, columns)
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if t != "string"})


def safe_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a value as manifests store it: whole floats without a fraction, NaN as null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(value.cast("string"))
        return F.when(F.isnan(value), F.lit(None)).when(whole, value.cast("bigint").cast("string")).otherwise(text)
    return value.cast("string")


def equals(column: Column, dtype: T.DataType, wanted) -> Column:
    """Type-strict equality: a text never equals a number, nothing equals null or NaN."""
    number = isinstance(dtype, T.NumericType)
    if wanted is None or isinstance(wanted, float) and wanted != wanted:
        return F.lit(False)
    if isinstance(wanted, bool):
        return F.coalesce(column == F.lit(wanted if isinstance(dtype, T.BooleanType) else int(wanted)), F.lit(False)) if number or isinstance(dtype, T.BooleanType) else F.lit(False)
    if isinstance(wanted, (int, float)) == number and (number or isinstance(wanted, str) == isinstance(dtype, T.StringType)):
        return F.coalesce(column == F.lit(wanted), F.lit(False))
    return F.lit(False)


def any_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows where any named column has its value, or one of a list or tuple of values.

    No names: no rows. A null in a list admits nulls. Chain calls for AND.
    """
    tests = [F.lit(False)]
    for name, value in wanted.items():
        if name not in df.columns:
            raise KeyError(name)
        dtype, column = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(value, (list, tuple)):
            tests += [column.isNull() if v is None else equals(column, dtype, v) for v in value]
        else:
            tests.append(equals(column, dtype, value))
    return df.filter(reduce(lambda a, b: a | b, tests))
