"""The engine's functions for SQL.

After ``register(spark)``: ``path_tokens(path)``, ``path_delimiters(path)``,
``is_safe_path(path)`` and ``canonical_number(text)`` are SQL expressions that
the optimiser sees through; ``SELECT * FROM fmt_parse(fmt, path)`` gives one
row a field, and joins laterally. ``fmt_match(fmt, path)`` is the map of a
path's fields, null if it doesn't fit, and ``fmt_render(fmt, fields)`` the path
of a map of fields; formats may differ by row there. ``register_format(spark,
name, fmt)`` gives ``name_match(path)`` and ``name_render(field, ...)`` of one
format as expressions that the optimiser sees through.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..plans.spec import FormatSpec
from .values import DECIMAL, INTEGER

#: name -> (parameters, result, body)
EXPRESSIONS = {
    "path_tokens": ("path STRING", "ARRAY<STRING>", r"split(path, '[_\\-./]', -1)"),
    "path_delimiters": ("path STRING", "ARRAY<STRING>", r"regexp_extract_all(path, '([_\\-./])', 1)"),
    "canonical_number": ("v STRING", "BOOLEAN", f"v RLIKE '{INTEGER}' OR v RLIKE '{DECIMAL}'".replace("\\", "\\\\")),
    "is_valid_checksum": ("algorithm STRING, v STRING", "BOOLEAN", "coalesce(v RLIKE '^[0-9a-fA-F]+$' AND length(v) = CASE lower(algorithm) WHEN 'md5' THEN 32 WHEN 'sha1' THEN 40 WHEN 'sha256' THEN 64 WHEN 'sha512' THEN 128 END, false)"),
}


@udtf(returnType="field string, value string")
class FormatParse:
    """Fields and values of a path that fits a format; no rows if it doesn't."""

    def __init__(self):
        self.known = {}

    def eval(self, fmt: str, path: str):
        if fmt is None or path is None:
            return
        if fmt not in self.known:
            spec = FormatSpec.compile(fmt)
            self.known[fmt] = (spec.fields, re.compile(spec.regex))
        fields, rule = self.known[fmt]
        found = rule.match(path)
        if found:
            yield from zip(fields, found.groups())


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def fmt_match(fmts: pd.Series, paths: pd.Series) -> pd.Series:
    """Fields of each path by its format; null where it doesn't fit or either is null."""
    rules = {f: FormatSpec.compile(f) for f in set(fmts.dropna())}
    found = [re.match(rules[f].regex, p) if f is not None and p is not None else None for f, p in zip(fmts, paths)]
    return pd.Series([dict(zip(rules[f].fields, m.groups())) if m else None for f, m in zip(fmts, found)], dtype=object)


@F.pandas_udf(T.StringType())
def fmt_render(fmts: pd.Series, fields: pd.Series) -> pd.Series:
    """The path of each map of fields; null where a field of the format is missing."""
    rules = {f: FormatSpec.compile(f) for f in set(fmts.dropna())}

    def one(f, values):
        if f is None or values is None:
            return None
        out = []
        for s in rules[f].segments:
            out.append(s.literal)
            if s.name:
                value = dict(values).get(s.name)
                if value is None:
                    return None
                out.append(format(int(float(value)) if s.kind == "int" else float(value), s.spec) if s.kind != "text" else value)
        return "".join(out)

    return pd.Series([one(f, v) for f, v in zip(fmts, fields)], dtype=object)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_format(spark: SparkSession, name: str, fmt: str) -> None:
    """SQL functions of one format: ``name_match(path)``, a struct of its fields (null: it doesn't fit), and ``name_render(field, ...)``, in the format's order."""
    if not name.isidentifier():
        raise ValueError(f"not a function name: {name!r}")
    spec = FormatSpec.compile(fmt)
    rule = sql_text(spec.regex)
    kinds = {s.name: s.kind for s in reversed(spec.segments) if s.name}
    sql_type = {"int": "BIGINT", "float": "DOUBLE", "text": "STRING"}
    fields = ", ".join(f"'{f}', CAST(regexp_extract(path, {rule}, {n}) AS {sql_type[kinds[f]]})" for n, f in enumerate(spec.fields, 1))
    shape = ", ".join(f"{f}: {sql_type[kinds[f]]}" for f in spec.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_match(path STRING) RETURNS STRUCT<{shape}> RETURN CASE WHEN path RLIKE {rule} THEN named_struct({fields}) END")
    parts = []
    for s in spec.segments:
        if s.literal:
            parts.append(sql_text(s.literal))
        if s.name:
            plain = s.kind == "text" or s.kind == "int" and s.spec == "d"
            parts.append(f"CAST({s.name} AS STRING)" if plain else f"format_string({sql_text('%' + s.spec)}, {s.name})")
    parameters = ", ".join(f"{f} {sql_type[kinds[f]]}" for f in spec.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_render({parameters}) RETURNS STRING RETURN concat({', '.join(parts)})")


def register(spark: SparkSession) -> None:
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("fmt_parse", FormatParse)
    spark.udf.register("fmt_match", fmt_match)
    spark.udf.register("fmt_render", fmt_render)
