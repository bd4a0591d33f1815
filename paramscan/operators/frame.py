"""Parameter tables: list files by a format, decode their paths, filter by parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import any_filter, infer_numeric
from ..plans.spec import FormatSpec
from ..sources.inventory import inventory


def rewritten(path: Column, encoding: dict | None) -> Column:
    """Every match of an encoding's ``aspin`` regex becomes ``-`` and its first group."""
    regex = (encoding or {}).get("aspin")
    return F.regexp_replace(path, regex, "-$1") if regex else path


def decoded(paths: DataFrame, fmt: str, encoding: dict | None = None, keep_specs: bool = False, infer: bool = True) -> DataFrame:
    """``path`` and one column per field for the paths that fit; the others are left out.

    ``path`` stays as it was listed. With ``infer``, one aggregation decides
    which text fields are numeric; give typed fields and ``keep_specs`` to
    stay lazy.
    """
    spec = FormatSpec.compile(fmt, keep_specs)
    target = rewritten(F.col("path"), encoding)
    rows = paths.filter(target.rlike(spec.regex))
    out = rows.select("path", *[value.alias(name) for name, value in spec.decode(target).items() if name != "path"])
    texts = [name for name, kind in out.dtypes if kind == "string" and name != "path"]
    return infer_numeric(out, texts) if infer else out


@dataclass
class ParamFrame:
    """A DataFrame of files and parameters; calling it filters by OR, chained calls by AND."""

    df: DataFrame
    encodings: list = field(default_factory=list)
    base_path: str = "."

    @classmethod
    def parse(cls, spark: SparkSession, fmt: str, root: str = ".", encodings: list | None = None, encoding: bool = False, **known) -> ParamFrame:
        """Files below ``root`` that fit ``fmt``. ``known`` field values narrow the listing itself."""
        chosen = find_encoding(encodings or [], fmt) if encoding else None
        if encoding and chosen is None:
            raise ValueError(f"no encoding for format {fmt!r}")
        listing = FormatSpec.compile(fmt)
        files = inventory(spark, root, listing.listing_regex(**known))
        frame = decoded(files.select("path"), chosen["fmt"] if chosen else fmt, (chosen or {}).get("encoding"))
        return cls(frame.orderBy("path"), encodings or [], root)

    def filter(self, **wanted) -> ParamFrame:
        return ParamFrame(any_filter(self.df, **wanted), self.encodings, self.base_path)

    __call__ = filter

    def __getitem__(self, item):
        return ParamFrame(self.df.filter(item), self.encodings, self.base_path) if isinstance(item, Column) else self.df[item]

    def __getattr__(self, name):
        return getattr(self.df, name)


def find_encoding(encodings: list[dict], fmt: str) -> dict | None:
    """The first encoding whose format is, or is part of, ``fmt``."""
    for entry in encodings:
        if not isinstance(entry, dict) or not isinstance(entry.get("fmt"), str):
            raise ValueError("an encoding needs a format")
        if not isinstance(entry.get("encoding"), dict):
            raise ValueError(f"encoding of {entry['fmt']!r} must map names to regexes")
        if entry["fmt"] in fmt:
            return entry
    return None
