"""Format strings compiled to Spark expressions.

A format such as ``a{a}_i{i:d}.h5`` names the fields of a path. One compiled
``FormatSpec`` gives the glob that lists candidates, the regex that decodes
paths, the expression that renders rows back to paths, and the schema.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = r"[-+ ]?[0-9]+"
REAL = r"[-+ ]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


@dataclass(frozen=True)
class Segment:
    """A literal and the field behind it; the last literal has no field."""

    literal: str
    name: str | None
    spec: str = ""

    @property
    def kind(self) -> str:
        last = self.spec[-1:]
        return "int" if last == "d" else "float" if last and last in "eEfFgG" else "text"


def quoted(literal: str) -> str:
    """``literal`` for a Java regex."""
    return "".join("\\" + c if not (c.isalnum() or c in "_ " or ord(c) > 127) else c for c in literal)


@dataclass(frozen=True)
class FormatSpec:
    fmt: str
    segments: tuple[Segment, ...]

    @classmethod
    def compile(cls, fmt: str, keep_specs: bool = True) -> FormatSpec:
        """Parse ``fmt``. Without ``keep_specs`` all fields are text, as in local scans."""
        segments = []
        for literal, name, spec, conversion in Formatter().parse(fmt):
            if name is not None and not name.isidentifier():
                raise ValueError(f"format {fmt!r} has a field without a plain name: {name!r}")
            if conversion:
                raise ValueError(f"format {fmt!r} converts field {name!r}; that is not supported")
            segments.append(Segment(literal, name, (spec or "") if keep_specs else ""))
        return cls(fmt, tuple(segments))

    @property
    def fields(self) -> list[str]:
        """Field names, each once, in order."""
        return list(dict.fromkeys(s.name for s in self.segments if s.name))

    @property
    def literal_chars(self) -> int:
        return sum(len(s.literal) for s in self.segments)

    @property
    def regex(self) -> str:
        """Whole-path Java regex, case-insensitive; groups by field order, repeats as back-references."""
        out, numbers = [], {}
        for s in self.segments:
            out.append(quoted(s.literal))
            if s.name is None:
                continue
            if s.name in numbers:
                out.append(f"\\{numbers[s.name]}")
                out.append("(?:)")  # so that a digit may follow the reference
                continue
            numbers[s.name] = len(numbers) + 1
            out.append("(" + {"int": WHOLE, "float": REAL, "text": ".+?"}[s.kind] + ")")
        return "(?is)^" + "".join(out) + "$"

    def glob(self, **known) -> str:
        """Listing pattern: literals, ``known`` values, ``*`` for the rest."""
        parts = []
        for s in self.segments:
            parts.append(re.sub(r"([*?\[])", r"[\1]", s.literal))
            if s.name:
                parts.append(format(known[s.name], s.spec) if s.name in known else "*")
        return re.sub(r"\*+", "*", "".join(parts))

    def listing_regex(self, **known) -> str:
        """Java regex of the glob: ``*`` stays within a path component and skips leading dots."""
        out, start = [], True
        for part in re.split(r"(\*|\[.\])", self.glob(**known)):
            if part == "*":
                out.append("(?!\\.)[^/]*" if start else "[^/]*")
            else:
                out.append(quoted(part[1]) if re.fullmatch(r"\[.\]", part) else quoted(part))
            if part:
                start = part.endswith("/")
        return "(?s)^" + "".join(out) + "$"

    def matches(self, path: Column) -> Column:
        return path.rlike(self.regex)

    def decode(self, path: Column) -> dict[str, Column]:
        """One expression per field; typed fields are cast, and empty where the path doesn't fit.

        All fields are parts of one split text, so that a projection of them
        runs the regex once. Zero characters, which no path holds, part them.
        """
        kinds = {s.name: s.kind for s in reversed(self.segments) if s.name}
        parts = F.split(F.regexp_replace(path, self.regex, "".join(f"\0${n}" for n in range(1, len(self.fields) + 1))), "\0", -1)
        out = {}
        for n, name in enumerate(self.fields, 1):
            value = F.coalesce(F.get(parts, F.lit(n)), F.lit("")) if len(self.fields) > 1 else F.regexp_extract(path, self.regex, n)
            out[name] = value if kinds[name] == "text" else F.trim(value).cast("bigint" if kinds[name] == "int" else "double")
        return out

    def render(self, columns: dict[str, Column] | None = None) -> Column:
        """The path of a row whose field columns are text or numbers."""
        get = lambda name: (columns or {}).get(name, F.col(name))
        parts: list[Column] = []
        for s in self.segments:
            if s.literal:
                parts.append(F.lit(s.literal))
            if s.name is None:
                continue
            value = get(s.name).cast("string")
            if s.kind == "int":
                whole = value.cast("double").cast("bigint")
                parts.append(F.format_string("%" + s.spec, whole) if s.spec != "d" else whole.cast("string"))
            elif s.kind == "float":
                parts.append(F.format_string("%" + s.spec.replace("F", "f"), value.cast("double")))
            else:
                parts.append(value)
        return F.concat(*parts) if parts else F.lit("")

    @property
    def schema(self) -> T.StructType:
        kinds = {s.name: s.kind for s in reversed(self.segments) if s.name}
        types = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType()}
        return T.StructType([T.StructField("path", T.StringType())] + [T.StructField(n, types[kinds[n]]) for n in self.fields])


def leak_score(spec: FormatSpec, values: dict[str, Column]) -> Column:
    """How often field values hold the punctuation that ends the literal before them."""
    terms = [F.lit(0)]
    for s in spec.segments:
        if s.name and s.literal and not s.literal[-1].isalnum() and s.literal[-1].isascii() and not s.literal[-1].isspace():
            value = F.coalesce(values[s.name].cast("string"), F.lit(""))
            terms.append(F.length(value) - F.length(F.replace(value, F.lit(s.literal[-1]), F.lit(""))))
    return reduce(lambda a, b: a + b, terms).cast("int")
