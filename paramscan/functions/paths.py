"""Path predicates and tokens as column expressions."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITERS = r"[_\-./]"
#: Directories that belong to a store, archive suffixes.
STORE_DIRS = (".hm", ".git")
ARCHIVES = ("tgz", "tar", "zip", "bz2", "xz", "zst", "7z", "rar")


def tokens(path: Column) -> Column:
    return F.split(path, DELIMITERS, -1)


def delimiters(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(f"({DELIMITERS})"), F.lit(1))


def joined(toks: Column, delims: Column) -> Column:
    """The text whose tokens and delimiters these are."""
    padded = F.concat(delims, F.array(F.lit("")))
    return F.array_join(F.zip_with(toks, padded, lambda t, d: F.concat(t, F.coalesce(d, F.lit("")))), "")


def is_safe_relative(path: Column) -> Column:
    """A relative path that stays below its root and outside of store directories."""
    first = F.lower(F.split(path, "/")[0])
    plain = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(^|/)(\./)+", "$1")
    first = F.lower(F.split(plain, "/")[0])
    bad = (
        (F.trim(path) == "")
        | path.rlike(r"^\.?/*$")
        | path.contains("\x00")
        | path.contains("\\")
        | path.startswith("/")
        | path.rlike(r"^[A-Za-z]:")
        | path.rlike(r"(^|/)\.\.(/|$)")
        | first.isin(*STORE_DIRS)
    )
    return F.coalesce(~bad, F.lit(False))


def checked_relative(value: str, label: str = "path") -> str:
    """The same rule for one value on the driver; returns the normalised path."""
    value = str(value)
    path = PurePosixPath(value)
    bad = not value.strip() or "\0" in value or "\\" in value or path.is_absolute() or value[1:2] == ":" and value[0].isalpha()
    if bad or not path.parts or ".." in path.parts or path.parts[0].lower() in STORE_DIRS:
        raise ValueError(f"{label} is not a safe relative path: {value!r}")
    return path.as_posix()


def within(path: Column, directory: str) -> Column:
    """Below ``directory`` by whole components; an empty directory holds everything."""
    directory = directory.strip("/")
    return F.lit(True) if directory in ("", ".") else (path == directory) | path.startswith(directory + "/")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def is_archive(path: Column) -> Column:
    return F.lower(path).rlike(r"(?:\.tar\.(?:gz|bz2|xz)|\.(?:" + "|".join(ARCHIVES) + "))$")


def tsv_name(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".tsv"), name).otherwise(F.concat(name, F.lit(".tsv")))


def url_of(base: str, path: Column) -> Column:
    """``base`` and the percent-encoded path; slashes stay."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.replace(encoded, F.lit("%7E"), F.lit("~")))


def manifest_path(name: Column, directory: Column) -> Column:
    """The path that a checksum manifest in ``directory`` (with a final slash, or empty) means by ``name``."""
    name = F.regexp_replace(F.trim(name), r"^(\./)+", "")
    first = F.split(name, "/")[0]
    bare = F.rtrim(directory, F.lit("/"))
    spliced = F.concat(F.expr("''"), F.substring(directory, F.lit(1), F.length(bare) - F.length(first)), name)
    return F.when(name.startswith(directory), name).when(~name.contains("/"), F.concat(directory, name)).when(bare.endswith(F.concat(F.lit("/"), first)), spliced).otherwise(name)
