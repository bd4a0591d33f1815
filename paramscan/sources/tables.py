"""Tab-separated manifests and YAML documents."""

from __future__ import annotations

import csv
import glob
import io
import os
import shutil
import tempfile
from contextlib import contextmanager

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns text, blanks empty text; ``NA`` or ``None`` stay as they are. A missing or blank file has only ``sha1``."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    if not df.columns:
        return spark.createDataFrame([], "sha1 string")
    return df.na.fill("")


def has_malformed_lines(spark: SparkSession, path: str) -> bool:
    """Whether a row has more values than the header has names, which ``read_tsv`` would cut off."""
    names = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"', multiLine=True).columns
    if not names:
        return False
    whole = T.StructType([T.StructField(f"c{n}", T.StringType()) for n in range(len(names) + 1)])
    rows = spark.read.csv(path, schema=whole, sep="\t", header=True, enforceSchema=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    return not rows.filter(F.col(f"c{len(names)}").isNotNull()).isEmpty()


def parse_tsv(spark: SparkSession, text: str) -> DataFrame:
    """``read_tsv`` of a small text, such as a stored revision."""
    rows = list(csv.reader(io.StringIO(text), delimiter="\t"))
    if not rows:
        return spark.createDataFrame([], "sha1 string")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in rows[0]])
    return spark.createDataFrame([tuple(r) for r in rows[1:] if r], schema)


@contextmanager
def atomic_path(path: str):
    """A temporary path beside ``path`` that replaces it on success and is removed in any case."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".tmp-")
    os.close(handle)
    try:
        yield temp
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def write_tsv(df: DataFrame, path: str, null: str = "") -> None:
    """One local file, written whole or not at all; nulls become ``null``. The export format of a manifest: use Parquet for large ones.

    All tasks write their rows at once, in a folder beside the file, which they
    must share; the parts are then put together in order.
    """
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)).alias(c) for c in df.columns])
    folder = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".tmp-")
    try:
        text.write.mode("overwrite").csv("file://" + folder, sep="\t", header=False, quote='"', escape='"', emptyValue="", nullValue=null)
        with atomic_path(path) as temp, open(temp, "wb") as out:
            head = io.StringIO()
            csv.writer(head, delimiter="\t", lineterminator="\n").writerow(df.columns)
            out.write(head.getvalue().encode())
            for part in sorted(glob.glob(os.path.join(folder, "part-*"))):
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def load_yaml(path: str) -> dict:
    """A YAML mapping; an empty document is an empty mapping."""
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


class _Dumper(yaml.SafeDumper):
    pass


_Dumper.add_representer(str, lambda d, v: d.represent_scalar("tag:yaml.org,2002:str", v, style="|" if "\n" in v else None))


def dump_yaml(value: dict, path: str) -> None:
    """Keys in order, multi-line texts as blocks, long lines whole."""
    with atomic_path(path) as temp, open(temp, "w", encoding="utf-8") as f:
        yaml.dump(value, f, Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=float("inf"))
