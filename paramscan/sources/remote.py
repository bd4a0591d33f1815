"""Files on remote servers: HTML indexes crawled level by level, checksum manifests, downloads.

A frontier of directories is fetched on the executors, at most ``workers`` at
a time; what a level lists is a DataFrame written to the checkpoint folder,
and directories seen before are left out by an anti-join. Functions that speak
to servers are parameters, so that tests need no network: ``fetch`` takes a URL
and returns bytes or None, ``size`` the length that a server tells or None, and
``chunks`` gives a body piece by piece or raises ``OSError``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import DIGITS, is_valid
from ..functions.paths import is_safe_relative, manifest_path
from ..plans.cut import checkpoint
from .tables import atomic_path

# How an index lists its entries, and how manifests list checksums.
INDEX_ROW = r'<tr class="object (collection|data-object[^"]*)"><td class="name"><a href="([^"]+)"'
MANIFEST_ROW = r"^([0-9a-fA-F]{8,})\s+\*?(.+?)\s*$"
MANIFEST_WORDS = ("sum", "checksum", "hash", "manifest", *DIGITS)
PLAUSIBLE = 0.5  # of a manifest's lines must be checksum lines
TIMEOUT = (10, 30)
SMALL = 10 * 1024 * 1024
CHUNK = 1 << 20
WORKERS = 8


def http_session():
    """One session serves a worker process."""
    import requests

    return http_session.__dict__.setdefault("session", requests.Session())


def http_get(url: str) -> bytes | None:
    """The body, or None if it cannot be had."""
    import requests

    try:
        response = http_session().get(url, timeout=TIMEOUT)
        response.raise_for_status()
        return response.content
    except requests.RequestException:
        return None


def http_size(url: str) -> int | None:
    """The length of a body by its header alone, or None if the server doesn't tell."""
    import requests

    try:
        response = http_session().head(url, timeout=TIMEOUT, allow_redirects=True)
        response.raise_for_status()
        return int(response.headers["Content-Length"])
    except (requests.RequestException, KeyError, ValueError):
        return None


def http_chunks(url: str) -> Iterator[bytes]:
    """The body piece by piece."""
    import requests

    try:
        with http_session().get(url, timeout=TIMEOUT, stream=True) as response:
            response.raise_for_status()
            yield from response.iter_content(CHUNK)
    except requests.RequestException as e:
        raise OSError(f"cannot be fetched: {e}") from e


def chunks_by(fetch) -> Callable[[str], Iterator[bytes]]:
    """``chunks`` of a function that has whole bodies."""

    def chunks(url: str) -> Iterator[bytes]:
        body = fetch(url)
        if body is None:
            raise OSError("cannot be fetched")
        yield from (body[at : at + CHUNK] for at in range(0, len(body), CHUNK))

    return chunks


def fetched(urls: DataFrame, fetch=http_get, workers: int = WORKERS, required: bool = False) -> DataFrame:
    """Add ``body`` (binary) to rows with ``url``; at most ``workers`` requests run at once."""
    out = urls.schema.add("body", "binary")

    def run(batches):
        for pdf in batches:
            bodies = [fetch(u) for u in pdf["url"]]
            if required and any(b is None for b in bodies):
                raise OSError(f"cannot read {pdf['url'][[b is None for b in bodies].index(True)]}")
            yield pdf.assign(body=bodies)

    return urls.repartition(workers).mapInPandas(run, out)


def index_entries(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """``(rel_dir, kind, path)`` of the entries of index pages ``(rel_dir, html)``; unsafe and absolute references are errors."""
    html = F.col("html") if html is None else html
    kinds, refs = F.regexp_extract_all(html, F.lit(INDEX_ROW), F.lit(1)), F.regexp_extract_all(html, F.lit(INDEX_ROW), F.lit(2))
    pairs = F.zip_with(kinds, refs, lambda k, h: F.struct(k.alias("kind"), h.alias("href")))
    rows = pages.select("rel_dir", F.explode(pairs).alias("e")).select("rel_dir", "e.kind", "e.href")
    # percent-decoding must keep a plus sign
    decoded = F.try_url_decode(F.replace(F.trim("href"), F.lit("+"), F.lit("%2B")))
    folder = F.col("kind") == "collection"
    name = F.when(folder, F.regexp_replace(decoded, "/+$", "")).otherwise(decoded)
    good = ~F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|[?#]") & is_safe_relative(name)
    checked = F.when(good, name).otherwise(F.raise_error(F.concat(F.lit("unsafe index entry: "), "href")))
    return rows.select("rel_dir", F.when(folder, "directory").otherwise("file").alias("kind"), F.concat("rel_dir", checked, F.when(folder, "/").otherwise("")).alias("path"))


def manifest_algorithm(name: Column) -> Column:
    """The algorithm that a manifest's file name tells, else ``unknown``."""
    found = F.regexp_extract(F.lower(name), "(" + "|".join(DIGITS) + ")", 1)
    return F.when(found != "", found).otherwise("unknown")


def is_manifest(name: Column) -> Column:
    """A text file whose name speaks of checksums."""
    return F.lower(F.element_at(F.split(name, "/"), -1)).rlike("|".join(MANIFEST_WORDS))


def manifest_lines(texts: DataFrame) -> DataFrame:
    """``(checksum, name)`` of each checksum line of rows with ``text`` and ``algorithm``; other columns stay."""
    carried = [c for c in texts.columns if c != "text"]
    lines = texts.select(*carried, F.explode(F.split("text", "\r?\n")).alias("line"))
    rows = lines.select(*carried, F.regexp_extract("line", MANIFEST_ROW, 1).alias("checksum"), F.regexp_extract("line", MANIFEST_ROW, 2).alias("name"))
    return rows.filter((F.col("checksum") != "") & is_valid(F.col("algorithm"), F.col("checksum"), allow_unknown=True))


def plausible(texts: DataFrame) -> DataFrame:
    """The manifests of which enough lines are checksum lines."""
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    good = F.filter(lines, lambda x: x.rlike(MANIFEST_ROW) & is_valid(F.col("algorithm"), F.regexp_extract(x, MANIFEST_ROW, 1), True))
    return texts.filter((F.size(good) > 0) & (F.size(good) >= PLAUSIBLE * F.size(lines)))


def crawl(spark: SparkSession, base_url: str, fetch=http_get, max_levels: int = 200) -> DataFrame:
    """``(path, algorithm, checksum)`` of every file below an index; null where no manifest names it. Later manifests win.

    An index deeper than ``max_levels`` is an error, since one that leads back
    into itself would never end.
    """
    base = base_url.rstrip("/") + "/"
    frontier = spark.createDataFrame([("",)], "rel_dir string")
    seen, files = frontier, None
    url = lambda column: F.concat(F.lit(base), F.replace(F.replace(F.replace(F.url_encode(column), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")))
    for _ in range(max_levels):
        pages = fetched(frontier.withColumn("url", url(F.col("rel_dir"))), fetch, required=True).withColumn("html", F.col("body").cast("string"))
        entries = checkpoint(index_entries(pages))
        found = entries.filter("kind = 'file'").select("path", "rel_dir")
        files = found if files is None else files.union(found)
        folders = entries.filter("kind = 'directory'").select(F.col("path").alias("rel_dir")).distinct()
        frontier = checkpoint(folders.join(seen, "rel_dir", "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.union(frontier))
    else:
        raise OSError(f"{base} has more than {max_levels} levels of directories")
    files = checkpoint(files.distinct())
    named = files.filter(is_manifest(F.col("path"))).withColumn("url", url(F.col("path")))
    texts = fetched(named, fetch).filter("body is not null")
    # beside a directory, NAME.md5sums speaks of files in NAME
    beside = F.regexp_extract("path", r"^(.+)\.(?:" + "|".join(DIGITS) + r")sums$", 1)
    folder = F.when(beside != "", F.concat(beside, F.lit("/"))).otherwise(F.col("rel_dir"))
    texts = texts.select(F.col("path").alias("manifest"), folder.alias("folder"), manifest_algorithm(F.element_at(F.split("path", "/"), -1)).alias("algorithm"), F.col("body").cast("string").alias("text"))
    lines = manifest_lines(plausible(texts))
    sums = lines.select(manifest_path(F.col("name"), F.col("folder")).alias("path"), "manifest", F.struct("algorithm", F.lower("checksum").alias("checksum")).alias("s"))
    best = sums.groupBy("path").agg(F.max_by("s", "manifest").alias("s"))
    return files.select("path").join(best, "path", "left").select("path", "s.algorithm", "s.checksum")


def small_digests(paths: DataFrame, base_url: str, fetch=None, size=None, chunks=None) -> DataFrame:
    """``(path, algorithm, checksum)``: md5 of files of at most ``SMALL`` bytes, else ``unknown``.

    The server is asked for a file's size first; without an answer, or with one
    above the limit, nothing is fetched, and a body that is longer than told is
    left at the limit.
    """
    base = base_url.rstrip("/") + "/"
    size = size or (http_size if fetch is None else lambda url: None if (body := fetch(url)) is None else len(body))
    chunks = chunks or (http_chunks if fetch is None else chunks_by(fetch))

    def digest(url: str) -> str | None:
        told = size(url)
        if told is None or told > SMALL:
            return None
        found, length = hashlib.md5(), 0
        try:
            for piece in chunks(url):
                length += len(piece)
                if length > SMALL:
                    return None
                found.update(piece)
        except OSError:
            return None
        return found.hexdigest()

    def run(batches):
        for pdf in batches:
            found = [digest(base + quote(p)) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "algorithm": ["unknown" if d is None else "md5" for d in found], "checksum": [d or "unknown" for d in found]})

    return paths.select("path").distinct().repartition(WORKERS).mapInPandas(run, "path string, algorithm string, checksum string")


def download(selection: DataFrame, base_url: str, folder: str, workers: int = 4, fetch=None, chunks=None) -> DataFrame:
    """Fetch ``(ord, path, algorithm, checksum)`` below ``folder``, a directory all workers see; ``(ord, path, ok, bytes, error)``.

    A file appears whole and verified or not at all: its pieces go to a
    temporary file of its own, so that a task that runs twice disturbs nothing,
    and never more than one piece is in memory.
    """
    if workers < 1:
        raise ValueError("workers must be positive")
    base = base_url.rstrip("/") + "/"
    chunks = chunks or (http_chunks if fetch is None else chunks_by(fetch))

    def one(path, algorithm, checksum):
        target, length = os.path.join(folder, path), 0
        found = hashlib.new(algorithm) if checksum else None
        os.makedirs(os.path.dirname(target), exist_ok=True)
        try:
            with atomic_path(target) as temp:
                with open(temp, "wb") as f:
                    for piece in chunks(base + quote(path)):
                        f.write(piece)
                        length += len(piece)
                        if found:
                            found.update(piece)
                if found and found.hexdigest() != checksum.lower():
                    raise OSError(f"{algorithm} differs")
        except OSError as e:
            return False, 0, str(e)
        return True, length, None

    def run(batches):
        for pdf in batches:
            done = [one(*x) for x in zip(pdf["path"], pdf["algorithm"], pdf["checksum"])]
            yield pd.DataFrame({"ord": pdf["ord"], "path": pdf["path"], "ok": [d[0] for d in done], "bytes": [d[1] for d in done], "error": [d[2] for d in done]})

    safe = F.when(is_safe_relative(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), "path")))
    rows = selection.select("ord", safe.alias("path"), "algorithm", "checksum")
    return rows.repartition(workers).mapInPandas(run, "ord long, path string, ok boolean, bytes long, error string")
