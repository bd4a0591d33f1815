"""Dataset configuration: formats, encodings, remotes. Plain mappings on the driver."""

from __future__ import annotations

from .functions.checksums import DIGITS
from .plans.spec import FormatSpec

TEMPLATE = {"data": [{"fmt": None, "encoding": None}], "remote": None, "meta": []}


def section(config: dict, name: str) -> list[dict]:
    """A section's mappings; a single mapping counts as a list, other values are left out."""
    found = config.get(name)
    found = [found] if isinstance(found, dict) else found if isinstance(found, list) else []
    return [e for e in found if isinstance(e, dict)]


def format_entries(config: dict) -> list[dict]:
    found = config.get("data")
    entries = [found] if isinstance(found, dict) else found or []
    if not all(isinstance(e, dict) for e in entries):
        raise ValueError("data entries must be mappings")
    return [e for e in entries if e.get("fmt")]


def single_format(config: dict) -> dict | None:
    """The one entry with a format; None without any."""
    entries = format_entries(config)
    if len(entries) > 1:
        raise ValueError("the configuration has more than one format")
    return entries[0] if entries else None


def with_format(config: dict, fmt: str | None = None, encoding: dict | None = None, remote=None) -> dict:
    """A copy of ``config`` with these set; other keys and their order stay, encodings are merged."""
    out = {**TEMPLATE, **config, "data": [dict(e) for e in section(config, "data")] or [dict(TEMPLATE["data"][0])]}
    if fmt is not None or encoding is not None:
        if len([e for e in out["data"] if "fmt" in e]) > 1:
            raise ValueError("the configuration has more than one format")
        entry = next((e for e in out["data"] if "fmt" in e), out["data"][0])
        if fmt is not None:
            FormatSpec.compile(fmt)
            entry["fmt"] = fmt
        if encoding is not None:
            entry["encoding"] = {**(entry.get("encoding") or {}), **encoding}
    if remote is not None:
        out["remote"] = remotes(remote)
    return out


def with_remote(config: dict, name: str | None = None, url: str | None = None) -> dict:
    """A copy of ``config`` whose remote of that name has that URL; the others stay.

    A single remote is changed as it is. Of several one must be named; a new
    name adds one, if it has a URL.
    """
    known = config.get("remote")
    given = {k: v.strip() for k, v in (("name", name), ("url", url)) if v is not None}
    if not all(given.values()):
        raise ValueError("a remote's name and URL must not be blank")
    if known is None or isinstance(known, dict):
        return {**config, "remote": {**(known or {}), **given}}
    if not isinstance(known, list) or not all(isinstance(e, dict) for e in known):
        raise ValueError(f"Invalid remote configuration: {known!r}")
    if name is None and len(known) != 1:
        raise ValueError("several remotes are configured: name one")
    hits = [n for n, e in enumerate(known) if name is None or e.get("name") == given["name"]]
    if hits:
        return {**config, "remote": [{**e, **given} if n == hits[0] else e for n, e in enumerate(known)]}
    if url is None:
        raise ValueError(f"no remote named {name!r}")
    return {**config, "remote": [*known, given]}


def remotes(value) -> list[dict]:
    """A text, mapping or list of them as a list of mappings with ``url``; several need different names."""
    values = value if isinstance(value, list) else [value]
    out = []
    for v in values:
        entry = {"url": v} if isinstance(v, str) else dict(v) if isinstance(v, dict) else None
        if not entry or not isinstance(entry.get("url"), str) or not entry["url"].strip():
            raise ValueError(f"not a remote: {v!r}")
        out.append(entry)
    names = [e.get("name") for e in out]
    if len(out) > 1 and (None in names or len(set(names)) < len(names)):
        raise ValueError("several remotes need different names")
    return out


def remote_url(config: dict, name: str | None = None) -> str:
    found = config.get("remote")
    if not found:
        raise ValueError("no remote is configured")
    entries = remotes(found)
    if name is None and len(entries) > 1:
        raise ValueError("several remotes are configured: name one")
    for e in entries:
        if name is None or e.get("name") == name:
            return e["url"]
    raise ValueError(f"no remote named {name!r}")


def build_entries(entries: list[dict]) -> list[dict]:
    """Format entries of a build: each has a new format and a table name, which ends in ``.tsv``."""
    seen, out = set(), []
    for n, e in enumerate(entries):
        if not isinstance(e, dict) or not str(e.get("fmt") or "").strip():
            raise ValueError(f"format entry {n} needs a format")
        if not e.get("db"):
            raise ValueError(f"format entry {n} must define a db name")
        fmt, db = e["fmt"].strip(), str(e["db"])
        if fmt in seen:
            raise ValueError(f"format entry {n} repeats {fmt!r}")
        if "/" in db or "\\" in db or db in (".", ".."):
            raise ValueError(f"not a table name: {db!r}")
        seen.add(fmt)
        out.append({**e, "fmt": fmt, "db": db if db.lower().endswith(".tsv") else db + ".tsv"})
    return out


def entry_checksum(entry: dict) -> tuple[str, str] | None:
    """The strongest checksum that a file entry names."""
    for a in DIGITS:
        value = str(entry.get(a) or "").strip()
        if value and value.lower() not in ("none", "nan", "unknown", "<na>"):
            return a, value
    value = str(entry.get("checksum") or "").strip()
    return (str(entry.get("checksum_algorithm") or "sha1").lower(), value) if value and value.lower() != "unknown" else None
