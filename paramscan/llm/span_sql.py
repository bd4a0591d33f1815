"""DuckDB SQL for reports of spans: regex matches by kind, kept by a condition, with their positions."""

from __future__ import annotations


def spans_query(kinds: list[tuple[str, str, str, str]], base: int, extra: str = "") -> str:
    """One row per document: counts by kind, digest of the first ``base`` kinds' spans, all spans, and ``extra`` aggregates.

    A kind is (name, regex, condition, score); condition and score see the
    match ``m`` and the text ``p`` between it and the match before.
    """
    found = "\nUNION ALL\n".join(
        f"""SELECT rid, {n} AS rank, '{name}' AS kind, s + length(p) AS "start", s + length(p) + length(m) AS "end", {score} AS score FROM (
  SELECT rid, unnest(m) AS m, unnest(p[1:len(m)]) AS p, unnest(list_transform(range(1, len(m) + 1), lambda i:
    CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
  FROM (SELECT rid, regexp_extract_all(text, '{rx}') AS m, regexp_split_to_array(text, '{rx}') AS p FROM d)) WHERE {keep}"""
        for n, (name, rx, keep, score) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (rank = {n}) AS n_{name}" for n, (name, *_) in enumerate(kinds))
    joined = """string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank)"""
    shown = ", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, *_ in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({found}),
g AS (SELECT rid, {counts}, {joined} FILTER (rank < {base}) AS base, {joined} AS spans{", " + extra if extra else ""} FROM s GROUP BY rid)
SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans{", " + extra.rsplit(" AS ", 1)[1] if extra else ""} FROM d LEFT JOIN g USING (rid)"""
