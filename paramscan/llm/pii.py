"""Personal data: regexes propose spans, checksums confirm them, context words adjust their scores.

Only column expressions: every text is handled in its own row, without a
shuffle. ``regexp_extract_all`` gives a kind's matches and ``split`` by the
same regex what lies between, so positions are prefix sums of lengths, taken
in blocks to stay near linear in the number of matches. Regexes start only
where a match can and use possessive runs, so they stay linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused
from .span_sql import spans_query

BLOCK = 64  # matches whose lengths are summed at once
CONTEXT = 40  # characters before a match that are searched for context words
KEEP = 0.5  # least score of a span of the added kinds


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` has lambdas that name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit text passes the Luhn check."""

    def passes(digits: Column) -> Column:
        n = F.length(digits)

        def digit(i: Column) -> Column:
            d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
            twice = d * 2
            return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0

    return let(digits, passes)


def mod97(match: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(match, "[ -]", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def passes(moved: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            code = F.ascii(F.substring(moved, i, F.lit(1)))
            return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1

    return let(moved, passes)


def _octets(match: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(match, "\\."), fits)


def _long(least: int, most: int):
    return lambda match: F.length(_digits(match)).between(least, most)


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """``needs``: a text that every match contains. ``score`` is raised by 0.3 after a word of ``context``, to 1 at most."""

    name: str
    regex: str
    check: object
    score: float
    context: str
    needs: str | None = None


#: The first four are the base kinds: confirmed matches stay whatever their score.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.7, "e?-?mail|contact|write to", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.5, "ip|host|server|address|login", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+", _card, 0.7, "card|visa|master|credit|debit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _long(9, 15), 0.5, "phone|tel|call|mobile|fax|contact", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod97, 0.8, "iban|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.3, "ssn|social security", "-"),
)
BASE = 4


def _starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of ints."""
    zero = F.lit(0)
    total = lambda array, start, n: F.aggregate(F.slice(array, start, n), zero, lambda a, x: a + x)

    def starts(lengths: Column, blocks: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return total(blocks, F.lit(1), block) + total(lengths, block * BLOCK + 1, i % BLOCK)

        return F.transform(F.sequence(zero, F.size(lengths) - 1), at)

    def blocks(lengths: Column) -> Column:
        return F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: total(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    return let(lengths, lambda n: let(blocks(n), lambda b: starts(n, b)))


def with_pii(docs: DataFrame, text: str = "text", out: str = "pii", kinds: tuple = KINDS) -> DataFrame:
    """Add ``out``: an array of ``(start, rank, kind, end, score)``, sorted; code points, end exclusive, rank the kind's place.

    A confirmed match of a base kind always stays; the others need a score of
    ``KEEP``. Null and empty texts have an empty array. All columns stay but one
    named ``out``, which is replaced.
    """
    names = [c for c in docs.columns if c != out]
    # temporary columns by kind and by what they hold, none of which hides a column of ``docs``
    fresh = {k.name: dict(zip("mpsk", unused(docs, *(f"{what} of {k.name}" for what in ("matches", "pieces", "starts", "kept"))))) for k in kinds}
    col = lambda what, kind: F.col(fresh[kind.name][what])
    body = F.coalesce(F.col(text), F.lit(""))

    def matched(kind: Kind) -> Column:
        found = F.regexp_extract_all(body, F.lit(kind.regex), F.lit(0))
        return F.when(F.contains(body, F.lit(kind.needs)), found) if kind.needs else found

    docs = docs.withColumns({fresh[k.name]["m"]: matched(k) for k in kinds})
    docs = docs.withColumns({fresh[k.name]["p"]: F.when(F.size(col("m", k)) > 0, F.split(body, k.regex, -1)) for k in kinds})
    # a piece, then the match behind it, and so on: lengths of both in turn
    docs = docs.withColumns({fresh[k.name]["s"]: _pair_starts(col("m", k), col("p", k)) for k in kinds})
    docs = docs.withColumns({fresh[k.name]["k"]: _spans(rank, k, col("m", k), col("p", k), col("s", k)) for rank, k in enumerate(kinds)})
    merged = F.filter(F.array(*[col("k", k) for k in kinds]), lambda x: x.isNotNull())
    return docs.select(*[F.col(c) for c in names], F.array_sort(F.flatten(merged)).alias(out))


def _pair_starts(matches: Column, pieces: Column) -> Column:
    """Where each piece begins."""
    lengths = F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    return F.when(pieces.isNotNull(), _starts(lengths))


def _spans(rank: int, kind: Kind, matches: Column, pieces: Column, starts: Column) -> Column:
    """The kept spans of one kind; null without matches."""

    def span(x: Column) -> Column:
        start = x["s"] + F.length(x["p"])
        near = F.lower(F.right(x["p"], F.lit(CONTEXT))).rlike(f"\\b(?:{kind.context})")
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0))
        ok = F.coalesce(kind.check(x["m"]), F.lit(False))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(x["m"])).alias("end"), score.alias("score"), ok.alias("ok"))

    # the last piece has no match behind it
    zipped = F.arrays_zip(matches.alias("m"), pieces.alias("p"), starts.alias("s"))
    held = F.filter(zipped, lambda x: x["m"].isNotNull())
    kept = F.filter(F.transform(held, span), lambda x: x["ok"] & (F.lit(rank < BASE) | (x["score"] >= KEEP)))
    return F.when(pieces.isNotNull(), kept)


def _of_rank(rank: int) -> Column:
    return F.size(F.filter("pii", lambda x: x["rank"] == rank)).cast("long")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple = KINDS) -> DataFrame:
    """One row per input row: counts of each kind, digest of the base spans, all spans as text and the highest score (null: no span)."""
    found = with_pii(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "pii", kinds).select("key", "pii")
    counts = [_of_rank(rank).alias(f"n_{kind.name}") for rank, kind in enumerate(kinds)]
    base = _joined(F.filter("pii", lambda x: x["rank"] < BASE))
    return found.select(F.col("key").alias(key), *counts, F.sha2(base, 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda x: x["score"])).alias("top_score"))


def _oracle() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({digits}, length({digits}) - i + 1, 1) AS INTEGER)"
        f" ELSE (2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INTEGER)) // 10 + (2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INTEGER)) % 10 END))"
    )
    plain = "regexp_replace(m, '[ -]', '', 'g')"
    moved = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    numbers = f"list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END)"
    octets = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || left(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0"
    score = {k.name: f"least(1.0, {k.score} + CASE WHEN regexp_matches(lower(right(p, {CONTEXT})), '\\b(?:{k.context})') THEN 0.3 ELSE 0.0 END)" for k in KINDS}
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", octets),
        ("card", r"[0-9](?:[\x20-]?[0-9]){11,}", f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sum} % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", f"{numbers} = 1 AND {score['iban']} >= {KEEP}"),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", f"{score['ssn']} >= {KEEP}"),
    ]
    typed = lambda s: f"CAST({s} AS DOUBLE)"
    return spans_query([(*k, typed(score[k[0]])) for k in kinds], BASE, "max(score) AS top_score")


#: DuckDB SQL for ``report`` over ``documents`` with the default kinds. The base kinds' regexes are written plainly here.
ORACLE = _oracle()
