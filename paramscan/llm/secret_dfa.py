"""Secret scans with one combined deterministic automaton.

Rule regexes (a small syntax over bytes) become one nondeterministic
automaton; subset construction and partition refinement turn it into a
minimal transition array, and one pass over a text's UTF-8 bytes finds where
each rule is first fulfilled. There the rule's reversed automaton is run back
to the leftmost start, and the run of the rule's tail class gives the end.

Texts are scanned where they lie, one at a time and whole: no shuffle, and
memory is the text's bytes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import astuple, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .span_sql import spans_query



@dataclass(frozen=True)
class Rule:
    """``head`` is scanned for; a match then extends over the bytes of ``tail``.

    ``least`` is how many bytes the head's last one and the tail must make for
    the match to count; shorter matches still use up their text. Only a run
    without a telling start, such as hex digits, is counted in the automaton. ``fold`` matches the head's letters in either case.
    """

    kind: str
    head: str
    tail: str = ""
    least: int = 0
    fold: bool = False


#: The first three are the base rules.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]"),
    Rule("private_key", "-----BEGIN\\x20([A-Z0-9]+\\x20)*PRIVATE\\x20KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "[A-Za-z0-9-]", 10),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]"),
)
BASE = 3


# --- regexes to nondeterministic automata


def parse(pattern: str, fold: bool = False) -> tuple:
    """Syntax tree of ``pattern``: bytes, ``\\xNN`` and escapes, classes, groups, ``|``, ``? * +`` and ``{n}``."""
    at = 0

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(c)

    def folded(bytes_: set) -> tuple:
        if fold:
            bytes_ = bytes_ | {b ^ 32 for b in bytes_ if chr(b).isalpha()}
        return ("set", frozenset(bytes_))

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            found: set = set()
            while pattern[at] != "]":
                low = high = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = one()
                found |= set(range(low, high + 1))
            at += 1
            return folded(found)
        return folded({one()})

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom()
            if at < len(pattern) and pattern[at] in "?*+":
                part = (pattern[at], part)
                at += 1
            elif at < len(pattern) and pattern[at] == "{":
                end = pattern.index("}", at)
                part = ("seq", (part,) * int(pattern[at + 1 : end]))
                at = end + 1
            parts.append(part)
        return ("seq", tuple(parts))

    def either() -> tuple:
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", tuple(options))

    return either()


def mirrored(tree: tuple) -> tuple:
    kind, inner = tree
    if kind == "set":
        return tree
    if kind == "seq":
        return ("seq", tuple(mirrored(x) for x in reversed(inner)))
    if kind == "or":
        return ("or", tuple(mirrored(x) for x in inner))
    return (kind, mirrored(inner))


class Nfa:
    """Thompson's construction: byte moves and empty moves between numbered states."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Build ``tree`` from ``start`` on; the end state."""
        kind, inner = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((inner, end))
            return end
        if kind == "seq":
            for x in inner:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "or":
            for x in inner:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        first = self.state()
        self.empty[start].append(first)
        last = self.add(inner, first)
        self.empty[last].append(end)
        if kind in "*?":
            self.empty[start].append(end)
        if kind in "*+":
            self.empty[last].append(first)
        return end

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def tail_chain(nfa: Nfa, accept: int) -> list[int]:
    """The states before ``accept`` that all wait for the bytes of the last move, nearest first.

    Of threads that wait in such a chain the one nearest to its end comes
    there first, and whatever stops it stops the others.
    """
    into = {t: (s, on) for s, moves in enumerate(nfa.moves) for on, t in moves}
    chain, at = [], accept
    while at in into and (not chain or into[at][1] == chain_on) and not nfa.empty[into[at][0]]:
        at, chain_on = into[at]
        chain.append(at)
        if any(at in targets for targets in nfa.empty):
            break
    return chain


def determinise(nfa: Nfa, start: int, accepts: dict[int, int], unanchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction, then minimisation: (states x 256 next states, accepted rules as bits). State 0 starts."""
    chains = [c for c in (tail_chain(nfa, a) for a in accepts) if len(c) > 1] if unanchored else []
    first = nfa.closure([start])

    def thinned(states: frozenset) -> frozenset:
        for chain in chains:
            waiting = [s for s in chain[:-1] if s in states]
            states = states - frozenset(waiting[1:])
        return states

    numbers, todo, rows, marks = {first: 0}, [first], [], []
    while todo:
        states = todo.pop(0)
        row: list[set] = [set() for _ in range(256)]
        for s in states:
            for on, t in nfa.moves[s]:
                for b in on:
                    row[b].add(t)
        known: dict[frozenset, int] = {}
        numbered = []
        for targets in row:
            key = frozenset(targets)
            if key not in known:
                new = nfa.closure(key)
                new = thinned(new | first) if unanchored else new
                if new not in numbers:
                    numbers[new] = len(numbers)
                    todo.append(new)
                known[key] = numbers[new]
            numbered.append(known[key])
        rows.append(numbered)
        marks.append(sum(1 << accepts[s] for s in states if s in accepts))
    table, mark = np.array(rows), np.array(marks)
    block = np.unique(mark, return_inverse=True)[1]
    while True:
        signature = np.column_stack([block, block[table]])
        kept, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.ravel()
        if len(kept) == block.max() + 1:
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    count = 0
    # the start first, then by first appearance, accepting blocks last
    for accepting in (False, True):
        for state, b in enumerate(block):
            if order[b] < 0 and (mark[state] > 0) == accepting:
                order[b], count = count, count + 1
    pick = np.zeros(count, int)
    pick[order[block][::-1]] = np.arange(len(block))[::-1]
    return order[block][table[pick]], mark[pick]


@dataclass(frozen=True)
class Automaton:
    rules: tuple
    table: list  # next state times 256, at state times 256 + byte
    accepting: int  # the least accepting entry
    marks: dict  # accepting entry -> rule numbers
    back: list  # of each rule: (table, set of accepting states, dead state)
    tails: list  # of each rule: a compiled run of tail bytes


@lru_cache(maxsize=4)
def compile_rules(rules: tuple = RULES) -> Automaton:
    nfa = Nfa()
    start = nfa.state()
    accepts, back, tails = {}, [], []
    for n, rule in enumerate(rules):
        tree = parse(rule.head, rule.fold)
        first = nfa.state()
        nfa.empty[start].append(first)
        accepts[nfa.add(tree, first)] = n
        other = Nfa()
        s = other.state()
        end = other.add(mirrored(tree), s)
        table, mark = determinise(other, s, {end: 0}, False)
        dead = [i for i in range(len(table)) if (table[i] == i).all() and not mark[i]]
        back.append((table.tolist(), set(np.flatnonzero(mark).tolist()), dead[0] if dead else -1))
        tails.append(re.compile(rule.tail.encode() + b"*") if rule.tail else None)
    table, mark = determinise(nfa, start, accepts, True)
    accepting = int(np.argmax(mark > 0)) * 256
    marks = {i * 256: [n for n in range(len(rules)) if int(mark[i]) >> n & 1] for i in np.flatnonzero(mark).tolist()}
    return Automaton(rules, (table * 256).ravel().tolist(), accepting, marks, back, tails)


def plain(auto: Automaton) -> tuple:
    """``auto`` as built-in values, which any worker can read."""
    return [astuple(r) for r in auto.rules], auto.table, auto.accepting, auto.marks, auto.back, auto.tails


def restored(values: tuple) -> Automaton:
    return Automaton(tuple(Rule(*r) for r in values[0]), *values[1:])


def scan(data: bytes, auto: Automaton) -> list[tuple[int, int, int]]:
    """``(start, end, rule number)`` in bytes, leftmost and not overlapping within a rule, sorted."""
    table, accepting, marks = auto.table, auto.accepting, auto.marks
    free = [0] * len(auto.rules)
    found = []
    state = 0
    for at, byte in enumerate(data):
        state = table[state + byte]
        if state >= accepting:
            for n in marks[state]:
                if at < free[n]:
                    continue
                rows, good, dead = auto.back[n]
                s, start = 0, -1
                for i in range(at, free[n] - 1, -1):
                    s = rows[s][data[i]]
                    if s == dead:
                        break
                    if s in good:
                        start = i
                if start < 0:
                    continue
                end = auto.tails[n].match(data, at + 1).end() if auto.tails[n] else at + 1
                free[n] = end
                if end - at >= auto.rules[n].least:
                    found.append((start, end, n))
    return sorted(found, key=lambda x: (x[0], x[2]))


def find_secrets(text: str | None, auto: Automaton) -> list[tuple[int, int, int]]:
    """``scan`` of a text in code points, end exclusive; null: none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scan(data, auto)
    if not found or len(data) == len(text):
        return found
    points, at, seen = {}, 0, 0
    for edge in sorted({x for a, b, _ in found for x in (a, b)}):
        seen += sum(1 for b in data[at:edge] if b & 0xC0 != 0x80)
        points[edge], at = seen, edge
    return [(points[a], points[b], n) for a, b, n in found]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def with_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", rules: tuple = RULES) -> DataFrame:
    """Add ``out``: an array of ``(kind, start, end)`` in code points, by start, then rule. Null and empty texts have none."""

    sent = docs.sparkSession.sparkContext.broadcast(plain(compile_rules(rules)))

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        auto = restored(sent.value)
        return pd.Series([[{"kind": auto.rules[n].kind, "start": a, "end": b} for a, b, n in find_secrets(t, auto)] for t in texts])

    return docs.withColumn(out, spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; overlapping spans become one, named by the first. Null stays null."""

    sent = docs.sparkSession.sparkContext.broadcast(plain(compile_rules(rules)))

    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series) -> pd.Series:
        auto = restored(sent.value)
        out = []
        for t in texts:
            parts, at = [], 0
            for a, b, n in find_secrets(t, auto) if t else []:
                if a >= at:
                    parts += [t[at:a], f"[{auto.rules[n].kind}]"]
                at = max(at, b)
            out.append(t if not parts else "".join([*parts, t[at:]]))
        return pd.Series(out)

    return docs.withColumn(text, masked(F.col(text)))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """One row per input row: counts of the base kinds, digest of the base spans, all spans as text."""
    kinds = [r.kind for r in rules]
    sent = docs.sparkSession.sparkContext.broadcast(plain(compile_rules(rules)))

    @F.pandas_udf(T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in kinds] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]))
    def summed(texts: pd.Series) -> pd.DataFrame:
        auto = restored(sent.value)
        out = []
        for t in texts:
            found = find_secrets(t, auto)
            joined = [",".join(f"{kinds[n]}:{a}:{b}" for a, b, n in found if n < most) for most in (BASE, len(kinds))]
            counts = [0] * len(kinds)
            for _, _, n in found:
                counts[n] += 1
            out.append((*counts, hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]))
        return pd.DataFrame(out, columns=[*(f"n_{k}" for k in kinds), "base_sha256", "spans"])

    return docs.select(F.col(key).alias("key"), summed(F.col(text)).alias("r")).select(F.col("key").alias(key), "r.*")


def _oracle() -> str:
    fold = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(fold(w) for w in ("password", "passwd", "secret", "token")) + f"|{fold('api')}_?{fold('key')}"
    assign = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
    group = f"^({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$"
    kinds = [
        ("assign", assign, f"length(regexp_extract(m, '{group}', 2)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]{24,}", "true"),
        ("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", "true"),
        ("github", "gh[opsur]_[A-Za-z0-9]+", "length(m) >= 40"),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true"),
    ]
    return spans_query([(*k, "0") for k in kinds], BASE)


#: DuckDB SQL for ``report`` over ``documents`` with the default rules.
ORACLE = _oracle()
