"""Secret scans through a trigram inverted index (DataFrame operations only)."""

from __future__ import annotations

import re._parser as regex_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, matches, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of a group for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False  # of the letters outside classes


#: The kinds, in the order of a listing. The first three are the contract's.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{1,1000}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("url_login", r"://[^ \t-\r/:@]+:[^ \t-\r/@]+@"),
)
BASE_KINDS = 3

# --- Boolean trigram queries ------------------------------------------------------------

#: A query is True (no trigram is mandatory), a trigram, or ("and" | "or", queries).
Query = object


def _all(queries: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(queries: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """Holds in each text that contains one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes, most: int = 64) -> tuple[set[str] | None, Query]:
    """The strings a sequence of regex nodes stands for, if they are few, and its query."""
    now, clauses, exact = {""}, [], True

    def flush() -> None:
        nonlocal now, exact
        clauses.append(_of_strings(now))
        now, exact = {""}, False

    for op, arg in nodes:
        name = str(op)
        strings: set[str] | None = None
        query: Query = True
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            strings = {chr(a).lower() for _, a in arg}
        elif name == "SUBPATTERN":
            strings, query = _walk(arg[3], most)
        elif name == "BRANCH":
            parts = [_walk(p, most) for p in arg[1]]
            strings = set().union(*(p[0] for p in parts)) if all(p[0] for p in parts) else None
            query = _any([p[1] for p in parts])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            strings, query = _walk(inner, most)
            if (low, high) == (0, 1) and strings:
                strings = strings | {""}
            elif low == high == 1:
                pass
            else:
                strings, query = None, query if low else True
        if strings and len(strings) * len(now) <= most:
            now = {a + b for a in now for b in strings}
        else:
            flush()
            clauses.append(query if strings is None else _of_strings(strings))
    return (now if exact else None), _all([*clauses, _of_strings(now)])


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match satisfies."""
    return _walk(regex_parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def clauses(query: Query) -> list[frozenset[str]]:
    """The query as alternatives of trigrams that must all occur (its disjunctive form)."""
    if isinstance(query, str):
        return [frozenset([query])]
    if query[0] == "or":
        return [c for q in query[1] for c in clauses(q)]
    out = [frozenset()]
    for q in query[1]:
        out = [a | b for a in out for b in clauses(q)]
    return out


def _one_of(words: Sequence[str]) -> str:
    """A regex for the words that shares their first letters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[0], []).append(w[1:])
    quote = lambda s: "".join(f"\\x{{{ord(c):x}}}" if not c.isalnum() else c for c in s)
    return "|".join(f"{quote(h)}(?:{'|'.join(map(quote, tails))})" for h, tails in heads.items())


# --- the scan ---------------------------------------------------------------------------


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, kind number, end) of a rule's matches that count, by start."""
    found = matches(text, rule.pattern, rule.group)
    if rule.least > 1:
        found = F.filter(found, lambda m: F.length(m["value"]) >= rule.least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def quick(rule: Rule) -> str:
    """A regex without places that finds at least the texts with a match that counts."""
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+") and rule.pattern.startswith("["):
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def trigram_index(docs: DataFrame, key: str, text: str, wanted: set[str]) -> DataFrame:
    """Postings (trigram, key): which rows hold which of the wanted trigrams in lower case."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"(?=({_one_of(sorted(wanted))}))"), F.lit(1)))
    return docs.select(F.explode(found).alias("trigram"), key)


def intersect(postings: DataFrame, key: str, queries: Sequence[Query]) -> DataFrame:
    """(key, rules): the rows that satisfy some of the queries, with these queries' numbers.

    Each alternative of a query is a set of lists that are intersected by marks: a list has a bit
    of its own, the postings of all lists are united, and the keys whose bits are all set stay.
    So a key that repeated rows share counts each list once, and one that different rows share by
    chance can only become a candidate too many. Of over 63 trigrams of an alternative, 63 are
    asked for: candidates are verified.
    """
    session = postings.sparkSession
    wanted = [(t, i, n, 1 << k, (1 << min(len(c), 63)) - 1) for i, q in enumerate(queries) if q is not True for n, c in enumerate(clauses(q)) for k, t in enumerate(sorted(c)[:63])]
    lists = F.broadcast(session.createDataFrame(wanted, "trigram string, rule int, clause int, bit long, full long"))  # as long as the rules
    held = postings.join(lists, "trigram").groupBy(key, "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full")).where("bits = full")
    return held.groupBy(key).agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: spans (start, kind, end; code points, end exclusive) by start.

    Each rule's regex gives a Boolean trigram query. The inverted index has the rows of each
    mandatory trigram; a rule's candidates are found by intersecting and uniting its lists,
    without the texts. They are few and join the texts by a broadcast of checked size (beyond it
    by a shuffle); only candidates are matched. Rules without mandatory trigrams (``hex``) scan
    all rows.

    Matches are leftmost and non-overlapping by rule; one whose group is too short is dropped
    after matching. The header of a ``jwt`` has 1,000 characters at most. A null text is empty
    and has no spans. Rows stay as they are, repeated ones and null ids included; a column named
    ``secrets`` is replaced. An empty table stays empty.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    kept = [c for c in docs.columns if c.lower() != "secrets"]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), text_of(text).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64(F.col("_row")[doc_id].cast("string"), "_text"))
    wanted = set().union(*map(trigrams, queries))
    found = F.array().cast("array<int>")
    if wanted:
        postings = cut(trigram_index(rows, "_key", "_text", wanted))
        rows = rows.join(lookup(intersect(postings, "_key", queries)), "_key", "left")
        found = F.coalesce(F.col("rules"), found)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = []
    for i, (rule, query) in enumerate(zip(rules, queries)):
        maybe = F.col("_text").rlike(quick(rule)) if query is True else F.array_contains(found, i)
        spans.append(F.when(maybe, spans_of(F.col("_text"), rule, i)).otherwise(none))
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], F.array_sort(F.concat(*spans)).alias("secrets"))


def as_text(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``; null stays null.

    Spans come by start. Overlapping ones count as one stretch, a mark for each stretch.
    """

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.when(apart & (s["start"] > acc["at"]), F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        out = F.when(apart, F.concat(acc["out"], piece, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
