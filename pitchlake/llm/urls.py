"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, joined_by_frequency

BITS_A_URL = 16  # of the filter, for each listed URL
WORDS = 8  # of a block, 64 bits each; a URL has a bit in each word
MOST_BLOCKS = 200_000  # blocks (64 bytes and their overhead) of a filter that goes to all tasks


@dataclass(frozen=True)
class Rule:
    """What holds for a host, all its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = ("ref", "fbclid", "gclid")
TRACKING_PREFIX = "utm_"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the URLs of a page; empty for a null one or one without ``://``.

    The host in lower case without ``www.``, the path without slashes at its end, the query's
    parameters in order without those that only track visitors; no scheme, no fragment.
    """
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith(TRACKING_PREFIX) & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host_of(url) != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail)).otherwise("")


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; of equally long ones the
    longer host's wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The place of a key's bit in each word of its block, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): a Bloom filter in blocks of 512 bits, each aggregated by bitwise or."""
    set_bits = [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in _bits(F.col(key))]
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(set_bits)])


def maybe_listed(rows: DataFrame, key: str, table: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key is in the filter, or seems to be: all bits of its block are set."""
    hit = reduce(lambda a, b: a & b, [F.getbit(F.col(f"w{i}"), b) == 1 for i, b in enumerate(_bits(F.col(key)))])
    return rows.withColumn("block", _block(F.col(key), blocks)).join(table, "block").where(hit).select(rows.columns)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", most_blocks: int = MOST_BLOCKS, most: int = 200_000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict`` (allow or block).

    The longest rule that fits a URL decides; without one, a URL is blocked if its canonical form
    is that of a row of ``listed`` (any number of rows, column ``url``). The listed forms make a
    blocked Bloom filter, 16 bits each. It goes to all tasks while it has at most ``most_blocks``
    blocks; a larger one stays in shards and the different forms of ``pages`` are dealt to its
    blocks. The different forms that pass are joined to the list itself, which removes the false
    positives. What is left goes back to the rows by a broadcast of at most ``most`` forms; if
    there are more, by the forms' frequency (``joined_by_frequency``), so a form of very many
    rows, listed or not, is in no shuffle.

    Rules are few and written by hand. A null URL, and one without ``://``, has an empty host and
    path, no rule and no listed form: allowed. Null rows of ``listed`` list nothing. Rows stay as
    they are, repeated ones included; columns of the five names are replaced, others kept. An
    empty table stays empty.
    """
    added = ("host", "path", "rule", "listed", "verdict")
    kept = [c for c in pages.columns if c.lower() not in added]
    rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in kept]).alias("_row"), canonical(F.col(url)).alias("form"))
    forms = cut(listed.select(canonical(F.col("url")).alias("form")).where("form <> ''").distinct())
    n = forms.count()
    blocks = max(1, -(-n * BITS_A_URL // (64 * WORDS)))
    table = cut(bloom_filter(forms, "form", blocks))
    of_pages = rows.select("form").where("form <> ''")
    if blocks <= most_blocks:
        passed = maybe_listed(of_pages, "form", F.broadcast(table), blocks).distinct()
    else:
        passed = maybe_listed(of_pages.distinct(), "form", table, blocks)
    hits = cut(passed.join(forms.hint("shuffle_hash"), "form").withColumn("listed", F.lit(True)))
    if hits.count() <= most:
        out = rows.join(F.broadcast(hits), "form", "left")
    else:
        every = cut(rows.groupBy("form").agg(F.count("*").alias("n")).join(hits, "form", "left"))
        out = joined_by_frequency(rows, every, "form", "n", most)
    given = out.select("_row", F.coalesce("listed", F.lit(False)).alias("listed"), host_of(F.col("_row")[url]).alias("host"), path_of(F.col("_row")[url]).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))
    return given.select(*[F.col("_row")[c].alias(c) for c in kept], "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))
