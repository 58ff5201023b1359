"""What the operators of this folder share: tables, words, row keys, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word is a longest run without ASCII white space (space, tab to carriage return).
WORD = r"[^ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    ``rows``: at most so many narrow ones; they go to as few files as they need.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(1 + rows // 100_000)).checkpoint(eager=True)


def lookup(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` (narrow rows) worked out and, if it has at most ``most`` rows, broadcast in joins.

    A larger one is joined by a shuffle.
    """
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def joined_by_frequency(rows: DataFrame, table: DataFrame, key: str, count: str, most: int = 200_000) -> DataFrame:
    """``rows`` (inner) joined with ``table``, which has each of their keys once and its ``count`` of rows.

    Keys that hold at least a ``most``-th of all rows are ``most`` at the most, so they are
    broadcast, whatever the table's size; the others join by a shuffle in which no key is hot.
    """
    total = int(table.agg(F.sum(count)).first()[0] or 0)
    least = -(-total // most)
    frequent = table.where(F.col(count) >= least).drop(count)
    found = rows.join(F.broadcast(frequent), key)
    if least <= 1:  # all of them: no more keys than rows
        return found
    others = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    return found.unionByName(others.join(table.where(F.col(count) < least).drop(count).hint("shuffle_hash"), key))


def text_of(col: str = "text") -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shard_count(docs: DataFrame, text: str = "text", mb: int = 8) -> int:
    """How many shards of about ``mb`` megabytes of text the table needs, at least 16."""
    total = docs.select(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    return max(16, -(-total // (mb << 20)))


RUN = 128  # matches that are added up one after the other


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a regex: structs (start, end, hit, value, before, after) in order.

    Code points, ``end`` exclusive; ``value`` is a group's text, ``before`` and ``after`` are up to 24 and 8
    characters around the match. The text is split once. The places come from the lengths of
    matches and of what stands between them, added up in runs of RUN matches and by runs, so
    the work grows with the text also where it holds very many matches.
    """
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values") if group else F.array().cast("array<string>").alias("values"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def paired(f: Column) -> Column:
        one = F.zip_with(f["hits"], f["values"], lambda h, v: F.struct(h.alias("hit"), v.alias("value"))) if group else F.transform(f["hits"], lambda h: F.struct(h.alias("hit"), h.alias("value")))
        two = F.zip_with(one, f["gaps"], lambda x, g: F.struct(x["hit"].alias("hit"), x["value"].alias("value"), F.length(g).alias("gap"), F.lower(F.substring(g, -24, 24)).alias("before")))
        three = F.zip_with(two, F.slice(f["gaps"], 2, F.size(f["gaps"])), lambda x, g: F.struct(x["hit"].alias("hit"), x["value"].alias("value"), x["gap"].alias("gap"), x["before"].alias("before"), F.substring(g, 1, 8).alias("after")))
        return F.filter(three, lambda x: x["hit"].isNotNull())

    width = lambda x: x["gap"] + F.length(x["hit"])
    item = "array<struct<hit:string,value:string,gap:int,before:string,after:string>>"
    span = "array<struct<start:int,end:int,hit:string,value:string,before:string,after:string>>"

    def of_run(run: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + width(x)
            one = F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(run["items"], F.struct(run["at"].alias("at"), F.array().cast(span).alias("out")), step, lambda acc: acc["out"])

    def runs(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(all_items) - 1, F.lit(RUN)), lambda i: F.slice(all_items, i + 1, RUN))
        step = lambda acc, part: F.struct((acc["at"] + F.aggregate(part, F.lit(0), lambda n, x: n + width(x))).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), part.alias("items")))).alias("out"))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,items:{item}>>").alias("out")), step, lambda acc: acc["out"])

    placed = once(once(found, paired), lambda x: F.when(F.size(x) > 0, F.flatten(F.transform(runs(x), of_run))).otherwise(F.array().cast(span)))
    return placed
