"""Reading exports, provider trees and spreadsheets; writing by source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import EVENT, LINEUP, SCHEMAS


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of an export: a JSON array in a file for each."""
    return {name: spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json") for name, schema in SCHEMAS.items()}


def write_tables(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table to a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def read_table_over_jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def write_pages(df: DataFrame, folder: str, by: str, key: str, payload: str | None = None, page: int = 1000) -> None:
    """Rows as a provider's JSON files: arrays of about ``page`` rows, a file each, in folders
    ``<by>=<value>``; with ``payload`` an object that holds the array under that name.

    Rows are dealt to a value's pages by a hash of ``key``, so no task holds more than a page.
    """
    pages = df.groupBy(by).agg(F.ceil(F.count("*") / page).alias("_pages"))
    j = df.join(pages, by).withColumn("_page", F.pmod(F.xxhash64(key), F.col("_pages")))
    rows = F.collect_list(F.struct(*[c for c in df.columns if c != by]))
    whole = F.to_json(F.struct(rows.alias(payload)) if payload else rows)
    j.groupBy(by, "_page").agg(whole.alias("value")).select(by, "value").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy(by).text(folder)


def read_event_tree(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Matches, lineups and events of a provider's tree, with the match id of a file's name or
    of its folder ``match_id=<id>``, as ``write_pages`` makes them.

    Multi-line JSON files aren't split; there are many of them, and the events are dealt by
    match afterwards, so later aggregations by match need no further shuffle.
    """
    path = F.col("_metadata.file_path")
    name = F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (r"match_id=(\d+)/[^/]+$", r"(\d+)\.json$")]).cast("long").alias("match_id")

    def read(part: str, schema: str) -> DataFrame:
        df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(f"{folder}/{part}")
        return df.select("*", name)

    matches = spark.read.option("multiLine", True).json(f"{folder}/matches/*")
    return {"matches": matches, "lineups": read("lineups", LINEUP), "events": read("events", EVENT).repartition("match_id")}


def read_provider_cache(spark: SparkSession, folder: str, parts: Sequence[str] = ("players", "matches", "teams"), paged: bool = False) -> dict[str, DataFrame]:
    """Rows under ``data`` of each season's files, for seasons that have all parts.

    A season is a folder ``season=<id>``; its part is a file ``<part>.json``, or a folder
    ``<part>/season=<id>`` of pages.
    """

    def read(part: str, paged: bool) -> DataFrame:
        df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(f"{folder}/{part}" if paged else f"{folder}/*/{part}.json")
        return df.select(F.explode("data").alias("row"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("season")).select("season", "row.*")

    tables = {p: read(p, paged) for p in parts}
    whole = None
    for df in tables.values():
        s = df.select("season").distinct()
        whole = s if whole is None else whole.join(s, "season", "left_semi")
    return {p: df.join(whole, "season", "left_semi") for p, df in tables.items()}


def header_name(name: str) -> str:
    """A column's name in one form: no byte order mark, lower case, underscores."""
    return "_".join(name.lstrip("﻿").strip().lower().replace("-", " ").split())


def read_people(spark: SparkSession, path: str, known: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """A spreadsheet of people: ';' or ',' by the header, names normalised, blank lines dropped.

    Unknown, missing and repeated columns are refused.
    """
    head = spark.read.text(path).limit(1).first()
    line = head[0].lstrip("﻿") if head else ""
    sep = ";" if line.count(";") > line.count(",") else ","
    df = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    names = [header_name(c) for c in line.split(sep)]
    if len(set(names)) < len(names):
        raise ValueError("a column is repeated")
    if unknown := set(names) - set(known):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    if missing := set(needed) - set(names):
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = df.toDF(*names)
    filled = F.lit(False)
    for n in names:
        filled = filled | (F.trim(F.coalesce(F.col(n), F.lit(""))) != "")
    return df.where(filled)


def import_verdict(row: Mapping[str, Column], born: str, guardian: str, reading: str, reading_date: str) -> Column:
    """ready, confirm or rejected, by the first thing that is wrong."""
    formula = F.lit(False)
    for c in row.values():
        formula = formula | F.coalesce(c.rlike(r"^[=+@\-][^0-9]"), F.lit(False))
    return (
        F.when(formula, "rejected")
        .when(row[born].isNotNull() & row[born].try_cast("date").isNull(), "rejected")
        .when(row[reading].isNotNull() & (F.regexp_replace(row[reading], ",", ".").try_cast("double").isNull() | row[reading_date].isNull()), "rejected")
        .when(row[guardian].isNotNull() & ~F.lower(row[guardian]).isin("yes", "no", "true", "false"), "confirm")
        .otherwise("ready")
    )


def replace_source(df: DataFrame, folder: str, source: str = "source") -> None:
    """Rows of the sources in ``df`` take the place of these sources' earlier ones; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(folder)


def resolve_external(rows: DataFrame, held: DataFrame, key: str, external: str) -> DataFrame:
    """``rows`` with ``id``: the held entity's of the same external id, else one made from it."""
    ids = held.select(F.col("external_ids")[external].alias(key), F.col("id").alias("_id")).where(F.col(key).isNotNull())
    new = F.substring(F.sha2(F.concat_ws("|", F.lit(external), F.col(key).cast("string")), 256), 1, 32)
    return rows.join(ids, key, "left").withColumn("id", F.coalesce("_id", new)).drop("_id")


def load_report(rows: DataFrame, reason: str) -> DataFrame:
    """Rows by reason; a null reason is 'loaded'."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("loaded")).alias("reason")).agg(F.count("*").alias("rows"))


def provider_season(df: DataFrame, needed: Sequence[str], minutes: str, position: str) -> DataFrame:
    """``df`` with unknown numbers (-1) as null and the ``reason`` to reject a player's season."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double")]
    out = df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in numbers})
    reason = F.when(F.lower(position) == "coach", "coach").when(F.col(minutes) == 0, "no minutes")
    for c in needed:
        reason = reason.when(F.col(c).isNull(), f"{c} missing")
    return out.withColumn("reason", reason)
