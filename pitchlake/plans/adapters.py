"""The given tables in the shapes of the domain, for Spark and as SQL.

Players are customers, readings orders, season rows line items by supplier and year, matches
pairs of suppliers in an order, tags events, spells successive orders, records parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.people import age_years


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, full_name, sex, date_of_birth, nation, tier."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("full_name"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("sex"),
        F.date_add(F.lit("1979-01-01").cast("date"), (F.col("c_custkey") * 7919 % 4018).cast("int")).alias("date_of_birth"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("tier"),
    )


PLAYERS = """players AS (SELECT c_custkey AS player_id, c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    CAST(DATE '1979-01-01' + CAST(c_custkey * 7919 % 4018 AS INTEGER) AS DATE) AS date_of_birth, c_nationkey AS nation, c_mktsegment AS tier FROM customer)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reading_id, player_id, measured_at, value, and the player's sex, tier, nation, age."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    r = o.join(players(spark, sf_dir), F.col("o_custkey") == F.col("player_id"))
    day = F.col("o_orderdate").cast("date")
    age = age_years(day, F.col("date_of_birth"))
    value = F.floor((100 + (F.col("o_custkey") * 104729 % 300) / 10.0 + 4.0 * age + F.col("o_totalprice") / 100000) * 10) / 10.0
    return r.select(F.col("o_orderkey").alias("reading_id"), "player_id", day.alias("measured_at"), value.alias("value"), "sex", "tier", "nation", "date_of_birth", age.alias("age"), F.col("o_orderpriority").alias("source"))


READINGS = (
    PLAYERS
    + """,
raw_readings AS (SELECT o_orderkey AS reading_id, player_id, CAST(o_orderdate AS DATE) AS measured_at, sex, tier, nation, date_of_birth, o_orderpriority AS source, o_totalprice,
    date_diff('day', date_of_birth, CAST(o_orderdate AS DATE)) / 365.25 AS age FROM orders JOIN players ON o_custkey = player_id),
readings AS (SELECT * EXCLUDE (o_totalprice), floor((100 + (player_id * 104729 % 300) / 10.0 + 4.0 * age + o_totalprice / 100000) * 10) / 10.0 AS value FROM raw_readings)"""
)


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, year, minutes, shots, goals, npxg, xa, passes, club, competition, grp."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("club"), F.col("n_regionkey").alias("competition"))
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    r2 = lambda c: F.bround(F.sum(F.col(c).cast("decimal(12,2)")), 2).cast("double")
    g = li.groupBy(F.col("l_suppkey").alias("player_id"), F.year("l_shipdate").alias("year")).agg(
        (90 * F.count("*")).alias("minutes"),
        F.count("*").alias("shots"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("goals"),
        r2("l_discount").alias("npxg"),
        r2("l_tax").alias("xa"),
        r2("l_quantity").alias("passes"),
    )
    return g.join(s, "player_id").withColumn("grp", F.col("player_id") % 3)


SEASONS = """seasons AS (SELECT l_suppkey AS player_id, CAST(year(l_shipdate) AS INTEGER) AS year, 90 * count(*) AS minutes, count(*) AS shots, count(*) FILTER (l_returnflag = 'R') AS goals,
    CAST(sum(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) AS npxg, CAST(sum(CAST(l_tax AS DECIMAL(12,2))) AS DOUBLE) AS xa, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS passes,
    any_value(s_nationkey) AS club, any_value(n_regionkey) AS competition, l_suppkey % 3 AS grp
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_suppkey, year(l_shipdate))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match results: match_id, played, a, b (a < b), points_a, points_b; ties left out.

    Lines are dealt out by order once: their sums, both sides of the join and the orders' dates
    meet there, and so do later steps by match.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), "l_quantity")
    li = li.repartition("o").groupBy("o", "s").agg(F.sum("l_quantity").cast("long").alias("p"))
    x, y = li.select("o", F.col("s").alias("a"), F.col("p").alias("points_a")), li.select("o", F.col("s").alias("b"), F.col("p").alias("points_b"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderdate").cast("date").alias("played"))
    return x.join(y, "o").where("a < b and points_a <> points_b").join(o, "o").select(F.col("o").alias("match_id"), "played", "a", "b", "points_a", "points_b")


RESULTS = """lines AS (SELECT l_orderkey AS o, l_suppkey AS s, CAST(sum(l_quantity) AS BIGINT) AS p FROM lineitem GROUP BY ALL),
results AS (SELECT x.o AS match_id, CAST(o_orderdate AS DATE) AS played, x.s AS a, y.s AS b, x.p AS points_a, y.p AS points_b
    FROM lines x JOIN lines y ON x.o = y.o AND x.s < y.s AND x.p <> y.p JOIN orders ON o_orderkey = x.o)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a match as logged by each side: some altered (every 11th), some missing (every 7th)."""
    r = results(spark, sf_dir)
    key = F.col("match_id") + F.col("a") * 31 + F.col("b") * 17
    # both rows of a match come of its one row, so the results are worked out once and stay dealt out by match
    row = lambda *cs: F.struct(*[c.alias(n) for c, n in zip(cs, ("player_id", "opponent_id", "won", "lost", "verified"))])
    first = row(F.col("a"), F.col("b"), F.col("points_a"), F.col("points_b"), key % 5 == 0)
    second = F.when(key % 7 != 0, row(F.col("b"), F.col("a"), F.col("points_b") + (key % 11 == 0).cast("long"), F.col("points_a"), key % 3 == 0))
    return r.select("match_id", "played", F.explode(F.array_compact(F.array(first, second))).alias("side")).select("match_id", "played", "side.*")


SIDES = (
    RESULTS
    + """,
keyed AS (SELECT *, match_id + a * 31 + b * 17 AS k FROM results),
sides AS (SELECT match_id, played, a AS player_id, b AS opponent_id, points_a AS won, points_b AS lost, k % 5 = 0 AS verified FROM keyed
    UNION ALL SELECT match_id, played, b, a, points_b + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END, points_a, k % 3 = 0 FROM keyed WHERE k % 7 <> 0)"""
)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, player_id, match_date, event_type, outcome, detail, x, y, tagged."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("player_id"),
        F.col("ts").cast("date").alias("match_date"),
        "event_type",
        F.when(F.col("value") < 10, "lost").when(F.col("value") < 50, "won").otherwise("shot").alias("outcome"),
        (F.get_json_object("props", "$.k").cast("int") % 5).alias("detail"),
        F.col("value").alias("x"),
        (F.get_json_object("props", "$.k").cast("double")).alias("y"),
        (F.col("event_id") % 4 != 0).alias("tagged"),
    )


TAGS = """tags AS (SELECT event_id, user_id AS player_id, CAST(ts AS DATE) AS match_date, event_type, CASE WHEN value < 10 THEN 'lost' WHEN value < 50 THEN 'won' ELSE 'shot' END AS outcome,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS detail, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_id % 4 <> 0 AS tagged FROM events)"""


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spell_id, player_id, organization_id, start_date, end_date (some overlap the next), purpose, granted."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nxt = F.lead(F.col("o_orderdate").cast("date")).over(w)
    return o.select(
        F.col("o_orderkey").alias("spell_id"),
        F.col("o_custkey").alias("player_id"),
        (F.col("o_orderkey") % 40).alias("organization_id"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add(nxt, F.when(F.col("o_orderkey") % 9 == 0, 5).otherwise(-1)).alias("end_date"),
        F.substring_index("o_orderpriority", "-", 1).alias("purpose"),
        (F.col("o_orderstatus") != "P").alias("granted"),
    )


SPELLS = """spells AS (SELECT o_orderkey AS spell_id, o_custkey AS player_id, o_orderkey % 40 AS organization_id, CAST(o_orderdate AS DATE) AS start_date,
    CAST(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE -1 END AS DATE) AS end_date,
    split_part(o_orderpriority, '-', 1) AS purpose, o_orderstatus <> 'P' AS granted FROM orders)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, name, date_of_birth, sport, sex, source: registrations, some entered twice."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("record_id"),
        F.col("p_name").alias("name"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size") * 7).alias("date_of_birth"),
        F.col("p_type").alias("sport"),
        F.when(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 2 == 0, "M").otherwise("F").alias("sex"),
        F.concat(F.lit("source"), (F.col("p_partkey") % 3).cast("string")).alias("source"),
    )


RECORDS = r"""records AS (SELECT p_partkey AS record_id, p_name AS name, CAST(DATE '2000-01-01' + p_size * 7 AS DATE) AS date_of_birth, p_type AS sport,
    CASE WHEN CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) % 2 = 0 THEN 'M' ELSE 'F' END AS sex, 'source' || (p_partkey % 3) AS source FROM part)"""


#: Consonants and vowels of made-up names, and the letters that write them in Arabic (fixed values).
NAME_CONSONANTS, NAME_VOWELS = "bdfgkmnrstzl", "aiu"
NAME_ARABIC = "بدفجكمنرستزل"


def _made_word(number: Column) -> tuple[Column, Column]:
    """A name of three syllables in Latin letters and the same in Arabic ones, which leave out a."""
    latin, c, v = [], len(NAME_CONSONANTS), len(NAME_VOWELS)
    for k in range(3):
        at = F.floor(number / (c * v) ** k)
        latin += [F.substring(F.lit(NAME_CONSONANTS), (at % c + 1).cast("int"), F.lit(1)), F.substring(F.lit(NAME_VOWELS), (F.floor(at / c) % v + 1).cast("int"), F.lit(1))]
    word = F.concat(*latin[:-1], F.lit(""))
    return F.initcap(word), F.translate(word, NAME_CONSONANTS + "iua", NAME_ARABIC + "يو")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registered people; every fourth is entered twice, the second time in Arabic
    letters, without a date, at another club, or with day and month swapped.

    record_id, person_id (who it is), full_name, known_as, sex, sport, date_of_birth, nationality
    and clubs (arrays), source. Given names are few, family names many.
    """
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = lambda salt, many: F.pmod(k * salt + F.floor(k / 7), F.lit(many)) * 7919 + many
    words = [_made_word(number(salt, many)) for salt, many in ((13, 60), (104729, 300), (7907, 4000))]
    born = F.date_add(F.lit("2000-01-01").cast("date"), (k * 7919 % 4018).cast("int"))
    base = c.select(
        k.alias("person_id"), *[w[i].alias(f"{n}{i}") for n, w in zip(("given", "father", "family"), words) for i in (0, 1)], F.when(k % 2 == 0, "M").otherwise("F").alias("sex"), F.element_at(F.array(*map(F.lit, ("football", "handball", "judo"))), (k % 3 + 1).cast("int")).alias("sport"),
        born.alias("born"), F.col("c_nationkey").alias("nation"), (k * 31 % 200).alias("club"), F.explode(F.when(k % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    again, kind = F.col("copy") == 1, F.floor(F.col("person_id") / 4) % 5
    swapped = F.try_to_timestamp(F.date_format("born", "yyyy-dd-MM"), F.lit("yyyy-MM-dd")).cast("date")
    line = lambda i: F.concat_ws(" ", f"given{i}", f"father{i}", f"family{i}")
    return base.select(
        (F.col("person_id") * 2 + F.col("copy")).alias("record_id"), "person_id", F.when(again & (kind == 0), line(1)).otherwise(line(0)).alias("full_name"), F.when(F.col("person_id") % 9 == 0, F.col("given0")).alias("known_as"), "sex", "sport",
        F.when((again & (kind == 1)) | (F.col("person_id") % 10 == 3), None).when(again & (kind == 2), F.coalesce(swapped, F.date_add("born", 3))).otherwise(F.col("born")).alias("date_of_birth"),
        F.array(F.col("nation").cast("string")).alias("nationality"), F.when(F.col("person_id") % 6 != 1, F.array(F.when(again & (kind == 3), F.col("club") + 200).otherwise(F.col("club")))).alias("clubs"), F.when(again, "federation").otherwise("academy").alias("source"),
    )
