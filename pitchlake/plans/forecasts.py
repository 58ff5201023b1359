"""Queries on forecasts, shrunk rates, neighbours, outliers, growth timing and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.people import age_range, birth_relation, name_tokens, normal_name, token_containment
from ..operators import cohorts, evaluation, models, seasons
from ..session import cut
from ..streaming import jobs
from . import adapters as ad
from .growth import Z_SQL, cards, height_reference
from .league import last

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


R4 = lambda *cs: [F.round(c, 4).alias(c) for c in cs]
ORIGINS = ("1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01")
CASE_SQL = f"""{ad.READINGS}, o AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in ORIGINS)}]) AS origin),
seen AS (SELECT origin, player_id, max((measured_at, value)) AS l, count(*) AS n FROM readings JOIN o ON measured_at <= origin GROUP BY ALL HAVING count(*) >= 2),
cases AS (SELECT s.origin, s.player_id, r.sex, l[1] AS last_date, l[2] AS last, r.measured_at AS target_date, r.value AS target FROM seen s JOIN readings r USING (player_id) WHERE r.measured_at > s.origin AND r.measured_at - s.origin <= 365)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = spark.sql("SELECT explode(array({})) AS origin".format(", ".join(f"DATE'{d}'" for d in ORIGINS)))
    r = ad.readings(spark, sf_dir)
    c = models.walk_forward(r.select("player_id", "measured_at", "value"), origins, "player_id", "measured_at", "value")
    return c.join(ad.players(spark, sf_dir).select("player_id", "sex", "date_of_birth"), "player_id")


@query(f"WITH {CASE_SQL} SELECT origin, player_id, last_date, last, target_date, target FROM cases")
def m1b_walk_forward_cases(spark, sf_dir):
    return cases(spark, sf_dir).select("origin", "player_id", "last_date", "last", "target_date", "target")


H = "CASE WHEN target_date - origin <= 91 THEN '0-91' WHEN target_date - origin <= 182 THEN '92-182' ELSE '183-365' END"


@query(f"WITH {CASE_SQL} SELECT {H} AS band, sex, count(*) AS n, round(avg(abs(last - target)), 4) AS mae, round(avg(last - target), 4) AS bias FROM cases GROUP BY GROUPING SETS (({H}), (sex), ())")
def m1_last_value_forecast(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("band", models.horizon_band(F.datediff("target_date", "origin")))
    return evaluation.errors_by(c, "target", "last", ["band", "sex"]).select("band", "sex", "n", *R4("mae", "bias"))


@query(f"""WITH {CASE_SQL}, c AS (SELECT *, {H} AS band, round(target - last, 3) AS e FROM cases), oo AS (SELECT DISTINCT origin FROM c)
SELECT oo.origin, band, round(quantile_cont(e, 0.1), 4) AS low, round(quantile_cont(e, 0.9), 4) AS high, count(*) AS errors FROM c JOIN oo ON c.target_date <= oo.origin GROUP BY ALL HAVING count(*) >= 30""")
def m1c_error_bands(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("guess", F.col("last")).withColumn("band", models.horizon_band(F.datediff("target_date", "origin")))
    b = models.error_bands(c, ["band"])
    return b.select("origin", "band", *R4("low", "high"), F.col("errors").cast("long").alias("errors"))


@query()
def m1_cohort_velocity_forecast(spark, sf_dir):
    """The last value plus the cohort's growth up to the target, learnt before each origin.

    Tests hold it against a population that grows evenly.
    """
    c = cases(spark, sf_dir)
    r = ad.readings(spark, sf_dir)
    v = cohorts.spaced_velocities(r.select("player_id", "measured_at", "value"), "player_id", "measured_at", "value")
    p = ad.players(spark, sf_dir).select("player_id", "sex", "date_of_birth")
    v = v.join(p, "player_id").withColumn("at", F.bround(F.datediff(F.col("end"), "date_of_birth") / 365.25, 0))
    origins = c.select("origin").distinct()
    known = v.join(F.broadcast(origins), F.col("end") <= F.col("origin")).groupBy("origin", "sex", "at").agg(F.median("velocity").alias("growth"), F.count("*").alias("n")).where("n >= 5")
    j = c.withColumn("at", F.bround(F.datediff("target_date", "date_of_birth") / 365.25, 0)).join(known, ["origin", "sex", "at"], "left")
    guess = F.col("last") + F.greatest(F.coalesce("growth", F.lit(0.0)), F.lit(0.0)) * F.datediff("target_date", "last_date") / 365.25
    return j.withColumn("guess", guess).groupBy("sex").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("guess") - F.col("target"))), 4).alias("mae"))


@query(f"""WITH {Z_SQL}, a AS (SELECT player_id, arg_max(z, (measured_at, value)) FILTER (measured_at <= DATE '1998-01-01') AS before, arg_max(z, (measured_at, value)) FILTER (measured_at >= DATE '1998-01-01' + 365) AS after FROM z GROUP BY 1)
SELECT player_id, round(after - before, 4) + 0.0 AS change, after - before >= 0.5 AS caught_up FROM a WHERE before IS NOT NULL AND after IS NOT NULL""")
def w15_caught_up(spark, sf_dir):
    """Whose size against the age has risen by half a deviation a year and more after a day."""
    cutoff, d, at = F.lit("1998-01-01").cast("date"), F.col("measured_at"), F.struct("measured_at", "value")
    z = cohorts.z_scores(ad.readings(spark, sf_dir), height_reference(spark, sf_dir), ["sex"], "age", "value")
    a = z.groupBy("player_id").agg(F.max_by("z", F.when(d <= cutoff, at)).alias("b"), F.max_by("z", F.when(d >= F.date_add(cutoff, 365), at)).alias("a"))
    change = F.col("a") - F.col("b")
    return a.where("a is not null and b is not null").select("player_id", (F.round(change, 4) + 0.0).alias("change"), (change >= 0.5).alias("caught_up"))


NEAR_SQL = f"""{ad.SEASONS}, s AS (SELECT player_id, grp, sum(minutes) AS e, sum(goals) AS goals, sum(npxg) AS npxg, sum(passes) AS passes FROM seasons GROUP BY ALL HAVING sum(minutes) >= 450),
l AS (SELECT player_id, grp, ln(90.0 * goals / e + 0.05) AS goals, ln(90.0 * npxg / e + 0.05) AS npxg, ln(90.0 * passes / e + 0.05) AS passes FROM s),
v AS (SELECT player_id, grp, (goals - avg(goals) OVER w) / stddev_pop(goals) OVER w AS x, (npxg - avg(npxg) OVER w) / stddev_pop(npxg) OVER w AS y, (passes - avg(passes) OVER w) / stddev_pop(passes) OVER w AS z FROM l WINDOW w AS (PARTITION BY grp))"""


def vectors(spark, sf_dir):
    return seasons.profile_vectors(ad.seasons(spark, sf_dir), "player_id", ["grp"], "minutes", ["goals", "npxg", "passes"], 450)


@query(f"""WITH {NEAR_SQL}, d AS (SELECT a.grp, a.player_id, b.player_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM v a JOIN v b ON a.grp = b.grp AND a.player_id <> b.player_id)
SELECT player_id, other, round(distance, 4) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY distance, other) AS place FROM d) WHERE place <= 5""")
def m4_nearest_profiles(spark, sf_dir):
    n = models.nearest(vectors(spark, sf_dir), ["grp"], "player_id", ["goals", "npxg", "passes"], 5)
    return n.select("player_id", "other", F.round("distance", 4).alias("distance"), "place")


@query(f"""WITH {NEAR_SQL}, d AS (SELECT a.player_id, b.player_id AS other, (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z)) AS cosine FROM v a JOIN v b ON a.grp = b.grp AND a.player_id <> b.player_id)
SELECT player_id, other, round(cosine, 4) AS cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY round(cosine, 9) DESC, other) AS place FROM d) WHERE place <= 6""")
def m5_similar_style(spark, sf_dir):
    """The six of the most similar style, by the cosine."""
    v = vectors(spark, sf_dir)
    norm = F.sqrt(F.col("goals") * F.col("goals") + F.col("npxg") * F.col("npxg") + F.col("passes") * F.col("passes"))
    u = v.withColumn("_n", norm).withColumns({c: F.col(c) / F.col("_n") for c in ("goals", "npxg", "passes")}).drop("_n")
    n = models.nearest(u, ["grp"], "player_id", ["goals", "npxg", "passes"], 6, cosine=True)
    return n.select("player_id", "other", F.round(1 - F.col("distance"), 4).alias("cosine"), "place")


@query()
def m7_shrunk_rates(spark, sf_dir):
    """Goal rates drawn to their group's, with intervals; tests hold the fit against a known prior."""
    s = models.shrunk_rates(last(spark, sf_dir), ["grp"], "player_id", "goals", "shots")
    return s.select("grp", "player_id", *R4("raw", "estimate", "weight", "low", "high"), "next_low", "next_high")


@query()
def d16_finishing(spark, sf_dir):
    """Goals against the range that the chances explain."""
    s = ad.seasons(spark, sf_dir).groupBy("player_id").agg(F.sum("goals").alias("goals"), (F.sum("shots") * 0.33).alias("chances"))
    s = s.withColumn("r", models.poisson_range(F.col("chances")))
    return s.select("player_id", "goals", F.round("chances", 4).alias("chances"), "r.low", "r.high", models.finishing(F.col("goals"), F.col("r")).alias("verdict"))


@query()
def m10_isolation_forest(spark, sf_dir):
    """How odd each player's latest card is."""
    return models.isolation_scores(cards(spark, sf_dir).select("player_id", "value", "age", "n"), "player_id", ["value", "age", "n"]).withColumn("score", F.round("score", 6))


@query()
def m11_growth_timing(spark, sf_dir):
    """The shift of age at which each player's readings fit their sex's curve."""
    r = ad.readings(spark, sf_dir)
    points = models.curve(r, ["sex"], "age", "value", 1.0)
    some = r.join(r.groupBy("player_id").count().where("count >= 5"), "player_id")
    return models.timing_shift(some, points, "sex", "player_id", "age", "value").select("player_id", "shift", *R4("size", "loss"))


@query(r"""WITH n AS (SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, '  ' || upper(p_name) || chr(9) || 'ＡＢ ' || p_brand FROM part),
m AS (SELECT source, id, trim(regexp_replace(replace(lower(name), 'ａｂ', 'ab'), '\s+', ' ', 'g')) AS name FROM n) SELECT source, id, name, len(list_distinct(list_filter(string_split(name, ' '), lambda w: w <> ''))) AS tokens FROM m""")
def f1_normal_names(spark, sf_dir):
    """Normal forms and distinct words of all names of customers, suppliers and parts."""
    of = lambda table, source, key, name: ad.table(spark, sf_dir, table).select(F.lit(source).alias("source"), F.col(key).alias("id"), name.alias("name"))
    wide = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\tＡＢ "), F.col("p_brand"))
    n = of("customer", "customer", "c_custkey", F.col("c_name")).union(of("supplier", "supplier", "s_suppkey", F.col("s_name"))).union(of("part", "part", "p_partkey", wide))
    n = n.select("source", "id", normal_name(F.col("name")).alias("name"))
    return n.withColumn("tokens", F.size(name_tokens(F.col("name"))).cast("long"))


@query(f"""WITH {ad.RECORDS}, p AS (SELECT a.record_id AS a, a.record_id + 64 AS b, a.name AS na, b.name AS nb, a.date_of_birth AS da, b.date_of_birth AS db FROM records a JOIN records b ON b.record_id = a.record_id + 64)
SELECT a, b, round(len(list_intersect(string_split(na, ' '), string_split(nb, ' '))) * 1.0 / least(len(list_distinct(string_split(na, ' '))), len(list_distinct(string_split(nb, ' ')))), 4) AS containment,
    CASE WHEN da = db THEN 'exact' WHEN abs(da - db) <= 7 THEN 'near' WHEN year(da) = year(db) AND month(da) = day(db) AND day(da) = month(db) THEN 'transposed' ELSE 'none' END AS relation FROM p""")
def f2_f3_record_comparison(spark, sf_dir):
    r = ad.records(spark, sf_dir)
    b = r.select((F.col("record_id") - 64).alias("record_id"), F.col("record_id").alias("b"), F.col("name").alias("nb"), F.col("date_of_birth").alias("db"))
    j = r.join(b, "record_id")
    return j.select(F.col("record_id").alias("a"), "b", F.round(token_containment(name_tokens(F.col("name")), name_tokens(F.col("nb"))), 4).alias("containment"), birth_relation(F.col("date_of_birth"), F.col("db")).alias("relation"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'looking for u' || (12 + o_orderkey % 8) WHEN 1 THEN (10 + o_orderkey % 5) || ' to ' || (15 + o_orderkey % 5) WHEN 2 THEN 'over ' || (14 + o_orderkey % 4) ELSE 'any age' END AS q FROM orders)
SELECT id, CASE id % 4 WHEN 1 THEN CAST(10 + id % 5 AS INTEGER) WHEN 2 THEN CAST(15 + id % 4 AS INTEGER) END AS least, CASE id % 4 WHEN 0 THEN CAST(11 + id % 8 AS INTEGER) WHEN 1 THEN CAST(15 + id % 5 AS INTEGER) END AS most FROM t""")
def f8_age_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    q = F.when(k % 4 == 0, F.concat(F.lit("looking for u"), s(12 + k % 8))).when(k % 4 == 1, F.concat(s(10 + k % 5), F.lit(" to "), s(15 + k % 5))).when(k % 4 == 2, F.concat(F.lit("over "), s(14 + k % 4))).otherwise("any age")
    return ad.table(spark, sf_dir, "orders").select(k.alias("id"), age_range(q).alias("r")).select("id", "r.least", "r.most")


@query(f"""WITH {ad.TAGS} SELECT match_date AS match_day, player_id, outcome, count(*) AS n FROM tags GROUP BY ALL""")
def st1_live_tallies(spark, sf_dir):
    """The streaming tallies run over the events as they lie there, until none is left."""
    cut(spark.range(1))  # sets the shared folder where none is set
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    kind = ad.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("player_id"), F.when(F.col("value") < 10, "lost").when(F.col("value") < 50, "won").otherwise("shot").alias("outcome"))
    tallies = jobs.live_tallies(e, "ts", "30 days")
    writer = tallies.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
