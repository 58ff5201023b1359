"""Queries on readings: references, growth, flags, percentiles, spells and consent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.people import age_label, age_years, calendar_age, is_minor
from ..operators import cohorts, flags, percentiles, temporal
from . import adapters as ad

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


HEIGHT_FLOOR = 0.5  # of the spread of heights within a cohort
REFERENCE_SQL = f"""{ad.READINGS},
bucket AS (SELECT sex, CAST(round_even(age, 0) AS INTEGER) AS age, value FROM readings),
own AS (SELECT DISTINCT sex, age FROM bucket),
near AS (SELECT sex, unnest([age - 1, age, age + 1]) AS age, value FROM bucket),
reference AS (SELECT sex, age, median(value) AS median, greatest(stddev_pop(value), {HEIGHT_FLOOR}) AS sd, count(*) AS members FROM near SEMI JOIN own USING (sex, age) GROUP BY sex, age HAVING count(*) >= 5)"""


def height_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_reference(ad.readings(spark, sf_dir), ["sex"], "age", "value", HEIGHT_FLOOR)


@query(f"WITH {REFERENCE_SQL} SELECT sex, age, round(median, 4) AS median, round(sd, 4) AS sd, members FROM reference")
def a1_cohort_reference(spark, sf_dir):
    return height_reference(spark, sf_dir).select("sex", "age", F.round("median", 4).alias("median"), F.round("sd", 4).alias("sd"), "members")


Z_SQL = f"""{REFERENCE_SQL},
z AS (SELECT r.*, (value - median) / sd AS z FROM readings r JOIN reference f ON r.sex = f.sex AND CAST(round_even(r.age, 0) AS INTEGER) = f.age),
zs AS (SELECT player_id, arg_max(z, (measured_at, value)) AS last_z, avg(z) AS mean_z, min(z) AS least_z, count(*) AS readings FROM z GROUP BY player_id)"""


def z_summary(spark, sf_dir):
    r = ad.readings(spark, sf_dir)
    return cohorts.z_summary(cohorts.z_scores(r, height_reference(spark, sf_dir), ["sex"], "age", "value"), "player_id", "measured_at", "value")


@query(f"WITH {Z_SQL} SELECT player_id, round(last_z, 4) AS last_z, round(mean_z, 4) AS mean_z, round(least_z, 4) AS least_z, readings FROM zs")
def a2_height_z(spark, sf_dir):
    return z_summary(spark, sf_dir).select("player_id", *[F.round(c, 4).alias(c) for c in ("last_z", "mean_z", "least_z")], "readings")


VELOCITY_SQL = """last_day AS (SELECT max(measured_at) AS ref FROM readings),
spans AS (SELECT player_id, min((measured_at, value)) AS a, max((measured_at, value)) AS b, count(*) AS n,
    min((measured_at, value)) FILTER (ref - measured_at <= 400) AS ra, max((measured_at, value)) FILTER (ref - measured_at <= 400) AS rb, count(*) FILTER (ref - measured_at <= 400) AS rn
    FROM readings, last_day GROUP BY player_id),
growth AS (SELECT player_id, CASE WHEN n < 2 OR b[1] - a[1] < 60 THEN 0.0 ELSE (b[2] - a[2]) / ((b[1] - a[1]) / 365.25) END AS velocity,
    CASE WHEN rn < 2 OR rb[1] - ra[1] < 60 THEN 0.0 ELSE (rb[2] - ra[2]) / ((rb[1] - ra[1]) / 365.25) END AS recent_velocity FROM spans)"""


def reference_date(r: DataFrame):
    return F.lit(r.agg(F.max("measured_at")).first()[0])


def growth_rates(spark, sf_dir):
    r = ad.readings(spark, sf_dir)
    return cohorts.growth(r, "player_id", "measured_at", "value", reference_date(r))


@query(f"WITH {ad.READINGS}, {VELOCITY_SQL} SELECT player_id, round(velocity, 4) AS velocity, round(recent_velocity, 4) AS recent_velocity FROM growth")
def w1_growth_velocity(spark, sf_dir):
    return growth_rates(spark, sf_dir).select("player_id", F.round("velocity", 4).alias("velocity"), F.round("recent_velocity", 4).alias("recent_velocity"))


FEATURES_SQL = f"""{Z_SQL}, {VELOCITY_SQL},
features AS (SELECT p.player_id, p.sex, date_diff('day', p.date_of_birth, ref) / 365.25 AS age, last_z, mean_z, readings, velocity, recent_velocity FROM players p JOIN zs USING (player_id) JOIN growth USING (player_id), last_day)"""


def features(spark, sf_dir):
    p, r = ad.players(spark, sf_dir), ad.readings(spark, sf_dir)
    on = reference_date(r)
    return p.select("player_id", "sex", age_years(on, F.col("date_of_birth")).alias("age")).join(z_summary(spark, sf_dir), "player_id").join(cohorts.growth(r, "player_id", "measured_at", "value", on), "player_id")


BLOOMER_SQL = f"{FEATURES_SQL}, bloomers AS (SELECT * FROM features WHERE age BETWEEN 11 AND 18.5 AND readings >= 3 AND mean_z <= -0.9 AND recent_velocity >= 3.0)"


@query(f"""WITH {BLOOMER_SQL} SELECT player_id, 'late_bloomer' AS type, round(mean_z, 4) AS mean_z, round(recent_velocity, 4) AS recent_velocity,
    left(sha256(player_id || '|late_bloomer|' || readings), 32) AS dedupe_key, 'mean z ' || round(mean_z, 2) || ', readings ' || readings AS reason FROM bloomers""")
def d1_late_bloomers(spark, sf_dir):
    """The slice from readings to flags with their keys."""
    f = cohorts.late_bloomers(features(spark, sf_dir))
    return f.select("player_id", F.lit("late_bloomer").alias("type"), F.round("mean_z", 4).alias("mean_z"), F.round("recent_velocity", 4).alias("recent_velocity"), flags.dedupe_key(F.col("player_id"), F.lit("late_bloomer"), F.col("readings")).alias("dedupe_key"), F.concat(F.lit("mean z "), F.round("mean_z", 2).cast("string"), F.lit(", readings "), F.col("readings").cast("string")).alias("reason"))


MISMATCH_SQL = f"""{FEATURES_SQL},
vref AS (SELECT sex, age_b, median(recent_velocity) AS m, greatest(stddev_pop(recent_velocity), 0.2) AS s FROM (SELECT sex, unnest([CAST(round_even(age, 0) AS INTEGER) - 1, CAST(round_even(age, 0) AS INTEGER), CAST(round_even(age, 0) AS INTEGER) + 1]) AS age_b, recent_velocity FROM features WHERE recent_velocity <> 0)
    SEMI JOIN (SELECT DISTINCT sex, CAST(round_even(age, 0) AS INTEGER) AS age_b FROM features WHERE recent_velocity <> 0) USING (sex, age_b) GROUP BY ALL HAVING count(*) >= 5),
mismatch AS (SELECT f.player_id, mean_z, CASE WHEN recent_velocity <> 0 THEN (recent_velocity - m) / s END AS velocity_z FROM features f LEFT JOIN vref v ON f.sex = v.sex AND CAST(round_even(f.age, 0) AS INTEGER) = age_b)"""


def mismatches(spark, sf_dir):
    f = features(spark, sf_dir)
    moving = f.where("recent_velocity <> 0")
    ref = cohorts.cohort_reference(moving, ["sex"], "age", "recent_velocity", 0.2)
    z = cohorts.z_scores(moving, ref, ["sex"], "age", "recent_velocity").select("player_id", F.col("z").alias("velocity_z"))
    return f.select("player_id", "mean_z").join(z, "player_id", "left")


@query(f"WITH {MISMATCH_SQL} SELECT player_id, round(mean_z - velocity_z, 4) AS mismatch FROM mismatch")
def d2_maturity_mismatch(spark, sf_dir):
    return mismatches(spark, sf_dir).select("player_id", F.round(cohorts.maturity_mismatch(F.col("mean_z"), F.col("velocity_z")), 4).alias("mismatch"))


OUTPUT_SQL = """sums AS (SELECT o_custkey AS player_id, count(*) AS e, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS waiting FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 <> 0 GROUP BY 1),
outs AS (SELECT player_id, sex, tier, e, m[1] AS metric, m[2] AS n, m[3] AS sign, m[2] * 1.0 / e AS rate FROM (SELECT s.*, sex, tier, unnest([('returned', returned, 1.0), ('waiting', waiting, -1.0)]) AS m FROM sums s JOIN players USING (player_id))),
n1 AS (SELECT sex, tier, metric, median(rate) AS m1, count(*) AS k1 FROM outs GROUP BY ALL), n2 AS (SELECT sex, metric, median(rate) AS m2, count(*) AS k2 FROM outs GROUP BY ALL),
output AS (SELECT player_id, avg(sign * ln((n + 0.5) / (CASE WHEN k1 >= 5 THEN m1 WHEN k2 >= 5 THEN m2 END * e + 0.5))) AS output FROM outs JOIN n1 USING (sex, tier, metric) JOIN n2 USING (sex, metric) GROUP BY 1)"""


def output_indices(spark, sf_dir):
    """Each player's output from the lines of their orders; a seventh of the players have none."""
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("player_id")).where("player_id % 7 <> 0")
    li = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(1).alias("lines"), (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_linestatus") == "O").cast("int").alias("waiting"))
    rows = li.join(o, "l_orderkey").join(ad.players(spark, sf_dir).select("player_id", "sex", "tier"), "player_id")
    return cohorts.output_index(rows, "player_id", ["sex", "tier"], ["sex"], ["returned", "waiting"], "lines", ["waiting"])


@query(f"WITH {ad.PLAYERS}, {OUTPUT_SQL} SELECT player_id, round(output, 4) + 0.0 AS output FROM output")
def a3_output_index(spark, sf_dir):
    return output_indices(spark, sf_dir).select("player_id", (F.round("output", 4) + 0.0).alias("output"))


@query(f"""WITH {MISMATCH_SQL}, {OUTPUT_SQL}, aged AS (SELECT f.player_id, sex, CAST(round_even(age, 0) AS INTEGER) AS age_o, output FROM features f JOIN output USING (player_id)),
oref AS (SELECT sex, age_o, median(output) AS m, greatest(stddev_pop(output), 0.05) AS s FROM (SELECT sex, unnest([age_o - 1, age_o, age_o + 1]) AS age_o, output FROM aged) SEMI JOIN (SELECT DISTINCT sex, age_o FROM aged) USING (sex, age_o) GROUP BY ALL HAVING count(*) >= 5),
o AS (SELECT x.player_id, mean_z, velocity_z, (output - m) / s AS output_z FROM mismatch x LEFT JOIN aged a ON a.player_id = x.player_id LEFT JOIN oref r ON r.sex = a.sex AND r.age_o = a.age_o),
g AS (SELECT *, coalesce(mean_z - velocity_z >= 1.8, false) OR (velocity_z IS NULL AND mean_z >= 1.8) AS led FROM o)
SELECT player_id, CASE WHEN led AND output_z >= 0.5 THEN 'growth and output' WHEN output_z >= 1.25 AND mean_z >= 1.0 THEN 'output and height' WHEN led AND output_z IS NULL THEN 'growth alone' END AS rule FROM g""")
def d3_age_misrepresentation(spark, sf_dir):
    """Growth against age together with output against age, both among the same sex."""
    aged = features(spark, sf_dir).select("player_id", "sex", "age").join(output_indices(spark, sf_dir), "player_id")
    ref = cohorts.cohort_reference(aged, ["sex"], "age", "output", 0.05)
    z = cohorts.z_scores(aged, ref, ["sex"], "age", "output").select("player_id", F.col("z").alias("output_z"))
    m = mismatches(spark, sf_dir).join(z, "player_id", "left")
    return m.select("player_id", cohorts.age_misrepresentation(F.col("mean_z"), F.col("velocity_z"), F.col("output_z")).alias("rule"))


@query(f"""WITH RECURSIVE {ad.READINGS}, s AS (SELECT player_id, measured_at, value, row_number() OVER (PARTITION BY player_id ORDER BY measured_at, value) AS i FROM readings),
walk AS (SELECT player_id, i, measured_at AS d, value AS v, CAST(NULL AS DATE) AS start, CAST(NULL AS DOUBLE) AS velocity, measured_at AS seen FROM s WHERE i = 1
    UNION ALL SELECT s.player_id, s.i, CASE WHEN s.measured_at - w.d >= 150 THEN s.measured_at ELSE w.d END, CASE WHEN s.measured_at - w.d >= 150 THEN s.value ELSE w.v END,
        CASE WHEN s.measured_at - w.d >= 150 THEN w.d END, CASE WHEN s.measured_at - w.d >= 150 THEN (s.value - w.v) / ((s.measured_at - w.d) / 365.25) END, s.measured_at FROM walk w JOIN s ON s.player_id = w.player_id AND s.i = w.i + 1)
SELECT player_id, start, seen AS "end", round(velocity, 4) AS velocity FROM walk WHERE start IS NOT NULL""")
def w2_spaced_velocities(spark, sf_dir):
    return cohorts.spaced_velocities(ad.readings(spark, sf_dir), "player_id", "measured_at", "value").withColumn("velocity", F.round("velocity", 4))


@query(f"""WITH {ad.READINGS}, l AS (SELECT player_id, max((measured_at, value)) AS last FROM readings GROUP BY 1),
f AS (SELECT r.player_id, any_value(last) AS last, max((measured_at, value)) AS first FROM readings r JOIN l USING (player_id) WHERE last[1] - measured_at >= 150 GROUP BY 1)
SELECT player_id, round((last[2] - first[2]) / ((last[1] - first[1]) / 365.25), 4) AS own_velocity FROM f""")
def w3_own_velocity(spark, sf_dir):
    return cohorts.own_velocity(ad.readings(spark, sf_dir), "player_id", "measured_at", "value").withColumn("own_velocity", F.round("own_velocity", 4))


LATEST_SQL = f"""{ad.READINGS}, latest AS (SELECT player_id, any_value(sex) AS sex, any_value(tier) AS tier, any_value(nation) AS nation, any_value(date_of_birth) AS date_of_birth,
    arg_max(age, (measured_at, value)) AS age, max((measured_at, value)) AS m, count(*) AS n FROM readings GROUP BY player_id),
cards AS (SELECT player_id, sex, tier, nation, date_of_birth, CAST(floor(age) AS INTEGER) AS age, m[1] AS measured_at, m[2] AS value, n FROM latest)"""


def cards(spark, sf_dir):
    """Each player's latest reading."""
    g = ad.readings(spark, sf_dir).groupBy("player_id").agg(*[F.first(c).alias(c) for c in ("sex", "tier", "nation", "date_of_birth")], F.max_by("age", F.struct("measured_at", "value")).alias("age"), F.max(F.struct("measured_at", "value")).alias("m"), F.count("*").alias("n"))
    return g.select("player_id", "sex", "tier", "nation", "date_of_birth", F.floor("age").cast("int").alias("age"), "m.measured_at", "m.value", "n")


@query(f"""WITH {LATEST_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY sex, age) AS n0, rank() OVER (PARTITION BY sex, age ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY sex, age, value) AS eq FROM cards)
SELECT player_id, greatest(1, least(99, CAST(round_even(100.0 * (below + eq / 2.0) / n0, 0) AS INTEGER))) AS percentile, n0 AS percentile_of FROM c""")
def w4_midrank_percentile(spark, sf_dir):
    return percentiles.midrank(cards(spark, sf_dir), ["sex", "age"], "value").select("player_id", "percentile", F.col("percentile_of").cast("long").alias("percentile_of"))


@query(f"""WITH {LATEST_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY tier) AS n0, rank() OVER (PARTITION BY tier ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY tier, value) AS eq FROM cards)
SELECT player_id, CASE WHEN n0 > 1 THEN greatest(1, least(99, CAST(round_even(100.0 * (below + (eq - 1) / 2.0) / (n0 - 1), 0) AS INTEGER))) END AS percentile FROM c""")
def w4_percentile_of_others(spark, sf_dir):
    return percentiles.midrank(cards(spark, sf_dir), ["tier"], "value", include_self=False).select("player_id", "percentile")


@query(f"""WITH {LATEST_SQL}, n AS (SELECT sex, age, count(*) AS n0 FROM cards GROUP BY ALL),
b AS (SELECT a.sex, a.age, CASE WHEN a.n0 >= 8 THEN 0 WHEN sum(o.n0) >= 8 THEN 1 END AS span FROM n a JOIN n o ON a.sex = o.sex AND abs(a.age - o.age) <= 1 GROUP BY a.sex, a.age, a.n0)
SELECT c.player_id, b.span, CASE WHEN b.span IS NOT NULL THEN greatest(1, least(99, CAST(round_even(100.0 * (count(*) FILTER (o.value < c.value) + count(*) FILTER (o.value = c.value) / 2.0) / count(*), 0) AS INTEGER))) END AS percentile
FROM cards c JOIN b USING (sex, age) JOIN cards o ON o.sex = c.sex AND abs(o.age - c.age) <= coalesce(b.span, 0) GROUP BY c.player_id, b.span""")
def w5_cohort_percentile(spark, sf_dir):
    return percentiles.cohort_percentile(cards(spark, sf_dir), ["sex"], "age", "value").select("player_id", "span", "percentile")


@query(f"""WITH {LATEST_SQL}, n AS (SELECT tier, sex, age, count(*) AS n0 FROM cards GROUP BY ALL),
s AS (SELECT a.tier, a.sex, a.age, sum(o.n0) FILTER (o.age = a.age) AS s0, sum(o.n0) FILTER (abs(o.age - a.age) <= 1) AS s1, sum(o.n0) FILTER (abs(o.age - a.age) <= 2) AS s2 FROM n a JOIN n o ON a.tier = o.tier AND a.sex = o.sex GROUP BY ALL)
SELECT tier, sex, age, CASE WHEN s0 >= 8 THEN 0 WHEN s1 >= 8 THEN 1 WHEN s2 >= 8 THEN 2 END AS spread, CAST(CASE WHEN s0 >= 8 THEN s0 WHEN s1 >= 8 THEN s1 WHEN s2 >= 8 THEN s2 END AS BIGINT) AS peers FROM s""")
def w6_widened_bands(spark, sf_dir):
    return percentiles.widened(cards(spark, sf_dir), ["tier", "sex"], "age")


@query(f"""WITH {LATEST_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY sex, age) AS n0, rank() OVER (PARTITION BY sex, age ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY sex, age, value) AS eq,
    row_number() OVER (PARTITION BY sex, age ORDER BY value DESC, player_id) AS rank, median(value) OVER (PARTITION BY sex, age) AS median FROM cards)
SELECT sex, age, player_id, rank, round(median, 4) AS median, greatest(1, least(99, CAST(round_even(100.0 * (below + eq / 2.0) / n0, 0) AS INTEGER))) AS percentile FROM c WHERE rank <= 5""")
def w7_leaderboard(spark, sf_dir):
    return percentiles.leaders(cards(spark, sf_dir), ["sex", "age"], "value", "player_id").select("sex", "age", "player_id", "rank", F.round("median", 4).alias("median"), "percentile")


@query(f"""WITH {LATEST_SQL} SELECT player_id, value, n, CASE WHEN count(*) OVER (PARTITION BY tier, sex) >= 8 THEN round(median(value) OVER (PARTITION BY tier, sex), 4) END AS group_median FROM cards""")
def w8_scatter_medians(spark, sf_dir):
    c = cards(spark, sf_dir)
    m = c.groupBy("tier", "sex").agg(F.median("value").alias("m"), F.count("*").alias("k"))
    return c.join(m, ["tier", "sex"]).select("player_id", "value", "n", F.when(F.col("k") >= 8, F.round("m", 4)).alias("group_median"))


@query(f"""WITH {LATEST_SQL}, l AS (SELECT tier, list_sort(list(value)) AS v, count(*) AS n FROM cards GROUP BY tier)
SELECT tier, n, round(list_median(v[1:greatest(1, n // 2)]), 4) AS p25, round(list_median(v), 4) AS p50, round(list_median(v[n - greatest(1, n // 2) + 1:]), 4) AS p75 FROM l""")
def a19_half_quantiles(spark, sf_dir):
    q = percentiles.half_quantiles(cards(spark, sf_dir), ["tier"], "value")
    return q.select("tier", "n", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


@query(f"""WITH {LATEST_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY sex, age) AS n0, rank() OVER (PARTITION BY sex, age ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY sex, age, value) AS eq FROM cards)
SELECT player_id FROM c WHERE greatest(1, least(99, CAST(round_even(100.0 * (below + eq / 2.0) / n0, 0) AS INTEGER))) >= 75""")
def w17_top_quarter(spark, sf_dir):
    return percentiles.quarter_filter(cards(spark, sf_dir), ["sex", "age"], "value").select("player_id")


@query(f"""WITH {LATEST_SQL}, c AS (SELECT player_id, sex, count(*) OVER (PARTITION BY sex) AS n0, row_number() OVER (PARTITION BY sex ORDER BY value, player_id) AS r FROM cards)
SELECT player_id, sex FROM c WHERE n0 >= 4 AND r <= greatest(1, floor(n0 * 0.25))""")
def w14_shortest_quarter(spark, sf_dir):
    return cohorts.shortest_quarter(cards(spark, sf_dir), ["sex"], "value", "player_id").select("player_id", "sex")


@query(f"""WITH {LATEST_SQL} SELECT player_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 4) AS z FROM cards WINDOW w AS (PARTITION BY sex, year(date_of_birth))""")
def w18_birth_year_z(spark, sf_dir):
    return cohorts.birth_year_z(cards(spark, sf_dir), ["sex"], "date_of_birth", "value").select("player_id", F.round("z", 4).alias("z"))


@query(f"""WITH {LATEST_SQL}, d AS (SELECT max(measured_at) AS ref FROM readings)
SELECT player_id, measured_at, value, CAST(ref - measured_at AS INTEGER) AS days_since, CAST(greatest(0, 3 - n) AS BIGINT) AS readings_needed, CAST(age AS VARCHAR) || 'y' AS age_text FROM cards, d""")
def a18_latest_values(spark, sf_dir):
    c = cards(spark, sf_dir)
    on = reference_date(ad.readings(spark, sf_dir))
    return c.select("player_id", "measured_at", "value", F.datediff(on, "measured_at").alias("days_since"), F.greatest(F.lit(0).cast("long"), 3 - F.col("n")).alias("readings_needed"), F.concat(F.col("age").cast("string"), F.lit("y")).alias("age_text"))


@query(f"""WITH {LATEST_SQL}, d AS (SELECT max(measured_at) AS ref FROM readings),
a AS (SELECT player_id, date_of_birth, ref, date_diff('day', date_of_birth, ref) / 365.25 AS years, CAST(date_part('year', age(ref, date_of_birth)) AS INTEGER) AS whole FROM cards, d)
SELECT player_id, whole AS calendar_age, whole < 18 AS minor, CAST(floor(floor(years * 12) / 12) AS INTEGER) || 'y ' || CAST(CAST(floor(years * 12) AS BIGINT) % 12 AS INTEGER) || 'm' AS label FROM a""")
def f7_ages(spark, sf_dir):
    c = cards(spark, sf_dir)
    on = reference_date(ad.readings(spark, sf_dir))
    born = F.col("date_of_birth")
    return c.select("player_id", calendar_age(on, born).alias("calendar_age"), is_minor(on, born).alias("minor"), age_label(age_years(on, born)).alias("label"))


@query(f"""WITH {ad.READINGS}, p AS (SELECT *, lag(measured_at) OVER w AS pd, lag(value) OVER w AS pv FROM readings WINDOW w AS (PARTITION BY player_id ORDER BY measured_at, reading_id))
SELECT reading_id, concat_ws(',', CASE WHEN NOT value BETWEEN 110 AND 210 THEN 'unusual' END, CASE WHEN value - pv < -1.5 THEN 'drop' END, CASE WHEN (value - pv) / greatest((measured_at - pd) / 30.44, 1.0) > 2.5 THEN 'fast gain' END) AS warnings FROM p""")
def p10_plausibility(spark, sf_dir):
    r = temporal.previous_reading(ad.readings(spark, sf_dir), ["player_id"], "measured_at", "reading_id", "value")
    return temporal.plausibility(r, "measured_at", "value", 110, 210).select("reading_id", F.concat_ws(",", "warnings").alias("warnings"))


@query(f"""WITH {ad.READINGS} SELECT reading_id, CAST(count(*) OVER (PARTITION BY player_id, measured_at) AS BIGINT) AS on_visit, concat_ws(',', CASE WHEN value < 100 OR value > 230 THEN 'impossible' END, CASE WHEN count(*) OVER (PARTITION BY player_id, measured_at) > 1 THEN 'repeated' END) AS reasons FROM readings""")
def p9_measurement_checks(spark, sf_dir):
    from ..operators import rules

    return rules.check_measurements(ad.readings(spark, sf_dir), "player_id", "measured_at", "value", 100, 230).select("reading_id", "on_visit", F.concat_ws(",", "reasons").alias("reasons"))


ON = "1999-06-30"


@query(f"""WITH {ad.PLAYERS}, {ad.SPELLS} SELECT player_id FROM players SEMI JOIN (SELECT player_id FROM spells WHERE granted AND purpose = '1' AND start_date <= DATE '{ON}' AND (end_date IS NULL OR end_date >= DATE '{ON}')) USING (player_id)""")
def j1_consent_in_effect(spark, sf_dir):
    c = ad.spells(spark, sf_dir).withColumnsRenamed({"start_date": "valid_from", "end_date": "valid_until"})
    return temporal.consented(ad.players(spark, sf_dir), c, F.lit(ON).cast("date"), "player_id", "1").select("player_id")


@query(f"""WITH {ad.SPELLS}, s AS (SELECT player_id, coalesce(bool_or(granted AND purpose = '1'), false) AS storage, coalesce(bool_or(granted AND purpose = '2'), false) AS analytics FROM spells WHERE start_date <= DATE '{ON}' AND (end_date IS NULL OR end_date >= DATE '{ON}') GROUP BY 1)
SELECT player_id, storage, analytics, storage AND analytics AS complete FROM s""")
def j2_consent_state(spark, sf_dir):
    c = ad.spells(spark, sf_dir).withColumnsRenamed({"start_date": "valid_from", "end_date": "valid_until"}).withColumn("purpose", F.when(F.col("purpose") == "1", "storage").when(F.col("purpose") == "2", "analytics").otherwise("other"))
    return temporal.consent_state(c, F.lit(ON).cast("date"), ["storage", "analytics"], ["storage", "analytics"])


@query(f"""WITH {ad.SPELLS} SELECT player_id, spell_id, organization_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY start_date DESC, spell_id) AS r FROM spells WHERE end_date IS NULL) WHERE r = 1""")
def j4_current_organization(spark, sf_dir):
    return temporal.current_spell(ad.spells(spark, sf_dir), "player_id", "start_date", "end_date", "spell_id").select("player_id", "spell_id", "organization_id")


@query(f"""WITH {ad.READINGS}, {ad.SPELLS}, j AS (SELECT r.reading_id, s.spell_id, row_number() OVER (PARTITION BY r.reading_id ORDER BY s.start_date DESC NULLS LAST, s.spell_id) AS k FROM readings r LEFT JOIN spells s ON r.player_id = s.player_id AND s.start_date <= r.measured_at - 30 AND (s.end_date IS NULL OR s.end_date >= r.measured_at - 30))
SELECT reading_id, spell_id FROM j WHERE k = 1""")
def j5_spell_on_date(spark, sf_dir):
    r = ad.readings(spark, sf_dir).select("reading_id", "player_id", F.date_sub("measured_at", 30).alias("on"))
    s = ad.spells(spark, sf_dir).select("player_id", "spell_id", "start_date", "end_date")
    return temporal.spell_on(r, s, "player_id", "on", "start_date", "end_date", "spell_id", "reading_id").select("reading_id", "spell_id")


@query(f"""WITH {ad.READINGS}, c AS (SELECT unnest([DATE '1997-01-01', DATE '1999-01-01', DATE '2001-01-01']) AS cutoff)
SELECT cutoff, player_id, count(*) AS readings, max(measured_at) AS last_seen FROM readings JOIN c ON measured_at <= cutoff GROUP BY ALL""")
def j7_as_of_cutoffs(spark, sf_dir):
    cutoffs = spark.sql("SELECT explode(array(DATE'1997-01-01', DATE'1999-01-01', DATE'2001-01-01')) AS cutoff")
    return temporal.as_of(ad.readings(spark, sf_dir), cutoffs, "measured_at").groupBy("cutoff", "player_id").agg(F.count("*").alias("readings"), F.max("measured_at").alias("last_seen"))


@query(f"""WITH {ad.SPELLS}, n AS (SELECT *, lead(start_date) OVER (PARTITION BY player_id ORDER BY start_date, spell_id) AS next_start FROM spells)
SELECT spell_id, end_date, next_start FROM n WHERE next_start IS NOT NULL AND (end_date IS NULL OR end_date >= next_start)""")
def p18_overlapping_spells(spark, sf_dir):
    return temporal.overlapping_spells(ad.spells(spark, sf_dir), ["player_id"], "start_date", "end_date", "spell_id").select("spell_id", "end_date", "next_start")


@query(f"""WITH {LATEST_SQL} SELECT CAST(n_nationkey AS INTEGER) AS nation, count(c.player_id) AS players FROM nation LEFT JOIN cards c ON n_nationkey = c.nation AND c.n >= 15 GROUP BY 1""")
def j14_every_region(spark, sf_dir):
    """Every nation with its well-measured players, those without any included."""
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return n.join(cards(spark, sf_dir).where("n >= 15").groupBy("nation").agg(F.count("*").alias("players")), "nation", "left").fillna(0, ["players"])


@query(f"""WITH {LATEST_SQL}, d AS (SELECT max(measured_at) AS ref FROM readings), {ad.SPELLS},
o AS (SELECT player_id, organization_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY start_date DESC, spell_id) AS r FROM spells WHERE end_date IS NULL) WHERE r = 1),
m AS (SELECT organization_id, CAST(ref - measured_at AS INTEGER) AS stale, age FROM cards JOIN o USING (player_id), d)
SELECT organization_id, count(*) AS players, count(*) FILTER (age < 18) AS youth, min(stale) AS least_stale, round(median(stale), 4) AS median_stale FROM m GROUP BY 1""")
def a17_organization_coverage(spark, sf_dir):
    o = temporal.current_spell(ad.spells(spark, sf_dir), "player_id", "start_date", "end_date", "spell_id").select("player_id", "organization_id")
    on = reference_date(ad.readings(spark, sf_dir))
    m = cards(spark, sf_dir).join(o, "player_id").withColumn("stale", F.datediff(on, "measured_at"))
    return m.groupBy("organization_id").agg(F.count("*").alias("players"), F.count(F.when(F.col("age") < 18, 1)).alias("youth"), F.min("stale").alias("least_stale"), F.round(F.median("stale"), 4).alias("median_stale"))


@query(f"""WITH {LATEST_SQL}, d AS (SELECT max(measured_at) AS ref FROM readings)
SELECT age, tier, count(*) AS tracked, count(*) FILTER (age < 18 AND ref - measured_at > 180) AS stale_minors FROM cards, d GROUP BY ALL""")
def a15_oversight(spark, sf_dir):
    on = reference_date(ad.readings(spark, sf_dir))
    return cards(spark, sf_dir).groupBy("age", "tier").agg(F.count("*").alias("tracked"), F.count(F.when((F.col("age") < 18) & (F.datediff(on, "measured_at") > 180), 1)).alias("stale_minors"))


@query(f"""WITH {LATEST_SQL} SELECT nation, approx AS players FROM (SELECT nation, count(DISTINCT player_id) AS approx FROM cards GROUP BY 1)""")
def a16_players_by_region(spark, sf_dir):
    return cards(spark, sf_dir).groupBy("nation").agg(F.countDistinct("player_id").alias("players"))


@query(f"""WITH {LATEST_SQL}, d AS (SELECT max(measured_at) AS ref FROM readings), r AS (SELECT player_id, tier, row_number() OVER (PARTITION BY tier ORDER BY measured_at, player_id) AS place FROM cards, d WHERE ref - measured_at >= 21)
SELECT player_id, tier, place FROM r WHERE place <= 10""")
def t5_measuring_order(spark, sf_dir):
    """Whom to measure next in each squad: the longest since last, 21 days at least."""
    on = reference_date(ad.readings(spark, sf_dir))
    w = Window.partitionBy("tier").orderBy(F.col("measured_at").asc_nulls_first(), "player_id")
    return cards(spark, sf_dir).where(F.datediff(on, "measured_at") >= 21).withColumn("place", F.row_number().over(w)).where("place <= 10").select("player_id", "tier", "place")


@query(f"""WITH {LATEST_SQL} SELECT player_id, CASE WHEN age < 18 AND player_id % 3 <> 0 THEN NULL ELSE value END AS value, CASE WHEN age < 18 AND player_id % 3 <> 0 THEN 'withheld' ELSE 'shown' END AS state FROM cards""")
def p19_redacted_fields(spark, sf_dir):
    hidden = (F.col("age") < 18) & (F.col("player_id") % 3 != 0)
    return flags.redact(cards(spark, sf_dir), ~hidden, ["value"], "state").select("player_id", "value", "state")


@query(f"""WITH {LATEST_SQL} SELECT player_id FROM cards WHERE sex = 'F' AND tier IN ('BUILDING', 'MACHINERY') AND age BETWEEN 12 AND 18 AND value BETWEEN 150 AND 190""")
def p11_player_search(spark, sf_dir):
    return cards(spark, sf_dir).where((F.col("sex") == "F") & F.col("tier").isin("BUILDING", "MACHINERY") & F.col("age").between(12, 18) & F.col("value").between(150, 190)).select("player_id")
