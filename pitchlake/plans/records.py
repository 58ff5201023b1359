"""Queries on people, imports, baselines, comparisons and measuring plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.match import clock_seconds, epoch_day, in_first_half, named, season_of_text, stamp_minute
from ..functions.people import name_tokens
from ..operators import evaluation, models, people, temporal
from . import adapters as ad
from .forecasts import NEAR_SQL, vectors
from .growth import BLOOMER_SQL, FEATURES_SQL, LATEST_SQL, Z_SQL, cards, features, reference_date, z_summary
from .league import FLAG_SQL, flag_rows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ad.RECORDS} SELECT record_id, CASE WHEN record_id > min(record_id) OVER w THEN min(record_id) OVER w END AS repeats FROM records WINDOW w AS (PARTITION BY date_of_birth, lower(name))""")
def p6_in_file_repeats(spark, sf_dir):
    r = ad.records(spark, sf_dir).withColumn("lower_name", F.lower("name"))
    return people.first_line(r, ["date_of_birth", "lower_name"], "record_id").select("record_id", "repeats")


@query(f"""WITH {ad.RECORDS} SELECT a.record_id, b.record_id AS held FROM records a JOIN records b ON a.date_of_birth = b.date_of_birth WHERE a.record_id % 10 = 0 AND b.record_id % 10 <> 0
    AND len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) = least(len(list_distinct(string_split(a.name, ' '))), len(list_distinct(string_split(b.name, ' '))))""")
def p7_may_exist(spark, sf_dir):
    """New records (every tenth) that may be held already."""
    r = ad.records(spark, sf_dir).select("record_id", "date_of_birth", name_tokens(F.col("name")).alias("tokens"))
    return people.may_exist(r.where("record_id % 10 = 0"), r.where("record_id % 10 <> 0"), "date_of_birth", "tokens", "record_id").select("record_id", "held")


@query(f"""WITH {LATEST_SQL} SELECT player_id, concat_ws('; ', CASE WHEN NOT age BETWEEN 5 AND 60 THEN 'age' END, CASE WHEN age < 18 AND player_id % 4 <> 0 THEN 'guardian' END, CASE WHEN tier = 'HOUSEHOLD' THEN 'role' END) AS reasons FROM cards""")
def p8_person_checks(spark, sf_dir):
    c = cards(spark, sf_dir)
    return c.select("player_id", F.concat_ws("; ", people.check_person(F.col("age"), F.col("player_id") % 4 == 0, F.col("tier") != "HOUSEHOLD")).alias("reasons"))


@query(f"""WITH {ad.PLAYERS}, {ad.SPELLS} SELECT player_id FROM players SEMI JOIN (SELECT player_id FROM spells WHERE organization_id = 7 AND end_date IS NULL) USING (player_id) WHERE player_id % 11 <> 0""")
def j3_visible_players(spark, sf_dir):
    own = ad.spells(spark, sf_dir).where("organization_id = 7 and end_date is null")
    return people.visible(ad.players(spark, sf_dir), "own", own, "player_id", F.col("player_id") % 11 == 0).select("player_id")


@query(f"""WITH {ad.SEASONS} SELECT a.player_id, a.year, a.goals, b.goals AS next_goals FROM seasons a JOIN seasons b ON a.player_id = b.player_id AND b.year = a.year + 1""")
def j13_next_season_pairs(spark, sf_dir):
    s = ad.seasons(spark, sf_dir).select("player_id", "year", "goals")
    return s.join(s.select("player_id", (F.col("year") - 1).alias("year"), F.col("goals").alias("next_goals")), ["player_id", "year"])


@query("""SELECT e.event_id, e.event_id - 1 - e.event_id % 3 AS pass_id, t.event_type AS to_event_type, round(t.value, 4) AS to_value FROM events e LEFT JOIN events t ON t.event_id = e.event_id - 1 - e.event_id % 3 AND t.user_id % 5 = e.user_id % 5 WHERE e.event_type = 'purchase'""")
def j16_linked_events(spark, sf_dir):
    """Purchases with the event that they refer to, of the same group of users."""
    e = ad.table(spark, sf_dir, "events")
    e = e.select("event_id", "event_type", "value", (F.col("user_id") % 5).alias("match"), F.when(F.col("event_type") == "purchase", F.col("event_id") - 1 - F.col("event_id") % 3).alias("pass_id"))
    return people.linked_events(e, "match", "event_id", "pass_id", ["event_type", "value"]).select("event_id", "pass_id", "to_event_type", F.round("to_value", 4).alias("to_value"))


@query(f"""WITH {ad.RECORDS}, f AS (SELECT *, min(record_id) OVER (PARTITION BY name) AS first FROM records) SELECT first, record_id FROM f WHERE record_id > first""")
def d7_exact_names(spark, sf_dir):
    return people.exact_name_pairs(ad.records(spark, sf_dir), "record_id", "name")


@query(f"""WITH {ad.PLAYERS} SELECT player_id FROM players WHERE CAST('0x' || left(md5('1:' || player_id), 7) AS BIGINT) < {int(0.1 * (1 << 28))}""")
def d7_random_baseline(spark, sf_dir):
    """A tenth of the players at random, the same on every run."""
    return people.random_flags(ad.players(spark, sf_dir), "player_id", 0.1)


@query(f"""WITH {FEATURES_SQL} SELECT player_id, CASE WHEN NOT coalesce(age BETWEEN 11 AND 18.5, false) THEN 'age' WHEN NOT readings >= 3 THEN 'readings' WHEN NOT mean_z <= -0.9 THEN 'size' WHEN NOT recent_velocity >= 3.0 THEN 'growth' END AS gate FROM features""")
def d8_first_gate(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("player_id", people.first_gate({"age": F.col("age").between(11, 18.5), "readings": F.col("readings") >= 3, "size": F.col("mean_z") <= -0.9, "growth": F.col("recent_velocity") >= 3.0}).alias("gate"))


@query(f"""WITH {BLOOMER_SQL}, {FLAG_SQL}, r AS (SELECT player_id, 'small and growing' AS reason FROM bloomers UNION ALL SELECT player_id, type FROM flags WHERE status = 'open') SELECT player_id, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM r GROUP BY 1""")
def d5_combined_reasons(spark, sf_dir):
    from ..operators import cohorts

    late = cohorts.late_bloomers(features(spark, sf_dir)).select("player_id", F.lit("small and growing").alias("reason"))
    return people.combined_reasons([late, flag_rows(spark, sf_dir).where("status = 'open'").select("player_id", F.col("type").alias("reason"))], "player_id", "reason")


@query(f"""WITH {ad.SPELLS}, q AS (SELECT DISTINCT player_id, purpose, DATE '1999-01-01' AS d FROM spells WHERE player_id % 50 = 0),
c AS (SELECT s.player_id, s.purpose, granted, start_date, CASE WHEN granted AND d IS NOT NULL AND start_date < d AND (end_date IS NULL OR end_date >= d) THEN CAST(d - 1 AS DATE) ELSE end_date END AS end_date FROM spells s LEFT JOIN q ON s.player_id = q.player_id AND s.purpose = q.purpose)
SELECT * FROM c UNION ALL SELECT player_id, purpose, false, d, NULL FROM q""")
def d14_withdrawals(spark, sf_dir):
    s = ad.spells(spark, sf_dir)
    asked = s.where("player_id % 50 = 0").select("player_id", "purpose").distinct().withColumn("on", F.lit("1999-01-01").cast("date"))
    return people.withdraw(s.select("player_id", "purpose", "granted", "start_date", "end_date"), asked, ["player_id", "purpose"], "start_date", "end_date")


@query(f"""WITH {LATEST_SQL}, l AS (SELECT player_id, 'height' AS metric, value FROM cards UNION ALL SELECT player_id, 'age', age FROM cards), p AS (SELECT metric, max(value) FILTER (player_id = 1) AS "1", max(value) FILTER (player_id = 2) AS "2", max(value) FILTER (player_id = 3) AS "3" FROM l GROUP BY 1)
SELECT metric, "1", "2", "3", round(greatest("1", "2", "3") - least("1", "2", "3"), 4) AS spread, greatest("1", "2", "3") - least("1", "2", "3") > 1.5 AS telling FROM p""")
def x3_comparison(spark, sf_dir):
    """Three players side by side."""
    c = cards(spark, sf_dir)
    l = c.select("player_id", F.lit("height").alias("metric"), "value").union(c.select("player_id", F.lit("age"), F.col("age").cast("double")))
    return people.comparison(l, [1, 2, 3], "player_id", "metric", "value", 1.5).withColumn("spread", F.round("spread", 4))


@query(f"""WITH {NEAR_SQL}, d AS (SELECT a.player_id, a.grp, b.player_id AS other, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS distance FROM v a JOIN v b ON a.grp = b.grp AND a.player_id <> b.player_id),
r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY distance, other) AS k, count(*) OVER (PARTITION BY player_id) AS others FROM d), t AS (SELECT k, others FROM r WHERE other = player_id + 3)
SELECT count(*) AS n, median(k) AS median_rank, round(avg(CAST(k <= 1 AS DOUBLE)), 4) AS top_1, round(avg(CAST(k <= 5 AS DOUBLE)), 4) AS top_5, round(avg(CAST(k <= 10 AS DOUBLE)), 4) AS top_10, round(avg(1.0 / k), 4) AS mrr, round(avg(least(1.0, 5.0 / others)), 4) AS random_5 FROM t""")
def a31_retrieval_scores(spark, sf_dir):
    """How near a player's twin (three ids on) is found among the players of the group."""
    v = vectors(spark, sf_dir).withColumn("twin", F.col("player_id") + 3)
    r = people.retrieval(models.twin_ranks(v, ["grp"], "player_id", "twin", ["goals", "npxg", "passes"]))
    return r.select("n", "median_rank", *[F.round(c, 4).alias(c) for c in ("top_1", "top_5", "top_10", "mrr", "random_5")])


@query(f"""WITH {BLOOMER_SQL}, {ad.RECORDS}, pop AS (SELECT player_id FROM players WHERE player_id % 7 <> 0), x AS (SELECT p.player_id, b.player_id IS NOT NULL AS predicted, p.player_id % 9 = 0 AS actual FROM pop p LEFT JOIN bloomers b USING (player_id))
SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM x""")
def a37_subtype_scores(spark, sf_dir):
    """Scores with another subtype's players taken out of the population."""
    from ..operators import cohorts

    p = ad.players(spark, sf_dir).select("player_id")
    population = p.join(p.where("player_id % 7 = 0"), "player_id", "left_anti")
    c = evaluation.confusion(population, cohorts.late_bloomers(features(spark, sf_dir)), p.where("player_id % 9 = 0"), "player_id")
    return c.select("tp", "fp", "fn", "tn")




@query(f"""WITH {LATEST_SQL}, {Z_SQL.removeprefix(ad.READINGS).lstrip(', ').lstrip()}, d AS (SELECT max(measured_at) AS ref FROM readings), c AS (SELECT c.*, last_z, CAST(ref - measured_at AS INTEGER) AS stale FROM cards c LEFT JOIN zs USING (player_id), d),
w AS (SELECT *, round(CASE WHEN age BETWEEN 11 AND 16 THEN 1.0 WHEN age BETWEEN 9 AND 18 THEN 0.5 ELSE 0.1 END::DOUBLE * (1 + abs(coalesce(last_z, 0))) * least(stale / 90.0::DOUBLE, 3.0) * CASE WHEN n < 3 THEN 1.5 ELSE 1.0 END, 6) AS worth FROM c)
SELECT tier, place, player_id, worth FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY CAST(stale > 365 AS INT) DESC, worth DESC, player_id) AS place FROM w) WHERE place <= 10""")
def t6_measuring_plan(spark, sf_dir):
    """Ten players of each squad whom it is worth most to measure; overdue ones first."""
    on = reference_date(ad.readings(spark, sf_dir))
    c = cards(spark, sf_dir).join(z_summary(spark, sf_dir).select("player_id", "last_z"), "player_id", "left").withColumn("stale", F.datediff(on, "measured_at"))
    c = c.withColumn("worth", F.round(people.measuring_value(F.col("age"), F.col("last_z"), F.col("stale"), F.col("n")), 6))
    w = Window.partitionBy("tier").orderBy((F.col("stale") > 365).cast("int").desc(), F.desc("worth"), "player_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 10").select("tier", "place", "player_id", "worth")


@query(f"""WITH {FLAG_SQL}, s AS (SELECT player_id, dedupe_key, raised, row_number() OVER (PARTITION BY player_id ORDER BY raised DESC, dedupe_key) AS r FROM flags WHERE type = 'anomaly' AND status = 'open') SELECT player_id, dedupe_key, raised FROM s WHERE r = 1 ORDER BY raised DESC, player_id LIMIT 20""")
def t7_scout_home(spark, sf_dir):
    """The twenty newest live anomalies, one for each player: a page of that length."""
    f = temporal.latest(flag_rows(spark, sf_dir).where("type = 'anomaly' and status = 'open'"), ["player_id"], [F.desc("raised"), F.col("dedupe_key")])
    return f.select("player_id", "dedupe_key", "raised").orderBy(F.desc("raised"), "player_id").limit(20)


@query("""SELECT event_id, (event_id % 95) * 60 + event_id % 60 AS seconds, CAST(event_id % 95 AS INTEGER) AS minute, event_id % 95 <= 45 AS first_half, CASE WHEN event_id % 7 > 0 THEN DATE '2024-01-01' + CAST(event_id % 7 AS INTEGER) END AS day FROM events""")
def f10_clocks_and_days(spark, sf_dir):
    k = F.col("event_id")
    clock = F.concat((k % 95).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    stamp = F.concat((k % 95).cast("string"), F.when(k % 3 == 0, "+2").otherwise(""))
    day = epoch_day(F.when(k % 7 > 0, 1704067200 + (k % 7) * 86400).otherwise(-1))
    return ad.table(spark, sf_dir, "events").select("event_id", clock_seconds(clock).cast("long").alias("seconds"), stamp_minute(stamp).alias("minute"), in_first_half(stamp).alias("first_half"), day.alias("day"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'EG' WHEN 1 THEN 'FR' WHEN 2 THEN 'MA' END AS code, '20' || (10 + n_nationkey % 9) || '/20' || (11 + n_nationkey % 9) AS season FROM nation""")
def f12_codes_and_seasons(spark, sf_dir):
    k = F.col("n_nationkey")
    country = F.when(k % 4 == 0, "Egypt").when(k % 4 == 1, "France").when(k % 4 == 2, "Morocco").otherwise("Nowhere")
    text = F.concat(F.lit("Premier League 20"), (10 + k % 9).cast("string"), F.lit("/"), (11 + k % 9).cast("string"))
    return ad.table(spark, sf_dir, "nation").select("n_nationkey", named(country, {"Egypt": "EG", "France": "FR", "Morocco": "MA"}).alias("code"), season_of_text(text).alias("season"))
