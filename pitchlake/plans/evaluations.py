"""Queries on forecasts, refits and joint curves, on breakouts, reports, neighbours and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.match import shot_geometry
from ..functions.people import exact_form
from ..operators import cohorts, evaluation, matches, models, people, seasons, temporal
from ..session import cut, written
from . import adapters as ad
from .forecasts import CASE_SQL, H, NEAR_SQL, cases, vectors
from .growth import FEATURES_SQL, features, mismatches
from .league import CAND_SQL, TEAM_SQL, last, teams
from .results import folded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


R4 = lambda *cs: [(F.round(c, 4) + 0.0).alias(c) for c in cs]

# --- height forecasts ---------------------------------------------------------------------


def _points_sql(name: str, rows: str, value: str, floor: float) -> str:
    """A curve for each origin and sex: half-years pooled with their neighbours."""
    return f"""{name}_b AS (SELECT origin, sex, round_even(age / 0.5, 0) * 0.5 AS pt, {value} AS v FROM {rows}),
{name}_p AS (SELECT origin, sex, pt, median(v) AS m, greatest(stddev_pop(v), {floor}) AS s FROM (SELECT origin, sex, unnest([pt - 0.5, pt, pt + 0.5]) AS pt, v FROM {name}_b) SEMI JOIN (SELECT DISTINCT origin, sex, pt FROM {name}_b) USING (origin, sex, pt) GROUP BY ALL HAVING count(*) >= 5),
{name} AS (SELECT *, lead(pt) OVER w AS at2, lead(m) OVER w AS m2, lead(s) OVER w AS s2, row_number() OVER w = 1 AS head FROM {name}_p WINDOW w AS (PARTITION BY origin, sex ORDER BY pt))"""


def _on_sql(c: str, age: str) -> str:
    return f"({age} >= {c}.pt OR {c}.head) AND ({c}.at2 IS NULL OR {age} < {c}.at2)"


def _value_sql(c: str, age: str, v: str = "m") -> str:
    return f"CASE WHEN {c}.at2 IS NULL THEN {c}.{v} ELSE {c}.{v} + (greatest({age}, {c}.pt) - {c}.pt) / ({c}.at2 - {c}.pt) * ({c}.{v}2 - {c}.{v}) END"


VELOCITY_SQL = """s AS (SELECT player_id, sex, date_of_birth, measured_at, value, row_number() OVER (PARTITION BY player_id ORDER BY measured_at, value) AS i FROM readings),
walk AS (SELECT player_id, sex, date_of_birth, i, measured_at AS d, value AS v, CAST(NULL AS DATE) AS start, CAST(NULL AS DOUBLE) AS velocity, measured_at AS seen FROM s WHERE i = 1
    UNION ALL SELECT s.player_id, s.sex, s.date_of_birth, s.i, CASE WHEN s.measured_at - w.d >= 150 THEN s.measured_at ELSE w.d END, CASE WHEN s.measured_at - w.d >= 150 THEN s.value ELSE w.v END,
        CASE WHEN s.measured_at - w.d >= 150 THEN w.d END, CASE WHEN s.measured_at - w.d >= 150 THEN (s.value - w.v) / ((s.measured_at - w.d) / 365.25) END, s.measured_at FROM walk w JOIN s ON s.player_id = w.player_id AND s.i = w.i + 1),
pieces AS (SELECT player_id, sex, seen AS ended, velocity, (start + CAST(floor((seen - start) / 2) AS INTEGER) - date_of_birth) / 365.25 AS age FROM walk WHERE start IS NOT NULL)"""
FORECAST_SQL = f"""{CASE_SQL}, {VELOCITY_SQL}, known AS (SELECT o.origin, r.* FROM readings r JOIN o ON measured_at <= o.origin), moving AS (SELECT o.origin, p.* FROM pieces p JOIN o ON ended <= o.origin),
{_points_sql('hc', 'known', 'value', 1.0)}, {_points_sql('vc', 'moving', 'velocity', 0.2)},
c0 AS (SELECT c.*, (last_date - p.date_of_birth) / 365.25 AS age0, (target_date - p.date_of_birth) / 365.25 AS age1 FROM cases c JOIN players p USING (player_id)),
spans AS (SELECT DISTINCT origin, sex, age0, age1, greatest(1, floor(abs(age1 - age0) / 0.05))::INT AS n FROM c0),
mids AS (SELECT *, (age1 - age0) / n AS width, age0 + (unnest(range(n)) + 0.5) * ((age1 - age0) / n) AS mid FROM spans),
grown AS (SELECT g.origin, g.sex, age0, age1, sum(greatest(coalesce({_value_sql('vc', 'mid')}, 0), 0) * width) AS growth FROM mids g LEFT JOIN vc ON vc.origin = g.origin AND vc.sex = g.sex AND {_on_sql('vc', 'mid')} GROUP BY ALL),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, player_id ORDER BY measured_at DESC, value DESC) AS r FROM known) WHERE r <= 3),
zz AS (SELECT k.origin, k.player_id, avg((value - ({_value_sql('hc', 'age')})) / ({_value_sql('hc', 'age', 's')})) AS z FROM recent k LEFT JOIN hc ON hc.origin = k.origin AND hc.sex = k.sex AND {_on_sql('hc', 'age')} GROUP BY ALL),
f AS (SELECT c0.*, {_value_sql('hc', 'c0.age1')} AS population, last + coalesce(growth, 0) AS cohort_velocity, {_value_sql('hc', 'c0.age1')} + z * ({_value_sql('hc', 'c0.age1', 's')}) AS centile
    FROM c0 LEFT JOIN hc ON hc.origin = c0.origin AND hc.sex = c0.sex AND {_on_sql('hc', 'c0.age1')} LEFT JOIN grown g ON g.origin = c0.origin AND g.sex = c0.sex AND g.age0 = c0.age0 AND g.age1 = c0.age1 LEFT JOIN zz ON zz.origin = c0.origin AND zz.player_id = c0.player_id)"""
METHODS = ("last_value", "population", "cohort_velocity", "centile")


def piece_velocities(spark, sf_dir):
    """Growth over pieces of 150 days and more, at the age in their middle."""
    r = ad.readings(spark, sf_dir)
    v = cohorts.spaced_velocities(r.select("player_id", "measured_at", "value"), "player_id", "measured_at", "value")
    v = v.join(ad.players(spark, sf_dir).select("player_id", "sex", "date_of_birth"), "player_id")
    middle = F.date_add("start", F.floor(F.datediff("end", "start") / 2).cast("int"))
    return v.withColumn("age", F.datediff(middle, "date_of_birth") / 365.25)


def forecasts(spark, sf_dir):
    return models.height_forecasts(ad.readings(spark, sf_dir), piece_velocities(spark, sf_dir), cases(spark, sf_dir))


@query(f"""WITH RECURSIVE {FORECAST_SQL}, l AS (SELECT sex, target, unnest([('last_value', last), ('population', population), ('cohort_velocity', cohort_velocity), ('centile', centile)]) AS m FROM f)
SELECT m[1] AS method, sex, count(m[2]) AS n, count(*) - count(m[2]) AS missing, round(avg(abs(m[2] - target)), 4) + 0.0 AS mae, round(avg(m[2] - target), 4) + 0.0 AS bias FROM l GROUP BY ALL""")
def m1_forecast_errors(spark, sf_dir):
    """The four forecasters' errors over the walk-forward cases; f16 and f17 are at work in them."""
    f = forecasts(spark, sf_dir)
    l = f.select("sex", "target", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("guess")) for m in METHODS])).alias("m")).select("sex", "target", "m.*")
    e = evaluation.errors(l, "target", "guess", ["method", "sex"])
    return e.select("method", "sex", "n", "missing", *R4("mae", "bias"))


HORIZONS = (91, 182, 365)
SERVE_SQL = f"""{FORECAST_SQL}, today AS (SELECT max(measured_at) AS d FROM readings), e AS (SELECT CASE WHEN age1 < 18 THEN 'youth' ELSE 'adult' END AS grp, sex, {H} AS band, target - CASE WHEN age1 < 18 THEN cohort_velocity ELSE last END AS e FROM f),
bands AS (SELECT grp, sex, band, quantile_cont(round(e, 3), 0.1) AS low, quantile_cont(round(e, 3), 0.9) AS high FROM e WHERE e IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
mine AS (SELECT player_id, max((measured_at, value)) AS l, count(*) AS n FROM readings GROUP BY 1),
p0 AS (SELECT p.player_id, p.sex, d, (l[1] - p.date_of_birth) / 365.25 AS age0, (d - p.date_of_birth) / 365.25 AS age, l[2] AS last, d - l[1] AS stale, p.date_of_birth, m.n, p.player_id % 13 <> 0 AS consent FROM players p LEFT JOIN mine m ON m.player_id = p.player_id, today),
hz AS (SELECT *, CASE WHEN age < 18 THEN 'youth' ELSE 'adult' END AS grp, unnest([(0, 91, '0-91'), (1, 182, '92-182'), (2, 365, '183-365')]) AS h FROM p0),
ph AS (SELECT *, (d + h[2]::INT - date_of_birth) / 365.25 AS age_t FROM hz),
ps AS (SELECT DISTINCT sex, age0, age_t, greatest(1, floor(abs(age_t - age0) / 0.05))::INT AS n FROM ph WHERE age0 IS NOT NULL), pm AS (SELECT *, (age_t - age0) / n AS width, age0 + (unnest(range(n)) + 0.5) * ((age_t - age0) / n) AS mid FROM ps),
pv0 AS (SELECT sex, round_even(age / 0.5, 0) * 0.5 AS pt, velocity AS v FROM pieces), pv1 AS (SELECT sex, pt, median(v) AS m FROM (SELECT sex, unnest([pt - 0.5, pt, pt + 0.5]) AS pt, v FROM pv0) SEMI JOIN (SELECT DISTINCT sex, pt FROM pv0) USING (sex, pt) GROUP BY ALL HAVING count(*) >= 5),
pv AS (SELECT *, lead(pt) OVER w AS at2, lead(m) OVER w AS m2, row_number() OVER w = 1 AS head FROM pv1 WINDOW w AS (PARTITION BY sex ORDER BY pt)),
pg AS (SELECT g.sex, age0, age_t, sum(greatest(coalesce({_value_sql('pv', 'mid')}, 0), 0) * width) AS growth FROM pm g LEFT JOIN pv ON pv.sex = g.sex AND {_on_sql('pv', 'mid')} GROUP BY ALL),
pf AS (SELECT ph.*, low, high, CASE WHEN ph.grp = 'youth' THEN last + coalesce(growth, 0) ELSE last END AS centre, CASE WHEN NOT consent THEN 'no consent' WHEN coalesce(ph.n, 0) < 2 THEN 'too few readings' WHEN stale > 365 THEN 'last reading too old' END AS why
    FROM ph LEFT JOIN pg ON pg.sex = ph.sex AND pg.age0 = ph.age0 AND pg.age_t = ph.age_t LEFT JOIN bands b ON b.grp = ph.grp AND b.sex = ph.sex AND b.band = h[3]),
pk AS (SELECT *, coalesce(min(CASE WHEN low IS NULL OR centre IS NULL THEN h[1] END) OVER (PARTITION BY player_id), 3) AS gap FROM pf), pr AS (SELECT *, coalesce(why, CASE WHEN gap = 0 THEN 'no band yet' END) AS reason FROM pk)"""


@query(f"""WITH RECURSIVE {SERVE_SQL} SELECT player_id, CASE WHEN reason IS NULL THEN h[2]::INT END AS days, CASE WHEN reason IS NULL THEN round(centre, 4) END AS centre, CASE WHEN reason IS NULL THEN round(centre + low, 4) END AS lower, CASE WHEN reason IS NULL THEN round(centre + high, 4) END AS upper, reason
FROM pr WHERE (reason IS NOT NULL AND h[1] = 0) OR (reason IS NULL AND h[1] < gap)""")
def m1e_serving_forecast(spark, sf_dir):
    """Today's forecast of each player with its band: growth for the youth, the last value for adults."""
    f = forecasts(spark, sf_dir).withColumn("band", models.horizon_band(F.datediff("target_date", "origin")))
    youth = F.datediff("target_date", "date_of_birth") / 365.25 < 18
    e = f.select(F.when(youth, "youth").otherwise("adult").alias("group"), "sex", "band", F.round(F.col("target") - F.when(youth, F.col("cohort_velocity")).otherwise(F.col("last")), 3).alias("e")).where("e is not null")
    counts = e.groupBy("group", "sex", "band", "e").agg(F.count("*").alias("n"))
    bands = counts.groupBy("group", "sex", "band").agg(F.expr("percentile(e, 0.1, n)").alias("low"), F.expr("percentile(e, 0.9, n)").alias("high"), F.sum("n").alias("n")).where("n >= 30").drop("n")
    r = ad.readings(spark, sf_dir)
    today = r.agg(F.max("measured_at")).first()[0]
    own = r.groupBy("player_id").agg(F.max(F.struct("measured_at", "value")).alias("l"), F.count("*").alias("n"))
    p = ad.players(spark, sf_dir).join(own, "player_id", "left").withColumn("today", F.lit(today))
    p = p.select("player_id", "sex", "date_of_birth", "n", F.col("l.value").alias("last"), (F.col("player_id") % 13 != 0).alias("consent"), F.datediff("today", "l.measured_at").alias("stale_days"), (F.datediff("l.measured_at", "date_of_birth") / 365.25).alias("age0"), F.when(F.datediff("today", "date_of_birth") / 365.25 < 18, "youth").otherwise("adult").alias("group"), "today")
    points = cut(models.curve(piece_velocities(spark, sf_dir), ["sex"], "age", "velocity", 0.2, around=1))
    for d in HORIZONS:
        p = models.growth_between(p.withColumn("age_t", F.datediff(F.date_add("today", d), "date_of_birth") / 365.25), points, ["sex"], "age0", "age_t", "_g")
        p = p.withColumn(f"at_{d}", F.when(F.col("group") == "youth", F.col("last") + F.coalesce("_g", F.lit(0.0))).otherwise(F.col("last"))).drop("_g", "age_t")
    return models.serving_forecasts(p, bands, HORIZONS).select("player_id", "days", *R4("centre", "lower", "upper"), "reason")


@query()
def m12_joint_curve(spark, sf_dir):
    """The curve of each sex fitted together with the players' shifts; a test plants shifts."""
    r = ad.readings(spark, sf_dir)
    some = r.join(r.groupBy("player_id").count().where("count >= 5"), "player_id")
    return models.joint_curve(some, "sex", "player_id", "age", "value").select("sex", "at", F.round("median", 4).alias("median"))


# --- refits ---------------------------------------------------------------------------------


@query()
def m3b_ratings_by_gender(spark, sf_dir):
    """Point strengths within each gender, unregistered players (every tenth) as one stand-in."""
    m = matches.with_outsiders(folded(spark, sf_dir).where("confirmed"), lambda p: p % 10 == 0, lambda p: -1 - (p / 10).cast("long") % 2)
    m = m.withColumn("gender", F.pmod("winner", F.lit(2))).where(F.pmod("loser", F.lit(2)) == F.col("gender"))
    t = matches.bradley_terry(m, by=["gender"])
    return t.where("player_id >= 0").select("gender", "player_id", F.round("theta", 4).alias("theta"), F.round("se", 4).alias("se"), matches.shown_range(F.col("theta"), F.col("se")).alias("shown"))


@query()
def m3c_walk_forward(spark, sf_dir):
    """Scores of predictions by strengths fitted anew before each month."""
    m = written(folded(spark, sf_dir).where("confirmed").select("played", "winner", "loser", "high", "low"))
    t = matches.refits(m)
    a, b = F.least("winner", "loser"), F.greatest("winner", "loser")
    played = m.select(F.trunc("played", "MM").cast("date").alias("month"), a.alias("a"), b.alias("b"), (F.col("winner") < F.col("loser")).alias("won"))
    of = lambda side: t.select("month", F.col("player_id").alias(side), F.col("theta").alias(f"theta_{side}"))
    p = played.join(of("a"), ["month", "a"]).join(of("b"), ["month", "b"]).withColumn("chance", 1 / (1 + F.exp(F.col("theta_b") - F.col("theta_a"))))
    return matches.score_predictions(p, "chance", "won").select("n", *R4("brier", "log_loss", "favourite_won"))


# --- breakouts, finishing, reports ------------------------------------------------------------

PAIR_SQL = f"""{TEAM_SQL}, first AS (SELECT competition, min(year) AS first FROM seasons GROUP BY 1),
p AS (SELECT s.*, t.chances, t.players, b.minutes AS minutes_b, b.goals AS goals_b, b.npxg AS npxg_b, b.xa AS xa_b, tb.chances AS chances_b, 17 + s.player_id % 9 AS age, s.player_id % 4 = 0 AS truth FROM seasons s JOIN first USING (competition) JOIN teams t ON t.club = s.club AND t.year = s.year
    LEFT JOIN seasons b ON b.player_id = s.player_id AND b.competition = s.competition AND b.year = s.year - 1 LEFT JOIN teams tb ON tb.club = b.club AND tb.year = b.year WHERE s.year > first.first),
q AS (SELECT *, ln(((npxg + xa) / chances + 0.025) / ((npxg_b + xa_b) / chances_b + 0.025)) AS score, (npxg + xa) * 90 / minutes AS rate, (npxg_b + xa_b) * 90 / minutes_b AS rate_b, (minutes - coalesce(minutes_b, 0)) / 3060.0 AS rise FROM p),
v AS (SELECT *, CASE WHEN NOT age BETWEEN 18 AND 24 THEN 'age' WHEN minutes < 270 THEN 'minutes' WHEN players < 3 THEN 'squad' WHEN score IS NULL THEN 'no season before' WHEN score >= 0.11 THEN 'breakout' ELSE 'none' END AS outcome,
    coalesce(age >= 18 AND age < 24 AND minutes >= 270 AND CASE WHEN minutes_b >= 270 THEN ln((rate + 0.05) / (rate_b + 0.05)) ELSE 0 END + 0.1 * rise >= 0.15, false) AS by_rate, coalesce(age >= 18 AND age < 24 AND rise >= 0.2, false) AS by_minutes FROM q)"""


def season_pairs(spark, sf_dir):
    """Seasons with the one before, the three detectors' verdicts and a planted truth."""
    t = teams(spark, sf_dir).select("club", "year", "chances", "players")
    s = ad.seasons(spark, sf_dir).join(t, ["club", "year"]).withColumn("own", F.col("npxg") + F.col("xa"))
    p = temporal.previous_season(s, ["player_id", "competition"], "year", ["own", "chances", "minutes", "goals", "npxg"], ["competition"])
    p = p.withColumn("age", 17 + F.col("player_id") % 9).withColumn("truth", F.col("player_id") % 4 == 0)
    p = p.withColumn("score", seasons.opportunity(F.col("own"), F.col("chances"), F.col("before_own"), F.col("before_chances")))
    p = p.withColumn("outcome", seasons.breakout(p, "score", "age", "minutes", "players", 0.11, squad=3))
    rate, before = F.col("own") * 90 / F.col("minutes"), F.col("before_own") * 90 / F.col("before_minutes")
    p = p.withColumn("by_rate", seasons.rate_breakout(p, "age", "minutes", rate, "before_minutes", before))
    return p.withColumn("by_minutes", seasons.minutes_breakout(F.col("age"), F.col("minutes"), F.col("before_minutes"), 0.2))


@query(f"""WITH {PAIR_SQL}, l AS (SELECT truth, unnest([('share', outcome = 'breakout'), ('rate', by_rate), ('minutes', by_minutes)]) AS d FROM v)
SELECT d[1] AS detector, count(*) FILTER (d[2] AND truth) AS tp, count(*) FILTER (d[2] AND NOT truth) AS fp, count(*) FILTER (NOT d[2] AND truth) AS fn, count(*) FILTER (NOT d[2] AND NOT truth) AS tn FROM l GROUP BY 1""")
def a35_breakout_scores(spark, sf_dir):
    """Three detectors of breakouts against the planted ones, a player's season being a case."""
    p = season_pairs(spark, sf_dir)
    l = p.select("truth", F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), c.alias("found")) for n, c in (("share", F.col("outcome") == "breakout"), ("rate", F.col("by_rate")), ("minutes", F.col("by_minutes")))])).alias("d")).select("truth", "d.*")
    return evaluation.counted(l, F.col("found"), F.col("truth"), ["detector"]).select("detector", "tp", "fp", "fn", "tn")


@query(f"""WITH {PAIR_SQL} SELECT outcome AS reason, count(*) AS n FROM v WHERE truth AND outcome NOT IN ('breakout', 'none') GROUP BY 1""")
def a35_unscorable(spark, sf_dir):
    """Why planted breakouts could not be scored."""
    return season_pairs(spark, sf_dir).where("truth and outcome not in ('breakout', 'none')").groupBy(F.col("outcome").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIR_SQL}, x AS (SELECT grp, year, goals * 90.0 / minutes AS actual, goals_b * 90.0 / minutes_b AS goals, npxg_b * 90.0 / minutes_b AS npxg FROM q WHERE minutes >= 900 AND minutes_b >= 900),
m AS (SELECT *, avg(goals) OVER (PARTITION BY grp, year) AS average FROM x), l AS (SELECT actual, unnest([('goals', goals), ('npxg', npxg), ('position average', average)]) AS p FROM m)
SELECT p[1] AS predictor, count(*) AS pairs, round(avg(abs(p[2] - actual)), 4) + 0.0 AS mae FROM l GROUP BY 1""")
def a35_finishing_errors(spark, sf_dir):
    """How well last season's goals, chances and the position's average tell next season's goals."""
    p = season_pairs(spark, sf_dir).where("minutes >= 900 and before_minutes >= 900")
    x = p.select("grp", "year", (F.col("goals") * 90.0 / F.col("minutes")).alias("actual"), (F.col("before_goals") * 90.0 / F.col("before_minutes")).alias("goals"), (F.col("before_npxg") * 90.0 / F.col("before_minutes")).alias("npxg"))
    x = x.join(x.groupBy("grp", "year").agg(F.avg("goals").alias("position average")), ["grp", "year"])
    l = seasons.melt(x, ["actual"], ["goals", "npxg", "position average"], "predictor", "guess")
    return evaluation.errors(l, "actual", "guess", ["predictor"]).select("predictor", F.col("n").alias("pairs"), *R4("mae"))


@query(f"""WITH {ad.SEASONS}, s AS (SELECT player_id, sum(goals) AS goals, sum(shots) * 0.33 AS mean FROM seasons GROUP BY 1), ks AS (SELECT unnest(range(0, 2000)) AS k),
c AS (SELECT player_id, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY player_id ORDER BY k) AS c FROM s, ks WHERE k <= 2 * mean + 60), r AS (SELECT player_id, min(k) FILTER (c >= 0.1 - 1e-12) AS low, min(k) FILTER (c >= 0.9 - 1e-12) AS high FROM c GROUP BY 1),
v AS (SELECT player_id, player_id % 3 = 0 AS good, CASE WHEN mean < 2 THEN 'too few chances' WHEN goals > high THEN 'above' WHEN goals < low THEN 'below' ELSE 'in line' END AS verdict FROM s JOIN r USING (player_id))
SELECT verdict, count(*) AS n, count(*) FILTER (good) AS good FROM v GROUP BY 1""")
def a35_finishing_verdicts(spark, sf_dir):
    """Career verdicts on finishing against the planted better finishers."""
    s = ad.seasons(spark, sf_dir).groupBy("player_id").agg(F.sum("goals").alias("goals"), (F.sum("shots") * 0.33).alias("mean"))
    s = s.withColumn("r", models.poisson_range(F.col("mean")))
    v = F.when(F.col("mean") < 2, "too few chances").when(F.col("goals") > F.col("r.high"), "above").when(F.col("goals") < F.col("r.low"), "below").otherwise("in line")
    return s.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.count(F.when(F.col("player_id") % 3 == 0, 1)).alias("good"))


REPORT_SQL = f"""{CAND_SQL}, rep AS (SELECT c.*, ((p1 + p2) / 2.0 + (p3 + p4) / 2.0) / 2 AS level, s_acctbal AS truth FROM pct c JOIN supplier ON s_suppkey = player_id),
rec AS (SELECT *, CASE WHEN level >= 70 AND minutes >= 900 THEN 'Shortlist' WHEN level < 50 THEN 'Not now' ELSE 'Monitor' END AS recommendation FROM rep WHERE level IS NOT NULL)"""


def reports(spark, sf_dir):
    r = seasons.report(last(spark, sf_dir), ["year", "grp"], "player_id", {"scoring": ["goals", "npxg"], "creation": ["xa", "passes"]}, "minutes")
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_acctbal").alias("truth"))
    r = r.where("level is not null").join(s, "player_id")
    return r.withColumn("recommendation", seasons.recommendation(F.col("grade"), F.col("confidence")))


@query(f"""WITH {REPORT_SQL}, k AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY level) + (count(*) OVER (PARTITION BY grp, level) - 1) / 2.0 AS a, rank() OVER (PARTITION BY grp ORDER BY minutes) + (count(*) OVER (PARTITION BY grp, minutes) - 1) / 2.0 AS b, rank() OVER (PARTITION BY grp ORDER BY truth) + (count(*) OVER (PARTITION BY grp, truth) - 1) / 2.0 AS t FROM rec)
SELECT grp, count(*) AS n, round(corr(a, t), 4) AS by_level, round(corr(b, t), 4) AS by_minutes FROM k GROUP BY 1""")
def a36_report_validity(spark, sf_dir):
    """How reports' levels, and minutes alone, rank with the truth in each group."""
    r = reports(spark, sf_dir).select("grp", "level", "minutes", "truth")
    a = evaluation.spearman(r, ["grp"], "level", "truth").select("grp", "n", F.round("spearman", 4).alias("by_level"))
    return a.join(evaluation.spearman(r, ["grp"], "minutes", "truth").select("grp", F.round("spearman", 4).alias("by_minutes")), "grp")


@query(f"""WITH {REPORT_SQL}, k AS (SELECT *, floor(count(*) OVER (PARTITION BY grp) / 3) AS third, row_number() OVER (PARTITION BY grp ORDER BY truth, player_id) AS r, row_number() OVER (PARTITION BY grp ORDER BY truth DESC, player_id) AS d FROM rec),
e AS (SELECT grp, max(truth) FILTER (r = third) AS low, max(truth) FILTER (d = third) AS high FROM k GROUP BY 1)
SELECT recommendation, count(*) AS n, count(*) FILTER ((recommendation = 'Shortlist' AND truth >= high) OR (recommendation = 'Not now' AND truth <= low)) AS hits FROM k JOIN e USING (grp) GROUP BY 1""")
def a36_recommendations(spark, sf_dir):
    """Recommendations and how many lie in the matching third of the truth."""
    return evaluation.thirds_agreement(reports(spark, sf_dir), ["grp"], "player_id", "recommendation", "truth")


@query(f"""WITH {NEAR_SQL}, r AS (SELECT v.*, player_id % 4 AS role, CAST(s_acctbal AS DECIMAL(12, 2)) AS level FROM v JOIN supplier ON s_suppkey = player_id), d AS (SELECT a.grp, a.player_id, a.role = b.role AS same, abs(a.level - b.level) AS gap, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance, b.player_id AS other FROM r a JOIN r b ON a.grp = b.grp AND a.player_id <> b.player_id),
k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY distance, other) AS place FROM d)
SELECT player_id, round(avg(CAST(same AS INT)) FILTER (place <= 5), 4) AS same_role, round(avg(CAST(same AS INT)), 4) AS chance, round(avg(gap) FILTER (place <= 5), 1) AS gap, round(avg(gap), 1) AS random_gap FROM k GROUP BY 1""")
def a32_neighbour_quality(spark, sf_dir):
    """Role and level of each player's five nearest against those of all others of the group."""
    v = vectors(spark, sf_dir)
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_acctbal").cast("decimal(12,2)").alias("level"))
    rows = v.select("grp", "player_id", (F.col("player_id") % 4).alias("role")).join(s, "player_id")
    near = models.nearest(v, ["grp"], "player_id", ["goals", "npxg", "passes"], 5)
    q = evaluation.neighbour_quality(near, rows, ["grp"], "player_id", "role", "level", 5)
    return q.select("player_id", *R4("same_role", "chance"), *[F.round(c, 1).alias(c) for c in ("gap", "random_gap")])


# --- baselines, nets ------------------------------------------------------------------------


@query(f"""WITH {FEATURES_SQL}, n AS (SELECT count(*) // 20 AS n FROM features) SELECT player_id FROM (SELECT player_id, row_number() OVER (ORDER BY mean_z, player_id) AS r FROM features WHERE mean_z IS NOT NULL) WHERE r <= (SELECT n FROM n)""")
def d7_shortest_for_age(spark, sf_dir):
    """As many of the shortest for their age as a twentieth of the players."""
    f = cut(features(spark, sf_dir).select("player_id", "mean_z"))
    return people.lowest(f, "player_id", "mean_z", f.count() // 20)


@query(f"WITH {ad.PLAYERS} SELECT 'everyone' AS baseline, count(*) AS n FROM players UNION ALL SELECT 'nobody', 0 UNION ALL SELECT 'self-submitted', count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority LIKE '5%' AND o_orderstatus <> 'F'")
def d7_plain_baselines(spark, sf_dir):
    """How many everyone, nobody, and all with an unchecked row of their own would flag."""
    p = ad.players(spark, sf_dir).agg(F.lit("everyone").alias("baseline"), F.count("*").alias("n"))
    o = ad.table(spark, sf_dir, "orders").where("o_orderpriority LIKE '5%' AND o_orderstatus <> 'F'").agg(F.lit("self-submitted").alias("baseline"), F.countDistinct("o_custkey").alias("n"))
    return p.union(spark.range(1).select(F.lit("nobody"), F.lit(0).cast("long"))).union(o)


@query(f"WITH {ad.RECORDS}, m AS (SELECT record_id, CASE WHEN record_id % 12 = 0 THEN record_id + 5 END AS merged_into FROM records), x AS (SELECT record_id AS id FROM m WHERE merged_into IS NOT NULL UNION SELECT merged_into FROM m WHERE merged_into IS NOT NULL) SELECT id AS record_id FROM x WHERE id IN (SELECT record_id FROM records)")
def d7_merge_pointers(spark, sf_dir):
    """Records that say themselves that they were merged, and where to."""
    r = ad.records(spark, sf_dir).select("record_id", F.when(F.col("record_id") % 12 == 0, F.col("record_id") + 5).alias("merged_into"))
    return people.pointed_at(r, "record_id", "merged_into")


NETS = ((-0.9, 3.0), (-0.6, 2.5), (-0.3, 2.0), (0.0, 1.5))


def nets(spark, sf_dir):
    f = features(spark, sf_dir)
    rules = [F.col("age").between(11, 18.5) & (F.col("readings") >= 3) & (F.col("mean_z") <= z) & (F.col("recent_velocity") >= v) for z, v in NETS]
    return f, people.loosened(f, "player_id", rules)


@query(f"""WITH {FEATURES_SQL}, n AS (SELECT unnest([(0, -0.9, 3.0), (1, -0.6, 2.5), (2, -0.3, 2.0), (3, 0.0, 1.5)]) AS n) SELECT CAST(n[1] AS INTEGER) AS level, player_id FROM features, n WHERE age BETWEEN 11 AND 18.5 AND readings >= 3 AND mean_z <= n[2] AND recent_velocity >= n[3]""")
def d9_loosened_nets(spark, sf_dir):
    """Whom the late-bloomer rule raises as each of its gates is loosened by a step."""
    return nets(spark, sf_dir)[1]


@query()
def d9_taught_filter(spark, sf_dir):
    """The widest net's players that reviewers of half of them would confirm; tests plant verdicts."""
    f, raised = nets(spark, sf_dir)
    x = f.join(mismatches(spark, sf_dir).select("player_id", "velocity_z"), "player_id", "left")
    x = cut(x.join(raised.where("level = 3"), "player_id"))
    decided = x.where("player_id % 4 < 2").withColumn("confirmed", F.col("mean_z") < -0.2)
    kept = people.taught_filter(decided, x, ["age", "mean_z", "least_z", "recent_velocity", "velocity_z", "readings"], "confirmed")
    return kept.select("player_id", F.round("chance", 4).alias("chance"))


# --- geometry, values, names -----------------------------------------------------------------

FRAME_SQL = "list_transform(range(0, 6), lambda i: {'x': 100.0 + (event_id * 7 + i * 13) % 20, 'y': 20.0 + (event_id * 11 + i * 17) % 40, 'teammate': i % 3 = 0, 'keeper': i = 5 AND event_id % 4 <> 0})"


def _side(p: str, q: str) -> str:
    return f"((f.x - {q}[1]) * ({p}[2] - {q}[2]) - ({p}[1] - {q}[1]) * (f.y - {q}[2]))"


_D = [_side("[x, y]", "[120.0, 36.0]"), _side("[120.0, 36.0]", "[120.0, 44.0]"), _side("[120.0, 44.0]", "[x, y]")]


@query(f"""WITH e AS (SELECT event_id, 95.0 + event_id % 25 AS x, 25.0 + event_id % 31 AS y, {FRAME_SQL} AS fr FROM events), g AS (SELECT *, list_filter(fr, lambda f: NOT (least({', '.join(_D)}) < 0 AND greatest({', '.join(_D)}) > 0)) AS cone, list_filter(fr, lambda f: NOT f.teammate AND f.keeper)[1] AS k, list_filter(fr, lambda f: NOT f.teammate AND NOT f.keeper) AS d FROM e)
SELECT event_id, round(sqrt((120 - x) ** 2 + (40 - y) ** 2), 4) AS distance, round(abs(atan2(44 - y, 120 - x) - atan2(36 - y, 120 - x)), 4) AS angle, len(cone) AS players_in_cone, len(list_filter(cone, lambda f: NOT f.teammate AND NOT f.keeper)) AS defenders_in_cone,
    round(coalesce(sqrt((k.x - x) ** 2 + (k.y - y) ** 2), 120), 4) AS keeper_to_shooter, round(coalesce(120 - k.x, 120), 4) AS keeper_off_line, round(coalesce(abs(k.y - 40), 40), 4) AS keeper_off_centre, round(coalesce(list_min(list_transform(d, lambda f: sqrt((f.x - x) ** 2 + (f.y - y) ** 2))), 60), 4) AS nearest_defender FROM g""")
def f14_shot_geometry(spark, sf_dir):
    """Geometry of shots from the places of the others at the moment of the shot."""
    k = F.col("event_id")
    frame = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((100.0 + (k * 7 + i * 13) % 20).alias("x"), (20.0 + (k * 11 + i * 17) % 40).alias("y"), (i % 3 == 0).alias("teammate"), ((i == 5) & (k % 4 != 0)).alias("keeper")))
    e = ad.table(spark, sf_dir, "events").select("event_id", shot_geometry(95.0 + k % 25, 25.0 + k % 31, frame).alias("g"))
    return e.select("event_id", *[F.round(f"g.{c}", 4).alias(c) for c in ("distance", "angle")], *[F.col(f"g.{c}").cast("long").alias(c) for c in ("players_in_cone", "defenders_in_cone")], *[F.round(f"g.{c}", 4).alias(c) for c in ("keeper_to_shooter", "keeper_off_line", "keeper_off_centre", "nearest_defender")])


@query(f"""WITH {ad.SEASONS} SELECT player_id, year, round(exp(ln(90.0 * goals / minutes + 0.05)) - 0.05, 4) + 0.0 AS goals_90, round(100.0 * goals / shots, 4) AS goal_percent, round(90.0 * (shots - goals) / minutes, 4) AS misses_90, round((npxg + xa) / nullif(passes, 0), 6) AS per_pass FROM seasons""")
def f19_f20_shown_values(spark, sf_dir):
    """A log rate and a share as they are shown, and values made of several fields."""
    s = ad.seasons(spark, sf_dir)
    raw = F.ln(90.0 * F.col("goals") / F.col("minutes") + 0.05)
    return s.select("player_id", "year", (F.round(seasons.shown_value(raw, "rate"), 4) + 0.0).alias("goals_90"), F.round(seasons.shown_value(F.col("goals") / F.col("shots"), "percent"), 4).alias("goal_percent"), F.round(seasons.gap_value(["shots"], ["goals"], minutes="minutes"), 4).alias("misses_90"), F.round(seasons.gap_value(["npxg", "xa"], over=["passes"]), 6).alias("per_pass"))


@query(r"""WITH n AS (SELECT p_partkey AS id, lower(trim(regexp_replace('  ' || upper(p_name) || chr(9) || p_brand || ' ', '\s+', ' ', 'g'))) AS form FROM part) SELECT form, min(id) AS id, count(*) AS records, count(*) > 1 AS ambiguous FROM n GROUP BY 1""")
def f21_exact_forms(spark, sf_dir):
    """Names in their exact form, and those that several records share."""
    n = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), exact_form(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"), F.col("p_brand"), F.lit(" "))).alias("form"))
    return n.groupBy("form").agg(F.min("id").alias("id"), F.count("*").alias("records")).withColumn("ambiguous", F.col("records") > 1)
