"""Queries on matches: folding, contradictions, rates, ratings, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.match import match_chance, set_chance, win_chance
from ..operators import matches, temporal
from . import adapters as ad

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


FOLD_SQL = f"""{ad.SIDES}, folded AS (SELECT match_id, played, CASE WHEN won > lost THEN player_id ELSE opponent_id END AS winner, CASE WHEN won > lost THEN opponent_id ELSE player_id END AS loser,
    greatest(won, lost) AS high, least(won, lost) AS low, count(DISTINCT player_id) AS sides, bool_or(verified) AS verified FROM sides WHERE won <> lost GROUP BY ALL),
m AS (SELECT *, sides > 1 OR verified AS confirmed FROM folded)"""


def folded(spark, sf_dir):
    return matches.fold(ad.sides(spark, sf_dir))


@query(f"WITH {FOLD_SQL} SELECT match_id, played, winner, loser, high, low, sides, confirmed FROM m")
def m3_fold_matches(spark, sf_dir):
    return folded(spark, sf_dir).drop("verified")


SIDE_ROWS = "SELECT *, match_id * 1000000 + player_id * 1000 + opponent_id AS row_id FROM sides"
CONTRA_SQL = f"""{ad.SIDES}, q AS (SELECT row_id, verified, played, least(player_id, opponent_id) AS p, greatest(player_id, opponent_id) AS q, player_id < opponent_id AS side,
    CASE WHEN player_id < opponent_id THEN won ELSE lost END AS x, CASE WHEN player_id < opponent_id THEN lost ELSE won END AS y FROM ({SIDE_ROWS})),
n AS (SELECT *, row_number() OVER (PARTITION BY played, p, q, side, x, y ORDER BY row_id) AS i FROM q),
l AS (SELECT *, row_number() OVER (PARTITION BY played, p, q, side ORDER BY row_id) AS k FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.played = b.played AND a.p = b.p AND a.q = b.q AND a.side <> b.side AND a.x = b.x AND a.y = b.y AND a.i = b.i)),
c AS (SELECT a.played, a.p, a.q, a.row_id AS a, b.row_id AS b, a.verified AS a_verified, b.verified AS b_verified FROM l a JOIN l b ON a.played = b.played AND a.p = b.p AND a.q = b.q AND a.k = b.k AND a.side AND NOT b.side)"""


def contradicting(spark, sf_dir):
    rows = ad.sides(spark, sf_dir).withColumn("row_id", F.col("match_id") * 1000000 + F.col("player_id") * 1000 + F.col("opponent_id"))
    return matches.contradictions(rows)


@query(f"WITH {CONTRA_SQL} SELECT * FROM c")
def j10_contradictions(spark, sf_dir):
    return contradicting(spark, sf_dir)


@query(f"""WITH {CONTRA_SQL}, s AS (SELECT a AS row_id, a_verified AS own, b_verified AS other FROM c UNION ALL SELECT b, b_verified, a_verified FROM c)
SELECT row_id, CASE WHEN other THEN 'against a verified row' ELSE 'neither is verified' END AS reason FROM s WHERE NOT own""")
def d4_blamed_rows(spark, sf_dir):
    return matches.blamed(contradicting(spark, sf_dir))


@query(f"""WITH {FOLD_SQL}, s AS (SELECT winner AS player_id, 1 AS w, high AS f, low AS g FROM m WHERE played < DATE '1999-01-01' UNION ALL SELECT loser, 0, low, high FROM m WHERE played < DATE '1999-01-01')
SELECT player_id, count(*) AS played, round(sum(w) / count(*), 4) AS win_rate, round(sum(f) / sum(f + g), 4) AS point_rate FROM s GROUP BY 1""")
def a30_rates_before(spark, sf_dir):
    r = matches.rates_before(folded(spark, sf_dir), F.lit("1999-01-01").cast("date"))
    return r.select("player_id", "played", F.round("win_rate", 4).alias("win_rate"), F.round("point_rate", 4).alias("point_rate"))


PRED_SQL = f"""{FOLD_SQL}, pr AS (SELECT match_id, winner, loser, 1 / (1 + exp(-((winner % 17) - (loser % 17)) / 10.0)) AS chance, winner < loser AS w FROM m),
pp AS (SELECT match_id, CASE WHEN w THEN chance ELSE 1 - chance END AS chance, w AS won FROM pr)"""


def predictions(spark, sf_dir):
    m = folded(spark, sf_dir).withColumn("won", F.col("winner") < F.col("loser"))
    c = 1 / (1 + F.exp(-((F.col("winner") % 17) - (F.col("loser") % 17)) / 10.0))
    return m.select("match_id", F.when(F.col("won"), c).otherwise(1 - c).alias("chance"), "won")


@query(f"""WITH {PRED_SQL}, y AS (SELECT chance AS p, CAST(won AS DOUBLE) AS y FROM pp)
SELECT count(*) AS n, round(avg((p - y) * (p - y)), 4) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 4) AS log_loss, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 4) AS favourite_won FROM y""")
def a25_prediction_scores(spark, sf_dir):
    s = matches.score_predictions(predictions(spark, sf_dir), "chance", "won")
    return s.select("n", *[F.round(c, 4).alias(c) for c in ("brier", "log_loss", "favourite_won")])


@query(f"""WITH {PRED_SQL} SELECT CAST(least(floor((greatest(chance, 1 - chance) - 0.5) * 10), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(greatest(chance, 1 - chance)), 4) AS mean_chance,
    round(avg(CASE WHEN chance >= 0.5 THEN CAST(won AS DOUBLE) ELSE 1 - CAST(won AS DOUBLE) END), 4) AS won FROM pp GROUP BY 1""")
def a25_calibration_bins(spark, sf_dir):
    return matches.calibration(predictions(spark, sf_dir), "chance", "won").select("bin", "n", F.round("mean_chance", 4).alias("mean_chance"), F.round("won", 4).alias("won"))


@query()
def m2_glicko_ratings(spark, sf_dir):
    """Monthly ratings over all confirmed matches; tests hold the step against a published example."""
    g = matches.glicko(folded(spark, sf_dir).where("confirmed"))
    return g.select("player_id", "month", *[F.round(c, 4).alias(c) for c in ("rating", "deviation", "volatility")])


@query()
def m3b_point_ratings(spark, sf_dir):
    """Strengths from points; tests hold them against a direct fit."""
    t = matches.bradley_terry(folded(spark, sf_dir).where("confirmed"))
    return t.select("player_id", F.round("theta", 4).alias("theta"), F.round("se", 4).alias("se"), F.col("points").cast("long").alias("points"))


@query(f"""WITH {FOLD_SQL}, t AS (SELECT winner AS player_id, date_trunc('month', played) AS mo, high - low AS d FROM m UNION ALL SELECT loser, date_trunc('month', played), low - high FROM m),
mm AS (SELECT player_id, CAST(mo + INTERVAL 1 MONTH AS DATE) AS month, round(avg(d), 4) AS form FROM t GROUP BY ALL)
SELECT match_id, winner, loser, form AS loser_form FROM m LEFT JOIN mm ON mm.player_id = m.loser AND mm.month = CAST(date_trunc('month', m.played) AS DATE)""")
def j6_strength_going_in(spark, sf_dir):
    """Each match with the loser's form of the month before."""
    m = folded(spark, sf_dir)
    t = m.select(F.col("winner").alias("player_id"), "played", (F.col("high") - F.col("low")).alias("d")).union(m.select("loser", "played", F.col("low") - F.col("high")))
    mm = t.groupBy("player_id", F.add_months(F.trunc("played", "MM"), 1).alias("month")).agg(F.round(F.avg("d"), 4).alias("form"))
    j = temporal.month_before(m, mm.withColumnRenamed("player_id", "loser"), "loser", "played", "month", "form")
    return j.select("match_id", "winner", "loser", F.col("form").alias("loser_form"))


@query(f"""WITH {FOLD_SQL}, k AS (SELECT *, least(winner, loser) AS p, greatest(winner, loser) AS q FROM m), held AS (SELECT DISTINCT p, q, high, low FROM k WHERE match_id % 5 = 0), n AS (SELECT * FROM k WHERE match_id % 5 <> 0)
SELECT n.match_id, n.winner, n.loser, CASE WHEN h.p IS NOT NULL THEN 'on record' WHEN row_number() OVER (PARTITION BY n.p, n.q, n.high, n.low ORDER BY n.match_id, n.winner) > 1 THEN 'repeated in file' ELSE 'new' END AS state FROM n LEFT JOIN held h ON h.p = n.p AND h.q = n.q AND h.high = n.high AND h.low = n.low""")
def p15_repeated_results(spark, sf_dir):
    """Results of a file (four fifths) against those on record (the rest)."""
    m = folded(spark, sf_dir).withColumn("p", F.least("winner", "loser")).withColumn("q", F.greatest("winner", "loser")).withColumn("line", F.struct("match_id", "winner"))
    d = matches.duplicates_of_record(m.where("match_id % 5 <> 0"), m.where("match_id % 5 = 0"), ["p", "q", "high", "low"], "line")
    return d.select("match_id", "winner", "loser", "state")


@query(f"""WITH {ad.RESULTS} SELECT match_id, a, b, played, points_a AS won, points_b AS lost FROM results UNION ALL SELECT match_id, b, a, played, points_b, points_a FROM results""")
def p14_mirrored_records(spark, sf_dir):
    r = ad.results(spark, sf_dir)
    one = r.select("match_id", "a", "b", "played", F.col("points_a").alias("won"), F.col("points_b").alias("lost"))
    return one.union(r.select("match_id", F.col("b").alias("a"), F.col("a").alias("b"), "played", "points_b", "points_a"))


GAME_SQL = """g AS (SELECT o_orderkey AS id, '11-' || (o_orderkey % 9) || ' ' || (5 + o_custkey % 8) || '-11 11-' || (o_custkey % 10) || CASE WHEN o_orderkey % 4 = 0 THEN ' 9-11' ELSE '' END AS score FROM orders)"""


@query(f"""WITH {GAME_SQL}, p AS (SELECT id, list_transform(regexp_extract_all(score, '(\\d+)-(\\d+)'), lambda t: [CAST(split_part(t, '-', 1) AS INTEGER), CAST(split_part(t, '-', 2) AS INTEGER)]) AS games FROM g),
w AS (SELECT id, games, len(list_filter(games, lambda x: x[1] > x[2])) AS won, len(list_filter(games, lambda x: x[1] < x[2])) AS lost,
    len(list_filter(games, lambda x: NOT (greatest(x[1], x[2]) >= 11 AND abs(x[1] - x[2]) >= 2 AND (greatest(x[1], x[2]) = 11 OR abs(x[1] - x[2]) = 2)))) AS unfinished FROM p)
SELECT id, CAST(won AS INTEGER) AS won, CAST(lost AS INTEGER) AS lost, CAST(list_sum(list_transform(games, lambda x: x[1])) AS BIGINT) AS points,
    concat_ws('; ', CASE WHEN unfinished > 0 THEN 'a game isn''t finished' END, CASE WHEN won = lost THEN 'undecided' END, CASE WHEN won <> lost AND (won > lost) <> (games[-1][1] > games[-1][2]) THEN 'games after the decider' END, CASE WHEN greatest(won, lost) NOT IN (2, 3, 4) THEN 'no known length' END) AS problems FROM w""")
def p13_game_scores(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    s = F.concat(F.lit("11-"), (F.col("o_orderkey") % 9).cast("string"), F.lit(" "), (5 + F.col("o_custkey") % 8).cast("string"), F.lit("-11 11-"), (F.col("o_custkey") % 10).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, " 9-11").otherwise(""))
    g = o.select(F.col("o_orderkey").alias("id"), matches.parse_games(s).alias("games"))
    return g.select("id", F.size(F.filter("games", lambda x: x["won"] > x["lost"])).alias("won"), F.size(F.filter("games", lambda x: x["won"] < x["lost"])).alias("lost"), F.aggregate("games", F.lit(0).cast("long"), lambda a, x: a + x["won"]).alias("points"), F.concat_ws("; ", matches.game_problems(F.col("games"))).alias("problems"))


@query("""SELECT s_suppkey AS player_id, round(10.0 ** 0, 1) AS unit, round(1 / (1 + 10.0 ** (-(1 / sqrt(1 + 3 * (ln(10) / 400) ** 2 * (80.0 ** 2 + 50.0 ** 2) / pi() ** 2)) * (s_acctbal / 10 - 500) / 400)), 6) AS chance FROM supplier""")
def f15_win_chance(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("player_id"), F.lit(1.0).alias("unit"), F.round(win_chance(F.col("s_acctbal") / 10, F.lit(80.0), F.lit(500.0), F.lit(50.0)), 6).alias("chance"))


def _set_sql(p: str, points: int = 11) -> str:
    import math

    wins = " + ".join(f"{math.comb(points - 1 + k, k)} * pow({p}, {points}) * pow(1 - {p}, {k})" for k in range(points - 1))
    return f"({wins} + {math.comb(2 * points - 2, points - 1)} * pow({p}, {points - 1}) * pow(1 - {p}, {points - 1}) * {p} * {p} / ({p} * {p} + (1 - {p}) * (1 - {p})))"


@query(f"""WITH s AS (SELECT s_suppkey AS player_id, 0.35 + (s_suppkey % 31) / 100.0 AS p FROM supplier), t AS (SELECT player_id, {_set_sql('p')} AS s FROM s)
SELECT player_id, round(s, 6) AS set_chance, round(pow(s, 3) + 3 * pow(s, 3) * (1 - s) + 6 * pow(s, 3) * pow(1 - s, 2), 6) AS match_chance FROM t""")
def f15_set_and_match_chance(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), set_chance(0.35 + (F.col("s_suppkey") % 31) / 100.0).alias("s"))
    return s.select("player_id", F.round("s", 6).alias("set_chance"), F.round(match_chance(F.col("s")), 6).alias("match_chance"))


@query(f"""WITH {FOLD_SQL}, s AS (SELECT winner AS p FROM m WHERE confirmed UNION ALL SELECT loser FROM m WHERE confirmed), t AS (SELECT p AS player_id, count(*) AS shown, p % 2 AS gender FROM s GROUP BY p)
SELECT player_id, gender, place FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY shown DESC, player_id) AS place FROM t) WHERE place <= 10""")
def t2_strongest(spark, sf_dir):
    """The ten of each gender with the most confirmed matches."""
    from pyspark.sql import Window

    m = folded(spark, sf_dir).where("confirmed")
    n = m.select(F.explode(F.array("winner", "loser")).alias("player_id")).groupBy("player_id").agg(F.count("*").alias("shown")).withColumn("gender", F.col("player_id") % 2)
    return n.withColumn("place", F.row_number().over(Window.partitionBy("gender").orderBy(F.desc("shown"), "player_id"))).where("place <= 10").select("player_id", "gender", "place")
