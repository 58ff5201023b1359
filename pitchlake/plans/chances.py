"""Queries of shots' features and chances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.match import shot_geometry
from ..operators import shots
from . import adapters as ad

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _pick_sql(names, k: str) -> str:
    return f"([{', '.join(repr(n) for n in names)}])[CAST({k} % {len(names)} AS INTEGER) + 1]"


BODY, TYPE = ("Right Foot", "Head", "Left Foot", "Chest"), ("Open Play", "Free Kick", "Corner", "Kick Off")
HOW, PLAY = ("Normal", "Half Volley", "Diving Header", "Scissors"), ("Regular Play", "From Counter", "From Throw In", "Other")
HEIGHT = ("Ground Pass", "Low Pass", "High Pass", "Unknown")


def events(spark, sf_dir):
    """Purchases and clicks as shots, each set up by the event before it (every third by none)."""
    k = F.col("event_id")
    frame = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((100.0 + (k * 7 + i * 13) % 20).alias("x"), (20.0 + (k * 11 + i * 17) % 40).alias("y"), (i % 3 == 0).alias("teammate"), ((i == 5) & (k % 4 != 0)).alias("keeper")))
    e = ad.table(spark, sf_dir, "events")
    passes = e.select(k.alias("pass_id"), F.lit(None).cast("string").alias("technique"), _pick(HEIGHT, k).alias("height"), (k % 11 == 0).alias("through_ball"), (k % 13 == 0).alias("cut_back"), (k % 5 == 0).alias("cross"))
    taken = e.where("event_type in ('purchase', 'click')").select(
        "event_id", F.to_date("ts").alias("match"), (F.col("value") < 12).alias("goal"), (k % 40 == 0).alias("penalty"), F.when(k % 3 > 0, k - 1).alias("key_pass"),
        shots.body_part(_pick(BODY, k)).alias("body_part"), shots.shot_type(_pick(TYPE, F.floor(k / 2))).alias("shot_type"), shots.technique(_pick(HOW, F.floor(k / 3))).alias("technique"), shots.pattern(_pick(PLAY, F.floor(k / 5))).alias("pattern"),
        shot_geometry(95.0 + k % 25, 25.0 + k % 31, frame).alias("g"), *[(k % m == 0).cast("double").alias(c) for m, c in ((3, "under_pressure"), (5, "first_time"), (17, "one_on_one"), (29, "open_goal"), (7, "follows_dribble"))],
    )
    return shots.with_assists(taken, passes, "key_pass", "pass_id").select("*", "g.*").drop("g")


@query(f"""WITH s AS (SELECT event_id AS k, CASE WHEN event_id % 3 > 0 THEN event_id - 1 END AS p FROM events WHERE event_type IN ('purchase', 'click')), j AS (SELECT s.k, e.event_id AS p FROM s LEFT JOIN events e ON e.event_id = s.p),
b AS (SELECT *, {_pick_sql(BODY, 'k')} AS body, {_pick_sql(TYPE, '(k // 2)')} AS kind, {_pick_sql(HOW, '(k // 3)')} AS how, {_pick_sql(PLAY, '(k // 5)')} AS play, {_pick_sql(HEIGHT, 'p')} AS height FROM j)
SELECT k AS event_id, CASE body WHEN 'Head' THEN 'head' WHEN 'Chest' THEN 'other' ELSE 'foot' END AS body_part, CASE kind WHEN 'Free Kick' THEN 'free_kick' WHEN 'Corner' THEN 'corner' ELSE 'open_play' END AS shot_type,
    CASE how WHEN 'Half Volley' THEN 'half_volley' WHEN 'Diving Header' THEN 'diving_header' ELSE 'normal' END AS technique, CASE play WHEN 'From Counter' THEN 'counter' WHEN 'From Throw In' THEN 'throw_in' WHEN 'Regular Play' THEN 'regular' ELSE 'other' END AS pattern,
    CASE WHEN p IS NULL THEN 'none' WHEN p % 11 = 0 THEN 'through_ball' WHEN p % 13 = 0 THEN 'cut_back' WHEN p % 5 = 0 THEN 'cross' WHEN height = 'Low Pass' THEN 'low' WHEN height = 'High Pass' THEN 'high' ELSE 'ground' END AS assist FROM b""")
def f14_shot_categories(spark, sf_dir):
    """What kind of shot, and how it was set up, read from a provider's names."""
    return events(spark, sf_dir).select("event_id", *shots.CATEGORIES)


#: The query chooses between two ridges; boosted settings (``shots.SETTINGS``) are for a job of its own.
SETTINGS = shots.SETTINGS[:2]


@query()
def m9_shot_chances(spark, sf_dir):
    """Chances of all shots: the better of two models by folds of matches, penalties at their own rate."""
    e, hot = shots.one_hot(events(spark, sf_dir))
    numbers = [F.col(c).cast("double").alias(c) for c in shots.NUMBERS]
    rows = e.select("event_id", F.col("match").cast("string").alias("match"), F.col("goal").cast("int").alias("goal"), "penalty", *numbers, *hot)
    scored, _ = shots.shot_chances(rows, "match", [*shots.NUMBERS, *hot], "goal", F.col("event_id") % 10 < 8, F.col("penalty"), SETTINGS, 3)
    return scored.select("event_id", "goal", "penalty", F.round("xg", 6).alias("xg"))
