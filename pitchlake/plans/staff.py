"""Queries on loading (trees, caches, spreadsheets), arriving readings, and pages for staff."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import feed, people, seasons, temporal
from ..session import shared_folder
from ..sources import io
from ..streaming import jobs
from . import adapters as ad
from . import growth, league
from .feeds import FEED_SQL, flat
from .growth import LATEST_SQL, ON, cards, reference_date
from .league import FLAG_SQL, TEAM_SQL, _pct_sql, flag_rows, last, teams

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def own_folder(spark) -> str:
    return f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"


# --- loading --------------------------------------------------------------------------------


def write_tree(spark, sf_dir, folder):
    """The events as a provider's tree: matches by competition, lineups and events by match."""
    e, shot = flat(spark, sf_dir), F.col("type") == "Shot"
    of = lambda c: F.struct(F.col(c).cast("long").alias("id"))
    name = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name")))
    nested = e.select(
        "match_id", F.col("event_id").cast("string").alias("id"), name("type").alias("type"), "period", "minute", F.lit(0).alias("second"), of("team_id").alias("team"), of("player_id").alias("player"), of("possession_team_id").alias("possession_team"), "duration",
        F.when(shot, F.struct(name("outcome").alias("outcome"), name("kind").alias("type"), "xg", F.col("key_pass_id").cast("string").alias("key_pass_id"))).alias("shot"),
        F.when(F.col("type") == "Pass", F.struct(name("outcome").alias("outcome"), name("kind").alias("type"), "goal_assist")).alias("pass"),
    )
    io.write_pages(nested, f"{folder}/events", "match_id", "id")
    squads = e.select("match_id", "team_id", "player_id").distinct().groupBy("match_id", "team_id").agg(F.collect_list(F.struct("player_id")).alias("lineup"))
    io.write_pages(squads, f"{folder}/lineups", "match_id", "team_id")
    matches = e.select("match_id").distinct().select((F.col("match_id") % 3).alias("folder"), (F.col("match_id") % 3).alias("competition_id"), F.col("match_id").alias("id"))
    io.write_pages(matches, f"{folder}/matches", "folder", "id")


@query(f"""WITH {FEED_SQL}, x AS (SELECT match_id, player_id, count(*) FILTER (type = 'Shot') AS shots, count(*) FILTER (type = 'Shot' AND outcome = 'Goal') AS goals, count(*) FILTER (type = 'Pass' AND coalesce(kind, '') <> 'Throw-in') AS passes FROM feed GROUP BY ALL)
SELECT 'feed' AS source, match_id::BIGINT AS match_id, player_id, shots, goals, passes FROM x WHERE match_id % 3 <> 2 UNION ALL SELECT 'staff', match_id, player_id, 0, 0, shots FROM x WHERE player_id % 10 = 0""")
def s3_event_tree(spark, sf_dir):
    """The events written as a provider's tree and read again; lines of the matches of two
    competitions loaded twice beside another source's, which stay."""
    folder = own_folder(spark)
    write_tree(spark, sf_dir, folder)
    tree = io.read_event_tree(spark, folder)
    wanted = tree["matches"].where(F.col("competition_id") != 2).select(F.col("id").cast("long").alias("match_id"))
    lines = feed.player_lines(feed.flatten(tree["events"].join(wanted, "match_id", "left_semi")))
    own = lines.select("match_id", "player_id", "shots", "goals", "passes", F.lit("feed").alias("source"))
    e = flat(spark, sf_dir).where("player_id % 10 = 0").groupBy(F.col("match_id").cast("long").alias("match_id"), "player_id")
    staff = e.agg(F.lit(0).cast("long").alias("shots"), F.lit(0).cast("long").alias("goals"), F.count(F.when(F.col("type") == "Shot", 1)).alias("passes")).withColumn("source", F.lit("staff"))
    for rows in (staff, own.withColumn("shots", F.lit(-1).cast("long")), own, own):
        io.replace_source(rows, f"{folder}/table")
    return spark.read.parquet(f"{folder}/table").select("source", "match_id", "player_id", "shots", "goals", "passes")


@query(f"""WITH {ad.SEASONS}, y AS (SELECT max(year) AS last FROM seasons), p AS (SELECT year AS season, player_id, CASE WHEN player_id % 17 = 0 THEN 'Coach' ELSE 'Forward' END AS position, CASE WHEN player_id % 19 = 0 THEN 0 ELSE minutes END AS minutes, CASE WHEN player_id % 13 <> 0 THEN npxg END AS npxg FROM seasons, y WHERE year < last)
SELECT 'season=' || season AS season, player_id, CASE WHEN player_id % 2 = 0 THEN 'held-' || player_id ELSE left(sha256('provider|' || player_id), 32) END AS id, CASE WHEN position = 'Coach' THEN 'coach' WHEN minutes = 0 THEN 'no minutes' WHEN npxg IS NULL THEN 'npxg missing' END AS reason, round(npxg, 4) AS npxg FROM p""")
def s4_provider_seasons(spark, sf_dir):
    """Seasons as a provider's pages, the last one without its teams, so it isn't loaded; each
    row with its id, a held player's or a made one, and the reason that rejects it."""
    folder, s = own_folder(spark), ad.seasons(spark, sf_dir)
    k = F.col("player_id")
    players = s.select(F.col("year").alias("season"), "player_id", F.when(k % 17 == 0, "Coach").otherwise("Forward").alias("position"), F.when(k % 19 == 0, 0).otherwise(F.col("minutes")).alias("minutes"), F.when(k % 13 == 0, -1.0).otherwise(F.col("npxg")).alias("npxg"))
    clubs = s.select(F.col("year").alias("season"), "club").distinct()
    latest = s.agg(F.max("year").alias("season"))
    io.write_pages(players, f"{folder}/players", "season", "player_id", "data")
    io.write_pages(clubs, f"{folder}/matches", "season", "club", "data")
    io.write_pages(clubs.join(latest, "season", "left_anti"), f"{folder}/teams", "season", "club", "data")
    rows = io.provider_season(io.read_provider_cache(spark, folder, paged=True)["players"], ["npxg"], "minutes", "position")
    supplier = ad.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("_s"))
    held = supplier.select(F.create_map(F.lit("provider"), "_s").alias("external_ids"), F.concat(F.lit("held-"), "_s").alias("id"))
    out = io.resolve_external(rows.withColumn("key", F.col("player_id").cast("string")), held, "key", "provider")
    return out.select("season", "player_id", "id", "reason", F.round("npxg", 4).alias("npxg"))


CELLS = """cells AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN '=SUM(A1)' ELSE c_name END AS full_name, CASE WHEN c_custkey % 17 = 0 THEN '2010-13-02' ELSE strftime(DATE '2005-01-01' + CAST(c_custkey % 3000 AS INTEGER), '%Y-%m-%d') END AS born,
    CASE WHEN c_custkey % 11 = 0 THEN 'perhaps' WHEN c_custkey % 3 = 0 THEN 'No' WHEN c_custkey % 3 = 1 THEN 'yes' END AS guardian, CASE WHEN c_custkey % 23 = 0 THEN 'tall' WHEN c_custkey % 5 > 0 THEN '1' || (40 + c_custkey % 50) || ',5' END AS height, CASE WHEN c_custkey % 29 > 0 THEN '2024-01-01' END AS measured FROM customer)"""


@query(f"""WITH {CELLS} SELECT k AS line, CASE WHEN regexp_matches(full_name, '^[=+@-][^0-9]') THEN 'rejected' WHEN try_cast(born AS DATE) IS NULL THEN 'rejected' WHEN height IS NOT NULL AND (try_cast(replace(height, ',', '.') AS DOUBLE) IS NULL OR measured IS NULL) THEN 'rejected' WHEN lower(guardian) NOT IN ('yes', 'no', 'true', 'false') THEN 'confirm' ELSE 'ready' END AS verdict,
    try_cast(replace(height, ',', '.') AS DOUBLE) AS height FROM cells""")
def p5_import_rows(spark, sf_dir):
    """A spreadsheet with ';' and loose headers, written and read again, with each row's verdict."""
    k, path = F.col("c_custkey"), f"{own_folder(spark)}/people"
    cells = ad.table(spark, sf_dir, "customer").select(
        k.alias("LINE"), F.when(k % 13 == 0, "=SUM(A1)").otherwise(F.col("c_name")).alias("Full Name"), F.when(k % 17 == 0, "2010-13-02").otherwise(F.date_add(F.lit("2005-01-01").cast("date"), (k % 3000).cast("int")).cast("string")).alias("Date-of-Birth"),
        F.when(k % 11 == 0, "perhaps").when(k % 3 == 0, "No").when(k % 3 == 1, "yes").alias("Guardian "), F.when(k % 23 == 0, "tall").when(k % 5 > 0, F.concat(F.lit("1"), (40 + k % 50).cast("string"), F.lit(",5"))).alias("Height"), F.when(k % 29 > 0, "2024-01-01").alias("measured on"),
    )
    cells.write.option("header", True).option("sep", ";").csv(path)
    names = ["line", "full_name", "date_of_birth", "guardian", "height", "measured_on"]
    rows = io.read_people(spark, path, names, names[:3])
    verdict = io.import_verdict({c: F.col(c) for c in names[1:]}, "date_of_birth", "guardian", "height", "measured_on")
    return rows.select(F.col("line").cast("long").alias("line"), verdict.alias("verdict"), F.regexp_replace("height", ",", ".").try_cast("double").alias("height"))


@query(f"""WITH {ad.READINGS}, p AS (SELECT *, lag(measured_at) OVER w AS pd, lag(value) OVER w AS pv FROM readings WINDOW w AS (PARTITION BY player_id ORDER BY measured_at, reading_id)),
f AS (SELECT reading_id, reading_id = last_value(reading_id) OVER (PARTITION BY player_id ORDER BY measured_at, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_last FROM readings WHERE measured_at < DATE '1996-01-01')
SELECT reading_id, concat_ws(',', CASE WHEN NOT value BETWEEN 110 AND 210 THEN 'unusual' END, CASE WHEN value - pv < -1.5 THEN 'drop' END, CASE WHEN (value - pv) / greatest((measured_at - pd) / 30.44, 1.0) > 2.5 THEN 'fast gain' END) AS warnings FROM p
UNION ALL SELECT reading_id, CASE WHEN is_last THEN 'repeated' ELSE 'late' END FROM f WHERE reading_id % 50 = 0""")
def st3_arriving_readings(spark, sf_dir):
    """All readings as a stream in two arrivals, the second with some of the first's again: the
    warnings are those of the batch form, the rows that come again are late or repeated."""
    folder = own_folder(spark)
    r = ad.readings(spark, sf_dir).select("reading_id", "player_id", "measured_at", "value")
    early = F.col("measured_at") < "1996-01-01"
    for rows in (r.where(early), r.where(~early | (F.col("reading_id") % 50 == 0))):
        rows.write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(r.schema).parquet(f"{folder}/in")
        writer = arriving.writeStream.foreachBatch(jobs.reading_sink(folder, 110, 210)).option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("reading_id", F.concat_ws(",", "warnings").alias("warnings"))


# --- pages for staff ------------------------------------------------------------------------


@query(f"""WITH {TEAM_SQL}, v AS (SELECT club, competition, year, goals * 1.0 / minutes AS value FROM teams), r AS (SELECT *, count(*) OVER (PARTITION BY year) AS n, rank() OVER (PARTITION BY year ORDER BY value DESC) AS rank FROM v),
needs AS (SELECT club, competition, year, unnest([0, 1]) AS grp FROM r WHERE n >= 8 AND rank > 2 * n / 3.0), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY year DESC, minutes DESC, club) AS r FROM seasons) WHERE r = 1),
pct AS (SELECT *, {_pct_sql('goals', 'competition, year, grp')} AS p1, {_pct_sql('npxg', 'competition, year, grp')} AS p2 FROM last), m AS (SELECT *, round_even((p1 + p2) / 2.0, 1) AS mean FROM pct WHERE p1 IS NOT NULL AND p2 IS NOT NULL),
c AS (SELECT n.club AS for_club, m.year, m.grp, m.player_id, m.club, m.mean, row_number() OVER (PARTITION BY n.club, m.competition, m.year, m.grp ORDER BY mean DESC, minutes DESC, player_id) AS place FROM m JOIN needs n ON m.competition = n.competition AND m.year = n.year AND m.grp = n.grp AND m.club <> n.club)
SELECT * FROM c WHERE place <= 3""")
def t1_club_candidates(spark, sf_dir):
    """Whom clubs that are weak in goals could look at in their own league, by two groups."""
    t = teams(spark, sf_dir)
    long = seasons.melt(t.withColumn("goals", F.col("goals") / F.col("minutes")), ["club", "competition", "year"], ["goals"])
    weak = seasons.team_profile(long, ["year"], "metric", "value", [], ["goals"]).where("weak")
    needs = weak.select("club", "competition", "year", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("grp"))
    c = seasons.club_candidates(last(spark, sf_dir), needs, ["competition", "year"], "grp", "club", "player_id", ["goals", "npxg"], "minutes", 3)
    return c.select("for_club", "year", "grp", "player_id", "club", "mean", "place")


@query(f"""WITH {LATEST_SQL}, d AS (SELECT max(measured_at) AS ref FROM readings), s AS (SELECT player_id, min(measured_at) AS since FROM readings GROUP BY 1)
SELECT tier, count(*) AS total, count(*) FILTER (age < 21) AS under_21, count(*) FILTER (ref - since < 30) AS new_this_month, coalesce(round(100.0 * count(*) FILTER (age < 18 AND ref - measured_at > 180) / nullif(count(*) FILTER (age < 18), 0), 1), 0.0) AS stale_pct FROM cards JOIN s USING (player_id), d GROUP BY 1""")
def a15_tier_totals(spark, sf_dir):
    """The association's totals by tier, those abroad being one of them."""
    r = ad.readings(spark, sf_dir)
    on = reference_date(r)
    since = r.groupBy("player_id").agg(F.min("measured_at").alias("since"))
    c = cards(spark, sf_dir).join(since, "player_id")
    return people.tier_totals(c, "tier", "age", F.datediff(on, "since"), F.datediff(on, "measured_at") > 180, F.col("age") < 18)


@query(f"""WITH {ad.SPELLS}, {FLAG_SQL}, o AS (SELECT player_id, organization_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY start_date DESC, spell_id) AS r FROM spells WHERE end_date IS NULL) WHERE r = 1),
c AS (SELECT player_id FROM spells WHERE start_date <= DATE '{ON}' AND (end_date IS NULL OR end_date >= DATE '{ON}') GROUP BY 1 HAVING bool_or(granted AND purpose = '1') AND bool_or(granted AND purpose IN ('2', '3'))),
f AS (SELECT player_id, count(*) AS n FROM flags WHERE status IN ('open', 'in_review') GROUP BY 1)
SELECT organization_id, count(*) AS players, round(100.0 * count(c.player_id) / count(*), 1) AS consent_pct, CAST(coalesce(sum(n), 0) AS BIGINT) AS open_flags FROM o LEFT JOIN c USING (player_id) LEFT JOIN f USING (player_id) GROUP BY 1""")
def a17_organization_state(spark, sf_dir):
    s = ad.spells(spark, sf_dir)
    current = temporal.current_spell(s, "player_id", "start_date", "end_date", "spell_id").select("player_id", "organization_id")
    purpose = F.when(F.col("purpose") == "1", "storage").when(F.col("purpose").isin("2", "3"), "analytics").otherwise("other")
    c = s.withColumnsRenamed({"start_date": "valid_from", "end_date": "valid_until"}).withColumn("purpose", purpose)
    complete = temporal.consent_state(c, F.lit(ON).cast("date"), ["storage", "analytics"], ["storage", "analytics"]).where("complete")
    return people.organization_state(current, complete, flag_rows(spark, sf_dir).where("status in ('open', 'in_review')"), "organization_id", "player_id")


@query(f"""WITH v AS ({growth.ORACLE["j1_consent_in_effect"]}), s AS (SELECT DISTINCT user_id % 20 AS scout, event_id % 2000 AS player_id FROM events WHERE event_type = 'click')
SELECT scout, count(v.player_id) AS shown, count(*) - count(v.player_id) AS withheld FROM s LEFT JOIN v USING (player_id) GROUP BY 1""")
def t7_shortlist(spark, sf_dir):
    """How many of the players that each scout saved may be shown."""
    saved = ad.table(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("user_id") % 20).alias("scout"), (F.col("event_id") % 2000).alias("player_id"))
    return people.shortlist(saved, growth.j1_consent_in_effect(spark, sf_dir), "scout", "player_id")


@query(f"""WITH v AS ({growth.ORACLE["j1_consent_in_effect"]}), b AS ({league.ORACLE["w12_breakouts"]}), d AS (SELECT max(year) AS ref FROM b)
SELECT player_id, year, score FROM b SEMI JOIN v USING (player_id), d WHERE year = ref AND outcome = 'breakout' ORDER BY score DESC, player_id LIMIT 6""")
def t7_breakouts(spark, sf_dir):
    """A page of the latest season's breakouts whose players agreed to analyses, best first."""
    b = league.w12_breakouts(spark, sf_dir)
    latest = b.agg(F.max("year").alias("year"))
    seen = b.join(F.broadcast(latest), "year").where("outcome = 'breakout'").join(growth.j1_consent_in_effect(spark, sf_dir), "player_id", "left_semi")
    return seen.select("player_id", "year", "score").orderBy(F.desc("score"), "player_id").limit(6)


@query(f"""WITH {ad.PLAYERS}, {ad.SPELLS}, k AS (SELECT player_id FROM players WHERE player_id % 11 <> 0)
SELECT 'scout' AS role, player_id FROM k UNION ALL SELECT 'coach', player_id FROM k SEMI JOIN (SELECT player_id FROM spells WHERE organization_id = 12 AND end_date IS NULL) USING (player_id) UNION ALL SELECT 'player', player_id FROM k WHERE player_id = 12""")
def j3_scopes(spark, sf_dir):
    """What a scout, a coach with a squad and without, a player and an unknown role see."""
    p, merged = ad.players(spark, sf_dir), F.col("player_id") % 11 == 0
    squad = ad.spells(spark, sf_dir).where("organization_id = 12 and end_date is null")
    scopes = {"scout": ("all", None), "coach": ("own", squad), "coach without a club": ("own", None), "player": ("own", p.where("player_id = 12")), "guest": ("none", squad)}
    out = None
    for role, (scope, own) in scopes.items():
        rows = people.visible(p, scope, own, "player_id", merged).select(F.lit(role).alias("role"), "player_id")
        out = rows if out is None else out.union(rows)
    return out
