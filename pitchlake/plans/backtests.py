"""Queries of the decision-moment backtest, as things stood at each cutoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest
from ..session import cut
from . import adapters as ad
from .growth import HEIGHT_FLOOR

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sql(dataset: str) -> str:
    """Common table expressions up to ``judged``; ``dataset`` parts the readings."""

    def reference(name: str, rows: str, keys: str) -> str:
        return f"""{name}_b AS (SELECT {keys}, sex, CAST(round_even(age, 0) AS INTEGER) AS a, value FROM {rows}),
{name} AS (SELECT {keys}, sex, a, median(value) AS m, greatest(stddev_pop(value), {HEIGHT_FLOOR}) AS s FROM (SELECT {keys}, sex, unnest([a - 1, a, a + 1]) AS a, value FROM {name}_b) x SEMI JOIN (SELECT DISTINCT {keys}, sex, a FROM {name}_b) y USING ({keys}, sex, a) GROUP BY ALL HAVING count(*) >= 5)"""

    return f"""{ad.READINGS}, rd AS (SELECT *, {dataset} AS dataset FROM readings),
ends AS (SELECT min(measured_at) + 365 AS a, max(measured_at) - 365 AS b FROM readings), cs AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 91 DAY)) AS DATE) AS cutoff FROM ends WHERE a <= b),
seen AS (SELECT cutoff, rd.* FROM rd JOIN cs ON measured_at <= cutoff), {reference('ref', 'seen', 'cutoff, dataset')}, {reference('whole', 'rd', 'dataset')},
z AS (SELECT seen.*, (value - m) / s AS z FROM seen JOIN ref ON seen.cutoff = ref.cutoff AND seen.dataset = ref.dataset AND seen.sex = ref.sex AND CAST(round_even(age, 0) AS INTEGER) = a),
zs AS (SELECT cutoff, player_id, arg_max(z, (measured_at, value)) AS last_z, avg(z) AS mean_z, count(*) AS readings FROM z GROUP BY ALL),
days AS (SELECT cutoff, max(measured_at) AS today FROM seen GROUP BY 1),
sp AS (SELECT cutoff, dataset, sex, player_id, date_of_birth AS born, today, max(measured_at) AS last_date, min((measured_at, value)) FILTER (today - measured_at <= 400) AS ra, max((measured_at, value)) FILTER (today - measured_at <= 400) AS rb, count(*) FILTER (today - measured_at <= 400) AS rn FROM seen JOIN days USING (cutoff) GROUP BY ALL),
snap AS (SELECT sp.*, last_z, mean_z, readings, date_diff('day', born, today) / 365.25 AS stated_age, date_diff('day', born, cutoff) / 365.25 AS age, CASE WHEN rn < 2 OR rb[1] - ra[1] < 60 THEN 0.0 ELSE (rb[2] - ra[2]) / ((rb[1] - ra[1]) / 365.25) END AS recent_velocity FROM sp JOIN zs USING (cutoff, player_id)),
el AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY cutoff, dataset, sex) AS n FROM snap WHERE cutoff - last_date <= 183 AND age >= 12 AND age < 16 WINDOW w AS (PARTITION BY cutoff, dataset, sex ORDER BY last_z, player_id)),
decided AS (SELECT *, CASE WHEN readings < 3 THEN 'too few readings' WHEN NOT stated_age BETWEEN 11 AND 18.5 THEN 'age' WHEN mean_z > -0.9 THEN 'not short enough on average' WHEN recent_velocity < 3 THEN 'not growing fast yet' END AS reason
    FROM el WHERE n >= 4 AND r <= greatest(1, floor(n * 0.25)) QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY cutoff) = 1),
hind AS (SELECT d.player_id, arg_max((r.value - m) / s, (measured_at, value)) FILTER (measured_at <= cutoff) AS z0, arg_max((r.value - m) / s, (measured_at, value)) FILTER (measured_at - cutoff >= 365) AS z1
    FROM decided d JOIN rd r USING (player_id) JOIN whole w ON w.dataset = r.dataset AND w.sex = r.sex AND w.a = CAST(round_even(r.age, 0) AS INTEGER) GROUP BY 1),
judged AS (SELECT d.*, reason IS NULL AS flagged, z1 - z0 AS z_change, z1 - z0 >= 0.5 AS caught_up FROM decided d LEFT JOIN hind USING (player_id))"""


def judged(spark, sf_dir, dataset):
    r = ad.readings(spark, sf_dir).withColumn("dataset", dataset)
    groups = ["dataset", "sex"]
    then = cut(backtest.snapshots(r, backtest.cutoffs(r, "measured_at"), groups, "player_id", "measured_at", "value", "date_of_birth", HEIGHT_FLOOR))
    return backtest.outcomes(backtest.decisions(then, groups, "player_id"), r, groups, "player_id", "measured_at", "value", HEIGHT_FLOOR)


@query(f"WITH {_sql('0')} SELECT player_id, cutoff, sex, readings, flagged, reason, round(z_change, 4) AS z_change, caught_up FROM judged")
def d17_decision_backtest(spark, sf_dir):
    """Each player first cut for size: flagged or not, why not, and what came of it."""
    return judged(spark, sf_dir, F.lit(0)).select("player_id", "cutoff", "sex", "readings", "flagged", "reason", F.round("z_change", 4).alias("z_change"), "caught_up")


@query(f"""WITH {_sql('nation % 3')}, c AS (SELECT CAST(dataset AS VARCHAR) AS dataset, count(*) AS decisions, count(*) FILTER (flagged) AS flagged, count(z_change) AS followed, count(*) FILTER (caught_up) AS caught_up, count(*) FILTER (flagged AND caught_up) AS hits, count(*) FILTER (flagged AND NOT caught_up) AS false_alarms FROM judged GROUP BY 1),
e AS (SELECT * FROM c UNION ALL SELECT 'all', {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT)' for c in ('decisions', 'flagged', 'followed', 'caught_up', 'hits', 'false_alarms'))} FROM c), w AS (SELECT *, hits * 1.0 / nullif(caught_up, 0) AS p, 1.96 AS q FROM e)
SELECT dataset, decisions, flagged, followed, caught_up, hits, false_alarms, round((p + q * q / (2 * caught_up) - q * sqrt(p * (1 - p) / caught_up + q * q / (4 * caught_up * caught_up))) / (1 + q * q / caught_up), 4) AS low,
    round((p + q * q / (2 * caught_up) + q * sqrt(p * (1 - p) / caught_up + q * q / (4 * caught_up * caught_up))) / (1 + q * q / caught_up), 4) AS high FROM w""")
def a33_backtest_summary(spark, sf_dir):
    """The backtest's counts by dataset (nations modulo three) and pooled, with Wilson's interval."""
    return backtest.summary(judged(spark, sf_dir, F.col("nation") % 3), "dataset").withColumns({c: F.round(c, 4) for c in ("low", "high")})
