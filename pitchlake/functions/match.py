"""Match clocks, seasons, shot geometry and chances."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(clock: Column) -> Column:
    """Seconds of a clock 'mm:ss' or 'hh:mm:ss'; null if it isn't one."""
    p = F.transform(F.split(clock, ":"), lambda x: x.try_cast("double"))
    return F.when(F.size(p) == 2, F.get(p, F.lit(0)) * 60 + F.get(p, F.lit(1))).when(F.size(p) == 3, F.get(p, F.lit(0)) * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2)))


def stamp_minute(stamp: Column) -> Column:
    """Minute of a stamp such as '46' or '45+2' (the part before the plus)."""
    return F.regexp_extract(stamp, r"^\s*(\d+)", 1).try_cast("int")


def in_first_half(stamp: Column) -> Column:
    """Up to minute 45, stoppage included."""
    return stamp_minute(stamp) <= 45


def epoch_day(seconds: Column) -> Column:
    """UTC date of epoch seconds; 0 and less are unknown."""
    return F.when(seconds > 0, F.to_date(F.timestamp_seconds(seconds)))


def season_label(day: Column, first_month: int = 7) -> Column:
    """'2015/2016' of a date, seasons beginning in ``first_month``."""
    start = F.year(day) - (F.month(day) < first_month).cast("int")
    return F.concat(start.cast("string"), F.lit("/"), (start + 1).cast("string"))


def season_of_text(text: Column) -> Column:
    """The season label named in a text: '2015/2016', '2015/16', or a year alone."""
    long, short, one = r"(\d{4})[/-](\d{4})", r"(\d{4})[/-](\d{2})\b", r"\b(\d{4})\b"
    g = lambda rx, i: F.regexp_extract(text, rx, i)
    return (
        F.when(text.rlike(long), F.concat(g(long, 1), F.lit("/"), g(long, 2)))
        .when(text.rlike(short), F.concat(g(short, 1), F.lit("/"), F.substring(g(short, 1), 1, 2), g(short, 2)))
        .when(text.rlike(one), g(one, 1))
    )


def touch_zone(x: Column, y: Column, columns: int = 12, rows: int = 8, width: float = 120.0, height: float = 80.0) -> Column:
    """Number of the pitch zone of a place, clamped to the grid."""
    c = F.least(F.greatest(F.floor(x / (width / columns)), F.lit(0)), F.lit(columns - 1))
    r = F.least(F.greatest(F.floor(y / (height / rows)), F.lit(0)), F.lit(rows - 1))
    return (c * rows + r).cast("int")


def goal_distance(x: Column, y: Column, goal_x: float = 120.0, goal_y: float = 40.0) -> Column:
    return F.hypot(F.lit(goal_x) - x, F.lit(goal_y) - y)


def goal_angle(x: Column, y: Column, goal_x: float = 120.0, goal_y: float = 40.0, width: float = 8.0) -> Column:
    """Angle in radians under which the goal is seen."""
    ahead, half = F.lit(goal_x) - x, width / 2
    return F.abs(F.atan2(F.lit(goal_y + half) - y, ahead) - F.atan2(F.lit(goal_y - half) - y, ahead))


def in_triangle(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a place lies in a triangle, its sides included."""
    side = lambda p, q: (x - q[0]) * (p[1] - q[1]) - (p[0] - q[0]) * (y - q[1])
    d = [side(corners[i], corners[(i + 1) % 3]) for i in range(3)]
    return ~((F.least(*d) < 0) & (F.greatest(*d) > 0))


def shot_geometry(x: Column, y: Column, frame: Column) -> Column:
    """Distance, goal angle, players and defenders between ball and posts, the keeper's and the
    nearest defender's distance, from the places of the others (x, y, teammate, keeper).

    Without a keeper or defender in the frame they count as far away: 120, 120, 40 and 60.
    """
    corners = [(x, y), (F.lit(120.0), F.lit(36.0)), (F.lit(120.0), F.lit(44.0))]
    far = lambda f: F.hypot(f["x"] - x, f["y"] - y)
    keepers = F.filter(frame, lambda f: ~f["teammate"] & f["keeper"])
    keeper = F.get(keepers, F.lit(0))
    cone = F.filter(frame, lambda f: in_triangle(f["x"], f["y"], corners))
    outfield = F.filter(frame, lambda f: ~f["teammate"] & ~f["keeper"])
    return F.struct(
        goal_distance(x, y).alias("distance"),
        goal_angle(x, y).alias("angle"),
        F.size(cone).alias("players_in_cone"),
        F.size(F.filter(cone, lambda f: ~f["teammate"] & ~f["keeper"])).alias("defenders_in_cone"),
        F.coalesce(far(keeper), F.lit(120.0)).alias("keeper_to_shooter"),
        F.coalesce(120.0 - keeper["x"], F.lit(120.0)).alias("keeper_off_line"),
        F.coalesce(F.abs(keeper["y"] - 40.0), F.lit(40.0)).alias("keeper_off_centre"),
        F.coalesce(F.array_min(F.transform(outfield, far)), F.lit(60.0)).alias("nearest_defender"),
    )


def set_chance(p: Column, points: int = 11) -> Column:
    """Chance to win a set to ``points`` by two from the chance to win a point."""
    q = 1 - p
    wins = sum((math.comb(points - 1 + k, k) * F.pow(p, F.lit(points)) * F.pow(q, F.lit(k)) for k in range(points - 1)), F.lit(0.0))
    deuce = math.comb(2 * points - 2, points - 1) * F.pow(p, F.lit(points - 1)) * F.pow(q, F.lit(points - 1))
    return wins + deuce * p * p / (p * p + q * q)


def match_chance(p_set: Column, best_of: int = 5) -> Column:
    """Chance to win a match of ``best_of`` sets from the chance to win a set."""
    need = best_of // 2 + 1
    return sum((math.comb(need - 1 + k, k) * F.pow(p_set, F.lit(need)) * F.pow(1 - p_set, F.lit(k)) for k in range(need)), F.lit(0.0))


def win_chance(rating: Column, deviation: Column, other: Column, other_deviation: Column) -> Column:
    """Chance of a rating against another by Glicko's formula, on the scale of 1500."""
    q = math.log(10) / 400
    g = 1 / F.sqrt(1 + 3 * q * q * (deviation * deviation + other_deviation * other_deviation) / math.pi**2)
    return 1 / (1 + F.pow(F.lit(10.0), -g * (rating - other) / 400))


def named(value: Column, names: Mapping[str, str]) -> Column:
    """A value's entry in a small table of names, null without one."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return table[value]
