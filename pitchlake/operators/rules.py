"""Rule sets as data, compiled to columns: validation, impossibilities, derived statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A rule set: {"properties": {name: {"min", "max", "values"}}, "required": [...],
#: "invariants": [{"lte": [a, b]} | {"ifZero": a, "thenZero": [..]} | {"raceTo": [w, l, best_of]} |
#: {"atLeast": [a, n, per]}]}.
Rules = Mapping[str, object]


def field(metrics: str, name: str) -> Column:
    """A metric of a map column, null if absent."""
    return F.try_element_at(F.col(metrics), F.lit(name))


def holds(rule: Mapping[str, object], metrics: str) -> Column:
    """Whether an invariant holds; true where one of its fields is absent."""
    f = lambda n: field(metrics, n)
    if "lte" in rule:
        a, b = rule["lte"]
        ok = f(a) <= f(b)
    elif "ifZero" in rule:
        ok = reduce(Column.__and__, [F.coalesce(~((f(rule["ifZero"]) == 0) & (f(z) != 0)), F.lit(True)) for z in rule["thenZero"]])
    elif "raceTo" in rule:
        w, l, best = rule["raceTo"]
        need = F.floor(f(best) / 2) + 1
        ok = (F.greatest(f(w), f(l)) == need) & (F.least(f(w), f(l)) < need)
    else:
        a, n, per = rule["atLeast"]
        ok = f(a) >= n * f(per)
    return F.coalesce(ok, F.lit(True))


def invariant_name(rule: Mapping[str, object]) -> str:
    kind = next(iter(rule))
    fields = rule[kind] if isinstance(rule[kind], (list, tuple)) else [rule[kind]]
    return kind + ":" + ",".join(map(str, fields))


def bounds(rules: Rules, metrics: str) -> list[Column]:
    out = []
    for name, spec in rules["properties"].items():
        v = field(metrics, name)
        if "min" in spec:
            out.append(F.when(v < spec["min"], f"{name} under {spec['min']}"))
        if "max" in spec:
            out.append(F.when(v > spec["max"], f"{name} over {spec['max']}"))
        if "values" in spec:
            out.append(F.when(~v.isin(*spec["values"]), f"{name} not allowed"))
    return out


def validate(rules: Rules, metrics: str) -> Column:
    """Every reason against a metrics map: missing, unknown, out of bounds; then invariants,
    which are looked at only if the rest passes."""
    missing = [F.when(field(metrics, n).isNull(), f"{n} missing") for n in rules.get("required", ())]
    known = F.array(*[F.lit(n) for n in rules["properties"]])
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(metrics), known)), lambda k: F.concat(k, F.lit(" unknown")))
    first = F.concat(F.array_compact(F.array(*missing, *bounds(rules, metrics))), F.coalesce(unknown, F.array().cast("array<string>")))
    return F.when(F.size(first) > 0, first).otherwise(broken(rules, metrics))


def broken(rules: Rules, metrics: str) -> Column:
    """The invariants that don't hold."""
    out = [F.when(~holds(r, metrics), invariant_name(r)) for r in rules.get("invariants", ())]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def impossible(rules: Rules, metrics: str) -> Column:
    """Only what can't be: out of bounds and broken invariants; missing and unknown don't count."""
    return F.concat(F.array_compact(F.array(*bounds(rules, metrics))), broken(rules, metrics))


def flagged(df: DataFrame, player: str, reasons: str) -> DataFrame:
    """(player, rows, reasons): entities with impossible rows, their reasons joined."""
    bad = df.where(F.size(reasons) > 0)
    each = bad.select(player, F.explode(reasons).alias("_r")).groupBy(player).agg(F.array_join(F.array_sort(F.collect_set("_r")), "; ").alias("reasons"))
    return bad.groupBy(player).agg(F.count("*").alias("rows")).join(each, player)


def pooled_ratio(top: Sequence[str], bottom: Sequence[str], scale: float = 1.0) -> Column:
    """Ratio of sums over the rows that hold every field; null for nothing below the line."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*top, *bottom]])
    add = lambda cs: reduce(Column.__add__, [F.col(c) for c in cs])
    return F.try_divide(scale * F.sum(F.when(whole, add(top))), F.nullif(F.sum(F.when(whole, add(bottom))), F.lit(0)))


def share_where(column: str, above: float) -> Column:
    """Share of the rows with a value in which it is above a bound."""
    return F.try_divide(F.count(F.when(F.col(column) > above, 1)), F.nullif(F.count(column), F.lit(0)))


def check_measurements(df: DataFrame, player: str, date: str, value: str, low: float, high: float) -> DataFrame:
    """``df`` with ``on_visit`` (readings of the day) and ``reasons``."""
    n = F.count("*").over(Window.partitionBy(player, date))
    reasons = F.array(F.when((F.col(value) < low) | (F.col(value) > high), "impossible"), F.when(n > 1, "repeated"))
    return df.withColumn("on_visit", n).withColumn("reasons", F.array_compact(reasons))
