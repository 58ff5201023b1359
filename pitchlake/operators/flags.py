"""The life of flags: keys, upserts, queues, closing, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import latest

OPEN = ("open", "in_review")


def dedupe_key(player: Column, kind: Column, fingerprint: Column) -> Column:
    """The first 32 hex digits of sha256(player|type|fingerprint)."""
    return F.substring(F.sha2(F.concat_ws("|", player.cast("string"), kind, fingerprint.cast("string")), 256), 1, 32)


def upsert(held: DataFrame, raised: DataFrame) -> DataFrame:
    """Flags after a run (dedupe_key, status, confidence, change).

    A held flag stays, whatever its status; an open one takes the new confidence; a new key
    becomes an open flag. One row by key on both sides.
    """
    h = held.select("dedupe_key", F.col("status").alias("_s"), F.col("confidence").alias("_c"))
    r = raised.select("dedupe_key", F.col("confidence").alias("_n"))
    both = h.join(r, "dedupe_key", "full")
    fresh = F.col("_s").isin(*OPEN) & F.col("_n").isNotNull()
    return both.select(
        "dedupe_key",
        F.coalesce("_s", F.lit("open")).alias("status"),
        F.when(fresh, F.col("_n")).otherwise(F.coalesce("_c", "_n")).alias("confidence"),
        F.when(F.col("_s").isNull(), "created").when(fresh, "refreshed").otherwise("kept").alias("change"),
    )


def close_merged(flags: DataFrame, merged: DataFrame, player: str, related: str) -> DataFrame:
    """Open flags about a merged record, on either side, are closed."""
    gone = merged.select(F.col(player).alias("_p")).distinct()
    sides = flags.select("dedupe_key", F.explode(F.array(player, related)).alias("_p")).join(gone, "_p", "left_semi").select("dedupe_key").distinct().withColumn("_hit", F.lit(True))
    out = flags.join(sides, "dedupe_key", "left")
    return out.withColumn("status", F.when(F.col("_hit") & F.col("status").isin(*OPEN), "closed").otherwise(F.col("status"))).drop("_hit")


def by_player(flags: DataFrame, player: str, related: str) -> DataFrame:
    """A row for each player that a flag is about; a duplicate is about both."""
    both = F.array_compact(F.array_distinct(F.array(player, related)))
    return flags.withColumn("shown_on", F.explode(both))


def review_queue(flags: DataFrame, order: Sequence[str], kind: str, confidence: str, raised: str, key: str, n: int) -> DataFrame:
    """The first ``n`` flags: kinds in order, confident first (unknown last), newest, key."""
    place = F.lit(len(order))
    for i, k in enumerate(order):
        place = F.when(F.col(kind) == k, i).otherwise(place)
    return flags.orderBy(place, F.desc_nulls_last(confidence), F.desc(raised), key).limit(n)


def best_reason(flags: DataFrame, player: str, confidence: str, key: str) -> DataFrame:
    """Each player's live flag of the highest confidence."""
    return latest(flags.where(F.col("status").isin(*OPEN)), [player], [F.desc_nulls_last(confidence), F.col(key)])


def combine_pairs(rules: DataFrame, engine: DataFrame, a: str, b: str) -> DataFrame:
    """One case for each pair that the rules or the engine propose, saying which do."""
    r = rules.select(a, b).distinct().withColumn("by_rules", F.lit(True))
    e = engine.select(a, b).distinct().withColumn("by_engine", F.lit(True))
    return r.join(e, [a, b], "full").fillna(False, ["by_rules", "by_engine"])


def redact(df: DataFrame, visible: Column, columns: Sequence[str], state: str) -> DataFrame:
    """``df`` with the columns withheld where a row isn't visible, and ``state`` saying so."""
    shown = F.coalesce(visible, F.lit(False))
    out = df.withColumn(state, F.when(shown, "shown").otherwise("withheld"))
    return out.withColumns({c: F.when(shown, F.col(c)) for c in columns})
