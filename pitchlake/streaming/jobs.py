"""Small streaming jobs: live tallies, incremental flags, arriving measurements."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.flags import OPEN


def live_tallies(events: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Events by player, match day and outcome; those later than the watermark are dropped."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day"), "player_id", "outcome")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").cast("date").alias("match_day"), "player_id", "outcome", "n")
    )


def new_flags(raised: DataFrame, ts: str, late: str = "7 days") -> DataFrame:
    """Each key once, however often it is raised within the watermark."""
    return raised.withWatermark(ts, late).dropDuplicatesWithinWatermark(["dedupe_key"])


def flag_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a table of flags by generations of a folder.

    A batch is merged with the last generation and written as the next one, so a batch that is
    repeated after a failure gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/generation={number - 1}"
        new = batch.groupBy("dedupe_key").agg(F.max_by("confidence", "raised_at").alias("confidence")).withColumn("status", F.lit("open"))
        if number == 0:
            out = new.select("dedupe_key", "status", "confidence")
        else:
            held = spark.read.parquet(before)
            joined = held.withColumnsRenamed({"status": "_s", "confidence": "_c"}).join(new, "dedupe_key", "full")
            fresh = F.col("_s").isNull() | (F.col("_s").isin(*OPEN) & F.col("confidence").isNotNull())
            out = joined.select("dedupe_key", F.coalesce("_s", "status").alias("status"), F.when(fresh, F.col("confidence")).otherwise(F.col("_c")).alias("confidence"))
        out.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return merge


def check_arrivals(last: str, out: str, drop: float = 1.5, monthly: float = 2.5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: arriving measurements against each player's last reading."""

    def check(batch: DataFrame, number: int) -> None:
        held = batch.sparkSession.read.parquet(last).select("player_id", F.col("measured_at").alias("_d"), F.col("value").alias("_v"))
        j = batch.join(held, "player_id", "left")
        change, months = F.col("value") - F.col("_v"), F.greatest(F.datediff("measured_at", "_d") / 30.44, F.lit(1.0))
        warnings = F.array_compact(F.array(F.when(change < -drop, "drop"), F.when(change / months > monthly, "fast gain")))
        j.withColumn("warnings", warnings).drop("_d", "_v").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return check


CHECKED = "reading_id long, player_id long, measured_at date, value double, warnings array<string>"


def check_player(key: tuple, frames: Iterator[pd.DataFrame], state, low: float, high: float, drop: float, monthly: float) -> Iterator[pd.DataFrame]:
    """A player's arriving readings against the last one in ``state``: (day, reading_id, value)."""
    new = pd.concat(list(frames)).sort_values(["measured_at", "reading_id"], kind="stable", ignore_index=True)
    day = pd.to_datetime(new["measured_at"]).to_numpy().astype("datetime64[D]").astype("int64")
    number, value = new["reading_id"].to_numpy(), new["value"].to_numpy(dtype=float)
    absent = new["measured_at"].isna().to_numpy() | np.isnan(value)
    held = state.get if state.exists else None
    late = again = np.zeros(len(new), dtype=bool)
    if held:
        again = (day == held[0]) & (number == held[1])
        late = (day < held[0]) | ((day == held[0]) & (number < held[1]))
    again = ~absent & (again | new.duplicated(["measured_at", "reading_id"]).to_numpy())
    fresh = ~absent & ~again & ~late
    before_day, before = np.full(len(new), np.nan), np.full(len(new), np.nan)
    if fresh.any():
        first_day, first = (held[0], held[2]) if held else (np.nan, np.nan)
        before_day[fresh] = np.concatenate([[first_day], day[fresh][:-1]])
        before[fresh] = np.concatenate([[first], value[fresh][:-1]])
        last = np.flatnonzero(fresh)[-1]
        state.update((int(day[last]), int(number[last]), float(value[last])))
    change, months = value - before, np.maximum((day - before_day) / 30.44, 1.0)
    marks = {"absent": absent, "repeated": again, "late": ~absent & ~again & late, "unusual": fresh & ~((value >= low) & (value <= high)), "drop": change < -drop, "fast gain": change / months > monthly}
    yield new.assign(warnings=[[n for n, m in marks.items() if m[i]] for i in range(len(new))])


def checked_readings(readings: DataFrame, low: float, high: float, drop: float = 1.5, monthly: float = 2.5) -> DataFrame:
    """Arriving readings (reading_id, player_id, measured_at, value) with their ``warnings``.

    The state of a player is the last reading alone. A batch's readings are taken in order of day
    and id; one that is older than the last is 'late', one that is the last itself or comes twice
    in a batch 'repeated', one without a day or value 'absent'. These are compared with nothing
    and leave the state as it is. A player's readings of one batch are held together in a task.
    """
    check = partial(check_player, low=low, high=high, drop=drop, monthly=monthly)
    rows = readings.select("reading_id", "player_id", "measured_at", F.col("value").cast("double").alias("value"))
    return rows.groupBy("player_id").applyInPandasWithState(check, CHECKED, "day long, reading_id long, value double", "append", "NoTimeout")


def reading_sink(folder: str, low: float, high: float, drop: float = 1.5, monthly: float = 2.5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function with the warnings of ``checked_readings``, by joins and windows.

    The state is a table of each player's last reading, by generations of ``folder``, so a batch
    that is repeated after a failure gives the same table; the checked rows go to ``folder``/out.
    """

    def check(batch: DataFrame, number: int) -> None:
        rows = batch.select("reading_id", "player_id", "measured_at", F.col("value").cast("double").alias("value"))
        absent = F.col("measured_at").isNull() | F.col("value").isNull() | F.isnan("value")
        last = F.struct(F.col("measured_at").alias("d"), F.col("reading_id").alias("n"), F.col("value").alias("v"))
        held = batch.sparkSession.createDataFrame([], "player_id long, last struct<d: date, n: long, v: double>")
        if number:
            held = batch.sparkSession.read.schema(held.schema).parquet(f"{folder}/last/generation={number - 1}")
        new = rows.where(~absent).select("player_id", last.alias("last"))
        held.union(new).groupBy("player_id").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{folder}/last/generation={number}")

        j = rows.withColumn("absent", absent).join(held.withColumnRenamed("player_id", "_p"), F.col("player_id").eqNullSafe(F.col("_p")), "left")
        once = F.row_number().over(Window.partitionBy("player_id", "measured_at", "reading_id", "absent").orderBy("value")) == 1
        known = F.col("last").isNotNull()
        j = j.withColumn("again", ~F.col("absent") & (~once | F.coalesce(F.col("measured_at").eqNullSafe(F.col("last.d")) & F.col("reading_id").eqNullSafe(F.col("last.n")) & known, F.lit(False))))
        older = (F.col("measured_at") < F.col("last.d")) | ((F.col("measured_at") == F.col("last.d")) & (F.col("reading_id") < F.col("last.n")))
        j = j.withColumn("late", ~F.col("absent") & ~F.col("again") & known & F.coalesce(older, F.lit(False)))
        j = j.withColumn("fresh", ~F.col("absent") & ~F.col("again") & ~F.col("late"))
        previous = F.coalesce(F.lag(last).over(Window.partitionBy("player_id", "fresh").orderBy("measured_at", "reading_id")), F.col("last"))
        j = j.withColumn("_b", F.when(F.col("fresh"), previous))
        change, months = F.col("value") - F.col("_b.v"), F.greatest(F.datediff("measured_at", "_b.d") / 30.44, F.lit(1.0))
        marks = {"absent": F.col("absent"), "repeated": F.col("again"), "late": F.col("late"), "unusual": F.col("fresh") & ~F.col("value").between(low, high), "drop": change < -drop, "fast gain": change / months > monthly}
        warnings = F.array_compact(F.array(*[F.when(c, n) for n, c in marks.items()]))
        j.select("reading_id", "player_id", "measured_at", "value", warnings.alias("warnings")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return check
