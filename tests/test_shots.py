"""Shot chances: trees beat a linear model where features act together, penalties have a rate of their own."""

import math
import random

from pitchlake.operators import shots


def test_boosted_trees_are_chosen_where_features_act_together(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, i // 9, float(a), float(b), int(rng.random() < (0.85 if a != b else 0.1)), False))
    rows += [(900 + i, i, None, None, int(i % 4 > 0), True) for i in range(40)] + [(950, None, None, 1.0, 1, False)]
    df = spark.createDataFrame(rows, "shot long, match long, a double, b double, goal int, penalty boolean")
    settings = (shots.Setting("linear"), shots.Setting("boosted", 4, 2, 0.5))
    out, losses = shots.shot_chances(df, "match", ["a", "b"], "goal", df["shot"] % 10 != 3, df["penalty"], settings, 2)
    got = {r["shot"]: r["xg"] for r in out.collect()}
    assert len(got) == len(rows) and dict(losses)["boosted"] < dict(losses)["linear"] - 0.1
    assert all((got[i] > 0.5) == (a != b) for i, _, a, b, _, _ in rows[:900])
    known = [r for r in rows[900:940] if r[0] % 10 != 3]
    assert all(math.isclose(got[900 + i], sum(r[4] for r in known) / len(known)) for i in range(40)) and got[950] is None


def test_names_become_categories(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Left Foot", "Regular Play", "Diving Header", "Penalty"), ("Other", "From Throw In", None, "Corner"), (None, "From Kick Off", "Half Volley", None)], "b string, p string, t string, k string")
    got = df.select(shots.body_part(F.col("b")), shots.pattern(F.col("p")), shots.technique(F.col("t")), shots.shot_type(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("foot", "regular", "diving_header", "open_play"), ("other", "throw_in", "normal", "corner"), ("other", "kick_off", "half_volley", "open_play")]
