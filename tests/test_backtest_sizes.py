"""How often the backtest's rows are shuffled."""

import datetime as dt

from pitchlake.operators import backtest


def test_cutoffs_multiply_rows_after_they_are_dealt_out(spark):
    born, day = dt.date(2006, 1, 1), dt.date(2018, 1, 1)
    rows = [(p, "M", born, day + dt.timedelta(days=30 * i), 12 + i / 12.0, 140.0 + i + p) for p in range(6) for i in range(36)]
    r = spark.createDataFrame(rows, "p long, sex string, born date, d date, age double, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = backtest.snapshots(r, backtest.cutoffs(r, "d"), ["sex"], "p", "d", "v", "born", 1.0)
        plan = s._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert s.count() > 0
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(cutoff" in x and " sex#" in x and " p#" in x]
