import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlight.operators import views
from rosterlight.plans.sync import Source, load_config, refreshed


def test_moves_stay_in_the_shift(spark):
    breaks = spark.createDataFrame([(1, 0, 400, 410), (1, 1, 500, 530)], "entry_id int, k int, start_min int, end_min int")
    roster = spark.createDataFrame([(1, 390, 600)], "entry_id int, start_min int, end_min int")
    moves = spark.createDataFrame([(1, 0, 450), (1, 1, 580)], "entry_id int, k int, to int")
    assert sorted(tuple(r) for r in views.moved_break(breaks, roster, moves).collect()) == [(1, 0, 450, 460), (1, 1, 500, 530)]


def test_validation_seeds_and_level_changes(spark):
    df = spark.createDataFrame([(0, 10, 20), (7, 10, 20), (1, 20, 20), (1, None, 5)], "weekday int, start_min int, end_min int")
    good, bad = views.split_valid(df)
    assert (good.count(), bad.count()) == (1, 3)
    assert views.seeded(df.limit(0), df.limit(1)).count() == 1 and views.seeded(df, df.limit(1)).count() == 4
    held = spark.createDataFrame([(1, 5, dt.date(2000, 1, 1)), (2, 5, dt.date(2030, 1, 1))], "employee_id int, level_id int, effective_from date")
    wanted = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "employee_id int, level_id int")
    assert sorted(r.employee_id for r in views.level_changes(held, wanted, F.lit("2026-01-01").cast("date")).collect()) == [2, 3]


def test_one_failing_source_leaves_the_other(spark):
    hours = spark.createDataFrame([("Ada", 1, 5.0)], "name string, period int, hours double")
    swaps = spark.createDataFrame([("Bo", 1)], "name string, day int")

    def broken():
        raise RuntimeError("session expired\nlong story")

    new = spark.createDataFrame([("Ada", 1, 8.0), ("Bo", 1, 3.0)], "name string, period int, hours double")
    sources = [Source("swaps", broken, ["name", "day"], [F.col("day")]), Source("hours", lambda: new, ["name", "period"], [F.desc("hours")])]
    after, status = refreshed(spark, {"hours": hours, "swaps": swaps}, sources, "2026-06-02")
    assert sorted(tuple(r) for r in after["hours"].collect()) == [("Ada", 1, 8.0), ("Bo", 1, 3.0)]
    assert after["swaps"].collect() == swaps.collect()
    row = status.first()
    assert (row.ok, row.error, row.rows) == (False, "swaps: session expired", {"swaps": 0, "hours": 2})


def test_latest_hours_ignore_case(spark):
    rows = [("Ada", dt.date(2026, 6, 1), dt.date(2026, 6, 7), 5.0), ("ADA", dt.date(2026, 6, 8), dt.date(2026, 6, 14), 6.0)]
    df = spark.createDataFrame(rows, "employee_name string, period_start date, period_end date, hours double")
    assert [r.hours for r in views.latest_hours(df).collect()] == [6.0]


def test_thresholds_that_repeat_and_negative_counts_are_invalid(spark):
    df = spark.createDataFrame([(100, 1), (100, 2), (200, -1), (300, 0), (None, 1)], "least int, n int")
    good, bad = views.split_valid(df, ("n",), "least")
    assert sorted((r.least or -1) for r in good.collect()) == [-1, 300] and bad.count() == 3


def test_windows_filters_and_lists(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, "A", 5), (3, "c", 7)], "employee_id int, name string, n int")
    assert [r.employee_id for r in views.listed(df, "employees").collect()] == [2, 1, 3]
    assert views.filtered(df, n=5, name=None).count() == 2 and views.filtered(df).count() == 3
    day = lambda s: F.lit(s).cast("date")
    r = spark.range(1).select(*views.default_window(day("2025-03-10"), 30), *views.default_window(day("2025-03-10"), 30, day("2025-01-01"), F.lit(None).cast("date"))).first()
    assert [str(x) for x in r] == ["2025-02-08", "2025-03-10", "2025-01-01", "2025-03-10"]


def test_scrape_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"hours": {"url": "https://x", "columns": {"name": ["crew"]}}}')
    assert load_config(str(tmp_path / "c.json"))["hours"]["columns"] == {"name": ["crew"]}
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "d.json"))
