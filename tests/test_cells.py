import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from rosterlight.operators import cells, ratings

from .test_operators import tables

T = dt.datetime


def made(spark, seed):
    """Crews over fourteen months, sessions across midnight and the ends of months, targets that change."""
    rnd = random.Random(seed)
    at = lambda: T(2027, 1, 20) + dt.timedelta(days=rnd.randrange(400), hours=rnd.randrange(24), minutes=rnd.randrange(60))
    sessions = [(k, rnd.randrange(4), 1 + (k % 9 == 0), s := at(), s + dt.timedelta(hours=rnd.randrange(1, 10))) for k in range(150)]
    sessions += [(900, 1, 1, T(2027, 3, 31, 20), T(2027, 4, 1, 4)), (901, 2, 1, T(2027, 12, 31, 22), T(2028, 1, 1, 2))]
    breaks = [(k, s[3] + dt.timedelta(minutes=20), s[3] + dt.timedelta(minutes=45)) for k, s in enumerate(sessions[:150]) if k % 3 == 0]
    inside = [s[3] + dt.timedelta(minutes=rnd.randrange(1, 600)) for s in sessions for _ in range(6)]
    tickets = [(i, a, rnd.choice([100, 200, 250, 400, 900]), rnd.random() < 0.1) for i, a in enumerate(inside + [at() for _ in range(200)])]
    return tables(spark, tickets, sessions, breaks, [(300, 0.9, dt.date(2000, 1, 1)), (220, 0.5, dt.date(2027, 6, 15)), (420, 0.6, dt.date(2027, 12, 31))])


WINDOWS = [("2027-01-01", "2028-12-31"), ("2027-03-31", "2027-03-31"), ("2027-04-01", "2027-04-30"), ("2027-02-11", "2027-11-05"), ("2027-12-31", "2027-12-31"), ("2019-01-01", "2019-02-01"), ("2027-08-01", "2051-01-01"), ("2040-01-01", "2041-01-01")]


@pytest.mark.parametrize("seed", [1, 2])
def test_ratings_from_cells_equal_those_from_tickets(spark, seed):
    x = made(spark, seed)
    c = cells.report_cells(*(x[n] for n in ("tickets", "sessions", "breaks", "levels", "sla")))
    got = cells.window_ratings(cells.rating_tables(c, x["sla"]), x["levels"], x["employee_levels"], x["sla"], WINDOWS, 50).collect()
    seen = 0
    for i, (s, e) in enumerate(WINDOWS):
        want = sorted(map(tuple, ratings.ratings(**x, start=s, end=e, shrink=50).collect()))
        assert sorted(tuple(r)[1:] for r in got if r.window_no == i) == want
        seen += len(want)
    assert seen > 15


def test_what_if_from_cells_equals_that_from_tickets_and_halves_add_up(spark):
    x = made(spark, 3)
    halves = [cells.report_cells(x["tickets"].where(f"ticket_id % 3 {op} 0"), *(x[n] for n in ("sessions", "breaks", "levels", "sla"))) for op in ("=", "<>")]
    both, whole = cells.merged(*halves), cells.report_cells(*(x[n] for n in ("tickets", "sessions", "breaks", "levels", "sla")))
    for a, b in ((both.tickets, whole.tickets), (both.floor, whole.floor)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    before = cells.marks(both.tickets, ["completion_seconds"], ["n"])
    got = {(r.window_no, r.target_seconds): (r.tickets, r.adherence) for r in cells.what_if_targets(both.tickets, before, [99, 250, 900], WINDOWS).collect()}
    for i, (s, e) in enumerate(WINDOWS):
        for t in (99, 250, 900):
            assert got[i, t] == tuple(ratings.what_if(x["tickets"], t, s, e).first())
    assert len(got) == 3 * len(WINDOWS)


def test_a_report_reads_the_months_of_its_edges_only(spark, tmp_path):
    """Two years of cells in a folder a month: a window of a year reads the cells and marks of the months of its edges."""
    day = F.date_add(F.lit("2027-01-01").cast("date"), (F.col("id") % 730).cast("int"))
    c = spark.range(7300).select(day.alias("day"), (F.col("id") % 24).cast("int").alias("hour"), F.lit(1).cast("long").alias("n"))
    c.withColumn("month", F.trunc("day", "month")).write.partitionBy("month").parquet(str(tmp_path / "c"))
    cells.marks(c, ["hour"], ["n"]).write.partitionBy("month").parquet(str(tmp_path / "m"))
    read = lambda p: spark.read.parquet(str(tmp_path / p))
    out = cells.window_sums(read("c"), read("m"), ["hour"], ["n"], [("2027-02-03", "2028-03-04")])
    assert out.agg(F.sum("n")).first()[0] == 10 * (28 - 2 + 306 + 31 + 29 + 4)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert len(scans) == 2 and all("month" in x and "2027-02-01" in x and "2028-03-01" in x for x in scans)
    # a mark holds all before its month, of every hour
    assert {r.n for r in read("m").where("month = '2028-01-01'").groupBy().agg(F.sum("n").alias("n")).collect()} == {3650}


def test_cells_of_no_tickets(spark):
    x = made(spark, 4)
    c = cells.report_cells(x["tickets"].limit(0), *(x[n] for n in ("sessions", "breaks", "levels", "sla")))
    assert cells.window_ratings(cells.rating_tables(c, x["sla"]), x["levels"], x["employee_levels"], x["sla"], WINDOWS).count() == 0
    got = cells.what_if_targets(c.tickets, cells.marks(c.tickets, ["completion_seconds"], ["n"]), [60], WINDOWS).collect()
    assert [(r.tickets, r.adherence) for r in got] == [(0, 0.0)] * len(WINDOWS)
