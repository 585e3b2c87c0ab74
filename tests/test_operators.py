import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlight.operators import ratings, rules, scheduling, temporal
from rosterlight.plans import queries
from rosterlight.sources import html_tables
from rosterlight.sources.testviews import Views

T = dt.datetime


def tables(spark, tickets, sessions, breaks, sla=((300, 0.9, dt.date(2000, 1, 1)),)):
    return {
        "tickets": spark.createDataFrame(tickets, "ticket_id long, created_at timestamp_ntz, completion_seconds int, recalled boolean"),
        "sessions": spark.createDataFrame(sessions, "session_id long, employee_id long, level_id int, clock_in timestamp_ntz, clock_out timestamp_ntz"),
        "breaks": spark.createDataFrame(breaks, "session_id long, break_start timestamp_ntz, break_end timestamp_ntz"),
        "levels": spark.createDataFrame([(1, "K1", 50, True), (2, "Training", 10, False)], "level_id int, level_name string, rank int, counts_for_rating boolean"),
        "employee_levels": spark.createDataFrame([(1, 1, dt.date(2000, 1, 1))], "employee_id long, level_id int, effective_from date"),
        "sla": spark.createDataFrame(list(sla), "target_seconds int, adherence_goal double, effective_from date"),
    }


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_sessions_and_breaks_are_half_open(spark):
    at = [(9, 0), (12, 0), (10, 0), (10, 59), (11, 0), (8, 59)]
    tickets = [(i, T(2026, 6, 2, h, m), 200, False) for i, (h, m) in enumerate(at)] + [(9, T(2026, 6, 2, 9, 30), 200, True)]
    sessions = [(1, 1, 1, T(2026, 6, 2, 9), T(2026, 6, 2, 12)), (2, 2, 2, T(2026, 6, 2, 8), T(2026, 6, 2, 13))]
    x = tables(spark, tickets, sessions, [(1, T(2026, 6, 2, 10), T(2026, 6, 2, 11))])
    own = ratings.judged(x["tickets"], x["sla"], "2026-06-01", "2026-06-03")
    hits = ratings.on_floor(own, x["sessions"], x["breaks"], x["levels"], "2026-06-01", "2026-06-03")
    assert sorted(r.ticket_id for r in hits.collect()) == [0, 4]


def test_overlapping_and_midnight_sessions_and_future_goals(spark):
    tickets = [(1, T(2026, 6, 2, 23, 30), 100, False), (2, T(2026, 6, 3, 0, 30), 350, False)]
    sessions = [(1, 1, 1, T(2026, 6, 2, 22), T(2026, 6, 3, 2)), (2, 1, 1, T(2026, 6, 2, 23), T(2026, 6, 3, 1))]
    sla = [(300, 0.9, dt.date(2000, 1, 1)), (400, 0.9, dt.date(2026, 6, 3)), (10, 0.2, dt.date(2030, 1, 1))]
    x = tables(spark, tickets, sessions, [], sla)
    r = ratings.ratings(**x, start="2026-06-01", end="2026-06-05").collect()
    assert [(r.tickets, r.on_floor_adherence, r.shifts_hit_target, r.shifts_total) for r in r] == [(4, 1.0, 2, 2)]


def test_ratings_match_a_plain_loop(spark):
    """Random crews, sessions, breaks and tickets, everything counted by hand."""
    rnd = random.Random(11)
    day = lambda d, h, m=0: T(2027, 1, 4) + dt.timedelta(days=d, hours=h, minutes=m)
    sessions = [(k, rnd.randrange(5), 1, day(d := rnd.randrange(6), h := rnd.randrange(5, 20)), day(d, h + rnd.randrange(1, 9), 30)) for k in range(40)]
    breaks = [(k, s[3] + dt.timedelta(minutes=20), s[3] + dt.timedelta(minutes=45)) for k, s in enumerate(sessions) if k % 3 == 0]
    tickets = [(i, day(rnd.randrange(6), rnd.randrange(24), rnd.randrange(60)), rnd.choice([100, 200, 400, 900]), rnd.random() < 0.1) for i in range(500)]
    x = tables(spark, tickets, sessions, breaks)
    live = [(t, a, int(s <= 300)) for t, a, s, gone in tickets if not gone]
    hour = {h: [ok for _, a, ok in live if a.hour == h] for h in range(24)}
    hits = {}
    for k, e, _, start, end in sessions:
        for _, a, ok in live:
            if start <= a < end and not any(b == k and f <= a < u for b, f, u in breaks):
                hits.setdefault(e, {}).setdefault(k, []).append((ok, sum(hour[a.hour]) / len(hour[a.hour])))
    got = {r.employee_id: r for r in ratings.ratings(**x, start="2027-01-04", end="2027-01-10", shrink=50).collect()}
    assert set(got) == set(hits)
    for e, own in hits.items():
        flat = [h for s in own.values() for h in s]
        n, actual, expected = len(flat), sum(ok for ok, _ in flat) / len(flat), sum(b for _, b in flat) / len(flat)
        assert (got[e].tickets, got[e].shifts_total) == (n, len(own))
        assert got[e].shifts_hit_target == sum(sum(ok for ok, _ in s) / len(s) >= 0.9 for s in own.values())
        assert abs(got[e].raw_plus_minus - 100 * (actual - expected)) < 0.006 and abs(got[e].plus_minus - 100 * (actual - expected) * n / (n + 50)) < 0.006
    assert ratings.ratings(**{**x, "tickets": x["tickets"].limit(0)}, start="2027-01-04", end="2027-01-10").count() == 0
    assert ratings.what_if(x["tickets"], 250, "2029-06-01", "2029-06-30").first().adherence == 0.0


def test_range_join_is_an_equi_join_and_ratings_scan_once(spark):
    x = tables(spark, [(1, T(2026, 6, 2, 9), 1, False)], [(1, 1, 1, T(2026, 6, 2, 8), T(2026, 6, 2, 10))], [])
    joined = temporal.point_in_interval(x["tickets"], x["sessions"], "created_at", "clock_in", "clock_out")
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
    v = Views(spark, "/root/testdata/sf0.001")
    plan = plan_of(ratings.ratings(v.tickets, v.sessions, v.breaks, v.levels, v.employee_levels, v.sla, "2024-01-03", "2024-01-27"))
    assert plan.count("hour__") and plan.count("sum(on_time") <= 6


def test_interval_join_keeps_stores_apart_and_crosses_midnight(spark):
    points = spark.createDataFrame([(1, "a", T(2026, 1, 1, 23, 59)), (2, "a", T(2026, 1, 2, 0, 0)), (3, "b", T(2026, 1, 2, 0, 0)), (4, "a", T(2026, 1, 2, 1, 0))], "p long, store string, at timestamp_ntz")
    spans = spark.createDataFrame([(7, "a", T(2026, 1, 1, 23, 30), T(2026, 1, 2, 1, 0)), (8, "b", T(2026, 1, 2, 2), T(2026, 1, 2, 1))], "i long, store string, s timestamp_ntz, e timestamp_ntz")
    assert sorted((r.p, r.i) for r in temporal.point_in_interval(points, spans, "at", "s", "e", ("store",)).collect()) == [(1, 7), (2, 7)]


@pytest.mark.parametrize("kind", ["long", "date"])
def test_as_of_is_the_same_by_broadcast_and_by_value(spark, kind, monkeypatch):
    rnd = random.Random(3)
    base = dt.date(2024, 1, 1)
    at = lambda n: base + dt.timedelta(days=n) if kind == "date" else n
    left = spark.createDataFrame([(i, at(rnd.randrange(400))) for i in range(300)] + [(999, None)], f"i long, a {kind}")
    right = spark.createDataFrame([(at(n), n * 7) for n in sorted(rnd.sample(range(20, 400), 60))], f"s {kind}, v long")
    small = sorted(map(str, temporal.asof_join(left, right, F.col("l.a"), "s").select("i", "v").collect()))
    monkeypatch.setattr(temporal, "is_small", lambda df: False)
    large = temporal.asof_join(left, right, F.col("l.a"), "s")
    assert "NestedLoop" not in plan_of(large) and sorted(map(str, large.select("i", "v").collect())) == small
    assert large.columns == ["i", "a", "s", "v"]


def test_windows_that_touch_merge(spark):
    df = spark.createDataFrame([(1, 0, 300, 400), (1, 0, 400, 500), (1, 0, 501, 600), (1, 0, 310, 320), (2, 0, 1, 2)], "employee_id int, weekday int, s int, e int")
    assert sorted(tuple(r) for r in temporal.merged_windows(df, ["employee_id", "weekday"], "s", "e").collect()) == [(1, 0, 300, 500), (1, 0, 501, 600), (2, 0, 1, 2)]


RULES = [(150, 1, 0), (260, 0, 1), (400, 2, 1), (700, 3, 0)]


def rule_table(spark):
    return spark.createDataFrame(RULES, "min_shift_minutes int, rest_breaks int, meal_breaks int")


def test_entitlement_is_that_of_the_longest_rule_reached(spark):
    roster = spark.createDataFrame([(n, 100, 100 + n) for n in range(1, 900, 13)] + [(n, 0, n) for n in (150, 259, 260, 400)], "entry_id int, start_min int, end_min int")
    for r in rules.entitled(roster, rule_table(spark)).collect():
        reached = [x[1:] for x in RULES if x[0] <= r.end_min - r.start_min]
        assert (r.rest_breaks, r.meal_breaks) == (reached[-1] if reached else (0, 0))


@pytest.mark.parametrize(("seed", "concurrent"), [(1, 1), (2, 2), (3, 3)])
def test_break_plans_of_random_rosters_keep_every_rule(spark, seed, concurrent):
    rnd = random.Random(seed)
    days = [dt.date(2025, 2, d) for d in (3, 4)]
    rows = [(i, rnd.choice(["s1", "s2"]), rnd.choice(days), s := rnd.randrange(200, 700), s + rnd.randrange(60, 640)) for i in range(16)]
    roster = spark.createDataFrame(rows, "entry_id int, store string, date date, start_min int, end_min int")
    costs = spark.range(288).select(F.col("id").cast("int").alias("slot"), (F.col("id") * 5 % 23).cast("int").alias("cost"))
    plan = scheduling.plan_breaks(roster, rule_table(spark), costs, rest_minutes=12, meal_minutes=25, edge=40, gap=60, concurrent=concurrent, meal_by=290).collect()
    shift, want = {r[0]: r for r in rows}, {r.entry_id: (r.rest_breaks, r.meal_breaks) for r in rules.entitled(roster, rule_table(spark)).collect()}
    assert {r.status for r in plan} <= {"optimal", "feasible"} and {r.entry_id for r in plan} == {i for i, (a, b) in want.items() if a + b}
    busy = {}
    for r in plan:
        _, store, date, start, end = shift[r.entry_id]
        assert (r.store, r.date, r.end_min - r.start_min, r.paid) == (store, date, 12 if r.kind == "rest" else 25, r.kind == "rest")
        assert start + 40 <= r.start_min and r.end_min <= end - 40 and r.start_min % 5 == 0 and 0 <= r.bound <= r.cost
        assert r.kind == "rest" or r.start_min <= start + 290
        for m in range(r.start_min, r.end_min):
            busy[store, date, m] = busy.get((store, date, m), 0) + 1
    assert max(busy.values()) <= concurrent
    for i in want:
        own = sorted((r.start_min, r.end_min) for r in plan if r.entry_id == i)
        assert all(b[0] - a[1] >= 60 for a, b in zip(own, own[1:], strict=False))


def test_days_without_a_plan_stand_at_their_anchors(spark):
    d = dt.date(2025, 2, 3)
    roster = spark.createDataFrame([(i, d, 480, 480 + 165) for i in range(40)] + [(99, dt.date(2025, 2, 4), 480, 700)], "entry_id int, date date, start_min int, end_min int")
    costs = spark.range(288).select(F.col("id").cast("int").alias("slot"), F.lit(1).alias("cost"))
    got = scheduling.plan_breaks(roster, rule_table(spark), costs).collect()
    assert {(r.date, r.status) for r in got} == {(d, "infeasible"), (dt.date(2025, 2, 4), "optimal")}
    alone = {(r.entry_id, r.k, r.kind, r.start_min, r.end_min) for r in scheduling.anchored_breaks(roster, rule_table(spark)).collect() if r.entry_id != 99}
    assert {(r.entry_id, r.k, r.kind, r.start_min, r.end_min) for r in got if r.entry_id != 99} == alone and len(alone) == 40


def test_weeks_keep_days_in_a_row_and_stores_apart(spark):
    """Seven days of one shift each for one person who worked the two days before; two stores ask for the same level."""
    monday = dt.date(2025, 9, 1)
    shifts = spark.createDataFrame([(s * 10 + d, f"s{s}", monday, monday + dt.timedelta(days=d), 600, 840) for s in (1, 2) for d in range(7)], "shift_id int, store string, week date, date date, start_min int, end_min int")
    need = shifts.select("shift_id", F.lit(4).alias("level_id"), F.lit(1).alias("count"))
    people = spark.createDataFrame([(1, True, 4, 2400, None), (2, True, 4, 2400, 480)], "employee_id long, active boolean, level_id int, max_week_minutes int, target_week_minutes int")
    candidates = shifts.select("shift_id", F.lit(4).alias("level_id"), F.when(F.col("store") == "s1", 1).otherwise(2).cast("long").alias("employee_id"))
    history = spark.createDataFrame([(1, monday - dt.timedelta(days=k)) for k in (1, 2)], "employee_id long, day date")
    none = spark.createDataFrame([], "shift_id int, employee_id long, fills_level_id int")
    rated, weights = spark.createDataFrame([], "employee_id long, plus_minus double"), spark.createDataFrame([], "shift_id int, weight int")
    got = scheduling.assign_weeks(candidates, shifts, need, people, rules.conflict_spans(shifts), history, rated, weights, none).collect()
    worked = {s: sorted((r.shift_id % 10) for r in got if r.store == s) for s in ("s1", "s2")}
    assert all(r.is_optimal for r in got) and len(worked["s1"]) == 6 and len(worked["s2"]) == 6
    runs = [-2, -1, *worked["s1"]]
    assert max(sum(d - k in runs for k in range(7)) for d in range(7)) <= 6 and worked["s1"] != list(range(6))


def random_shifts(spark, n, stores, seed, busy=1440):
    rnd = random.Random(seed)
    monday = dt.date(2025, 9, 1)
    rows = []
    for i in range(n):
        day, start = rnd.randrange(10), rnd.randrange(0, busy)
        rows.append((i, rnd.randrange(stores), monday + dt.timedelta(days=day - day % 7), monday + dt.timedelta(days=day), start, min(1440, start + rnd.randrange(1, 600))))
    return rows, spark.createDataFrame(rows, "shift_id int, store int, week date, date date, start_min int, end_min int")


@pytest.mark.parametrize(("rest", "seed"), [(480, 1), (0, 2), (1439, 3), (2000, 4)])
def test_conflicts_equal_a_look_at_every_pair(spark, rest, seed):
    rows, df = random_shifts(spark, 120, 2, seed)
    for stored in (df, df.drop("store")):
        want = set()
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[2] == b[2] and (a[1] == b[1] or "store" not in stored.columns):
                    s, e, t, u = ((x[3] - x[2]).days * 1440 + m for x in (a, b) for m in x[4:])
                    pad = 0 if a[3] == b[3] else rest
                    if t < e + pad and s < u + pad:
                        want.add((a[0], b[0]))
        got = [tuple(r) for r in rules.conflict_edges(stored, rest).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_conflict_spans_are_one_row_a_shift_however_many_clash(spark):
    """All 2,000 shifts of a day clash with each other: 2,000 rows, and no join in the plan."""
    day = dt.date(2025, 9, 1)
    df = spark.createDataFrame([(i, day, day, 600 + i % 60, 900) for i in range(2000)], "shift_id int, week date, date date, start_min int, end_min int")
    spans = rules.conflict_spans(df)
    assert spans.count() == 2000 and "Join" not in spans._jdf.queryExecution().optimizedPlan().toString()
    assert spans.where("same_until = 2000").count() == 2000
    assert rules.conflict_edges(df).count() == 1999 * 1000


def shuffled_rows(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_conflicts_are_made_after_the_shuffle(spark):
    """1,200 shifts of a day clash with each other: 719,400 pairs, of which the shuffle sees a few rows a shift."""
    day = dt.date(2025, 9, 1)
    df = spark.createDataFrame([(i, day, day, 600 + i % 60, 900) for i in range(1200)], "shift_id int, week date, date date, start_min int, end_min int")
    before = shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        pairs = rules.conflict_edges(df).agg(F.count(F.lit(1)), F.sum(F.col("b") - F.col("a"))).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuple(pairs) == (719_400, sum(d * (1200 - d) for d in range(1, 1200))) and shuffled_rows(spark) - before < 20_000


@pytest.mark.parametrize(("tile", "task_shifts"), [(1, 1000), (3, 20), (7, 1)])
def test_conflicts_are_the_same_for_any_tiles_and_tasks(spark, tile, task_shifts):
    _, df = random_shifts(spark, 120, 2, 5)
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(rules.conflict_edges(df, task_shifts=task_shifts, tile=tile)) == rows(rules.conflict_edges(df))


def test_no_task_sweeps_more_shifts_however_many_there_are(spark):
    """120,000 shifts take about a megabyte in a shuffle, and still are several tasks; places are the same in any number of tasks."""
    week = F.date_add(F.lit("2020-01-06").cast("date"), (F.col("id") % 400 * 7).cast("int"))
    df = spark.range(120_000).select(F.col("id").alias("shift_id"), week.alias("week"), F.date_add(week, (F.col("id") % 5).cast("int")).alias("date"), (F.col("id") * 37 % 900).cast("int").alias("start_min"), (F.col("id") * 37 % 900 + 90).cast("int").alias("end_min"))
    most = rules.conflict_spans(df).groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
    assert most < 60_000
    few = df.where("shift_id % 97 = 0")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(rules.conflict_spans(few, task_shifts=100)) == rows(rules.conflict_spans(few))


def test_people_meet_the_shifts_of_their_own_store(spark):
    _, shifts = random_shifts(spark, 60, 3, 7)
    need = shifts.select("shift_id", F.lit(1).alias("level_id"), F.lit(1).alias("count"))
    people = spark.createDataFrame([(e, True, 1, e % 3, f"P{e}", 2400) for e in range(9)], "employee_id long, active boolean, level_id int, store int, name string, max_week_minutes int")
    windows = spark.createDataFrame([], "employee_id long, weekday int, start_min int, end_min int")
    off = spark.createDataFrame([], "employee_id long, start_date date, end_date date")
    none = spark.createDataFrame([], "employee_id long, shift_id int, fills_level_id int")
    pairs = rules.feasible_pairs(people, shifts, need, windows, off, none.drop("fills_level_id"))
    store = {r.shift_id: r.store for r in shifts.collect()}
    assert {(r.employee_id, r.shift_id) for r in pairs.collect()} == {(e, s) for e in range(9) for s in store if e % 3 == store[s]}
    levels = spark.createDataFrame([(1, "B2", 50, True)], "level_id int, level_name string, rank int, counts_for_rating boolean")
    rated = spark.createDataFrame([(4, 2.5, 7)], "employee_id long, plus_minus double, tickets long")
    got = rules.suggestions(need.select("shift_id", "level_id"), shifts, people, levels, none, windows, off, spark.createDataFrame([], "employee_id long, day date"), rated).collect()
    assert {(r.employee_id, r.shift_id) for r in got} == {(e, s) for e in range(9) for s in store if e % 3 == store[s]}
    assert {(r.employee_id, r.place) for r in got if store[r.shift_id] == 1} == {(4, 1), (1, 2), (7, 3)}


@pytest.mark.parametrize("most", [0, 1, 6, 7, 15])
def test_history_meets_the_weeks_it_can_touch(spark, most):
    days = [dt.date(2025, 9, 1) + dt.timedelta(days=k) for k in range(9)]
    got = {(r.day, r.week) for r in rules.by_week(spark.createDataFrame([(1, d) for d in days], "employee_id long, day date"), most).collect()}
    mondays = [dt.date(2025, 8, 25) + dt.timedelta(days=7 * k) for k in range(8)]
    assert got == {(d, w) for d in days for w in mondays if w - dt.timedelta(days=most) <= d < w}


def test_carry_crosses_ranges_and_covers_every_row(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "cold", i if i % 37 == 5 or i == 400 else None) for i in range(-20, 500) if not 200 < i < 320]
    want, last = set(), {}
    for i, k, v in rows:
        last[k] = v if v is not None else last.get(k)
        want.add((i, k, last[k]))
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = temporal.carried_by_range(df, F.col("v"), "id", "k", "owner", range_rows=16).select("id", "k", "owner").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_carry_goes_both_ways(spark):
    rows = [(i * i / 7, "k", i if i % 5 == 2 else None) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, "k", None), (None, "j", 9)], "at double, k string, v long")
    got = {r.at: r.o for r in temporal.carried_by_range(df, F.col("v"), "at", "k", "o", range_rows=20, descending=True).where("k = 'k'").collect()}
    assert got == {None: 2, **{at: next((v for _, _, v in rows[i:] if v is not None), None) for i, (at, _, _) in enumerate(rows)}}


def test_range_numbers_count_the_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (None, -3.0, 0.0, 1.0, 1.5, 99.0)], "x double")
    for bounds in ([], [1.0], [0.0, 1.0, 2.0], [float(i) for i in range(1000)]):
        got = {r.x: r.n for r in df.select("x", temporal.range_number(F.col("x"), bounds, "double").alias("n")).collect()}
        assert got == {x: sum(b <= x for b in bounds) if x is not None else 0 for x in got}


def test_as_of_of_two_large_timestamp_sides_fills_many_tasks_evenly(spark):
    """Most timestamps lie in one hour of a year; microseconds are all distinct."""
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    when = sorted({start + dt.timedelta(microseconds=rnd.randrange(3_600_000_000 if rnd.random() < 0.9 else 31_000_000_000_000)) for _ in range(20_000)})
    left = spark.createDataFrame([(i, t) for i, t in enumerate(when[::2])], "i long, t timestamp_ntz")
    right = spark.createDataFrame([(t, i) for i, t in enumerate(when[1::2])], "from_ timestamp_ntz, v long")
    got = {r.i: r.v for r in temporal.asof_by_value(left, right, F.col("l.t"), "from_", range_rows=1000).collect()}
    assert got == {i: i - 1 if i else None for i in range(len(when[::2]))}
    values = left.select(F.unix_micros(F.col("t").cast("timestamp")).alias("at")).union(right.select(F.unix_micros(F.col("from_").cast("timestamp"))))
    bounds = temporal.range_bounds(values, "at", 1000)
    sizes = [r["count"] for r in values.groupBy(temporal.range_number(F.col("at"), bounds, "bigint")).count().collect()]
    assert 18 <= len(sizes) <= 21 and max(sizes) < 1500  # rows of a task; the only window without a key has one row for each


def test_the_plan_of_a_scan_has_windows_over_ranges_only(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    plan = temporal.carried_by_range(df, F.col("v"), "id", None, "o", range_rows=500)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert len(windows) == 2
    assert sum("end__" in w for w in windows) == 1  # over the ends of ranges
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_head_of_a_page_with_very_many(spark):
    rng = np.random.default_rng(4)
    place, at = np.round(rng.uniform(0, 5000, 100_000), 2), np.round(rng.uniform(-10, 5010, 3000), 2)
    heads = spark.createDataFrame(pd.DataFrame({"page": 1, "o": np.arange(len(place)), "x": place})).union(spark.createDataFrame([(2, 7, 1.0), (2, 5, 3.0), (2, 4, None), (3, 1, 0.0)], "page long, o long, x double"))
    marks = spark.createDataFrame(pd.DataFrame({"m": np.arange(len(at)), "page": 1, "at": at})).union(spark.createDataFrame([(5000, 2, 2.0), (5001, 2, 1.5), (5002, 4, 1.0), (5003, 2, None)], "m long, page long, at double"))
    got = {r.m: r.o for r in html_tables.nearest(marks, heads, "m", "at", "x", "o", "page", range_rows=9000).collect()}
    want = {}
    for m, a in enumerate(at):
        d = np.abs(place - a)
        want[m] = int(np.flatnonzero(d == d.min())[0])
    assert got == {**want, 5000: 5, 5001: 7}


def test_carry_forward_has_an_owner_row_for_every_ticket(spark):
    got = queries.QUERIES["carry_forward"](spark, "/root/testdata/sf0.01")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()


def test_suggestions_come_in_order_with_their_reasons(spark):
    got = queries.QUERIES["suggestions"](spark, "/root/testdata/sf0.001").collect()
    key = [(r.shift_id, r.level_id, r.softness, -(r.rating or 0.0), r.employee_id) for r in got]
    assert key == sorted(key) and all(r.reason and r.employee_name for r in got)
    assert all((r.softness == -1) == r.reason.startswith("Eligible") for r in got)
