"""Rule evaluation over schedules: availability, conflicts, shortages, warnings, suggestions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_join, day_runs, merged_windows, small

#: Shifts that one task numbers and sweeps, and places of a tile.
TASK_SHIFTS, TILE = 50_000, 256


def absolute(week: Column, day: Column, minute: Column) -> Column:
    """Minutes since the start of a week."""
    return F.datediff(day, week) * 1440 + minute


def conflicting(a: str, b: str, week: Column, rest: int) -> Column:
    """Whether shifts a and b overlap; on different days ``rest`` minutes must lie between them."""
    at = lambda s, m: absolute(week, F.col(f"{s}.date"), F.col(f"{s}.{m}"))
    pad = F.when(F.col(f"{a}.date") == F.col(f"{b}.date"), 0).otherwise(rest)
    return (at(b, "start_min") < at(a, "end_min") + pad) & (at(a, "start_min") < at(b, "end_min") + pad)


def shared_store(*tables: DataFrame) -> list[str]:
    """The store key, if all tables have one: people and shifts of different stores then never meet."""
    return ["store"] if all("store" in t.columns for t in tables) else []


def _tasks(shifts: DataFrame, task_shifts: int) -> int:
    """How many tasks ``shifts`` are dealt to; runs a job that counts them.

    Shuffled shifts compress to some ten bytes, so partitions made by size hold millions, and the sorts of a task grow with the input.
    """
    return max(1, math.ceil(shifts.count() / task_shifts))


def _placed(shifts: DataFrame, tasks: int) -> DataFrame:
    """``shifts`` dealt by (store and) week, with place: their number there in order of date, start and id."""
    keys = [*shared_store(shifts), "week"]
    return shifts.repartition(tasks, *keys).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("date", "start_min", "shift_id")))


def conflict_spans(shifts: DataFrame, rest: int = 480, task_shifts: int = TASK_SHIFTS) -> DataFrame:
    """For each shift the later shifts that nobody can do beside it, as two runs of places: one row a shift, no pairs.

    (store,) week, shift_id, place, same_until, next_from, next_until.  Shifts of a week (of a store) are numbered in order
    of date, start and id.  Those that clash with a shift and come after it are the ones of its date up to
    ``same_until``, which start before it ends, and those of other dates from ``next_from`` to ``next_until``, which start
    less than ``rest`` minutes after it.  One sweep over starts, ends and padded ends counts the starts before each end.
    Shifts are dealt once, about ``task_shifts`` a task, and all steps keep to that.
    """
    return _spans(_placed(shifts, _tasks(shifts, task_shifts)), [*shared_store(shifts), "week"], rest)


def _spans(placed: DataFrame, keys: list[str], rest: int) -> DataFrame:
    start, end = absolute(F.col("week"), F.col("date"), F.col("start_min")), absolute(F.col("week"), F.col("date"), F.col("end_min"))
    own = Window.partitionBy(*keys)
    rows = placed.select(*keys, "date", "shift_id", start.alias("s"), end.alias("e"), "place")
    rows = rows.withColumn("last", F.max("place").over(Window.partitionBy(*keys, "date")))
    event = lambda at, is_start, role: F.struct(at.alias("at"), F.lit(is_start).alias("is_start"), F.lit(role).alias("role"))
    events = rows.withColumn("x", F.explode(F.array(event(F.col("s"), 1, "start"), event(F.col("e"), 0, "same"), event(F.col("e") + rest, 0, "next"))))
    # an end at a start's minute comes first: the two touch and do not overlap
    counted = events.withColumn("before", F.sum("x.is_start").over(own.orderBy("x.at", "x.is_start").rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda role: F.max(F.when(F.col("x.role") == role, F.col("before"))).cast("int")
    spans = counted.groupBy(*keys, "shift_id", "place", "last").agg(of("same").alias("same"), of("next").alias("next_until"))
    return spans.select(*keys, "shift_id", "place", F.least("same", "last").alias("same_until"), (F.col("last") + 1).alias("next_from"), "next_until")


def conflict_edges(shifts: DataFrame, rest: int = 480, task_shifts: int = TASK_SHIFTS, tile: int = TILE) -> DataFrame:
    """a, b: pairs of shifts of one week (a < b; of one store, where shifts have one) that nobody can do both.

    The spans of ``conflict_spans`` written out.  Places are cut into tiles, and the ids of a tile are one row; a shift meets
    the tiles that its runs touch and takes its part of their ids.  So pairs are made after the shuffle and the sort, which
    move a row a shift and tile, and no pair is made that is not in the result.
    """
    keys = [*shared_store(shifts), "week"]
    tasks = _tasks(shifts, task_shifts)
    spans = _spans(_placed(shifts, tasks), keys, rest)
    run = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    runs = F.filter(F.array(run(F.col("place") + 1, F.col("same_until")), run(F.col("next_from"), F.col("next_until"))), lambda r: r["low"] <= r["high"])
    of = lambda place: F.floor((place - 1) / tile).cast("int")
    parts = spans.select(*keys, F.col("shift_id").alias("x"), F.explode(runs).alias("r")).select(*keys, "x", "r.*", F.explode(F.sequence(of(F.col("r.low")), of(F.col("r.high")))).alias("tile"))
    first = F.greatest(F.col("low") - F.col("tile") * tile, F.lit(1))
    last = F.least(F.col("high") - F.col("tile") * tile, F.lit(tile))
    parts = parts.select(*keys, "tile", "x", first.alias("first"), (last - first + 1).alias("n"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "shift_id"))), lambda y: y["shift_id"])
    tiles = _placed(shifts, tasks).groupBy(*keys, of(F.col("place")).alias("tile")).agg(ids.alias("ids"))
    # dealt by number here too, so that neither side is coalesced or taken for small enough to broadcast
    deal = lambda df: df.repartition(tasks, *keys, "tile") if tasks > 1 else df
    met = deal(parts).join(deal(tiles).hint("merge"), [*keys, "tile"])
    pairs = met.select("x", F.explode(F.slice("ids", F.col("first"), F.col("n"))).alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def entitled(roster: DataFrame, rules: DataFrame) -> DataFrame:
    """``roster`` with rest_breaks and meal_breaks of the longest rule that its length reaches, else none."""
    length = F.col("l.end_min") - F.col("l.start_min")
    out = asof_join(roster, rules, length, "min_shift_minutes")
    return out.drop("min_shift_minutes").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rest_breaks", "meal_breaks")})


def free_pairs(pairs: DataFrame, time_off: DataFrame) -> DataFrame:
    """(employee_id, date, ...) less those within a time off, both ends included."""
    off = (F.col("p.employee_id") == F.col("o.employee_id")) & F.col("p.date").between(F.col("o.start_date"), F.col("o.end_date"))
    return pairs.alias("p").join(time_off.alias("o"), off, "left_anti")


def in_windows(pairs: DataFrame, availability: DataFrame) -> DataFrame:
    """(employee_id, date, start_min, end_min, ...) with ``inside``: within one merged window of that weekday.

    Who has no window at all is always available; who has some, but none that weekday, is not.
    """
    merged = merged_windows(availability, ["employee_id", "weekday"], "start_min", "end_min")
    fits = (F.col("p.employee_id") == F.col("w.employee_id")) & (F.weekday("p.date") == F.col("w.weekday")) & (F.col("w.start_min") <= F.col("p.start_min")) & (F.col("p.end_min") <= F.col("w.end_min"))
    hit = pairs.alias("p").join(merged.alias("w"), fits, "left").select("p.*", F.col("w.weekday").isNotNull().alias("hit"))
    some = availability.select("employee_id", F.lit(True).alias("some")).distinct()
    return hit.join(some, "employee_id", "left").withColumn("inside", F.col("hit") | F.col("some").isNull()).drop("hit", "some")


def available_pairs(pairs: DataFrame, availability: DataFrame, time_off: DataFrame) -> DataFrame:
    return in_windows(free_pairs(pairs, time_off), availability).where("inside").drop("inside")


def feasible_pairs(employees: DataFrame, shifts: DataFrame, requirements: DataFrame, availability: DataFrame, time_off: DataFrame, manual: DataFrame, rest: int = 480) -> DataFrame:
    """employee_id, shift_id, level_id that a solver may use: level wanted, available, no clash with a manual pick.

    ``employees`` has their level_id of the week; ``manual`` the manual assignments (employee_id, shift_id).  Where shifts
    and employees both have a store, people meet the shifts of their own store only.
    """
    store = shared_store(shifts, employees)
    wanted = requirements.where(F.col("count") > 0).select("shift_id", "level_id").distinct()
    pairs = shifts.join(wanted, "shift_id").join(employees.where("active").select("employee_id", "level_id", *store), ["level_id", *store])
    pairs = available_pairs(pairs, availability, time_off)
    picked = manual.join(shifts, "shift_id")
    clash = (F.col("s.employee_id") == F.col("m.employee_id")) & (F.col("s.week") == F.col("m.week")) & ((F.col("s.shift_id") == F.col("m.shift_id")) | conflicting("s", "m", F.col("s.week"), rest))
    return pairs.alias("s").join(picked.alias("m"), clash, "left_anti").select("employee_id", "shift_id", "level_id")


def unfilled(requirements: DataFrame, assignments: DataFrame) -> DataFrame:
    """shift_id, level_id, missing: requirements that have too few assignments."""
    have = assignments.groupBy("shift_id", F.col("fills_level_id").alias("level_id")).agg(F.count(F.lit(1)).alias("have"))
    missing = F.col("count") - F.coalesce("have", F.lit(0))
    return requirements.join(have, ["shift_id", "level_id"], "left").where(missing > 0).select("shift_id", "level_id", missing.cast("int").alias("missing"))


def worked_dates(sessions: DataFrame, assignments: DataFrame, shifts: DataFrame) -> DataFrame:
    """employee_id, day: distinct days with a session or an assignment, drafts included."""
    a = sessions.select("employee_id", F.to_date("clock_in").alias("day"))
    b = assignments.join(shifts.select("shift_id", "date"), "shift_id").select("employee_id", F.col("date").alias("day"))
    return a.union(b).distinct()


def by_week(history: DataFrame, max_consecutive: int) -> DataFrame:
    """employee_id, day and each week (Monday) that has the day among the ``max_consecutive`` days before it: for equi-joins by week."""
    monday = F.date_add("day", 7 - F.weekday("day"))  # the first one after the day
    last = F.greatest(F.date_add("day", max_consecutive), F.date_sub("day", 1))
    weeks = F.when(monday <= last, F.sequence(monday, last, F.expr("INTERVAL 7 DAYS"))).otherwise(F.array().cast("array<date>"))
    return history.select("employee_id", "day").distinct().select("employee_id", "day", F.explode(weeks).alias("week"))


def warnings(assignments: DataFrame, shifts: DataFrame, employees: DataFrame, history: DataFrame, max_day: int = 480, max_consecutive: int = 6) -> DataFrame:
    """employee_id, week, kind, value, day: limits that the assignments of each week cross.

    value is minutes, or the days of a run; day the date, or the run's first day.  A week's runs see ``history`` of the
    ``max_consecutive`` days before it and the week's own assignments, so longer runs are cut at that start.
    """
    own = assignments.join(shifts, "shift_id").select("employee_id", "week", "date", (F.col("end_min") - F.col("start_min")).alias("minutes"))
    day = own.groupBy("employee_id", "week", "date").agg(F.sum("minutes").alias("value"))
    over_day = day.where(F.col("value") > max_day).select("employee_id", "week", F.lit("overtime_day").alias("kind"), "value", F.col("date").alias("day"))
    week = own.groupBy("employee_id", "week").agg(F.sum("minutes").alias("value")).join(employees.select("employee_id", "max_week_minutes"), "employee_id", "left")
    over_week = week.where(F.col("value") > F.coalesce("max_week_minutes", F.lit(2400))).select("employee_id", "week", F.lit("overtime_week").alias("kind"), "value", F.col("week").alias("day"))
    weeks = day.select("employee_id", "week").distinct()
    past = by_week(history, max_consecutive).join(weeks, ["employee_id", "week"], "left_semi")
    days = past.select("employee_id", "week", "day").union(day.select("employee_id", "week", F.col("date").alias("day")))
    runs = day_runs(days, ["employee_id", "week"], "day").where((F.col("run_days") > max_consecutive) & (F.col("run_end") >= F.col("week")))
    streak = runs.select("employee_id", "week", F.lit("consecutive_days").alias("kind"), F.col("run_days").cast("long").alias("value"), F.col("run_start").alias("day"))
    cast = lambda df: df.withColumn("value", F.col("value").cast("long"))
    return cast(over_day).unionByName(cast(over_week)).unionByName(streak)


# The wording of reasons and warnings.
COVERS, OVER_WEEK, OVER_DAY = "Higher level covering down", "Would exceed their weekly hours cap (overtime)", "Would exceed %dh that day (overtime)"
IN_A_ROW, OUTSIDE, ELIGIBLE = "Would be consecutive day #%d (limit %d)", "Outside their submitted availability", "Eligible now (schedule changed since last solve)"


def hours_text(minutes: Column, digits: int) -> Column:
    """Minutes as hours, rounded half to even."""
    return F.format_string(f"%.{digits}f", F.bround(minutes / 60.0, digits))


def warning_messages(warned: DataFrame, employees: DataFrame, max_day: int = 480) -> DataFrame:
    """The rows of ``warnings`` with employee_name and message, in order of employee, kind and day."""
    who = warned.join(employees.select("employee_id", F.col("name").alias("employee_name"), "max_week_minutes"), "employee_id", "left")
    said = (
        F.when(F.col("kind") == "overtime_day", F.concat(hours_text(F.col("value"), 1), F.lit("h on "), F.col("day").cast("string"), F.lit(" (over "), hours_text(F.lit(max_day), 0), F.lit("h/day)")))
        .when(F.col("kind") == "overtime_week", F.concat(hours_text(F.col("value"), 1), F.lit("h this week (over their "), hours_text(F.coalesce("max_week_minutes", F.lit(2400)), 0), F.lit("h cap)")))
        .otherwise(F.concat(F.col("value").cast("string"), F.lit(" consecutive days (run starting "), F.col("day").cast("string"), F.lit(")")))
    )
    return who.withColumn("message", F.concat("employee_name", F.lit(": "), said)).drop("max_week_minutes").orderBy("employee_id", "kind", "day")


def suggestions(slots: DataFrame, shifts: DataFrame, employees: DataFrame, levels: DataFrame, assignments: DataFrame, availability: DataFrame, time_off: DataFrame, history: DataFrame, ratings: DataFrame, rest: int = 480, max_day: int = 480, max_consecutive: int = 6) -> DataFrame:
    """For each open slot (shift_id, level_id) who could fill it, and how much of a stretch it would be.

    Hard exclusions: inactive, level that does not count or is lower, on the shift already, time off, clash with an own
    shift.  Flags: 0 covering down, 1 overtime of week or day, 2 too many days in a row, 3 outside availability; softness
    is the highest flag, -1 without any, and ``reason`` joins what they say.  ``employees`` has name, active, level_id and
    max_week_minutes; ``ratings`` plus_minus and tickets (null and 0 for who has none).  Where shifts and employees both
    have a store, only people of the slot's store are asked.  In order of slot, softness, rating (null as 0, best first)
    and id; ``place`` numbers the candidates of a slot in that order.
    """
    store = shared_store(shifts, employees)
    lv = levels.select(F.col("level_id"), "level_name", "rank", "counts_for_rating")
    people = employees.where("active").join(small(lv), "level_id").where("counts_for_rating")
    people = people.select(*store, "employee_id", F.col("name").alias("employee_name"), F.col("level_id").alias("own_level"), "level_name", F.col("rank").alias("own_rank"), "max_week_minutes")
    open_ = slots.join(shifts, "shift_id").join(small(lv.select("level_id", "rank")), "level_id").withColumn("minutes", F.col("end_min") - F.col("start_min"))
    # at most as many ranks as levels: an equi-join on every rank that covers the slot's
    ranks = lv.select(F.col("rank").alias("own_rank")).distinct()
    reach = open_.join(small(ranks), F.col("own_rank") >= F.col("rank"))
    pairs = reach.join(people, ["own_rank", *store]).where((F.col("own_level") == F.col("level_id")) | (F.col("own_rank") > F.col("rank")))
    mine = assignments.join(shifts, "shift_id").select("employee_id", "shift_id", "week", "date", "start_min", "end_min")
    clash = (F.col("p.employee_id") == F.col("m.employee_id")) & (F.col("p.week") == F.col("m.week")) & ((F.col("p.shift_id") == F.col("m.shift_id")) | conflicting("m", "p", F.col("p.week"), rest))
    pairs = free_pairs(pairs, time_off).alias("p").join(mine.alias("m"), clash, "left_anti")
    week = mine.groupBy("employee_id", "week").agg(F.sum(F.col("end_min") - F.col("start_min")).alias("week_minutes"))
    day = mine.groupBy("employee_id", "date").agg(F.sum(F.col("end_min") - F.col("start_min")).alias("day_minutes"))
    pairs = in_windows(pairs.join(week, ["employee_id", "week"], "left").join(day, ["employee_id", "date"], "left"), availability)
    # the run through the shift's day: days of the week's own shifts and of the days before the week, and that day
    key = ["employee_id", "week", "date"]
    seeds = pairs.select(*key).distinct()
    known = mine.select("employee_id", "week", F.col("date").alias("day"))
    past = seeds.join(by_week(history, max_consecutive), ["employee_id", "week"])
    days = past.select(*key, "day").union(seeds.join(known, ["employee_id", "week"]).select(*key, "day")).union(seeds.select(*key, F.col("date").alias("day")))
    run = day_runs(days, key, "day").where(F.col("date").between(F.col("run_start"), F.col("run_end"))).select(*key, "run_days")
    pairs = pairs.join(run, key)
    down = F.col("own_level") != F.col("level_id")
    over_week = F.coalesce("week_minutes", F.lit(0)) + F.col("minutes") > F.col("max_week_minutes")
    over_day = F.coalesce("day_minutes", F.lit(0)) + F.col("minutes") > max_day
    late, away = F.col("run_days") > max_consecutive, ~F.col("inside")
    flag = lambda test, n: F.when(test, n).otherwise(-1)
    softness = F.greatest(flag(down, 0), flag(over_week | over_day, 1), flag(late, 2), flag(away, 3))
    said = [
        F.when(down, COVERS), F.when(over_week, OVER_WEEK), F.when(over_day, OVER_DAY % round(max_day / 60)),
        F.when(late, F.format_string(IN_A_ROW, "run_days", F.lit(max_consecutive))), F.when(away, OUTSIDE),
    ]
    reason = F.coalesce(F.nullif(F.concat_ws("; ", *said), F.lit("")), F.lit(ELIGIBLE))
    rated = ratings.select("employee_id", F.col("plus_minus").alias("rating"), "tickets")
    out = pairs.withColumns({"softness": softness, "reason": reason}).join(rated, "employee_id", "left")
    out = out.select("shift_id", "level_id", "employee_id", "employee_name", "level_name", "softness", "reason", "run_days", "rating", F.coalesce("tickets", F.lit(0)).cast("long").alias("tickets"))
    order = ["softness", F.desc(F.coalesce("rating", F.lit(0.0))), "employee_id"]
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("shift_id", "level_id").orderBy(*order)))
    return out.orderBy("shift_id", "level_id", *order)
