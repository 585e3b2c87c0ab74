"""Nested output views, validations and single edits of schedules and rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ratings import level_as_of
from .rules import conflicting


def employee_view(employees: DataFrame, employee_levels: DataFrame, levels: DataFrame, availability: DataFrame, time_off: DataFrame, day: Column) -> DataFrame:
    """Employees with their level on ``day`` and their windows and time off as ordered arrays (empty, not null)."""
    held = level_as_of(employee_levels, day).join(levels.select("level_id", "level_name"), "level_id").select("employee_id", F.col("level_name").alias("level"))
    windows = availability.groupBy("employee_id").agg(F.sort_array(F.collect_list(F.struct("weekday", "start_min", "end_min"))).alias("availability"))
    off = time_off.groupBy("employee_id").agg(F.sort_array(F.collect_list(F.struct("start_date", "end_date"))).alias("time_off"))
    out = employees.drop("level_id").join(held, "employee_id", "left").join(windows, "employee_id", "left").join(off, "employee_id", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    return out.withColumns({"availability": empty("availability", "array<struct<weekday:int,start_min:int,end_min:int>>"), "time_off": empty("time_off", "array<struct<start_date:date,end_date:date>>")})


def schedule_view(shifts: DataFrame, requirements: DataFrame, assignments: DataFrame, missing: DataFrame) -> DataFrame:
    """One row per shift with its requirements, assignments and open slots as ordered arrays; zero requirements are left out."""
    nested = lambda df, cols, name: df.groupBy("shift_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    return (
        shifts.join(nested(requirements.where(F.col("count") > 0), ["level_id", "count"], "requirements"), "shift_id", "left")
        .join(nested(assignments, ["employee_id", "fills_level_id", "manual"], "assignments"), "shift_id", "left")
        .join(nested(missing, ["level_id", "missing"], "unfilled"), "shift_id", "left")
    )


def schedule_detail(shifts: DataFrame, assignments: DataFrame, missing: DataFrame, warned: DataFrame) -> DataFrame:
    """One row per week: its shifts, assignments, open slots and warnings as ordered arrays (empty, not null)."""
    week = shifts.select("shift_id", "week")
    nested = lambda df, cols, name: df.groupBy("week").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = nested(shifts, ["date", "start_min", "shift_id", "end_min"], "shifts")
    parts = [(assignments.join(week, "shift_id"), ["shift_id", "employee_id", "fills_level_id", "manual"], "assignments"), (missing.join(week, "shift_id"), ["shift_id", "level_id", "missing"], "unfilled"), (warned, ["employee_id", "kind", "day", "message"], "warnings")]
    for df, cols, name in parts:
        own = nested(df, cols, name)
        out = out.join(own, "week", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def day_view(roster: DataFrame, breaks: DataFrame) -> DataFrame:
    """Roster entries with their breaks in order of start."""
    own = breaks.groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("start_min", "end_min", "kind"))).alias("breaks"))
    return roster.join(own, "entry_id", "left")


def week_slice(shifts: DataFrame, week: Column) -> DataFrame:
    """The shifts of the seven days from ``week`` on, by date, start and id."""
    return shifts.where((F.col("date") >= week) & (F.col("date") < F.date_add(week, 7))).orderBy("date", "start_min", "shift_id")


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have these values; a filter of None is none."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def members(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``wanted``."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


#: The order of each listing; a minus sign is descending.
ORDERS = {
    "levels": ("-rank", "level_id"),
    "employees": ("lower(name)", "employee_id"),
    "templates": ("weekday", "start_min"),
    "shifts": ("date", "start_min", "shift_id"),
    "hours": ("-period_start", "lower(employee_name)"),
    "sla": ("effective_from",),
    "roster": ("start_min", "entry_id"),
}


def listed(df: DataFrame, listing: str) -> DataFrame:
    """``df`` in the order of a listing of ``ORDERS``."""
    return df.orderBy(*[F.expr(c[1:]).desc() if c[0] == "-" else F.expr(c) for c in ORDERS[listing]])


def default_window(today: Column, days: int, start: Column | None = None, end: Column | None = None) -> tuple[Column, Column]:
    """The window of a report: what is asked, else the ``days`` up to ``today``."""
    last = today if end is None else F.coalesce(end, today)
    first = F.date_sub(today, days)
    return (first if start is None else F.coalesce(start, first)), last


def split_valid(df: DataFrame, not_negative: tuple[str, ...] = (), unique: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose minutes (and weekday, if there is one) make sense, and the others.

    Columns of ``not_negative`` must be 0 or more; a value of ``unique`` that several rows have makes all of them invalid.
    """
    good = F.lit(True)
    if "start_min" in df.columns:
        good = (F.col("start_min") >= 0) & (F.col("start_min") < F.col("end_min")) & (F.col("end_min") <= 1440)
    if "weekday" in df.columns:
        good = good & F.col("weekday").between(0, 6)
    for c in not_negative:
        good = good & (F.col(c) >= 0)
    good = F.coalesce(good, F.lit(False))
    if unique:
        good = good & (F.count(F.lit(1)).over(Window.partitionBy(unique)) == 1)
    marked = df.withColumn("good__", good)
    return marked.where("good__").drop("good__"), marked.where("NOT good__").drop("good__")


def visible(schedules: DataFrame, manager: bool) -> DataFrame:
    return schedules if manager else schedules.where("status = 'published'")


def manual_check(asked: DataFrame, requirements: DataFrame, assignments: DataFrame, shifts: DataFrame) -> DataFrame:
    """Asked picks (employee_id, shift_id, level_id) with ``problem``: no such requirement, already on, overlaps, or null.

    Overlap only: rest between days, availability and time off are the warnings' business.
    """
    wanted = requirements.select("shift_id", "level_id", F.lit(True).alias("wanted")).distinct()
    on = assignments.select("shift_id", "employee_id", F.lit(True).alias("on")).distinct()
    mine = assignments.join(shifts, "shift_id").select("employee_id", "shift_id", "week", "date", "start_min", "end_min")
    a = asked.join(shifts, "shift_id").alias("a")
    hit = (F.col("a.employee_id") == F.col("m.employee_id")) & (F.col("a.week") == F.col("m.week")) & (F.col("a.shift_id") != F.col("m.shift_id")) & conflicting("a", "m", F.col("a.week"), 0)
    over = a.join(mine.alias("m"), hit, "left_semi").select("employee_id", "shift_id", F.lit(True).alias("over")).distinct()
    out = asked.join(wanted, ["shift_id", "level_id"], "left").join(on, ["shift_id", "employee_id"], "left").join(over, ["employee_id", "shift_id"], "left")
    problem = F.when(F.col("wanted").isNull(), "no such requirement").when(F.col("on").isNotNull(), "already on the shift").when(F.col("over").isNotNull(), "overlaps another shift")
    return out.select("employee_id", "shift_id", "level_id", problem.alias("problem"))


def moved_break(breaks: DataFrame, roster: DataFrame, moves: DataFrame) -> DataFrame:
    """Breaks (entry_id, k, start_min, end_min) moved to the ``to`` of ``moves`` (entry_id, k, to), where it stays in the shift."""
    shift = roster.select("entry_id", F.col("start_min").alias("from__"), F.col("end_min").alias("until__"))
    rows = breaks.join(moves, ["entry_id", "k"], "left").join(shift, "entry_id")
    length = F.col("end_min") - F.col("start_min")
    ok = F.col("to").isNotNull() & (F.col("to") >= F.col("from__")) & (F.col("to") + length <= F.col("until__"))
    return rows.withColumns({"end_min": F.when(ok, F.col("to") + length).otherwise(F.col("end_min")), "start_min": F.when(ok, F.col("to")).otherwise(F.col("start_min"))}).select(*breaks.columns)


def level_changes(employee_levels: DataFrame, wanted: DataFrame, today: Column) -> DataFrame:
    """Rows to upsert (employee_id, level_id, effective_from = today) where the level differs from the one held today."""
    held = level_as_of(employee_levels, today).withColumnRenamed("level_id", "held")
    return wanted.join(held, "employee_id", "left").where(~F.col("level_id").eqNullSafe(F.col("held"))).select("employee_id", "level_id", today.alias("effective_from"))


def seeded(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """``df``, or the defaults if it has no row."""
    return df.unionByName(defaults.join(df.limit(1).select(F.lit(1)), F.lit(True), "left_anti"))


def latest_hours(hours: DataFrame) -> DataFrame:
    """Of each person, without regard to case, the row of the latest period."""
    return hours.groupBy(F.lower("employee_name").alias("key")).agg(F.max_by(F.struct(*hours.columns), F.struct("period_start", "period_end")).alias("r")).select("r.*")
