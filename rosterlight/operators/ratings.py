"""Plus/minus ratings: who was on the floor when tickets were on time more, or less, often than the hour would suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_join, point_in_interval, small

DEFAULT_TARGET = 300
DEFAULT_GOAL = 0.9


def in_range(at: str, start: str, end: str) -> Column:
    """``at`` on the days from start to end, both included; the column stays bare, so that scans can skip by it."""
    return (F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def judged(tickets: DataFrame, sla: DataFrame, start: str, end: str) -> DataFrame:
    """Tickets of the range that were not recalled, with the target in force on their day, on_time and hour."""
    live = tickets.where(in_range("created_at", start, end) & ~F.col("recalled"))
    due = asof_join(live, sla.select("target_seconds", "effective_from"), F.to_date("l.created_at"), "effective_from")
    target = F.coalesce("target_seconds", F.lit(DEFAULT_TARGET))
    return due.drop("effective_from").withColumn("target_seconds", target).withColumns({"on_time": (F.col("completion_seconds") <= target).cast("int"), "hour": F.hour("created_at")})


def hour_baseline(tickets: DataFrame) -> DataFrame:
    """Judged tickets -> hour, baseline: the share on time; at most 24 rows."""
    return tickets.groupBy("hour").agg(F.avg("on_time").alias("baseline"))


def on_floor(tickets: DataFrame, sessions: DataFrame, breaks: DataFrame, levels: DataFrame, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per judged ticket and session that it fell into, off breaks, at a level that counts.

    Overlapping sessions of one person count a ticket each.  ``keys`` (a store, say) are columns of tickets and sessions
    that must agree.
    """
    crew = sessions.where((F.col("clock_in") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")) & (F.col("clock_out") > F.lit(start).cast("timestamp_ntz")))
    crew = crew.join(small(levels.where("counts_for_rating").select("level_id")), "level_id", "left_semi").select("session_id", "employee_id", "clock_in", "clock_out", *keys)
    hits = point_in_interval(tickets, crew, "created_at", "clock_in", "clock_out", keys)
    off = (F.col("h.session_id") == F.col("b.session_id")) & (F.col("b.break_start") <= F.col("h.created_at")) & (F.col("h.created_at") < F.col("b.break_end"))
    return hits.alias("h").join(breaks.alias("b"), off, "left_anti")


def by_session(hits: DataFrame) -> DataFrame:
    """Hits -> employee_id, session_id, n, ok (and base, where hits have a baseline): all that ratings need of them, in one pass."""
    base = [F.sum("baseline").alias("base")] if "baseline" in hits.columns else []
    return hits.groupBy("employee_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("on_time").alias("ok"), *base)


def session_hits(hits: DataFrame, goal: DataFrame) -> DataFrame:
    """Hits -> employee_id, shifts_hit_target, shifts_total over sessions with a ticket; ``goal`` is one row."""
    return by_session(hits).crossJoin(F.broadcast(goal)).groupBy("employee_id").agg(*met())


def met() -> list[Column]:
    """Aggregates over rows of one session each, with n, ok and goal."""
    return [F.count_if(F.col("ok") / F.col("n") >= F.col("goal")).cast("int").alias("shifts_hit_target"), F.count(F.lit(1)).cast("int").alias("shifts_total")]


def level_as_of(employee_levels: DataFrame, day: Column) -> DataFrame:
    """employee_id, level_id: each employee's level on a day."""
    return employee_levels.where(F.col("effective_from") <= day).groupBy("employee_id").agg(F.max_by("level_id", "effective_from").alias("level_id"))


def latest_goal(sla: DataFrame) -> DataFrame:
    """One row: the goal of the last configuration, even one that is not yet in force."""
    return sla.agg(F.coalesce(F.max_by("adherence_goal", "effective_from"), F.lit(DEFAULT_GOAL)).alias("goal"))


def ratings(tickets: DataFrame, sessions: DataFrame, breaks: DataFrame, levels: DataFrame, employee_levels: DataFrame, sla: DataFrame, start: str, end: str, shrink: int = 300, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per employee with a ticket: adherence, expectation, raw and shrunk plus/minus, sessions that met the goal."""
    own = judged(tickets, sla, start, end)
    hits = on_floor(own, sessions, breaks, levels, start, end, keys).join(F.broadcast(hour_baseline(own)), "hour")
    sums = by_session(hits).crossJoin(F.broadcast(latest_goal(sla))).groupBy("employee_id").agg(
        F.sum("n").alias("tickets"), (F.sum("ok") / F.sum("n")).alias("actual"), (F.sum("base") / F.sum("n")).alias("expected"), *met()
    )
    named = level_as_of(employee_levels, F.lit(end).cast("date")).join(levels.select("level_id", "level_name"), "level_id").select("employee_id", "level_name")
    return sums.join(named, "employee_id", "left").select(*shown(shrink))


def shown(shrink: int) -> list[Column]:
    """A person's report of tickets, actual, expected and level_name, and the sessions that were met."""
    raw = (F.col("actual") - F.col("expected")) * 100
    return [
        F.col("employee_id"),
        F.coalesce("level_name", F.lit("")).alias("level_name"),
        F.col("tickets").cast("long").alias("tickets"),
        F.round("actual", 4).alias("on_floor_adherence"),
        F.round("expected", 4).alias("expected_adherence"),
        (F.round(raw, 2) + 0.0).alias("raw_plus_minus"),
        (F.round(raw * F.col("tickets") / (F.col("tickets") + shrink), 2) + 0.0).alias("plus_minus"),
        F.col("shifts_hit_target"),
        F.col("shifts_total"),
    ]


def ranked(rated: DataFrame) -> DataFrame:
    """``rated`` with its place, the best first, of equals the lower id; one row a person, so one task numbers them."""
    order = [F.desc("plus_minus"), F.col("employee_id")]
    return rated.withColumn("place", F.row_number().over(Window.orderBy(*order))).orderBy("place")


def what_if(tickets: DataFrame, target: int, start: str, end: str) -> DataFrame:
    """One row: the share of the range's tickets within a target; 0.0 without a ticket."""
    live = tickets.where(in_range("created_at", start, end) & ~F.col("recalled"))
    share = F.coalesce(F.try_divide(F.count_if(F.col("completion_seconds") <= target), F.count(F.lit(1))), F.lit(0.0))
    return live.agg(F.count(F.lit(1)).cast("long").alias("tickets"), F.round(share, 4).alias("adherence"))
