"""Report cells: exact sums by day that answer ratings of any window, and what-if for any targets, without the tickets.

Cells are whole-number sums, so cells of two uploads add up.  Beside them stand marks: the sums of each key before the
first day of every month.  A window is the difference of what lies before its two edges, and what lies before an edge is
the mark of its month and the cells of that month before it.  However long a window is, a report reads two months of cells
and two marks a key; only sessions, which a window may cut, are read for its days.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ratings import DEFAULT_TARGET, judged, latest_goal, met, on_floor, shown
from .temporal import asof_join

#: A window: its first and last day, both included, as ISO text.
Days = tuple[str, str]

ALL_DAYS: Days = ("0001-01-01", "9999-12-30")


@dataclass(frozen=True)
class Cells:
    """tickets: day, hour, completion_seconds, n.  floor: employee_id, session_id, day, hour, n, ok, of tickets on somebody's floor."""

    tickets: DataFrame
    floor: DataFrame


def ticket_cells(tickets: DataFrame) -> DataFrame:
    """day, hour, completion_seconds, n of the tickets that were not recalled; those without a creation time, and recalled null, count nowhere."""
    live = tickets.where(~F.col("recalled") & F.col("created_at").isNotNull())
    return live.groupBy(F.to_date("created_at").alias("day"), F.hour("created_at").alias("hour"), "completion_seconds").agg(F.count(F.lit(1)).alias("n"))


def report_cells(tickets: DataFrame, sessions: DataFrame, breaks: DataFrame, levels: DataFrame, sla: DataFrame, keys: tuple[str, ...] = ()) -> Cells:
    """The cells of all tickets.  Floor cells judge by ``sla``: after a change of targets, build those of its days again."""
    hits = on_floor(judged(tickets, sla, *ALL_DAYS), sessions, breaks, levels, *ALL_DAYS, keys)
    floor = hits.groupBy("employee_id", "session_id", F.to_date("created_at").alias("day"), "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("on_time").cast("long").alias("ok"))
    return Cells(ticket_cells(tickets), floor)


def merged(one: Cells, other: Cells) -> Cells:
    """The cells of two sets of tickets that share none."""
    both = lambda a, b, sums: a.unionByName(b).groupBy(*[c for c in a.columns if c not in sums]).agg(*[F.sum(c).alias(c) for c in sums])
    return Cells(both(one.tickets, other.tickets, ["n"]), both(one.floor, other.floor, ["n", "ok"]))


def marks(cells: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """month, keys, sums: totals of each key before the first day of a month, from its second month to one month after the last of all."""
    month = F.trunc("day", "month").alias("month")
    per = cells.groupBy(*keys, month).agg(*[F.sum(c).alias(c) for c in sums])
    up = Window.partitionBy(*keys).orderBy("month")
    run = per.select(*keys, "month", F.lead("month").over(up).alias("next__"), *[F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in sums])
    last = per.agg(F.add_months(F.max("month"), 1).alias("last__"))
    until = F.sequence(F.add_months("month", 1), F.coalesce("next__", "last__"), F.expr("INTERVAL '1' MONTH"))
    return run.crossJoin(F.broadcast(last)).select(*keys, *sums, F.explode(until).alias("month")).select("month", *keys, *sums)


def _among(windows: list[Days]) -> Column:
    day = lambda d: F.lit(dt.date.fromisoformat(d))
    return F.array(*[F.struct(F.lit(i).alias("window_no"), day(s).alias("first"), day(e).alias("last")) for i, (s, e) in enumerate(windows)])


def window_sums(cells: DataFrame, before: DataFrame, keys: list[str], sums: list[str], windows: list[Days]) -> DataFrame:
    """window_no, keys, sums of the windows (numbered from 0) in which the key has a row; ``before`` holds the marks of ``cells``.

    Looks up the last month of the marks first.  ``windows`` is a list of reports asked for, which becomes part of the plan.
    Cells may be stored by a ``month`` column (the first of the month), so that folders of other months are not opened.
    """
    top = before.agg(F.max("month")).first()[0]
    edges = []
    for i, (s, e) in enumerate(windows):
        for day, sign in ((dt.date.fromisoformat(s), -1), (dt.date.fromisoformat(e) + dt.timedelta(days=1), 1)):
            edges.append((i, day if top is None or day < top else top, sign))
    held = F.array(*[F.struct(F.lit(i).alias("window_no"), F.lit(d).alias("edge"), F.lit(d.replace(day=1)).alias("month"), F.lit(sign).alias("sign")) for i, d, sign in edges])
    signed = lambda df, of: df.withColumn("x__", F.explode(F.filter(held, of))).select("x__.window_no", *keys, *[(F.col("x__.sign") * F.col(c)).alias(c) for c in sums])
    months = sorted({d.replace(day=1) for _, d, _ in edges})
    heads = signed(before.where(F.col("month").isin(months)), lambda x: x.month == F.col("month"))
    near = None
    for m in months:
        end = max(d for _, d, _ in edges if d.replace(day=1) == m)
        one = (F.col("day") >= F.lit(m)) & (F.col("day") < F.lit(end))
        one = one & (F.col("month") == F.lit(m)) if "month" in cells.columns else one
        near = one if near is None else near | one
    rest = signed(cells.where(near), lambda x: (x.month <= F.col("day")) & (F.col("day") < x.edge))
    out = heads.unionByName(rest).groupBy("window_no", *keys).agg(*[F.sum(c).alias(c) for c in sums])
    return out.where(F.col(sums[0]) != 0)


def what_if_targets(tickets: DataFrame, before: DataFrame, targets: list[int], windows: list[Days]) -> DataFrame:
    """window_no, target_seconds, tickets, adherence: what each target would have meant for each window; 0.0 without a ticket.

    ``tickets`` are ticket cells and ``before`` their marks by completion_seconds.
    """
    per = window_sums(tickets, before, ["completion_seconds"], ["n"], windows)
    within = lambda t: F.coalesce(F.sum(F.when(F.col("completion_seconds") <= t, F.col("n"))), F.lit(0))
    sums = per.groupBy("window_no").agg(F.sum("n").alias("n"), F.array(*[F.struct(F.lit(t).alias("target_seconds"), within(t).alias("ok")) for t in targets]).alias("of"))
    asked = tickets.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(len(windows) - 1))).alias("window_no"))
    asked = asked.withColumn("target_seconds", F.explode(F.array(*[F.lit(t) for t in targets])))
    got = sums.select("window_no", F.col("n"), F.explode("of").alias("x")).select("window_no", "x.target_seconds", "n", "x.ok")
    return F.broadcast(asked).join(got, ["window_no", "target_seconds"], "left").select(
        "window_no", "target_seconds", F.coalesce("n", F.lit(0)).cast("long").alias("tickets"), F.round(F.coalesce(F.col("ok") / F.col("n"), F.lit(0.0)), 4).alias("adherence")
    )


@dataclass(frozen=True)
class RatingTables:
    """What ratings read: hours (day, hour, n, ok of all judged tickets), people (employee_id, day, hour, n, ok), their marks, and session days."""

    hours: DataFrame
    hours_before: DataFrame
    people: DataFrame
    people_before: DataFrame
    sessions: DataFrame


def rating_tables(cells: Cells, sla: DataFrame) -> RatingTables:
    """Cells as the tables that ratings read.  They hold a few rows a person and day: write them (by month) where reports are many."""
    due = asof_join(cells.tickets, sla.select("target_seconds", "effective_from"), F.col("l.day"), "effective_from")
    known = due.where(F.col("completion_seconds").isNotNull())
    ok = F.when(F.col("completion_seconds") <= F.coalesce("target_seconds", F.lit(DEFAULT_TARGET)), F.col("n")).otherwise(0)
    hours = known.groupBy("day", "hour").agg(F.sum("n").alias("n"), F.sum(ok).alias("ok"))
    people = cells.floor.groupBy("employee_id", "day", "hour").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    sessions = cells.floor.groupBy("employee_id", "session_id", "day").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    return RatingTables(hours, marks(hours, ["hour"], ["n", "ok"]), people, marks(people, ["employee_id", "hour"], ["n", "ok"]), sessions)


def window_ratings(t: RatingTables, levels: DataFrame, employee_levels: DataFrame, sla: DataFrame, windows: list[Days], shrink: int = 300) -> DataFrame:
    """``ratings.ratings`` of every window, with its number: the same rows, from the cells."""
    among = _among(windows)
    base = window_sums(t.hours, t.hours_before, ["hour"], ["n", "ok"], windows).select("window_no", "hour", (F.col("ok") / F.col("n")).alias("baseline"))
    own = window_sums(t.people, t.people_before, ["employee_id", "hour"], ["n", "ok"], windows)
    per = own.join(F.broadcast(base), ["window_no", "hour"], "left").groupBy("window_no", "employee_id").agg(
        F.sum("n").alias("tickets"), (F.sum("ok") / F.sum("n")).alias("actual"), (F.sum(F.col("baseline") * F.col("n")) / F.sum("n")).alias("expected")
    )
    lo, hi = (F.lit(dt.date.fromisoformat(f(d[k] for d in windows))) for k, f in ((0, min), (1, max)))
    days = t.sessions.where((F.col("day") >= lo) & (F.col("day") <= hi)).withColumn("x__", F.explode(F.filter(among, lambda w: (w.first <= F.col("day")) & (F.col("day") <= w.last))))
    rates = days.groupBy("x__.window_no", "employee_id", "session_id").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    hit = rates.crossJoin(F.broadcast(latest_goal(sla))).groupBy("window_no", "employee_id").agg(*met())
    level = employee_levels.withColumn("x__", F.explode(F.filter(among, lambda w: F.col("effective_from") <= w.last)))
    level = level.groupBy("x__.window_no", "employee_id").agg(F.max_by("level_id", "effective_from").alias("level_id"))
    named = level.join(levels.select("level_id", "level_name"), "level_id").select("window_no", "employee_id", "level_name")
    out = per.join(hit, ["window_no", "employee_id"]).join(named, ["window_no", "employee_id"], "left")
    return out.select("window_no", *shown(shrink))
