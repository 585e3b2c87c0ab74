"""Weekly assignment and daily break placement.

Candidates, limits and conflicts are DataFrames; only the search of a group runs in Python (``search``).  A group of the
assignment is one level of one week (of one store, where shifts name one): everybody has one level a week, so levels share
neither people nor slots.  A group of the breaks is one day (of one store).  Neither grows with the history.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import by_week, entitled
from .search import SLOT, Break, Day, Person, Pick, Week, best_day, best_week, parts


def solved_weeks(candidates: DataFrame, shifts: DataFrame, requirements: DataFrame, employees: DataFrame, conflicts: DataFrame, history: DataFrame, ratings: DataFrame, weights: DataFrame, manual: DataFrame, max_day: int = 480, max_consecutive: int = 6) -> DataFrame:
    """One row per week and level with a candidate: picks (employee_id, shift_id), objective, bound and is_optimal.

    The objective is 1e6 for each fill, plus the rating in tenths times the shift's demand weight, less everybody's distance
    from their target minutes.  ``bound`` is a value that no plan exceeds; is_optimal says that the plan reaches it.  A
    part of a group that shares no person and no slot with others is searched alone, exactly up to a number of nodes.
    ``conflicts`` are the ``conflict_spans`` of the shifts.  ``shifts`` may have a store; groups are then those of a store,
    and people and slots of stores are never mixed.
    """
    store = [c for c in ("store",) if c in shifts.columns]
    keys = [*store, "week", "level_id"]
    rated = ratings.select("employee_id", F.col("plus_minus").alias("rating"))
    size = requirements.groupBy("shift_id", "level_id").agg(F.sum("count").alias("cap"))
    have = manual.groupBy("shift_id", F.col("fills_level_id").alias("level_id")).agg(F.count(F.lit(1)).alias("filled"))
    clash = conflicts.select("shift_id", F.struct("place", "same_until", "next_from", "next_until").alias("clash"))
    fixed = manual.join(shifts, "shift_id").groupBy("employee_id", "week").agg(F.collect_list(F.struct(F.datediff("date", "week").alias("d"), (F.col("end_min") - F.col("start_min")).alias("m"))).alias("fixed"))
    past = by_week(history, max_consecutive).groupBy("employee_id", "week").agg(F.collect_set(F.datediff("day", "week")).alias("past"))
    rows = (
        candidates.join(shifts, "shift_id").join(size, ["shift_id", "level_id"]).join(have, ["shift_id", "level_id"], "left").join(clash, "shift_id", "left")
        .join(weights, "shift_id", "left").join(rated, "employee_id", "left").join(employees.select("employee_id", "max_week_minutes", "target_week_minutes"), "employee_id")
        .join(fixed, ["employee_id", "week"], "left").join(past, ["employee_id", "week"], "left")
    )
    rows = rows.select(
        *keys, "employee_id", "shift_id", F.datediff("date", "week").alias("d"), (F.col("end_min") - F.col("start_min")).alias("m"),
        F.greatest(F.col("cap") - F.coalesce("filled", F.lit(0)), F.lit(0)).alias("room"), "clash",
        ((F.coalesce("rating", F.lit(0.0)) * 10).cast("int") * F.coalesce("weight", F.lit(1))).alias("quality"),
        "max_week_minutes", F.coalesce("target_week_minutes", F.lit(0)).alias("target"), "fixed", "past",
    )
    types = dict(rows.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf.to_dict("records")
        part = parts([(("e", r["employee_id"]), ("s", r["shift_id"])) for r in items])
        grouped: dict[int, list[dict]] = {}
        for r in items:
            grouped.setdefault(part["e", r["employee_id"]], []).append(r)
        picks, objective, bound = [], 0, 0
        for own in grouped.values():
            people: dict[int, Person] = {}
            for r in own:
                if r["employee_id"] not in people:
                    day: dict[int, int] = {}
                    for x in r["fixed"] if r["fixed"] is not None else ():
                        day[x["d"]] = day.get(x["d"], 0) + x["m"]
                    total = sum(day.values())
                    past = set(map(int, r["past"])) if r["past"] is not None else set()
                    people[r["employee_id"]] = Person(max(int(r["max_week_minutes"]), total), int(r["target"]), {d: max(max_day, m) for d, m in day.items()}, set(day), past, total, dict(day))
            room = {r["shift_id"]: int(r["room"]) for r in own}
            clashes = {r["shift_id"]: tuple(r["clash"][k] for k in ("place", "same_until", "next_from", "next_until")) for r in own if r["clash"] is not None}
            week = Week([Pick(r["employee_id"], r["shift_id"], int(r["d"]), int(r["m"]), int(r["quality"])) for r in own], people, room, clashes, max_day, max_consecutive)
            plan, score, top = best_week(week)
            picks += [{"employee_id": p.employee, "shift_id": p.shift} for p in plan]
            objective, bound = objective + score, bound + top
        first = pdf.iloc[0]
        return pd.DataFrame([(*[first[k] for k in keys], picks, objective, bound, objective == bound)], columns=[*keys, "picks", "objective", "bound", "is_optimal"])

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(solve, f"{schema}, picks array<struct<employee_id:{types['employee_id']},shift_id:{types['shift_id']}>>, objective long, bound long, is_optimal boolean")


def assign_weeks(candidates: DataFrame, shifts: DataFrame, requirements: DataFrame, employees: DataFrame, conflicts: DataFrame, history: DataFrame, ratings: DataFrame, weights: DataFrame, manual: DataFrame, max_day: int = 480, max_consecutive: int = 6) -> DataFrame:
    """(store,) week, employee_id, shift_id, level_id, is_optimal: the picks of ``solved_weeks``, one row each."""
    solved = solved_weeks(candidates, shifts, requirements, employees, conflicts, history, ratings, weights, manual, max_day, max_consecutive)
    store = [c for c in ("store",) if c in solved.columns]
    return solved.select(*store, "week", "level_id", "is_optimal", F.explode("picks").alias("p")).select(*store, "week", "p.employee_id", "p.shift_id", "level_id", "is_optimal")


def _breaks(rest: Column, meal: Column, fallback: bool) -> Column:
    """The breaks of an entitlement as (order, kind, share of the shift).  The fallback anchors a lone rest at a quarter."""
    b = lambda k, kind, at: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(at).alias("share"))
    if fallback:
        rests = F.when(rest >= 1, F.array(b(0, "rest", 0.25))).otherwise(F.array().cast("array<struct<k:int,kind:string,share:double>>"))
        more = F.when(rest >= 2, F.array(b(99, "rest", 0.75))).otherwise(F.array().cast("array<struct<k:int,kind:string,share:double>>"))
        meals = F.transform(F.when(meal >= 1, F.sequence(F.lit(1), meal)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.cast("int").alias("k"), F.lit("meal").alias("kind"), F.lit(0.5).alias("share")))
        return F.concat(rests, meals, more)
    return (
        F.when((rest >= 2) & (meal >= 1), F.array(b(0, "rest", 0.25), b(1, "meal", 0.5), b(2, "rest", 0.75)))
        .when((rest == 1) & (meal >= 1), F.array(b(0, "rest", 0.25), b(1, "meal", 0.5)))
        .when(meal >= 1, F.array(b(0, "meal", 0.5)))
        .when(rest == 1, F.array(b(0, "rest", 0.5)))
        .when(rest == 2, F.array(b(0, "rest", 0.33), b(1, "rest", 0.75)))
        .when(rest >= 3, F.transform(F.sequence(F.lit(0), rest - 1), lambda k: F.struct(k.cast("int").alias("k"), F.lit("rest").alias("kind"), F.lit(0.5).alias("share"))))
    )


def anchored_breaks(roster: DataFrame, rules: DataFrame, rest_minutes: int = 10, meal_minutes: int = 30, edge: int = 45, meal_by: int = 300) -> DataFrame:
    """entry_id, k, kind, start_min, end_min: each break at its anchor, moved inside the shift, without regard to others."""
    rows = entitled(roster, rules)
    rows = rows.withColumn("b", F.explode(_breaks(F.col("rest_breaks"), F.col("meal_breaks"), True))).select("*", "b.*")
    minutes = F.when(F.col("kind") == "rest", rest_minutes).otherwise(meal_minutes)
    start = (F.col("start_min") + (F.col("end_min") - F.col("start_min")) * F.col("share")).cast("int")
    start = F.least(F.greatest(start, F.col("start_min") + edge), F.col("end_min") - edge - minutes)
    start = F.when(F.col("kind") == "meal", F.least(start, F.col("start_min") + meal_by)).otherwise(start)
    rows = rows.withColumn("at", start).where((F.col("at") >= F.col("start_min")) & (F.col("at") + minutes <= F.col("end_min")))
    return rows.select("entry_id", "k", "kind", F.col("at").cast("int").alias("start_min"), (F.col("at") + minutes).cast("int").alias("end_min"))


def plan_breaks(roster: DataFrame, rules: DataFrame, costs: DataFrame, rest_minutes: int = 10, meal_minutes: int = 30, edge: int = 45, gap: int = 90, concurrent: int = 1, meal_by: int = 300) -> DataFrame:
    """(store,) date, entry_id, k, kind, start_min, end_min, paid, status, cost, bound: the breaks of a day at the least cost.

    The cost is ten times the demand of the slots that breaks take (``costs``: the 288 slots of a day) plus their distance
    in slots from their anchors; at most ``concurrent`` at a time, ``gap`` minutes between breaks of one entry.  Breaks
    that cannot keep the edges of their shift are left out.  status: ``optimal`` (no cheaper plan), ``feasible`` (the
    search ended at its number of nodes), and, where all breaks of the day stand at their own anchors without regard to
    others (``anchored_breaks``), ``infeasible`` (no plan exists) or ``not found``.  cost is that of the day's plan and bound
    one that no plan undercuts (-1 without a plan).  Lengths that are no multiple of five
    minutes reserve their last slot whole.  ``roster`` may have a store; days are then those of a store.
    """
    store = [c for c in ("store",) if c in roster.columns]
    keys = [*store, "date"]
    due = entitled(roster, rules).where("rest_breaks + meal_breaks > 0")
    rows = due.withColumn("b", F.explode(_breaks(F.col("rest_breaks"), F.col("meal_breaks"), False))).select(*keys, "entry_id", "start_min", "end_min", "b.*")
    minutes = F.when(F.col("kind") == "rest", rest_minutes).otherwise(meal_minutes)
    high = F.col("end_min") - edge - minutes
    high = F.when(F.col("kind") == "meal", F.least(high, F.col("start_min") + meal_by)).otherwise(high)
    rows = rows.withColumns({"minutes": minutes, "low": F.ceil((F.col("start_min") + edge) / SLOT).cast("int"), "high": F.floor(high / SLOT).cast("int"), "anchor": F.bround((F.col("start_min") + (F.col("end_min") - F.col("start_min")) * F.col("share")) / SLOT).cast("int")})
    rows = rows.where("low <= high").select(*keys, "entry_id", "k", "kind", "minutes", "low", "high", "anchor", F.lit(0).alias("start_min"), F.lit(0).alias("end_min"))
    alone = anchored_breaks(roster, rules, rest_minutes, meal_minutes, edge, meal_by).join(roster.select("entry_id", *keys), "entry_id")
    alone = alone.select(*keys, "entry_id", "k", "kind", *[F.lit(None).cast("int").alias(c) for c in ("minutes", "low", "high", "anchor")], "start_min", "end_min")
    both = rows.unionByName(alone)
    table = costs.agg(F.array_sort(F.collect_list(F.struct("slot", "cost"))).alias("costs"))  # 288 numbers
    both = both.crossJoin(F.broadcast(table))
    types = dict(both.dtypes)
    names = [*keys, "entry_id", "k", "kind", "start_min", "end_min", "paid", "status", "cost", "bound"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cost = {int(x["slot"]): int(x["cost"]) for x in pdf["costs"].iloc[0]}
        pdf = pdf.drop(columns="costs")
        items = sorted(pdf[pdf["low"].notna()].to_dict("records"), key=lambda r: (r["low"], r["entry_id"], r["k"]))
        breaks = []
        for r in items:
            slots = -(-int(r["minutes"]) // SLOT)
            prices = {s: 10 * sum(cost.get(s + i, 0) for i in range(slots)) + abs(s - int(r["anchor"])) for s in range(int(r["low"]), int(r["high"]) + 1)}
            breaks.append(Break(r["entry_id"], int(r["k"]), int(r["low"]), int(r["high"]), slots, prices))
        # breaks whose windows never meet, of entries that never meet, do not touch each other
        links, end, open_ = [], -1, None
        for n, b in sorted(enumerate(breaks), key=lambda x: x[1].low):
            links += [(n, ("entry", b.entry)), (n, open_ if b.low < end else n)]
            if b.high + b.slots > end:
                end, open_ = b.high + b.slots, n
        part = parts(links)
        starts: dict[int, int] = {}
        status, cost_all, bound = "optimal", 0, 0
        for p in sorted({part[n] for n in range(len(breaks))}):
            own = [n for n in range(len(breaks)) if part[n] == p]
            plan, price, least, exact = best_day(Day([breaks[n] for n in own], -(-gap // SLOT), concurrent))
            if plan is None:
                status = "infeasible" if exact else "not found"
                break
            if price > least:
                status = "feasible"
            cost_all, bound = cost_all + price, bound + least
            starts |= {own[i]: s for i, s in plan.items()}
        if status in ("optimal", "feasible"):
            out = [(*[r[k] for k in keys], r["entry_id"], int(r["k"]), r["kind"], starts[n] * SLOT, starts[n] * SLOT + int(r["minutes"]), r["kind"] == "rest", status, cost_all, bound) for n, r in enumerate(items)]
        else:
            out = [(*[r[k] for k in keys], r["entry_id"], int(r["k"]), r["kind"], int(r["start_min"]), int(r["end_min"]), r["kind"] == "rest", status, -1, -1) for r in pdf[pdf["low"].isna()].to_dict("records")]
        return pd.DataFrame(out, columns=names)

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return both.groupBy(*keys).applyInPandas(solve, f"{schema}, entry_id {types['entry_id']}, k int, kind string, start_min int, end_min int, paid boolean, status string, cost long, bound long")
