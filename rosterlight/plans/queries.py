"""The registered domain queries and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells, demand, ratings, rules, scheduling, temporal, views
from ..sources import html_tables, sinks, testviews
from ..sources.testviews import END, START, Views
from .shared import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under its name; ``sql`` follows the common tables of the domain.  ``dates`` are returned as text."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})
        if sql is not None:
            own = f"WITH {testviews.SQL.strip()}{sql}"
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({own})" if dates else own
        return f

    return put


_JUDGED = f""",
    live AS (SELECT *, hour(created_at) AS h FROM tickets WHERE created_at >= DATE '{START}' AND created_at < DATE '{END}' + 1 AND NOT recalled),
    judged AS (SELECT t.*, coalesce((SELECT s.target_seconds FROM sla s WHERE s.effective_from <= CAST(t.created_at AS DATE) ORDER BY s.effective_from DESC LIMIT 1), 300) AS target FROM live t),
    verdict AS (SELECT *, CASE WHEN completion_seconds <= target THEN 1 ELSE 0 END AS ok FROM judged)"""
_HITS = f"""{_JUDGED},
    base AS (SELECT h, avg(ok) AS baseline FROM verdict GROUP BY h),
    hits AS (SELECT s.employee_id, s.session_id, v.ticket_id, v.ok, b.baseline FROM verdict v JOIN base b USING (h)
             JOIN sessions s ON s.clock_in <= v.created_at AND v.created_at < s.clock_out JOIN levels l ON l.level_id = s.level_id AND l.counts_for_rating
             WHERE NOT EXISTS (SELECT 1 FROM breaks k WHERE k.session_id = s.session_id AND k.break_start <= v.created_at AND v.created_at < k.break_end)),
    rates AS (SELECT employee_id, session_id, sum(ok) / count(*) AS rate FROM hits GROUP BY ALL),
    met AS (SELECT employee_id, CAST(count(*) FILTER (rate >= 0.6) AS INTEGER) AS shifts_hit_target, CAST(count(*) AS INTEGER) AS shifts_total FROM rates GROUP BY employee_id)"""
_RATED = f"""{_HITS},
    sums AS (SELECT employee_id, count(*) AS n, avg(ok) AS actual, avg(baseline) AS expected FROM hits GROUP BY employee_id),
    held AS (SELECT employee_id, arg_max(level_id, effective_from) AS level_id FROM employee_levels WHERE effective_from <= DATE '{END}' GROUP BY employee_id),
    rated AS (SELECT employee_id, coalesce(level_name, '') AS level_name, n AS tickets, round(actual, 4) AS on_floor_adherence, round(expected, 4) AS expected_adherence,
              round((actual - expected) * 100, 2) + 0.0 AS raw_plus_minus, round((actual - expected) * 100 * n / (n + 300), 2) + 0.0 AS plus_minus, shifts_hit_target, shifts_total
              FROM sums JOIN met USING (employee_id) LEFT JOIN held USING (employee_id) LEFT JOIN levels USING (level_id))"""


def as_text(array: str, fields: list[str], by: str = "-") -> Column:
    """An array of structs as text, so that whole arrays are compared, in their order."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(by, *[x[f].cast("string") for f in fields])), ";")


def _ratings(v: Views) -> DataFrame:
    return ratings.ratings(v.tickets, v.sessions, v.breaks, v.levels, v.employee_levels, v.sla, START, END)


@query(f"{_RATED} SELECT *, CAST(row_number() OVER (ORDER BY plus_minus DESC, employee_id) AS INTEGER) AS place FROM rated")
def rating_plus_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.ranked(_ratings(Views(spark, sf_dir)))


@query(f"{_JUDGED} SELECT ticket_id, target AS target_seconds, ok AS on_time FROM verdict")
def on_time_as_of_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return ratings.judged(v.tickets, v.sla, START, END).select("ticket_id", "target_seconds", "on_time")


@query(f"{_JUDGED} SELECT CAST(h AS INTEGER) AS hour, round(avg(ok), 6) AS baseline FROM verdict GROUP BY h")
def hour_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return ratings.hour_baseline(ratings.judged(v.tickets, v.sla, START, END)).select("hour", F.round("baseline", 6).alias("baseline"))


@query(f"{_HITS} SELECT employee_id, session_id, ticket_id, ok AS on_time FROM hits")
def on_floor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return ratings.on_floor(ratings.judged(v.tickets, v.sla, START, END), v.sessions, v.breaks, v.levels, START, END).select("employee_id", "session_id", "ticket_id", "on_time")


@query(f"{_HITS} SELECT * FROM met")
def session_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return ratings.session_hits(ratings.on_floor(ratings.judged(v.tickets, v.sla, START, END), v.sessions, v.breaks, v.levels, START, END), ratings.latest_goal(v.sla))


@query(f"{_JUDGED} SELECT count(*) AS tickets, coalesce(round(avg(CASE WHEN completion_seconds <= 180 THEN 1 ELSE 0 END), 4), 0.0) AS adherence FROM verdict")
def what_if_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.what_if(Views(spark, sf_dir).tickets, 180, START, END)


# reports from cells: windows that cut months, hold whole ones, and lie past the tickets
_WINDOWS = [(START, END), ("2024-01-10", "2024-02-09"), ("2023-12-25", "2024-01-31"), ("2024-01-17", "2024-01-17"), ("2024-01-20", "2030-06-15"), ("2031-01-01", "2031-01-31")]
_TARGETS = [60, 180, 300, 431]


def _for_windows(sql: str, select: str) -> str:
    """``sql``, a list of common tables for the window of most queries, with ``select`` for each of the windows."""
    of = lambda s, e: f"WITH {sql.strip().lstrip(',')} {select}".replace(f"'{START}'", f"'{s}'").replace(f"'{END}'", f"'{e}'")
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS window_no, * FROM ({of(s, e)})" for i, (s, e) in enumerate(_WINDOWS))


def _cells(v: Views) -> cells.Cells:
    """The cells of two halves of the tickets, added up and written."""
    halves = [cells.report_cells(v.tickets.where(f"ticket_id % 2 = {k}"), v.sessions, v.breaks, v.levels, v.sla) for k in (0, 1)]
    both = cells.merged(*halves)
    return cells.Cells(kept(both.tickets, "ticket-cells"), kept(both.floor, "floor-cells"))


@query(" " + _for_windows(_RATED, "SELECT * FROM rated"))
def window_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir, kept)
    return cells.window_ratings(cells.rating_tables(_cells(v), v.sla), v.levels, v.employee_levels, v.sla, _WINDOWS)


@query(" " + _for_windows(_JUDGED, f"SELECT CAST(t AS INTEGER) AS target_seconds, count(completion_seconds) AS tickets, coalesce(round(count(*) FILTER (completion_seconds <= t) / nullif(count(completion_seconds), 0), 4), 0.0) AS adherence FROM (VALUES {', '.join(f'({t})' for t in _TARGETS)}) AS a(t) LEFT JOIN verdict ON true GROUP BY t"))
def what_if_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kept(cells.ticket_cells(Views(spark, sf_dir).tickets), "ticket-cells")
    return cells.what_if_targets(t, cells.marks(t, ["completion_seconds"], ["n"]), _TARGETS, _WINDOWS)


_HOURLY = """,
    hourly AS (SELECT hour(created_at) AS hour, count(*) / (SELECT count(DISTINCT CAST(created_at AS DATE)) FROM tickets WHERE NOT recalled) AS average FROM tickets WHERE NOT recalled GROUP BY 1),
    weights AS (SELECT shift_id, greatest(1, CAST(round_even(sum(coalesce(average, 0) * greatest(0, least(end_min, (k + 1) * 60) - greatest(start_min, k * 60)) / 60), 0) AS INTEGER)) AS weight
                FROM shifts CROSS JOIN range(24) AS x(k) LEFT JOIN hourly ON hour = k GROUP BY shift_id)"""


@query(f"{_HOURLY} SELECT CAST(hour AS INTEGER) AS hour, round(average, 6) AS average FROM hourly")
def hourly_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.hourly_averages(Views(spark, sf_dir).tickets).select("hour", F.round("average", 6).alias("average"))


@query(f"{_HOURLY} SELECT shift_id, CAST(weight AS INTEGER) AS weight FROM weights")
def shift_demand_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return demand.shift_weights(v.shifts, demand.hourly_averages(v.tickets))


@query(f"{_HOURLY} SELECT CAST(k AS INTEGER) AS slot, CAST(round_even(coalesce(average, 0) * 10, 0) AS INTEGER) AS cost FROM range(288) AS x(k) LEFT JOIN hourly ON hour = k * 5 // 60")
def slot_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.slot_costs(demand.hourly_averages(Views(spark, sf_dir).tickets))


_ENTITLED = """,
    due AS (SELECT r.*, coalesce((SELECT x.rest_breaks FROM rules x WHERE x.min_shift_minutes <= r.end_min - r.start_min ORDER BY 1 * x.min_shift_minutes DESC LIMIT 1), 0) AS rest_breaks,
            coalesce((SELECT x.meal_breaks FROM rules x WHERE x.min_shift_minutes <= r.end_min - r.start_min ORDER BY 1 * x.min_shift_minutes DESC LIMIT 1), 0) AS meal_breaks FROM roster r)"""


# the breaks of an entitlement that can keep the edges of their shift
_DUE_BREAKS = """,
    dealt AS (SELECT *, 10 AS n, false AS meal FROM due, range(2) AS x(i) WHERE i < rest_breaks AND meal_breaks = 0 UNION ALL SELECT *, 10, false FROM due, range(2) AS x(i) WHERE i < least(rest_breaks, 2) AND meal_breaks > 0
              UNION ALL SELECT *, 0, 30, true FROM due WHERE meal_breaks > 0),
    fits AS (SELECT * FROM dealt WHERE ceil((start_min + 45) / 5.0) <= floor(CASE WHEN meal THEN least(end_min - 45 - n, start_min + 300) ELSE end_min - 45 - n END / 5.0))"""


@query(f"{_ENTITLED} SELECT entry_id, end_min - start_min AS minutes, rest_breaks, meal_breaks FROM due")
def break_entitlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return rules.entitled(v.roster, v.rules).select("entry_id", (F.col("end_min") - F.col("start_min")).alias("minutes"), "rest_breaks", "meal_breaks")


@query(" SELECT employee_id, arg_max(level_id, effective_from) AS level_id FROM employee_levels WHERE effective_from <= DATE '2024-01-16' GROUP BY employee_id")
def level_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.level_as_of(Views(spark, sf_dir).employee_levels, F.lit("2024-01-16").cast("date"))


_MERGED = """,
    minutes AS (SELECT employee_id, weekday, unnest(range(start_min, end_min)) AS m FROM availability),
    spans AS (SELECT employee_id, weekday, m, m - row_number() OVER (PARTITION BY employee_id, weekday ORDER BY m) AS run FROM (SELECT DISTINCT * FROM minutes)),
    merged AS (SELECT employee_id, weekday, CAST(min(m) AS INTEGER) AS start_min, CAST(max(m) + 1 AS INTEGER) AS end_min FROM spans GROUP BY employee_id, weekday, run)"""


@query(f"{_MERGED} SELECT * FROM merged")
def availability_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.merged_windows(Views(spark, sf_dir).availability, ["employee_id", "weekday"], "start_min", "end_min")


_CAN = f"""{_MERGED},
    can AS (SELECT e.employee_id, s.shift_id FROM employees e, shifts s WHERE NOT EXISTS (SELECT 1 FROM time_off o WHERE o.employee_id = e.employee_id AND s.date BETWEEN o.start_date AND o.end_date)
            AND (NOT EXISTS (SELECT 1 FROM availability a WHERE a.employee_id = e.employee_id)
                 OR EXISTS (SELECT 1 FROM merged m WHERE m.employee_id = e.employee_id AND m.weekday = isodow(s.date) - 1 AND m.start_min <= s.start_min AND s.end_min <= m.end_min)))"""


def _all_pairs(v: Views) -> DataFrame:
    """Everyone with every shift of the four weeks: the product is what ``available_pairs`` is asked about."""
    return v.employees.select("employee_id").crossJoin(v.shifts)


@query(f"{_CAN} SELECT * FROM can")
def available_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return rules.available_pairs(_all_pairs(v), v.availability, v.time_off).select("employee_id", "shift_id")


_EDGES = """,
    abs AS (SELECT *, CAST(date - week AS BIGINT) * 1440 + start_min AS s, CAST(date - week AS BIGINT) * 1440 + end_min AS e FROM shifts),
    edges AS (SELECT x.shift_id AS a, y.shift_id AS b FROM abs x JOIN abs y ON x.week = y.week AND x.shift_id < y.shift_id
              AND y.s < x.e + CASE WHEN x.date = y.date THEN 0 ELSE 480 END AND x.s < y.e + CASE WHEN x.date = y.date THEN 0 ELSE 480 END)"""


#: Orders as shifts: a store by customer, a start by order number.  They grow with the tables.
_ORDER_SHIFTS = """,
    oshifts AS (SELECT o_orderkey AS shift_id, o_custkey % 40 AS store, date_trunc('week', o_orderdate)::DATE AS week, CAST(o_orderdate AS DATE) AS date, CAST(300 + o_orderkey * 37 % 900 AS INTEGER) AS start_min,
                CAST(300 + o_orderkey * 37 % 900 + 120 + o_orderkey % 5 * 60 AS INTEGER) AS end_min, o_orderstatus AS status FROM orders)"""


def order_shifts(v: Views) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    start = 300 + key * 37 % 900
    return v.table("orders").select(
        key.alias("shift_id"), (F.col("o_custkey") % 40).alias("store"), F.date_trunc("week", day).cast("date").alias("week"), day.alias("date"),
        start.cast("int").alias("start_min"), (start + 120 + key % 5 * 60).cast("int").alias("end_min"), F.col("o_orderstatus").alias("status"),
    )


_ORDER_EDGES = _EDGES.replace("FROM shifts", "FROM oshifts").replace("x.week = y.week AND", "x.week = y.week AND x.store = y.store AND")


@query(f"{_ORDER_SHIFTS}{_ORDER_EDGES} SELECT * FROM edges")
def shift_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of shifts of a store and week that nobody can do both."""
    return rules.conflict_edges(order_shifts(Views(spark, sf_dir)))


@query(f"""{_ORDER_SHIFTS}{_ORDER_EDGES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY store, week ORDER BY date, start_min, shift_id) AS place FROM oshifts)
    SELECT n.store, n.week, n.shift_id, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM edges WHERE a = n.shift_id OR b = n.shift_id) AS clashes FROM numbered n""", dates=("week",))
def conflict_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shift with its place and with how many it clashes: those of its own runs, and those in whose runs it stands."""
    spans = rules.conflict_spans(order_shifts(Views(spark, sf_dir)))
    run = lambda low, high: F.greatest(high - low + 1, F.lit(0))
    runs = [(F.col("place") + 1, F.col("same_until")), (F.col("next_from"), F.col("next_until"))]
    mark = lambda at, n, shift, later: F.struct(at.alias("at"), n.alias("n"), shift.cast("long").alias("shift_id"), later.alias("later"))
    edge = lambda at, n, low, high: mark(at, F.when(low <= high, n).otherwise(0), F.lit(None), F.lit(0))
    marks = [m for low, high in runs for m in (edge(low, 1, low, high), edge(high + 1, -1, low, high))]
    itself = mark(F.col("place"), F.lit(0), F.col("shift_id"), reduce(Column.__add__, [run(low, high) for low, high in runs]))
    both = spans.select("store", "week", F.explode(F.filter(F.array(itself, *marks), lambda m: m["shift_id"].isNotNull() | (m["n"] != 0))).alias("x")).select("store", "week", "x.*")
    open_ = F.sum("n").over(Window.partitionBy("store", "week").orderBy("at"))
    return both.select("store", "week", "shift_id", F.col("at").alias("place"), (open_ + F.col("later")).alias("clashes")).where("shift_id IS NOT NULL")


_FEASIBLE = f"""{_CAN}{_EDGES},
    both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges UNION ALL SELECT shift_id, shift_id FROM shifts),
    feasible AS (SELECT c.employee_id, c.shift_id, r.level_id FROM can c JOIN employees e USING (employee_id) JOIN requirements r ON r.shift_id = c.shift_id AND r.level_id = e.level_id AND r.count > 0
                 WHERE e.active AND NOT EXISTS (SELECT 1 FROM assignments m JOIN both_ways x ON x.a = m.shift_id WHERE m.manual AND m.employee_id = c.employee_id AND x.b = c.shift_id))"""


def _feasible(v: Views) -> DataFrame:
    return rules.feasible_pairs(v.employees, v.shifts, v.requirements, v.availability, v.time_off, v.assignments.where("manual").select("employee_id", "shift_id"))


@query(f"{_FEASIBLE} SELECT * FROM feasible")
def feasible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feasible(Views(spark, sf_dir))


_WORKED = """,
    worked AS (SELECT employee_id, CAST(clock_in AS DATE) AS day FROM sessions UNION SELECT a.employee_id, s.date FROM assignments a JOIN shifts s USING (shift_id))"""


def _worked(v: Views) -> DataFrame:
    return rules.worked_dates(v.sessions, v.assignments, v.shifts)


@query(f"{_WORKED} SELECT * FROM worked", dates=("day",))
def worked_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worked(Views(spark, sf_dir))


_RUNS = """,
    marks AS (SELECT employee_id, day, CASE WHEN lag(day) OVER w = day - 1 THEN 0 ELSE 1 END AS fresh FROM worked WINDOW w AS (PARTITION BY employee_id ORDER BY day)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY employee_id ORDER BY day) AS k FROM marks),
    runs AS (SELECT employee_id, min(day) AS run_start, max(day) AS run_end, CAST(count(*) AS INTEGER) AS run_days FROM numbered GROUP BY employee_id, k)"""


@query(f"{_WORKED}{_RUNS} SELECT * FROM runs", dates=("run_start", "run_end"))
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.day_runs(_worked(Views(spark, sf_dir)), ["employee_id"], "day")


@query(f"{_WORKED} SELECT x.employee_id, x.day, CAST(count(*) AS INTEGER) AS worked FROM worked x JOIN worked y ON x.employee_id = y.employee_id AND y.day BETWEEN x.day - 6 AND x.day GROUP BY ALL", dates=("day",))
def rolling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.rolling_days(_worked(Views(spark, sf_dir)), "employee_id", "day", 7)


_SHIFTY = ", logged AS (SELECT employee_id, CAST(clock_in AS DATE) AS day, CASE WHEN dayofyear(clock_in) > 10 + employee_id % 9 THEN 2 ELSE 1 END + (dayofyear(clock_in) // 20) % 2 AS level_id FROM sessions)"


@query(
    f"""{_SHIFTY}, last AS (SELECT employee_id, arg_max(level_id, day) AS level_id FROM logged GROUP BY employee_id)
    SELECT l.employee_id, CAST(l.level_id AS INTEGER) AS level_id, min(d.day) AS since FROM last l JOIN logged d ON d.employee_id = l.employee_id
    WHERE d.day > coalesce((SELECT max(o.day) FROM logged o WHERE o.employee_id = l.employee_id AND o.level_id <> l.level_id), DATE '1900-01-01') GROUP BY ALL""", dates=("since",))
def last_level_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.dayofyear("clock_in")
    level = F.when(n > 10 + F.col("employee_id") % 9, 2).otherwise(1) + F.floor(n / 20).cast("int") % 2
    logged = Views(spark, sf_dir).sessions.select("employee_id", F.to_date("clock_in").alias("day"), level.cast("int").alias("level_id"))
    return temporal.last_level_run(logged, "employee_id", "day", "level_id")


@query(" SELECT ticket_id, last_value(CASE WHEN items % 5 = 0 THEN ticket_id END IGNORE NULLS) OVER (PARTITION BY station ORDER BY ticket_id) AS owner FROM tickets")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a station that opens a block owns the rows after it."""
    t = Views(spark, sf_dir).tickets
    return temporal.carried_by_range(t, F.when(F.col("items") % 5 == 0, F.col("ticket_id")), "ticket_id", "station", "owner").select("ticket_id", "owner")


_OPEN = """,
    have AS (SELECT shift_id, fills_level_id AS level_id, count(*) AS n FROM assignments GROUP BY ALL),
    open AS (SELECT r.shift_id, r.level_id, CAST(r.count - coalesce(h.n, 0) AS INTEGER) AS missing FROM requirements r LEFT JOIN have h USING (shift_id, level_id) WHERE r.count > coalesce(h.n, 0))"""


@query(f"{_OPEN} SELECT * FROM open")
def unfilled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return rules.unfilled(v.requirements, v.assignments)


_OWN = """,
    own AS (SELECT a.employee_id, s.shift_id, s.week, s.date, s.start_min, s.end_min, s.end_min - s.start_min AS minutes FROM assignments a JOIN shifts s USING (shift_id))"""


_WARNED = """,
    daily AS (SELECT employee_id, week, date, sum(minutes) AS v FROM own GROUP BY ALL),
    seen AS (SELECT d.employee_id, d.week, d.date AS day FROM daily d UNION SELECT d.employee_id, d.week, x.day FROM daily d JOIN worked x ON x.employee_id = d.employee_id AND x.day < d.week AND x.day >= d.week - 6),
    marked AS (SELECT *, CASE WHEN lag(day) OVER w = day - 1 THEN 0 ELSE 1 END AS fresh FROM seen WINDOW w AS (PARTITION BY employee_id, week ORDER BY day)),
    stretch AS (SELECT employee_id, week, day, sum(fresh) OVER (PARTITION BY employee_id, week ORDER BY day) AS k FROM marked)"""
_WARNINGS = """ SELECT employee_id, week, 'overtime_day' AS kind, CAST(v AS BIGINT) AS value, date AS day FROM daily WHERE v > 480
    UNION ALL SELECT employee_id, week, 'overtime_week', CAST(sum(v) AS BIGINT), week FROM daily JOIN employees USING (employee_id) GROUP BY employee_id, week, max_week_minutes HAVING sum(v) > max_week_minutes
    UNION ALL SELECT employee_id, week, 'consecutive_days', count(*), min(day) FROM stretch GROUP BY employee_id, week, k HAVING count(*) > 6 AND max(day) >= week"""


@query(f"{_WORKED}{_OWN}{_WARNED}{_WARNINGS}", dates=("week", "day"))
def schedule_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return rules.warnings(v.assignments, v.shifts, v.employees, _worked(v))


@query(f"{_WORKED}{_OWN}{_WARNED}, said AS ({_WARNINGS}" + """)
    SELECT s.employee_id, s.week, s.kind, s.value, s.day, e.name AS employee_name, e.name || ': ' || CASE kind WHEN 'overtime_day' THEN printf('%.1f', round_even(value / 60.0, 1)) || 'h on ' || CAST(day AS VARCHAR) || ' (over 8h/day)'
           WHEN 'overtime_week' THEN printf('%.1f', round_even(value / 60.0, 1)) || 'h this week (over their ' || printf('%.0f', round_even(max_week_minutes / 60.0, 0)) || 'h cap)'
           ELSE value || ' consecutive days (run starting ' || CAST(day AS VARCHAR) || ')' END AS message
    FROM said s JOIN employees e USING (employee_id)""", dates=("week", "day"))
def warning_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return rules.warning_messages(rules.warnings(v.assignments, v.shifts, v.employees, _worked(v)), v.employees)


@query(
    f"""{_RATED}{_CAN}{_WORKED}{_OWN}{_OPEN},
    slots AS (SELECT o.shift_id, o.level_id, s.week, s.date, s.start_min, s.end_min, l.rank FROM open o JOIN shifts s USING (shift_id) JOIN levels l USING (level_id)),
    cand AS (SELECT s.*, e.employee_id, e.level_id AS own_level, e.max_week_minutes FROM slots s, employees e JOIN levels x ON x.level_id = e.level_id
             WHERE e.active AND x.counts_for_rating AND (e.level_id = s.level_id OR x.rank > s.rank)
             AND NOT EXISTS (SELECT 1 FROM time_off o WHERE o.employee_id = e.employee_id AND s.date BETWEEN o.start_date AND o.end_date)
             AND NOT EXISTS (SELECT 1 FROM own m WHERE m.employee_id = e.employee_id AND m.week = s.week AND (m.shift_id = s.shift_id
                 OR (CAST(s.date - s.week AS BIGINT) * 1440 + s.start_min < CAST(m.date - m.week AS BIGINT) * 1440 + m.end_min + CASE WHEN m.date = s.date THEN 0 ELSE 480 END
                     AND CAST(m.date - m.week AS BIGINT) * 1440 + m.start_min < CAST(s.date - s.week AS BIGINT) * 1440 + s.end_min + CASE WHEN m.date = s.date THEN 0 ELSE 480 END)))),
    near AS (SELECT DISTINCT c.employee_id, c.week, c.date, c.date + CAST(k AS INTEGER) AS day, k FROM cand c, range(-14, 15) AS x(k)
             WHERE k = 0 OR EXISTS (SELECT 1 FROM own m WHERE m.employee_id = c.employee_id AND m.week = c.week AND m.date = c.date + CAST(k AS INTEGER))
             OR EXISTS (SELECT 1 FROM worked p WHERE p.employee_id = c.employee_id AND p.day = c.date + CAST(k AS INTEGER) AND p.day < c.week AND p.day >= c.week - 6)),
    steps AS (SELECT *, k - row_number() OVER (PARTITION BY employee_id, week, date ORDER BY k) AS g FROM near),
    streak AS (SELECT s.employee_id, s.week, s.date, CAST(count(*) AS INTEGER) AS run_days FROM steps s JOIN (SELECT employee_id, week, date, g FROM steps WHERE k = 0) z USING (employee_id, week, date, g) GROUP BY ALL),
    flags AS (SELECT c.shift_id, c.level_id, c.employee_id, c.own_level, run_days, c.own_level <> c.level_id AS down,
             coalesce((SELECT sum(minutes) FROM own m WHERE m.employee_id = c.employee_id AND m.week = c.week), 0) + c.end_min - c.start_min > c.max_week_minutes AS per_week,
             coalesce((SELECT sum(minutes) FROM own m WHERE m.employee_id = c.employee_id AND m.date = c.date), 0) + c.end_min - c.start_min > 480 AS per_day,
             NOT EXISTS (SELECT 1 FROM can x WHERE x.employee_id = c.employee_id AND x.shift_id = c.shift_id) AS away FROM cand c JOIN streak USING (employee_id, week, date))
    SELECT f.shift_id, f.level_id, f.employee_id, 'Person ' || f.employee_id AS employee_name, l.level_name,
           CAST(CASE WHEN away THEN 3 WHEN run_days > 6 THEN 2 WHEN per_week OR per_day THEN 1 WHEN down THEN 0 ELSE -1 END AS INTEGER) AS softness,
           coalesce(nullif(concat_ws('; ', CASE WHEN down THEN 'Higher level covering down' END, CASE WHEN per_week THEN 'Would exceed their weekly hours cap (overtime)' END, CASE WHEN per_day THEN 'Would exceed 8h that day (overtime)' END,
             CASE WHEN run_days > 6 THEN 'Would be consecutive day #' || run_days || ' (limit 6)' END, CASE WHEN away THEN 'Outside their submitted availability' END), ''), 'Eligible now (schedule changed since last solve)') AS reason,
           run_days, r.plus_minus AS rating, coalesce(r.tickets, 0) AS tickets, CAST(row_number() OVER (PARTITION BY f.shift_id, f.level_id
             ORDER BY CASE WHEN away THEN 3 WHEN run_days > 6 THEN 2 WHEN per_week OR per_day THEN 1 WHEN down THEN 0 ELSE -1 END, coalesce(r.plus_minus, 0) DESC, f.employee_id) AS INTEGER) AS place
    FROM flags f JOIN levels l ON l.level_id = f.own_level LEFT JOIN rated r USING (employee_id)"""
)
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir, kept)
    slots = rules.unfilled(v.requirements, v.assignments).select("shift_id", "level_id")
    return rules.suggestions(slots, v.shifts, v.employees, v.levels, v.assignments, v.availability, v.time_off, kept(_worked(v), "worked"), kept(_ratings(v), "ratings"))


@query(f"{_ENTITLED}, grid2 AS (SELECT due.*, i FROM due, range(4) AS x(i)), " + """
    picked AS (SELECT entry_id, i, start_min, end_min, CASE WHEN i IN (0, 2) THEN 'rest' ELSE 'meal' END AS kind, CASE i WHEN 0 THEN 0.25 WHEN 2 THEN 0.75 ELSE 0.5 END AS share,
               CASE WHEN i IN (0, 2) THEN 10 ELSE 30 END AS n FROM grid2 WHERE (i = 0 AND rest_breaks >= 1) OR (i = 2 AND rest_breaks >= 2) OR (i = 1 AND meal_breaks >= 1)),
    placed AS (SELECT *, least(greatest(CAST(floor(start_min + (end_min - start_min) * share) AS INTEGER), start_min + 45), end_min - 45 - n) AS p FROM picked),
    final AS (SELECT *, CASE WHEN kind = 'meal' THEN least(p, start_min + 300) ELSE p END AS q FROM placed)
    SELECT entry_id, kind, CAST(q AS INTEGER) AS start_min, CAST(q + n AS INTEGER) AS end_min FROM final WHERE q >= start_min AND q + n <= end_min""")
def break_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return scheduling.anchored_breaks(v.roster, v.rules).drop("k")


@query(f"{_ORDER_SHIFTS} SELECT s.date + 364 AS date, s.start_min, s.end_min FROM oshifts s WHERE year(s.week) = 1997 AND s.store < 20 AND NOT EXISTS (SELECT 1 FROM oshifts t WHERE t.store = 21 AND t.date = s.date + 364)", dates=("date",))
def copy_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shifts of a year's weeks 52 weeks on, except on days that have shifts (of another store) already."""
    s = order_shifts(Views(spark, sf_dir))
    return sinks.copied_week(s.where("year(week) = 1997 AND store < 20").select("date", "start_min", "end_min"), s.where("store = 21"), 364)


@query(
    f"""{_ORDER_SHIFTS}, templates AS (SELECT DISTINCT CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(store % 5 AS INTEGER) AS block FROM oshifts WHERE status = 'P'),
    blocks AS (SELECT r_regionkey AS block, CAST(360 + 90 * r_regionkey AS INTEGER) AS start_min, CAST(660 + 90 * r_regionkey AS INTEGER) AS end_min FROM region)
    SELECT w.week + weekday AS date, start_min, end_min FROM (SELECT DISTINCT week FROM oshifts) w, templates JOIN blocks USING (block) WHERE NOT EXISTS (SELECT 1 FROM oshifts s WHERE s.store < 3 AND s.week = w.week)""", dates=("date",))
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates seen in some orders, in all weeks in which three stores have no shift."""
    v = Views(spark, sf_dir)
    s, r = order_shifts(v), F.col("r_regionkey")
    templates = s.where("status = 'P'").select(F.weekday("date").alias("weekday"), (F.col("store") % 5).cast("int").alias("block")).distinct()
    blocks = v.table("region").select(r.alias("block"), (360 + 90 * r).cast("int").alias("start_min"), (660 + 90 * r).cast("int").alias("end_min"))
    return sinks.expanded_templates(templates, blocks, s.select("week").distinct(), s.where("store < 3")).select("date", "start_min", "end_min")


@query(" SELECT station, CAST(created_at AS DATE) AS day, max(items) AS items FROM tickets WHERE (station, CAST(created_at AS DATE), created_at) IN (SELECT station, CAST(created_at AS DATE), max(created_at) FROM tickets GROUP BY ALL) GROUP BY ALL", dates=("day",))
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot per station and day, refreshed twice: the later row wins."""
    t = Views(spark, sf_dir).tickets.select("station", F.to_date("created_at").alias("day"), "created_at", "items")
    return sinks.upserted(t.where("hour(created_at) < 12"), t.where("hour(created_at) >= 12"), ["station", "day"], [F.desc("created_at"), F.desc("items")]).select("station", "day", "items")


@query(" SELECT DISTINCT sha256(concat_ws('|', station, CAST(items AS VARCHAR), CAST(completion_seconds AS VARCHAR))) AS row_hash FROM tickets")
def insert_if_absent_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Views(spark, sf_dir).tickets
    h = t.select(text.row_hash(["station", "items", "completion_seconds"]).alias("row_hash"), "ticket_id")
    base = sinks.first_by(h.where("ticket_id % 2 = 0"), ["row_hash"], [F.col("ticket_id")])
    return base.union(sinks.absent(h.where("ticket_id % 3 > 0 OR ticket_id % 2 = 1"), base, ["row_hash"], [F.col("ticket_id")])).select("row_hash")


@query(
    """, spans AS (SELECT employee_id, date_trunc('week', clock_in)::DATE AS period_start, count(*) * 6.0 AS hours FROM sessions GROUP BY ALL)
    SELECT CASE WHEN week(max(period_start)) % 2 = 0 THEN 'PERSON ' ELSE 'Person ' END || employee_id AS employee_name, max(period_start) AS period_start, arg_max(hours, period_start)::DOUBLE AS hours FROM spans GROUP BY employee_id""", dates=("period_start",))
def latest_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly hours under names that change their case from week to week."""
    week = F.date_trunc("week", "clock_in").cast("date")
    hours = Views(spark, sf_dir).sessions.groupBy("employee_id", week.alias("period_start")).agg((F.count(F.lit(1)) * 6.0).alias("hours"))
    said = F.concat(F.when(F.weekofyear("period_start") % 2 == 0, "PERSON ").otherwise("Person "), F.col("employee_id").cast("string"))
    rows = hours.select(said.alias("employee_name"), "period_start", F.date_add("period_start", 6).alias("period_end"), "hours")
    return views.latest_hours(rows).select("employee_name", "period_start", "hours")


@query(" SELECT p.name AS reported, e.employee_id FROM (SELECT DISTINCT CASE WHEN items % 2 = 0 THEN 'PERSON ' ELSE ' person ' END || (items % 30) AS name FROM tickets) p LEFT JOIN employees e ON lower(trim(p.name)) = lower(e.name)")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    said = v.tickets.select(F.concat(F.when(F.col("items") % 2 == 0, "PERSON ").otherwise(" person "), (F.col("items") % 30).cast("string")).alias("reported")).distinct()
    return sinks.matched_by_name(said, v.employees, "reported", "name").select("reported", "employee_id")


@query(
    """, incoming AS (SELECT DISTINCT 'Person ' || (items % 28) AS name, CASE WHEN items % 3 = 0 THEN 'pay-' || (items % 7) END AS payroll_id FROM tickets),
    known AS (SELECT employee_id, name, 'pay-' || employee_id AS payroll_id FROM employees)
    SELECT i.name, i.payroll_id, coalesce(a.employee_id, b.employee_id) AS employee_id, CASE WHEN a.employee_id IS NOT NULL THEN 'name' WHEN b.employee_id IS NOT NULL THEN 'payroll' ELSE 'new' END AS found_by
    FROM incoming i LEFT JOIN known a ON a.name = i.name LEFT JOIN known b ON b.payroll_id = i.payroll_id"""
)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    inc = v.tickets.select(F.concat(F.lit("Person "), (F.col("items") % 28).cast("string")).alias("name"), F.when(F.col("items") % 3 == 0, F.concat(F.lit("pay-"), (F.col("items") % 7).cast("string"))).alias("payroll_id")).distinct()
    known = v.employees.select("employee_id", "name", F.concat(F.lit("pay-"), F.col("employee_id").cast("string")).alias("payroll_id"))
    return sinks.resolved(inc, known)


@query(
    """, heads AS (SELECT e AS ord, CAST(e * 13 % 101 AS DOUBLE) AS x FROM people), marks AS (SELECT ticket_id, CAST(items % 103 AS DOUBLE) + 0.25 AS mx FROM tickets)
    SELECT ticket_id, (SELECT ord FROM heads WHERE ord % 3 = ticket_id % 3 ORDER BY abs(x - mx), ord LIMIT 1) AS ord FROM marks"""
)
def nearest_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    heads = v.people.select(F.col("e").alias("ord"), (F.col("e") * 13 % 101).cast("double").alias("x"), (F.col("e") % 3).alias("page"))
    marks = v.tickets.select("ticket_id", ((F.col("items") % 103).cast("double") + 0.25).alias("mx"), (F.col("ticket_id") % 3).alias("page"))
    return html_tables.nearest(marks, heads, "ticket_id", "mx", "x", "ord", "page")


@query(
    """, cells AS (SELECT ticket_id, '7:10 am - 3:35 pm' || chr(10) || CASE WHEN items % 5 = 0 THEN 'no show' WHEN items % 5 = 1 THEN 'TOTAL:  ' || items || ' hr' ELSE 'Total: ' || (items % 12) || ' hrs ' || (items % 60) || ' min' END AS cell, items FROM tickets)
    SELECT ticket_id, CASE WHEN items % 5 = 0 THEN NULL WHEN items % 5 = 1 THEN CAST(items AS DOUBLE) ELSE round(items % 12 + (items % 60) / 60.0, 2) END AS hours FROM cells"""
)
def hours_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("items")
    tail = F.when(i % 5 == 0, F.lit("no show")).when(i % 5 == 1, F.concat(F.lit("TOTAL:  "), i.cast("string"), F.lit(" hr"))).otherwise(F.concat(F.lit("Total: "), (i % 12).cast("string"), F.lit(" hrs "), (i % 60).cast("string"), F.lit(" min")))
    return Views(spark, sf_dir).tickets.select("ticket_id", text.hours_total(F.concat(F.lit("7:10 am - 3:35 pm\n"), tail)).alias("hours"))


@query(f"{_WORKED} SELECT CAST(max(n) AS BIGINT) AS most FROM (SELECT day, count(*) AS n FROM worked GROUP BY day)")
def crew_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worked(Views(spark, sf_dir)).groupBy("day").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))


@query()
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page the table that fits the wanted columns best."""
    return html_tables.best_tables(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", {"name": ["team member", "name"], "worked": ["worked", "hours"]})


def _assigned(v: Views) -> DataFrame:
    manual = v.assignments.where("manual")
    weights = demand.shift_weights(v.shifts, demand.hourly_averages(v.tickets))
    return scheduling.assign_weeks(_feasible(v), v.shifts, v.requirements, v.employees, rules.conflict_spans(v.shifts), _worked_before(v), _ratings(v), weights, manual)


def _worked_before(v: Views) -> DataFrame:
    return v.sessions.select("employee_id", F.to_date("clock_in").alias("day")).distinct()


@query()
def assign_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(Views(spark, sf_dir, kept))


@query(" SELECT 'violations' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'could be added', 0 UNION ALL SELECT 'not proved best', 0 UNION ALL SELECT 'wanted', CAST((SELECT sum(count) FROM requirements) AS BIGINT)")
def assign_week_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of any limit by the assigned weeks (level, availability, overlap and rest, minutes of day and week, days in a
    row, requirement), candidates that could still be added (an empty plan has many), plans not proved best, and the slots
    that picks, manual picks and open slots add up to."""
    v = Views(spark, sf_dir, kept)
    got = kept(_assigned(v), "assigned")  # one search; the checks below read its rows
    manual = v.assignments.where("manual")
    edges = kept(rules.conflict_edges(v.shifts), "edges")
    either = edges.union(edges.select("b", "a"))
    feasible = kept(_feasible(v), "feasible")
    every = got.select("employee_id", "shift_id", "level_id").union(manual.select("employee_id", "shift_id", "fills_level_id"))
    timed = every.join(v.shifts, "shift_id").withColumn("m", F.col("end_min") - F.col("start_min"))
    fixed = manual.join(v.shifts, "shift_id").withColumn("m", F.col("end_min") - F.col("start_min"))
    per = lambda df, c, name: df.groupBy("employee_id", c).agg(F.sum("m").alias(name))
    caps = v.employees.select("employee_id", "max_week_minutes")
    past = rules.by_week(_worked_before(v), 6).select("employee_id", "week", "day")

    a, b = got.select("employee_id", F.col("shift_id").alias("a")), got.select("employee_id", F.col("shift_id").alias("b"))
    bad = [
        a.join(edges, "a").join(b, ["employee_id", "b"]),
        got.join(feasible, ["employee_id", "shift_id", "level_id"], "left_anti"),
        per(timed, "week", "m").join(caps, "employee_id").join(per(fixed, "week", "f"), ["employee_id", "week"], "left").where("m > greatest(max_week_minutes, coalesce(f, 0))"),
        per(timed, "date", "m").join(per(fixed, "date", "f"), ["employee_id", "date"], "left").where("m > greatest(480, coalesce(f, 0))"),
        got.groupBy("shift_id", "level_id").agg(F.count(F.lit(1)).alias("employee_id")).join(v.requirements, ["shift_id", "level_id"]).where("employee_id > count"),
    ]
    # runs with a picked day, not one that history and manual picks make alone
    days = timed.select("employee_id", "week", F.col("date").alias("day")).union(past)
    runs = temporal.day_runs(days, ["employee_id", "week"], "day").where("run_days > 6")
    picked = got.join(v.shifts.select("shift_id", "date"), "shift_id").join(fixed.select("employee_id", "date").distinct(), ["employee_id", "date"], "left_anti").select("employee_id", "week", "date")
    bad.append(runs.join(picked, ["employee_id", "week"]).where("date BETWEEN run_start AND run_end"))
    broken = reduce(DataFrame.union, [x.select(F.lit("violations").alias("what")) for x in bad])

    # what could be added: a candidate for an open slot that clashes with nothing and stays within all limits
    open_ = rules.unfilled(v.requirements, every.withColumnRenamed("level_id", "fills_level_id"))
    more = feasible.join(open_.select("shift_id", "level_id"), ["shift_id", "level_id"]).join(every, ["employee_id", "shift_id"], "left_anti").join(v.shifts, "shift_id").withColumn("m", F.col("end_min") - F.col("start_min"))
    busy = every.join(either, every["shift_id"] == either["a"]).select("employee_id", F.col("b").alias("shift_id"))
    more = more.join(busy, ["employee_id", "shift_id"], "left_anti").join(caps, "employee_id")
    more = more.join(per(timed, "week", "w"), ["employee_id", "week"], "left").join(per(timed, "date", "d"), ["employee_id", "date"], "left").where("m + coalesce(w, 0) <= max_week_minutes AND m + coalesce(d, 0) <= 480")
    then = more.select("employee_id", "week", F.col("date").alias("asked"), F.col("date").alias("day")).union(days.join(more.select("employee_id", "week", F.col("date").alias("asked")), ["employee_id", "week"]).select("employee_id", "week", "asked", "day"))
    long = temporal.day_runs(then, ["employee_id", "week", "asked"], "day").where("run_days > 6 AND asked BETWEEN run_start AND run_end").select("employee_id", "week", F.col("asked").alias("date"))
    more = more.join(long, ["employee_id", "week", "date"], "left_anti").select(F.lit("could be added").alias("what"))

    unsure = got.where("NOT is_optimal").select(F.lit("not proved best").alias("what"))
    slots = every.select(F.lit("wanted").alias("what")).union(open_.select(F.explode(F.sequence(F.lit(1), "missing"))).select(F.lit("wanted")))
    every_kind = spark.createDataFrame([(x,) for x in ("violations", "could be added", "not proved best", "wanted")], "what string")
    counted = broken.union(more).union(unsure).union(slots).groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    return every_kind.join(counted, "what", "left").select("what", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _planned(v: Views) -> DataFrame:
    return scheduling.plan_breaks(v.roster, v.rules, demand.slot_costs(demand.hourly_averages(v.tickets)))


@query()
def plan_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(Views(spark, sf_dir))


_ALONE = f"""{_ENTITLED}{_HOURLY},
    costs AS (SELECT k AS slot, CAST(round_even(coalesce(average, 0) * 10, 0) AS BIGINT) AS cost FROM range(288) AS x(k) LEFT JOIN hourly ON hour = k * 5 // 60),
    kinds(rests, meals, k, n, share) AS (VALUES (1, 0, 0, 10, 0.5), (2, 1, 0, 10, 0.25), (2, 1, 1, 30, 0.5), (2, 1, 2, 10, 0.75)),
    planned AS (SELECT d.entry_id, d.date, k.k, k.n, CAST(ceil((d.start_min + 45) / 5.0) AS BIGINT) AS low, CAST(floor(CASE WHEN k.n = 30 THEN least(d.end_min - 45 - k.n, d.start_min + 300) ELSE d.end_min - 45 - k.n END / 5.0) AS BIGINT) AS high,
                CAST(round_even((d.start_min + (d.end_min - d.start_min) * k.share) / 5, 0) AS BIGINT) AS anchor FROM due d JOIN kinds k ON k.rests = d.rest_breaks AND k.meals = d.meal_breaks),
    open_ AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY k) AS r FROM planned WHERE low <= high),
    starts AS (SELECT entry_id, date, r, n // 5 AS w, s, abs(s - anchor) + 10 * (SELECT sum(cost) FROM costs WHERE slot >= s AND slot < s + n // 5) AS price FROM (SELECT *, unnest(range(low, high + 1)) AS s FROM open_)),
    one AS (SELECT entry_id, date, s, w, price FROM starts WHERE r = 1),
    two AS (SELECT b.entry_id, b.date, b.s, b.w, b.price + min(a.price) AS price FROM starts b JOIN one a ON a.entry_id = b.entry_id AND a.s + a.w + 18 <= b.s WHERE b.r = 2 GROUP BY b.entry_id, b.date, b.s, b.w, b.price),
    three AS (SELECT b.entry_id, b.date, b.s, b.w, b.price + min(a.price) AS price FROM starts b JOIN two a ON a.entry_id = b.entry_id AND a.s + a.w + 18 <= b.s WHERE b.r = 3 GROUP BY b.entry_id, b.date, b.s, b.w, b.price),
    best AS (SELECT x.entry_id, x.date, min(x.price) AS price FROM (SELECT *, 1 AS r FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three) x
             WHERE x.r = (SELECT max(o.r) FROM open_ o WHERE o.entry_id = x.entry_id) GROUP BY x.entry_id, x.date)"""


@query(f"{_ALONE} SELECT date, CAST(sum(price) AS BIGINT) AS cost, true AS proved FROM best GROUP BY date", dates=("date",))
def break_costs_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of each day if any number may be on break at a time: entries then stand alone, and SQL can find their best."""
    v = Views(spark, sf_dir)
    plan = scheduling.plan_breaks(v.roster, v.rules, demand.slot_costs(demand.hourly_averages(v.tickets)), concurrent=1000)
    return plan.groupBy("date").agg(F.max("cost").alias("cost"), (F.min("status") == "optimal").alias("proved"))


@query(f"{_ALONE} SELECT date, true AS as_priced, true AS bounded, true AS within_a_hundredth FROM best GROUP BY date", dates=("date",))
def break_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day whether its cost is that of its breaks, no less than if entries stood alone, and within 1 % of the bound."""
    v = Views(spark, sf_dir, kept)
    costs = kept(demand.slot_costs(demand.hourly_averages(v.tickets)), "costs")
    plan = kept(scheduling.plan_breaks(v.roster, v.rules, costs), "plan")
    alone = scheduling.plan_breaks(v.roster, v.rules, costs, concurrent=1000).groupBy("date").agg(F.max("cost").alias("alone"))
    share = F.when(F.col("kind") == "meal", 0.5).when(F.col("n") == 1, 0.5).when(F.col("k") == 0, 0.25).otherwise(0.75)
    of = plan.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date", "entry_id"))).join(v.roster.select("entry_id", F.col("start_min").alias("from"), F.col("end_min").alias("until")), "entry_id")
    far = F.abs(F.col("start_min") / 5 - F.bround((F.col("from") + (F.col("until") - F.col("from")) * share) / 5))
    near = of.groupBy("date").agg(F.sum(far).cast("long").alias("far"))
    slots = of.select("date", F.explode(F.sequence((F.col("start_min") / 5).cast("int"), (F.col("end_min") / 5).cast("int") - 1)).alias("slot")).join(costs, "slot").groupBy("date").agg(F.sum("cost").alias("taken"))
    days = plan.groupBy("date").agg(F.max("cost").alias("cost"), F.max("bound").alias("bound")).join(near, "date").join(slots, "date").join(alone, "date")
    return days.select("date", (F.col("cost") == 10 * F.col("taken") + F.col("far")).alias("as_priced"), ((F.col("alone") <= F.col("bound")) & (F.col("bound") <= F.col("cost"))).alias("bounded"), (F.col("cost") * 100 <= F.col("bound") * 101).alias("within_a_hundredth"))


@query(f"{_ENTITLED}{_DUE_BREAKS} SELECT CAST(1 AS BIGINT) AS most, CAST(0 AS BIGINT) AS too_close, (SELECT count(*) FROM fits) AS breaks, CAST(0 AS BIGINT) AS alone, CAST(0 AS BIGINT) AS outside")
def break_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all planned breaks: most people on break in a minute, gaps below 90 minutes, how many there are, how many stand
    alone because their day has no plan, and how many are too near to an edge of their shift or, meals, too late."""
    v = Views(spark, sf_dir)
    plan = _planned(v)
    busy = plan.select("date", F.explode(F.sequence("start_min", F.col("end_min") - 1)).alias("m")).groupBy("date", "m").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    gap = F.col("start_min") - F.lag("end_min").over(Window.partitionBy("date", "entry_id").orderBy("start_min"))
    shift = v.roster.select("entry_id", F.col("start_min").alias("from"), F.col("end_min").alias("until"))
    outside = (F.col("start_min") < F.col("from") + 45) | (F.col("end_min") > F.col("until") - 45) | ((F.col("kind") == "meal") & (F.col("start_min") > F.col("from") + 300))
    rest = plan.join(shift, "entry_id").select("*", gap.alias("gap"), outside.alias("outside")).agg(
        F.count_if(F.col("gap") < 90).alias("too_close"), F.count(F.lit(1)).alias("breaks"), F.count_if(F.col("status").isin("infeasible", "not found")).alias("alone"), F.count_if("outside").alias("outside")
    )
    return busy.crossJoin(rest)  # one row each


@query(
    """, held AS (SELECT employee_id, arg_max(level_id, effective_from) AS level_id FROM employee_levels WHERE effective_from <= DATE '2024-01-20' GROUP BY employee_id),
    a AS (SELECT employee_id, string_agg(concat_ws('-', weekday, start_min, end_min), ';' ORDER BY weekday, start_min, end_min) AS s FROM availability GROUP BY employee_id)
    SELECT e.employee_id, l.level_name AS level, coalesce(a.s, '') AS windows, coalesce((SELECT string_agg(concat_ws('/', start_date, end_date), ';' ORDER BY start_date) FROM time_off o WHERE o.employee_id = e.employee_id), '') AS times_off
    FROM employees e LEFT JOIN held USING (employee_id) LEFT JOIN levels l ON l.level_id = held.level_id LEFT JOIN a ON a.employee_id = e.employee_id"""
)
def employee_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = views.employee_view(v.employees, v.employee_levels, v.levels, v.availability, v.time_off, F.lit("2024-01-20").cast("date"))
    windows, off = as_text("availability", ["weekday", "start_min", "end_min"]), as_text("time_off", ["start_date", "end_date"], "/")
    return rows.select("employee_id", "level", windows.alias("windows"), off.alias("times_off"))



@query(
    f"""{_OPEN}
    SELECT s.shift_id, (SELECT count(*) FROM assignments a WHERE a.shift_id = s.shift_id) AS assigned, (SELECT CAST(sum(count) AS BIGINT) FROM requirements r WHERE r.shift_id = s.shift_id) AS wanted,
           CAST(coalesce((SELECT sum(missing) FROM open o WHERE o.shift_id = s.shift_id), 0) AS BIGINT) AS missing FROM shifts s"""
)
def schedule_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = views.schedule_view(v.shifts, v.requirements, v.assignments, rules.unfilled(v.requirements, v.assignments))
    add = lambda c, f: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x[f]), F.lit(0).cast("long"))
    return rows.select("shift_id", F.coalesce(F.size("assignments"), F.lit(0)).cast("long").alias("assigned"), add("requirements", "count").alias("wanted"), add("unfilled", "missing").alias("missing"))


@query(
    f"""{_EDGES.replace("480", "0")}{_OWN},
    asked AS (SELECT DISTINCT e.employee_id, s.shift_id, e.level_id FROM own o JOIN shifts s ON s.week = o.week JOIN employees e ON e.employee_id = o.employee_id)
    SELECT k.employee_id, k.shift_id, k.level_id, CASE WHEN NOT EXISTS (SELECT 1 FROM requirements r WHERE r.shift_id = k.shift_id AND r.level_id = k.level_id) THEN 'no such requirement'
             WHEN EXISTS (SELECT 1 FROM assignments a WHERE a.shift_id = k.shift_id AND a.employee_id = k.employee_id) THEN 'already on the shift'
             WHEN EXISTS (SELECT 1 FROM own m JOIN edges x ON (x.a = m.shift_id AND x.b = k.shift_id) OR (x.b = m.shift_id AND x.a = k.shift_id) WHERE m.employee_id = k.employee_id) THEN 'overlaps another shift' END AS problem
    FROM asked k"""
)
def manual_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everybody who works in a week against every shift of that week."""
    v = Views(spark, sf_dir)
    busy = v.assignments.join(v.shifts.select("shift_id", "week"), "shift_id").select("employee_id", "week").distinct()
    asked = busy.join(v.shifts.select("shift_id", "week"), "week").join(v.employees.select("employee_id", "level_id"), "employee_id").select("employee_id", "shift_id", "level_id")
    return views.manual_check(asked, v.requirements, v.assignments, v.shifts)
