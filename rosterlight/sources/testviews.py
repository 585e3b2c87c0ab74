"""The domain's tables, derived from the driver's by fixed arithmetic, so that SQL can derive the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "2024-01-03", "2024-01-27"

# The seeded levels; targets, rules and weeks are this table set's own.
LEVELS = [(1, "Manager", 100, True), (2, "Shift Lead", 90, True), (3, "AM in Training", 80, True), (4, "B2", 70, True), (5, "B1", 60, True), (6, "K1", 50, True), (7, "T2", 40, True), (8, "Training", 10, False)]
SLAS = [(300, 0.9, "2000-01-01"), (240, 0.5, "2024-01-10"), (420, 0.9, "2024-01-20"), (200, 0.6, "2030-01-01")]
RULES = [(210, 1, 0), (361, 2, 1)]
WEEKS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str, kept: Callable[[DataFrame, str], DataFrame] = lambda df, name: df):
        """``kept`` may write the two tables that most others are made from, so that a plan with many uses reads events once."""
        self.spark, self.dir = spark, sf_dir
        self.table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        self.events = ev
        self.tickets = ev.select(
            F.col("event_id").alias("ticket_id"), F.col("ts").alias("created_at"), F.floor(F.col("value") * 6).cast("int").alias("completion_seconds"), (F.col("event_type") == "error").alias("recalled"),
            F.col("event_type").alias("station"), F.get_json_object("props", "$.k").cast("int").alias("items"),
        )
        self.people = kept(ev.select((F.col("user_id") % 25).alias("e")).distinct(), "people")
        worked = ev.select((F.col("user_id") % 25).alias("e"), F.to_date("ts").alias("d")).distinct().where((F.col("e") * 7 + F.dayofmonth("d")) % 10 < 6)
        start = F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=(6 + (F.col("e") * 3 + F.dayofmonth("d")) % 8).cast("int"))
        sessions = worked.select((F.col("e") * 1000 + F.dayofyear("d")).alias("session_id"), F.col("e").alias("employee_id"), (1 + F.col("e") % 8).cast("int").alias("level_id"), start.alias("clock_in"))
        self.sessions = kept(sessions.withColumn("clock_out", F.col("clock_in") + F.expr("INTERVAL '6' HOUR")), "sessions")
        self.breaks = self.sessions.where("employee_id % 2 = 0").select("session_id", (F.col("clock_in") + F.expr("INTERVAL '3' HOUR")).alias("break_start"), (F.col("clock_in") + F.expr("INTERVAL '4' HOUR")).alias("break_end"))
        self.levels = spark.createDataFrame(LEVELS, "level_id int, level_name string, rank int, counts_for_rating boolean")
        self.sla = spark.createDataFrame(SLAS, "target_seconds int, adherence_goal double, effective_from string").withColumn("effective_from", F.to_date("effective_from"))
        self.rules = spark.createDataFrame(RULES, "min_shift_minutes int, rest_breaks int, meal_breaks int")
        old = self.people.select(F.col("e").alias("employee_id"), (1 + F.col("e") % 8).cast("int").alias("level_id"), F.to_date(F.lit("2000-01-01")).alias("effective_from"))
        new = self.people.where("e % 4 = 0").select(F.col("e").alias("employee_id"), (1 + (F.col("e") + 1) % 8).cast("int").alias("level_id"), F.to_date(F.lit("2024-01-15")).alias("effective_from"))
        self.employee_levels = old.union(new)
        self.employees = self.people.select(
            F.col("e").alias("employee_id"), F.concat(F.lit("Person "), F.col("e").cast("string")).alias("name"), (F.col("e") % 11 != 10).alias("active"), (1 + F.col("e") % 8).cast("int").alias("level_id"),
            F.when(F.col("e") % 3 == 0, 1500).otherwise(2400).alias("max_week_minutes"), F.when(F.col("e") % 2 == 0, 1200).alias("target_week_minutes"),
        )
        r = lambda n, c: spark.range(n).select(F.col("id").cast("int").alias(c))
        grid = r(4, "w").crossJoin(r(7, "d")).crossJoin(r(3, "b"))
        week = F.date_add(F.lit("2024-01-01").cast("date"), F.col("w") * 7)
        self.shifts = grid.select(
            (F.col("w") * 100 + F.col("d") * 10 + F.col("b")).alias("shift_id"), week.alias("week"), F.date_add(week, F.col("d")).alias("date"),
            F.element_at(F.array(F.lit(360), F.lit(600), F.lit(900)), F.col("b") + 1).alias("start_min"), F.element_at(F.array(F.lit(660), F.lit(900), F.lit(1260)), F.col("b") + 1).alias("end_min"),
        )
        need = [grid.select((F.col("w") * 100 + F.col("d") * 10 + F.col("b")).alias("shift_id"), (1 + (F.col("d") + F.col("b") + k) % 8).cast("int").alias("level_id"), (1 + (F.col("d") + F.col("b")) % 2).cast("int").alias("count")) for k in (0, 3)]
        self.requirements = reduce(DataFrame.union, need)
        picks = self.requirements.join(self.employees.select("employee_id", "level_id"), "level_id").where((F.col("employee_id") * 5 + F.col("shift_id")) % 7 < 2)
        self.assignments = picks.select("shift_id", "employee_id", F.col("level_id").alias("fills_level_id"), (F.col("employee_id") % 5 == 0).alias("manual"))
        days = self.people.crossJoin(r(7, "weekday")).where("e % 3 <> 0 AND (e + weekday) % 4 <> 0")
        a = days.select(F.col("e").alias("employee_id"), "weekday", (300 + (F.col("e") % 3) * 60).cast("int").alias("start_min"), F.lit(800).alias("end_min"))
        b = days.select(F.col("e").alias("employee_id"), "weekday", (780 + (F.col("e") % 2) * 20 + F.floor((F.col("e") % 5) / 4) * 30).cast("int").alias("start_min"), (1320 - (F.col("e") % 5) * 30).cast("int").alias("end_min"))
        self.availability = a.union(b)
        self.time_off = self.people.where("e % 6 = 1").select(F.col("e").alias("employee_id"), F.to_date(F.lit("2024-01-08")).alias("start_date"), F.to_date(F.lit("2024-01-10")).alias("end_date"))
        roster = self.people.crossJoin(r(7, "d")).where("(e + d) % 5 < 2 AND e < 20")
        self.roster = roster.select(
            (F.col("e") * 10 + F.col("d")).alias("entry_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), (360 + (F.col("e") % 5) * 60).cast("int").alias("start_min"),
            (360 + (F.col("e") % 5) * 60 + 120 + (F.col("e") * 7 + F.col("d")) % 9 * 50).cast("int").alias("end_min"),
        )


#: The same tables in DuckDB, as the beginning of a WITH list.
SQL = """
    tickets AS (SELECT event_id AS ticket_id, ts AS created_at, CAST(floor(value * 6) AS INTEGER) AS completion_seconds, event_type = 'error' AS recalled,
                event_type AS station, CAST(json_extract_string(props, '$.k') AS INTEGER) AS items FROM events),
    people AS (SELECT DISTINCT user_id % 25 AS e FROM events),
    sessions AS (SELECT e * 1000 + dayofyear(d) AS session_id, e AS employee_id, CAST(1 + e % 8 AS INTEGER) AS level_id,
                 d + to_hours(CAST(6 + (e * 3 + day(d)) % 8 AS INTEGER)) AS clock_in, d + to_hours(CAST(12 + (e * 3 + day(d)) % 8 AS INTEGER)) AS clock_out
                 FROM (SELECT DISTINCT user_id % 25 AS e, CAST(ts AS DATE) AS d FROM events) WHERE (e * 7 + day(d)) % 10 < 6),
    breaks AS (SELECT session_id, clock_in + INTERVAL 3 HOUR AS break_start, clock_in + INTERVAL 4 HOUR AS break_end FROM sessions WHERE employee_id % 2 = 0),
    levels(level_id, level_name, rank, counts_for_rating) AS (VALUES (1, 'Manager', 100, true), (2, 'Shift Lead', 90, true), (3, 'AM in Training', 80, true), (4, 'B2', 70, true),
                 (5, 'B1', 60, true), (6, 'K1', 50, true), (7, 'T2', 40, true), (8, 'Training', 10, false)),
    sla(target_seconds, adherence_goal, effective_from) AS (VALUES (300, 0.9, DATE '2000-01-01'), (240, 0.5, DATE '2024-01-10'), (420, 0.9, DATE '2024-01-20'), (200, 0.6, DATE '2030-01-01')),
    rules(min_shift_minutes, rest_breaks, meal_breaks) AS (VALUES (210, 1, 0), (361, 2, 1)),
    employee_levels AS (SELECT e AS employee_id, CAST(1 + e % 8 AS INTEGER) AS level_id, DATE '2000-01-01' AS effective_from FROM people
                 UNION ALL SELECT e, CAST(1 + (e + 1) % 8 AS INTEGER), DATE '2024-01-15' FROM people WHERE e % 4 = 0),
    employees AS (SELECT e AS employee_id, 'Person ' || e AS name, e % 11 <> 10 AS active, CAST(1 + e % 8 AS INTEGER) AS level_id, CASE WHEN e % 3 = 0 THEN 1500 ELSE 2400 END AS max_week_minutes FROM people),
    grid AS (SELECT w, d, b, w * 100 + d * 10 + b AS shift_id FROM range(4) AS x(w), range(7) AS y(d), range(3) AS z(b)),
    shifts AS (SELECT CAST(shift_id AS INTEGER) AS shift_id, DATE '2024-01-01' + CAST(w * 7 AS INTEGER) AS week, DATE '2024-01-01' + CAST(w * 7 + d AS INTEGER) AS date,
                 [360, 600, 900][b + 1] AS start_min, [660, 900, 1260][b + 1] AS end_min FROM grid),
    requirements AS (SELECT CAST(shift_id AS INTEGER) AS shift_id, CAST(1 + (d + b + k) % 8 AS INTEGER) AS level_id, CAST(1 + (d + b) % 2 AS INTEGER) AS count FROM grid, (VALUES (0), (3)) AS q(k)),
    assignments AS (SELECT r.shift_id, e.employee_id, r.level_id AS fills_level_id, e.employee_id % 5 = 0 AS manual FROM requirements r JOIN employees e USING (level_id) WHERE (e.employee_id * 5 + r.shift_id) % 7 < 2),
    adays AS (SELECT e, CAST(k AS INTEGER) AS weekday FROM people, range(7) AS y(k) WHERE e % 3 <> 0 AND (e + k) % 4 <> 0),
    availability AS (SELECT e AS employee_id, weekday, CAST(300 + (e % 3) * 60 AS INTEGER) AS start_min, 800 AS end_min FROM adays
                 UNION ALL SELECT e, weekday, CAST(780 + (e % 2) * 20 + (e % 5) // 4 * 30 AS INTEGER), CAST(1320 - (e % 5) * 30 AS INTEGER) FROM adays),
    time_off AS (SELECT e AS employee_id, DATE '2024-01-08' AS start_date, DATE '2024-01-10' AS end_date FROM people WHERE e % 6 = 1),
    roster AS (SELECT e * 10 + d AS entry_id, DATE '2024-01-01' + CAST(d AS INTEGER) AS date, CAST(360 + (e % 5) * 60 AS INTEGER) AS start_min,
                 CAST(360 + (e % 5) * 60 + 120 + (e * 7 + d) % 9 * 50 AS INTEGER) AS end_min FROM people, range(7) AS y(d) WHERE (e + d) % 5 < 2 AND e < 20)
"""
