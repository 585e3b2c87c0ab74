"""Registered queries over sources, sinks, views and scalar helpers, with their DuckDB text.

Exports are made from the tables first (``Exports``), so that the readers work on files as they would in a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rules, scheduling, temporal, views
from ..sources import html_tables, imports, sinks, tables
from ..sources.testviews import START, Views
from ..streaming import adherence
from . import applied, sync
from .queries import _ENTITLED, _ORDER_SHIFTS, _OWN, _WARNED, _WARNINGS, _WORKED, _planned, as_text, order_shifts, query
from .shared import scratch

_DAY = "CAST(clock_in AS DATE)"


def put(df: DataFrame, name: str) -> str:
    """Lines of text (one string column) as files of a new folder."""
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


def clock(c: Column) -> Column:
    """6:05am, without a leading zero."""
    return text.minute_label(F.hour(c) * 60 + F.minute(c))


def long_day(c: Column) -> Column:
    return F.date_format(c, "MMMM d yyyy")


def timesheet_lines(v: Views) -> DataFrame:
    """A block a person: a title, a header, each session with its first break row beside it and a second one below, totals, and a no-show."""
    e = F.col("employee_id")
    line = lambda **at: F.array_join(F.array(*[at.get(f"c{k}", F.lit("")) for k in range(22)]), ",")
    day, name = F.col("clock_in"), F.concat(F.lit("Person "), e.cast("string"))
    first = F.when(e % 2 == 0, clock(day + F.expr("INTERVAL '3' HOUR"))).otherwise("")
    last = F.when(e % 2 == 0, clock(day + F.expr("INTERVAL '4' HOUR"))).otherwise("")
    shift = line(c0=name, c1=long_day(day), c2=clock(day), c3=long_day(F.col("clock_out")), c4=clock(F.col("clock_out")), c5=first, c6=last, c8=F.lit("Paid"), c9=F.concat(F.lit("pay-"), e.cast("string")), c10=F.concat(F.lit("L"), F.col("level_id").cast("string")))
    pause = line(c5=clock(day + F.expr("INTERVAL '5' HOUR")), c6=clock(day + F.expr("INTERVAL '310' MINUTE")), c8=F.lit("Unpaid"))
    rows = v.sessions.groupBy("employee_id").agg(F.array_sort(F.collect_list(F.struct("clock_in", F.concat_ws("\n", shift, pause).alias("x")))).alias("xs"))
    title, head = line(c0=F.lit("Payroll Period")), line(c0=F.lit("Name"), c10=F.lit("Role"))
    absent = line(c0=name, c1=F.lit("February 1 2024"), c10=F.lit("L1"), c19=F.when(e % 3 == 0, "Sick").otherwise("Late"))
    body = F.array_join(F.col("xs.x"), "\n")
    return rows.select(F.concat_ws("\n", title, head, body, line(c0=F.concat(F.lit("Totals for "), name)), F.lit("short,row"), absent).alias("value"))


def _sheet(v: Views) -> dict[str, DataFrame]:
    return imports.timesheet(v.spark, put(timesheet_lines(v), "timesheet"))


# sources

@query(" SELECT DISTINCT 'K' || station AS station, items, completion_seconds, strftime(date_trunc('minute', created_at), '%Y-%m-%d %H:%M:%S') AS created_at, recalled FROM tickets WHERE items % 7 <> 0")
def ticket_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickets as a CSV export, some without a duration, read back."""
    t = Views(spark, sf_dir).tickets
    rows = t.select(
        F.concat(F.lit("K"), "station").alias("Device Name"), F.col("items").cast("string").alias("Number of Items"), F.when(F.col("items") % 7 != 0, F.col("completion_seconds").cast("string")).otherwise(" ").alias("Completion Time (seconds)"),
        F.date_format("created_at", "M/d/yyyy H:mm").alias("Time Created"), F.lit("").alias("Time Completed"), F.when(F.col("recalled"), "yes").otherwise("").alias("Time Recalled"),
    )
    path = scratch(spark, "tickets")
    rows.write.option("header", True).csv(path)
    return imports.tickets(spark, path).select("station", "items", "completion_seconds", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "recalled")


@query(""" SELECT DISTINCT station || ' "no. ' || items || '"' || chr(10) || 'and, more' AS source, items, completion_seconds, strftime(date_trunc('minute', created_at), '%Y-%m-%d %H:%M:%S') AS created_at FROM tickets""")
def ticket_import_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export whose cells hold quotes, commas and line feeds, read back in splits."""
    source = F.concat("station", F.lit(' "no. '), F.col("items").cast("string"), F.lit('"\nand, more'))
    rows = Views(spark, sf_dir).tickets.select(
        source.alias("Order Source"), F.col("items").cast("string").alias("Number of Items"), F.col("completion_seconds").cast("string").alias("Completion Time (seconds)"), F.date_format("created_at", "M/d/yyyy H:mm").alias("Time Created")
    )
    path = scratch(spark, "tickets")
    rows.write.options(header=True, escape='"').csv(path)
    return imports.tickets(spark, path).select("source", "items", "completion_seconds", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(f" SELECT 'Person ' || employee_id AS name, 'pay-' || employee_id AS payroll_id, 'L' || level_id AS role, CAST(clock_in AS VARCHAR) AS clock_in, CAST(clock_out AS VARCHAR) AS clock_out FROM sessions")
def timesheet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sheet(Views(spark, sf_dir))["sessions"]
    return s.select("name", "payroll_id", "role", F.col("clock_in").cast("string").alias("clock_in"), F.col("clock_out").cast("string").alias("clock_out"))


@query(
    f""" SELECT 'Person ' || employee_id AS name, CAST({_DAY} + (clock_in::TIME + INTERVAL 5 HOUR) AS VARCHAR) AS break_start, CAST({_DAY} + (clock_in::TIME + INTERVAL 310 MINUTE) AS VARCHAR) AS break_end, false AS paid FROM sessions
    UNION ALL SELECT 'Person ' || employee_id, CAST({_DAY} + (clock_in::TIME + INTERVAL 3 HOUR) AS VARCHAR), CAST({_DAY} + (clock_in::TIME + INTERVAL 4 HOUR) AS VARCHAR), true FROM sessions WHERE employee_id % 2 = 0"""
)
def timesheet_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break rows belong to the session above them and are stamped with its clock-in day."""
    b = _sheet(Views(spark, sf_dir))["breaks"]
    return b.select("name", F.col("break_start").cast("string").alias("break_start"), F.col("break_end").cast("string").alias("break_end"), "paid")


@query(" SELECT DISTINCT 'Person ' || employee_id AS name, '2024-02-01' AS date, CASE WHEN employee_id % 3 = 0 THEN 'Sick' ELSE 'Late' END AS reason FROM sessions")
def timesheet_no_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(Views(spark, sf_dir))["no_shows"].select("name", F.col("date").cast("string").alias("date"), "reason")


def _known(v: Views) -> applied.Tables:
    """Tables before an import: people 0 to 9 known, sessions of even days there already."""
    few = v.employees.where("employee_id < 10")
    return {
        "employees": few.select("employee_id", "name", F.lit(None).cast("string").alias("payroll_id"), F.lit(None).cast("string").alias("location")),
        "levels": v.spark.createDataFrame([(1, "L1", 90, True), (2, "L2", 80, True)], "level_id long, level_name string, rank int, counts_for_rating boolean"),
        "sessions": v.sessions.where("employee_id < 10 AND day(clock_in) % 2 = 0").select("employee_id", F.col("level_id").cast("long").alias("level_id"), "clock_in", "clock_out"),
        "breaks": v.spark.createDataFrame([], "employee_id long, clock_in timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz, paid boolean"),
        "no_shows": few.where("employee_id < 3").select("employee_id", F.lit("2024-02-01").cast("date").alias("date"), F.when(F.col("employee_id") % 3 == 0, "Sick").otherwise("Late").alias("reason")),
        "employee_levels": few.select("employee_id", F.lit(1).cast("long").alias("level_id"), F.lit("2000-01-01").cast("date").alias("effective_from")),
        "locations": v.spark.createDataFrame([(1, "North")], "location_id long, location string"),
    }


@query(
    """, kept AS (SELECT * FROM sessions WHERE employee_id < 10 AND day(clock_in) % 2 = 0), who AS (SELECT DISTINCT employee_id, level_id FROM sessions)
    SELECT (SELECT count(*) FROM sessions) - (SELECT count(*) FROM kept) AS created, (SELECT count(*) FROM kept) AS skipped,
           (SELECT count(*) FROM who) - (SELECT count(*) FROM people p WHERE e < 3 AND e IN (SELECT employee_id FROM who)) AS no_shows,
           (SELECT count(*) FROM who WHERE NOT (employee_id < 10 AND level_id = 1)) AS levels_updated"""
)
def timesheet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import reports; all levels count, and everybody works at one level here."""
    v = Views(spark, sf_dir)
    return applied.timesheet_import(_known(v), _sheet(v))[1].select("created", "skipped", "no_shows", "levels_updated")


@query(
    """ SELECT e.employee_id::BIGINT AS known_id, s.name, count(*) AS sessions FROM (SELECT 'Person ' || employee_id AS name, employee_id FROM sessions) s
    LEFT JOIN (SELECT e AS employee_id FROM people WHERE e < 10) e ON e.employee_id = s.employee_id GROUP BY ALL"""
)
def timesheet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by name after the import; who was known before keeps the id."""
    v = Views(spark, sf_dir)
    after = applied.timesheet_import(_known(v), _sheet(v))[0]
    n = after["sessions"].groupBy("employee_id").agg(F.count(F.lit(1)).alias("sessions"))
    return n.join(after["employees"], "employee_id").select(F.when(F.col("employee_id").between(0, 9), F.col("employee_id")).alias("known_id"), "name", "sessions")


def _team(v: Views) -> DataFrame:
    """Two exports with their columns in another order each; every second person has a second row."""
    e = F.col("employee_id")
    cells = lambda first, last, place, pay, role: {"First Name": first, "Last Name": last, "Location": place, "Payroll ID": pay, "Role Name": role}
    blank = F.lit("")
    head = cells(F.lit("Person"), e.cast("string"), F.concat(F.lit("Store "), (e % 3).cast("string")), F.when(e % 4 == 0, blank).otherwise(F.concat(F.lit("pay-"), e.cast("string"))), F.when(e % 5 == 0, blank).otherwise(F.concat(F.lit("R"), (e % 6).cast("string"))))
    more = cells(blank, blank, F.concat(F.lit("Annex "), (e % 2).cast("string")), F.concat(F.lit("late-"), e.cast("string")), blank)
    paths = []
    for odd in (0, 1):
        names = ["First Name", "Last Name", "Location", "Payroll ID", "Role Name"][:: -1 if odd else 1]
        line = lambda c, names=names: F.concat_ws(",", *[c[n] for n in names])
        own = v.employees.where(f"employee_id % 2 = {odd}").select("employee_id", F.when(e % 4 < 2, F.concat_ws("\n", line(head), line(more))).otherwise(line(head)).alias("x"))
        one = own.agg(F.array_sort(F.collect_list(F.struct("employee_id", "x"))).alias("xs")).select(F.concat_ws("\n", F.lit(",".join(names)), F.array_join(F.col("xs.x"), "\n")).alias("value"))
        paths.append(put(one.coalesce(1), "team"))
    return imports.team(v.spark, paths)


_TEAM = ", team AS (SELECT e, 'Person ' || e AS name, 'Store ' || (e % 3) AS location, CASE WHEN e % 4 > 0 THEN 'pay-' || e WHEN e % 4 < 2 THEN 'late-' || e END AS payroll_id, CASE WHEN e % 5 > 0 THEN 'R' || (e % 6) END AS role, CAST(CASE WHEN e % 4 < 2 THEN 1 ELSE 0 END AS INTEGER) AS more_rows FROM people)"


@query(f"{_TEAM} SELECT name, location, payroll_id, role, more_rows FROM team")
def team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _team(Views(spark, sf_dir)).select("name", "location", "payroll_id", "role", "more_rows")


@query(
    f"""{_TEAM} SELECT count(*) FILTER (e >= 10) AS created, count(*) FILTER (e < 10) AS updated, array_to_string(list_sort(list(DISTINCT role) FILTER (e >= 10 AND role IS NOT NULL)), ',') AS new_levels,
    CAST(sum(more_rows) AS BIGINT) AS additional_locations_skipped, count(*) FILTER (e < 10 AND role IS NOT NULL) AS levels_kept_unchanged FROM team"""
)
def team_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return applied.team_import(_known(v), _team(v), "2024-01-31")[1].withColumn("new_levels", F.array_join("new_levels", ","))


@query(f"{_TEAM} SELECT name, location, payroll_id FROM team")
def team_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employees after a team import: locations applied, payroll ids filled."""
    v = Views(spark, sf_dir)
    return applied.team_import(_known(v), _team(v), "2024-01-31")[0]["employees"].select("name", "location", "payroll_id")


@query(
    """ SELECT 'Person ' || employee_id AS name, 'L' || level_id AS role, CAST(hour(clock_in) * 60 AS INTEGER) AS start_min, CAST(hour(clock_out) * 60 AS INTEGER) AS end_min FROM sessions WHERE hour(clock_out) > hour(clock_in)"""
)
def roster_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a feed a day, under changing spellings and wrappings; shifts over midnight have no place in it."""
    v = Views(spark, sf_dir)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e, name = F.col("employee_id"), F.concat(F.lit("Person "), F.col("employee_id").cast("string"))
    a = F.to_json(F.struct(stamp("clock_in").alias("start_at"), stamp("clock_out").alias("end_at"), F.lit("Person").alias("first_name"), e.cast("string").alias("last_name"), F.concat(F.lit("L"), "level_id").alias("role")))
    b = F.to_json(F.struct(F.lit("").alias("start_at"), stamp("clock_in").alias("starts_at"), stamp("clock_out").alias("end"), name.alias("employee_name"), F.concat(F.lit("L"), "level_id").alias("role_name")))
    day = v.sessions.groupBy(F.to_date("clock_in").alias("day")).agg(F.array_join(F.collect_list(F.when(e % 2 == 0, a).otherwise(b)), ",").alias("x"))
    whole = day.select(F.concat(F.when(F.dayofmonth("day") % 3 == 0, "[").when(F.dayofmonth("day") % 3 == 1, '{"shifts": [').otherwise('{"data": ['), "x", F.when(F.dayofmonth("day") % 3 == 0, "]").otherwise("]}")).alias("value"), "day")
    path = scratch(spark, "feed")
    whole.withColumn("day", F.col("day").cast("string")).write.partitionBy("day").text(path)
    return imports.roster_json(spark, path + "/*")


def _hours_pages(v: Views) -> DataFrame:
    """A page a day: a table of other things first, then the hours with a role below each name."""
    e = F.col("employee_id")
    worked = F.when(e % 7 == 3, "<td>no show</td>").otherwise(F.concat(F.lit("<td>in and out<br>Total: 5 hrs "), (e % 60).cast("string"), F.lit(" min</td>")))
    row = F.concat(F.lit("<tr><td><span>aNN-lee o'"), F.translate(e.cast("string"), "0123456789", "abcdefghij"), F.lit("</span><div>B2</div></td>"), worked, F.lit("<td></td></tr>"))
    rows = v.sessions.groupBy(F.dayofyear("clock_in").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("x"))
    return rows.select("page", F.concat(F.lit("<ul><li>Team member</li></ul><table><tr><th>Name</th></tr><tr><td>x</td></tr></table><table><tr><th>Team <b>member</b></th><th> WORKED\n</th><th>Issues</th></tr>"), "x", F.lit("<tr><td> </td></tr></table>")).alias("html"))


_LETTERS = "translate(CAST(employee_id AS VARCHAR), '0123456789', 'abcdefghij')"
_UPPER = "upper(" + _LETTERS + "[1]) || " + _LETTERS + "[2:]"


@query(f" SELECT CAST(dayofyear(clock_in) AS INTEGER) AS page, 'Ann-Lee O''' || {_UPPER} AS name, round(5 + (employee_id % 60) / 60.0, 2) AS hours FROM sessions WHERE employee_id % 7 <> 3")
def html_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables.hours_rows(_hours_pages(Views(spark, sf_dir)), "page", "html", ["team member"], ["worked"])


@query(
    f""" SELECT CAST(dayofyear(clock_in) AS INTEGER) AS page, 'ann-lee o''' || {_LETTERS} AS name, CASE WHEN employee_id % 7 = 3 THEN 'no show' ELSE 'in and out total: 5 hrs ' || (employee_id % 60) || ' min' END AS worked, NULL::VARCHAR AS pay, '' AS issues FROM sessions"""
)
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"name": ["member"], "worked": ["hours", "worked"], "pay": ["paid"], "issues": ["issue"]}
    return html_tables.table_rows(_hours_pages(Views(spark, sf_dir)), "page", "html", wanted).drop("row_no")


@query(" SELECT DISTINCT CAST(dayofyear(clock_in) AS INTEGER) AS page, 2 AS n_tables, CAST(count(*) OVER (PARTITION BY dayofyear(clock_in)) AS INTEGER) AS n_rows, 'pay' AS missing FROM sessions")
def html_best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists are no tables, and rows without text do not count."""
    return html_tables.best_tables(_hours_pages(Views(spark, sf_dir)), "page", "html", {"name": ["member"], "worked": ["worked"], "pay": ["paid"]})


@query(" SELECT DISTINCT CAST(employee_id % 4 AS BIGINT) AS page, 'Person ' || employee_id AS name, CAST(DATE '2024-03-03' + CAST((employee_id * 3) % 7 AS INTEGER) AS VARCHAR) AS date FROM sessions")
def open_shift_pickups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of four pages: a marker for everybody, twice, nearest to one day header and to the own row."""
    v = Views(spark, sf_dir)
    people = v.sessions.select("employee_id").distinct()
    page, e = (F.col("employee_id") % 4).alias("page"), F.col("employee_id")
    days = spark.createDataFrame([(d, f" {n}, {d + 3} ") for d, n in enumerate(["Sun", "mon", "Tue", "WED", "Thursday", "Fri", "Sat"])], "d int, text string")
    heads = people.select(page).distinct().crossJoin(days).select("page", "text", (F.col("d") * 100.0).alias("x"), F.lit(0.0).alias("y"))
    rows = people.select(page, F.concat(F.lit("PERSON "), e.cast("string"), F.lit(" ")).alias("text"), F.lit(-50.0).alias("x"), (e * 40.0).alias("y"))
    marks = people.select(page, F.lit("Picked up OPEN shift").alias("text"), ((e * 3) % 7 * 100.0 + 20).alias("x"), (e * 40.0 + 15).alias("y"))
    texts = heads.union(rows).union(marks).union(marks)
    return html_tables.pickups(texts, v.employees.select("name"), ["open shift"], "2024-03-03").withColumn("date", F.col("date").cast("string"))


@query(" SELECT '2024-02-01' AS attempted_at, false AS ok, 'swaps: session expired' AS error, (SELECT count(*) FROM sessions) AS hours_rows, CAST(0 AS BIGINT) AS swaps_rows, (SELECT count(*) FROM sessions) AS hours_after, (SELECT count(*) FROM people) AS swaps_after")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of which one source fails: its table stays, the other's rows come in."""
    v = Views(spark, sf_dir)

    def broken() -> DataFrame:
        raise RuntimeError("session expired")

    hours = v.sessions.select("session_id", "employee_id")
    before = {"hours": hours.where("session_id % 2 = 0"), "swaps": v.people}
    after, status = sync.refreshed(spark, before, [sync.Source("swaps", broken, ["e"], [F.col("e")]), sync.Source("hours", lambda: hours, ["session_id"], [F.col("employee_id")])], "2024-02-01")
    n = lambda name: after[name].agg(F.count(F.lit(1)).alias(f"{name}_after"))
    return status.select("attempted_at", "ok", "error", F.col("rows")["hours"].alias("hours_rows"), F.col("rows")["swaps"].alias("swaps_rows")).crossJoin(n("hours")).crossJoin(n("swaps"))  # one row each


@query(" SELECT n_nationkey AS level_id, n_name AS level_name, 'empty' AS which FROM nation UNION ALL SELECT n_nationkey, n_name, 'full' FROM nation WHERE n_regionkey = 1")
def seeded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default rows come in only where a table has none."""
    n = Views(spark, sf_dir).table("nation")
    lv = n.select(F.col("n_nationkey").alias("level_id"), F.col("n_name").alias("level_name"))
    made = lambda df, name: views.seeded(df, lv).withColumn("which", F.lit(name))
    return made(lv.where("level_id < 0"), "empty").union(made(lv.where(n["n_regionkey"] == 1), "full"))


@query(" SELECT entry_id, start_min, CAST(start_min + 100 * (entry_id % 11) AS INTEGER) AS end_min, start_min + 100 * (entry_id % 11) > start_min AND start_min + 100 * (entry_id % 11) <= 1440 AS valid FROM roster")
def roster_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual entries: those whose minutes make sense are appended, the others set aside."""
    rows = Views(spark, sf_dir).roster.select("entry_id", "start_min", (F.col("start_min") + 100 * (F.col("entry_id") % 11)).cast("int").alias("end_min"))
    good, bad = views.split_valid(rows)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query(" SELECT CAST(e AS INTEGER) AS min_shift, CAST(e % 4 - 1 AS INTEGER) AS rest_breaks, e % 4 > 0 AND e % 5 > 1 AS valid FROM (SELECT CASE WHEN e % 5 <= 1 THEN e - e % 5 ELSE e END AS e FROM people) x")
def rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break rules: a threshold that two rules share and a negative count are invalid."""
    e = F.when(F.col("e") % 5 <= 1, F.col("e") - F.col("e") % 5).otherwise(F.col("e"))
    rows = Views(spark, sf_dir).people.select(e.cast("int").alias("min_shift"), (e % 4 - 1).cast("int").alias("rest_breaks"))
    good, bad = views.split_valid(rows, ("rest_breaks",), "min_shift")
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


# sinks

@query(" SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'old' ELSE 'new' END AS source FROM sessions")
def insert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent by (employee, clock-in): the upload holds every session twice."""
    s = Views(spark, sf_dir).sessions
    old = s.where("session_id % 3 = 0").withColumn("source", F.lit("old"))
    new = s.union(s).withColumn("source", F.lit("new"))
    return old.union(sinks.absent(new, old, ["employee_id", "clock_in"], [F.col("session_id")])).select("session_id", "source")


@query(" SELECT employee_id, CAST(CAST(clock_in AS DATE) AS VARCHAR) AS shift_date, CASE WHEN session_id % 2 = 0 THEN 2 ELSE 1 END AS synced FROM sessions")
def upsert_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by (date, person): a row seen again is touched."""
    s = Views(spark, sf_dir).sessions.select("employee_id", F.to_date("clock_in").cast("string").alias("shift_date"), "session_id")
    old, new = s.withColumn("synced", F.lit(1)), s.where("session_id % 2 = 0").withColumn("synced", F.lit(2))
    return sinks.upserted(old, new, ["employee_id", "shift_date"], [F.desc("synced")]).drop("session_id")


@query(
    """, said AS (SELECT l_linenumber AS n, CAST(l_shipdate AS DATE) AS day, CAST(max(l_quantity) AS INTEGER) AS target FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
    SELECT CAST(arg_max(target, n) AS INTEGER) AS target_seconds, CAST(day AS VARCHAR) AS effective_from FROM said GROUP BY day"""
)
def upsert_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by day, of which a second list changes some and adds others."""
    lines = Views(spark, sf_dir).table("lineitem")
    said = lambda n: lines.where(F.col("l_linenumber") == n).groupBy(F.to_date("l_shipdate").cast("string").alias("effective_from")).agg(F.max("l_quantity").cast("int").alias("target_seconds")).withColumn("n", F.lit(n))
    return sinks.upserted(said(1), said(2), ["effective_from"], [F.desc("n")]).select("target_seconds", "effective_from")


@query(
    """, held AS (SELECT employee_id, arg_max(level_id, effective_from) AS level_id FROM employee_levels WHERE effective_from <= DATE '2024-01-20' GROUP BY employee_id)
    SELECT p.e AS employee_id, CAST(1 + p.e % 4 AS INTEGER) AS level_id, '2024-01-20' AS effective_from FROM people p LEFT JOIN held h ON h.employee_id = p.e WHERE h.level_id IS DISTINCT FROM 1 + p.e % 4"""
)
def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level rows of today, only where the level differs from the one held."""
    v = Views(spark, sf_dir)
    wanted = v.people.select(F.col("e").alias("employee_id"), (1 + F.col("e") % 4).cast("int").alias("level_id"))
    return views.level_changes(v.employee_levels, wanted, F.lit("2024-01-20").cast("date")).withColumn("effective_from", F.col("effective_from").cast("string"))


@query(" SELECT employee_id, weekday, start_min, end_min FROM availability WHERE employee_id % 4 <> 0 UNION ALL SELECT e, 2, 60, 120 FROM people WHERE e % 4 = 0")
def replace_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who hands in windows replaces all they had."""
    v = Views(spark, sf_dir)
    new = v.people.where("e % 4 = 0").select(F.col("e").alias("employee_id"), F.lit(2).alias("weekday"), F.lit(60).alias("start_min"), F.lit(120).alias("end_min"))
    return sinks.replaced(v.availability, new, ["employee_id"])


@query(" SELECT shift_id, employee_id, manual FROM assignments WHERE manual UNION ALL SELECT s.shift_id, p.e, false FROM shifts s JOIN people p ON p.e = s.shift_id % 25")
def replace_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new solution replaces the solver's picks; manual ones stay."""
    v = Views(spark, sf_dir)
    old = v.assignments.select("shift_id", "employee_id", "manual")
    new = v.shifts.select("shift_id", (F.col("shift_id") % 25).cast("long").alias("employee_id")).join(v.people.select(F.col("e").alias("employee_id")), "employee_id").select("shift_id", "employee_id", F.lit(False).alias("manual"))
    return sinks.replaced_where(old, F.col("manual"), new)


@query(" SELECT r.entry_id, CASE WHEN r.date < DATE '2024-01-04' THEN 1 ELSE 0 END AS generation, count(*) AS n FROM roster r, range(2) GROUP BY ALL")
def replace_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's new plan replaces that day's breaks."""
    r = Views(spark, sf_dir).roster.select("entry_id", "date")
    two = r.union(r)
    out = sinks.replaced(two.withColumn("generation", F.lit(0)), two.where("date < '2024-01-04'").withColumn("generation", F.lit(1)), ["date"])
    return out.groupBy("entry_id", "generation").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT employee_id, weekday, start_min, end_min FROM availability WHERE employee_id % 3 <> 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of deleted people go with them."""
    v = Views(spark, sf_dir)
    return sinks.without_parents(v.availability, v.employees.where("employee_id % 3 = 1"), "employee_id")


@query(" SELECT employee_id, CASE WHEN employee_id % 2 = 0 THEN 'Renamed ' || employee_id ELSE name END AS name, active, CASE WHEN employee_id % 3 = 0 THEN 600 ELSE max_week_minutes END AS max_week_minutes FROM employees")
def patch_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch sets its non-null fields only."""
    v, e = Views(spark, sf_dir), F.col("employee_id")
    patch = v.employees.select("employee_id", F.when(e % 2 == 0, F.concat(F.lit("Renamed "), e.cast("string"))).alias("name"), F.when(e % 3 == 0, 600).alias("max_week_minutes"))
    return sinks.patched(v.employees.select("employee_id", "name", "active", "max_week_minutes"), patch, ["employee_id"])


@query(" SELECT employee_id, name, 'none' AS payroll_id, CAST(7 AS INTEGER) AS grade FROM employees")
def migrated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return sinks.with_columns(v.employees.select("employee_id", "name"), {"payroll_id": "none", "name": "kept", "grade": 7})


@query(" SELECT DISTINCT CASE WHEN items % 10 < 8 THEN levels.level_name ELSE 'Novel ' || (items % 10) END AS level_name, CASE WHEN items % 10 < 8 THEN rank ELSE 0 END AS rank FROM tickets LEFT JOIN levels ON level_id = items % 10 + 1 UNION SELECT level_name, rank FROM levels")
def new_level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the dimension lacks are added once each."""
    v = Views(spark, sf_dir)
    n = F.col("items") % 10
    said = v.tickets.select((n + 1).alias("level_id"), n.alias("n")).join(v.levels.select("level_id", "level_name"), "level_id", "left")
    names = said.select(F.when(F.col("n") < 8, F.col("level_name")).otherwise(F.concat(F.lit("Novel "), F.col("n").cast("string"))).alias("level_name"))
    grown = sinks.with_new_names(v.levels.select(F.col("level_id").cast("long").alias("level_id"), "level_name", "rank"), names, "level_name", "level_id", {"rank": F.lit(0)})
    return grown.select("level_name", "rank")


@query(" SELECT session_id, CAST(CASE WHEN session_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM sessions")
def swapped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, read, upserted into itself and swapped."""
    s, path = Views(spark, sf_dir).sessions.select("session_id"), scratch(spark, "table")
    tables.written(s.withColumn("version", F.lit(1)), path)
    tables.written(sinks.upserted(tables.current(spark, path), s.where("session_id % 2 = 0").withColumn("version", F.lit(2)), ["session_id"], [F.desc("version")]), path)
    return tables.current(spark, path)


@query(" SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type AS station, max(event_id) AS last_ticket FROM events GROUP BY ALL")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, upserted batch by batch into a snapshot of the last ticket by day and station."""
    path, state = f"{sf_dir}/events.parquet", scratch(spark, "stream")
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path + "*").select(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("station"), F.col("event_id").alias("last_ticket"))
    adherence.upserted_batches(rows, f"{state}/table", ["day", "station"], [F.desc("last_ticket")], f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return tables.current(spark, f"{state}/table")


@query(" SELECT ticket_id FROM tickets")
def stream_ingested_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticket arrives in one stream and, under another checkpoint, once more: the table holds it once."""
    state = scratch(spark, "stream")
    for run in ("first", "again"):
        adherence.ingested_once(_ticket_stream(spark, sf_dir), f"{state}/table", ["ticket_id"], [F.col("created_at")], f"{state}/{run}").trigger(availableNow=True).start().awaitTermination()
    return tables.current(spark, f"{state}/table").select("ticket_id")


def _drained(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream appends once all there is has been read."""
    state = scratch(spark, "stream")
    rows.writeStream.format("parquet").option("path", f"{state}/out").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{state}/out")


def _ticket_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    return rows.select(F.col("event_id").alias("ticket_id"), F.col("ts").cast("timestamp").alias("created_at"), F.floor(F.col("value") * 6).cast("int").alias("completion_seconds"), (F.col("event_type") == "error").alias("recalled"))


@query(
    """, live AS (SELECT date_trunc('hour', created_at) AS h, completion_seconds <= coalesce((SELECT s.target_seconds FROM sla s WHERE s.effective_from <= CAST(t.created_at AS DATE) ORDER BY s.effective_from DESC LIMIT 1), 300) AS ok FROM tickets t WHERE NOT recalled)
    SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_start, count(*) AS tickets, count(*) FILTER (ok) AS on_time FROM live WHERE h + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM tickets WHERE NOT recalled) - INTERVAL 2 HOUR GROUP BY h"""
)
def stream_hourly_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed, each ticket judged by the target of its day."""
    got = _drained(adherence.hourly_adherence(_ticket_stream(spark, sf_dir), Views(spark, sf_dir).sla), spark)
    return got.select(F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "tickets", "on_time")


@query(" SELECT ticket_id FROM tickets")
def stream_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticket arrives twice and is taken once."""
    rows = _ticket_stream(spark, sf_dir).withColumn("row_hash", F.col("ticket_id").cast("string"))
    return _drained(adherence.once_each(rows.union(rows)), spark).select("ticket_id")


# filters and views

@query(
    f"""{_WORKED}{_OWN}{_WARNED}, warned AS ({_WARNINGS})
    SELECT CAST(w.week AS VARCHAR) AS week, (SELECT string_agg(concat_ws('/', date, start_min, shift_id, end_min), ';' ORDER BY date, start_min, shift_id) FROM shifts s WHERE s.week = w.week) AS shifts,
           (SELECT string_agg(concat_ws('-', shift_id, employee_id, fills_level_id, manual), ';' ORDER BY shift_id, employee_id, fills_level_id, manual) FROM assignments a JOIN shifts s USING (shift_id) WHERE s.week = w.week) AS assignments,
           (SELECT string_agg(concat_ws('-', shift_id, level_id, n), ';' ORDER BY shift_id, level_id) FROM (SELECT s.week, r.shift_id, r.level_id, r.count - count(a.employee_id) AS n FROM requirements r JOIN shifts s USING (shift_id)
            LEFT JOIN assignments a ON a.shift_id = r.shift_id AND a.fills_level_id = r.level_id GROUP BY s.week, r.shift_id, r.level_id, r.count HAVING count(a.employee_id) < r.count) u WHERE u.week = w.week) AS unfilled,
           (SELECT count(*) FROM warned x WHERE x.week = w.week) AS n_warnings FROM (SELECT DISTINCT week FROM shifts) w"""
)
def schedule_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week with its shifts, assignments, open slots and warnings as ordered arrays, here as text."""
    v = Views(spark, sf_dir)
    warned = rules.warning_messages(rules.warnings(v.assignments, v.shifts, v.employees, rules.worked_dates(v.sessions, v.assignments, v.shifts)), v.employees)
    rows = views.schedule_detail(v.shifts, v.assignments, rules.unfilled(v.requirements, v.assignments), warned)
    parts = [as_text("shifts", ["date", "start_min", "shift_id", "end_min"], "/").alias("shifts"), as_text("assignments", ["shift_id", "employee_id", "fills_level_id", "manual"]).alias("assignments")]
    return rows.select(F.col("week").cast("string").alias("week"), *parts, as_text("unfilled", ["shift_id", "level_id", "missing"]).alias("unfilled"), F.size("warnings").cast("long").alias("n_warnings"))


@query(f"{_ORDER_SHIFTS} SELECT shift_id, CAST(date AS VARCHAR) AS date FROM oshifts WHERE date >= DATE '1997-05-14' AND date < DATE '1997-05-21'")
def week_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days from any date on, in order."""
    return views.week_slice(order_shifts(Views(spark, sf_dir)), F.lit("1997-05-14").cast("date")).select("shift_id", F.col("date").cast("string").alias("date"))


@query(" SELECT ticket_id FROM tickets WHERE station = 'view' AND NOT recalled")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that are not set filter nothing."""
    return views.filtered(Views(spark, sf_dir).tickets, station="view", items=None, recalled=False).select("ticket_id")


@query(" SELECT employee_id, name FROM employees WHERE employee_id IN (SELECT employee_id FROM assignments WHERE manual)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return views.members(v.employees, v.assignments.where("manual"), "employee_id").select("employee_id", "name")


@query(f"{_ORDER_SHIFTS}, weeks AS (SELECT week, bool_or(status = 'P') AS open_ FROM oshifts GROUP BY week) SELECT CAST(week AS VARCHAR) AS week, who FROM weeks, (VALUES ('manager'), ('staff')) AS x(who) WHERE who = 'manager' OR NOT open_")
def visible_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts (here weeks with an order in progress) are for managers."""
    weeks = order_shifts(Views(spark, sf_dir)).groupBy("week").agg(F.when(F.bool_or(F.col("status") == "P"), "draft").otherwise("published").alias("status"))
    see = lambda manager, who: views.visible(weeks, manager).select(F.col("week").cast("string").alias("week"), F.lit(who).alias("who"))
    return see(True, "manager").union(see(False, "staff"))


@query(" SELECT ticket_id FROM tickets WHERE created_at >= DATE '2024-01-20' AND created_at < DATE '2024-01-26' AND NOT recalled")
def default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five days back from a given today, both ends included."""
    first, last = views.default_window(F.lit("2024-01-25").cast("date"), 5)
    t = Views(spark, sf_dir).tickets
    return t.where((F.col("created_at") >= first.cast("timestamp_ntz")) & (F.col("created_at") < F.date_add(last, 1).cast("timestamp_ntz")) & ~F.col("recalled")).select("ticket_id")


@query(f"{_ENTITLED} SELECT entry_id, CAST(rest_breaks + meal_breaks AS BIGINT) AS n FROM due")
def day_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster entries with their breaks as an ordered array; here how many there are."""
    v = Views(spark, sf_dir)
    seen = views.day_view(v.roster, _planned(v))
    inside = F.forall(F.coalesce("breaks", F.array().cast("array<struct<start_min:int,end_min:int,kind:string>>")), lambda b: (b["start_min"] >= F.col("start_min")) & (b["end_min"] <= F.col("end_min")))
    return seen.select("entry_id", F.when(inside, F.coalesce(F.size("breaks"), F.lit(0))).otherwise(-1).cast("long").alias("n"))


@query(
    """, b AS (SELECT entry_id, start_min, end_min, start_min + 60 AS f, start_min + 70 AS u, CAST(start_min + (entry_id * 37) % 700 - 50 AS INTEGER) AS t FROM roster)
    SELECT entry_id, CASE WHEN t >= start_min AND t + 10 <= end_min THEN t ELSE f END AS start_min, CASE WHEN t >= start_min AND t + 10 <= end_min THEN t + 10 ELSE u END AS end_min FROM b"""
)
def moved_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A break moves if it stays inside the shift."""
    r = Views(spark, sf_dir).roster
    held = r.select("entry_id", F.lit(0).alias("k"), (F.col("start_min") + 60).alias("start_min"), (F.col("start_min") + 70).alias("end_min"))
    moves = r.select("entry_id", F.lit(0).alias("k"), (F.col("start_min") + (F.col("entry_id") * 37) % 700 - 50).cast("int").alias("to"))
    return views.moved_break(held, r, moves).select("entry_id", "start_min", "end_min")


def _listing(name: str, rows: str, order: str) -> str:
    return f"SELECT '{name}' AS listing, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, {rows}"


@query(
    " " + " UNION ALL ".join([
        _listing("levels", "CAST(level_id AS VARCHAR) AS key FROM levels", "rank DESC, level_id"), _listing("employees", "CAST(employee_id AS VARCHAR) FROM employees", "lower(name), employee_id"),
        _listing("shifts", "CAST(shift_id AS VARCHAR) FROM shifts", "date, start_min, shift_id"), _listing("sla", "CAST(effective_from AS VARCHAR) FROM sla", "effective_from"), _listing("roster", "CAST(entry_id AS VARCHAR) FROM roster", "start_min, entry_id"),
    ])
)
def ordered_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in their orders, with the places of their rows (tables of at most some thousand rows)."""
    v, out = Views(spark, sf_dir), None
    for name, df, key in (("levels", v.levels, "level_id"), ("employees", v.employees, "employee_id"), ("shifts", v.shifts, "shift_id"), ("sla", v.sla, "effective_from"), ("roster", v.roster, "entry_id")):
        rows = views.listed(df, name).select(F.col(key).cast("string").alias("key")).coalesce(1).withColumn("place", (F.monotonically_increasing_id() + 1).cast("int")).select(F.lit(name).alias("listing"), "place", "key")
        out = rows if out is None else out.union(rows)
    return out


@query(" SELECT level_name, shift_id, CAST(missing AS INTEGER) AS missing FROM (SELECT r.shift_id, r.level_id, r.count - count(a.employee_id) AS missing FROM requirements r LEFT JOIN assignments a ON a.shift_id = r.shift_id AND a.fills_level_id = r.level_id GROUP BY r.shift_id, r.level_id, r.count) x JOIN levels USING (level_id) WHERE missing > 0")
def unfilled_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return rules.unfilled(v.requirements, v.assignments).join(v.levels, "level_id").select("level_name", "shift_id", "missing")


# as-of without a small side, and the interval join by a key

@query(" SELECT t.ticket_id, (SELECT max(o.ticket_id) FROM tickets o WHERE o.ticket_id <= t.items * 100 AND o.ticket_id % 2 = 0) AS step FROM tickets t")
def as_of_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of many steps at or before a number."""
    t = Views(spark, sf_dir).tickets
    steps = t.where("ticket_id % 2 = 0").select(F.col("ticket_id").alias("step"), F.col("ticket_id").alias("at"))
    return temporal.asof_by_value(t.select("ticket_id", "items"), steps, F.col("l.items") * 100, "at").select("ticket_id", "step")


@query(" SELECT t.ticket_id, (SELECT max(o.created_at) FROM tickets o WHERE o.created_at <= t.created_at - INTERVAL 90 MINUTE AND o.items % 4 = 1)::VARCHAR AS before FROM tickets t")
def as_of_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of many timestamps an hour and a half before each of many others, in ranges of some thousand values."""
    t = Views(spark, sf_dir).tickets
    steps = t.where("items % 4 = 1").select("created_at", F.col("created_at").alias("before"))
    got = temporal.asof_by_value(t.select("ticket_id", F.col("created_at").alias("at")), steps, F.col("l.at") - F.expr("INTERVAL '90' MINUTE"), "created_at", range_rows=5000)
    return got.select("ticket_id", F.regexp_replace(F.col("before").cast("string"), r"(\.\d*?)0+$", "$1").alias("before"))


@query(f" SELECT t.ticket_id, s.session_id FROM tickets t JOIN sessions s ON s.clock_in <= t.created_at AND t.created_at < s.clock_out AND s.employee_id % 3 = t.ticket_id % 3 WHERE t.created_at >= DATE '{START}'")
def on_floor_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets meet the sessions of their own store only."""
    v = Views(spark, sf_dir)
    t = v.tickets.where(F.col("created_at") >= F.lit(START).cast("timestamp_ntz")).select("ticket_id", "created_at", (F.col("ticket_id") % 3).alias("store"))
    s = v.sessions.select("session_id", "clock_in", "clock_out", (F.col("employee_id") % 3).alias("store"))
    return temporal.point_in_interval(t, s, "created_at", "clock_in", "clock_out", ("store",)).select("ticket_id", "session_id")


# scalars

@query(
    """ SELECT ticket_id, CAST(date_trunc('week', created_at)::DATE AS VARCHAR) AS monday, CAST(CAST(created_at AS DATE) - CAST(dayofweek(created_at) AS INTEGER) AS VARCHAR) AS sunday, printf('%02d:%02d', items // 60 % 24, items % 60) AS hh_mm,
    printf('%d:%02d', completion_seconds // 60, completion_seconds % 60) AS m_ss, printf('%d:%02d%s', CASE WHEN hour(created_at) % 12 = 0 THEN 12 ELSE hour(created_at) % 12 END, minute(created_at), CASE WHEN hour(created_at) < 12 THEN 'am' ELSE 'pm' END) AS label,
    CAST(hour(created_at) * 60 + minute(created_at) AS INTEGER) AS parsed FROM tickets"""
)
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Views(spark, sf_dir).tickets
    label = text.minute_label(F.hour("created_at") * 60 + F.minute("created_at"))
    i = F.floor(F.col("items") / 60) % 24 * 60 + F.col("items") % 60
    return t.select("ticket_id", text.monday_of(F.col("created_at")).cast("string").alias("monday"), text.sunday_of(F.to_date("created_at")).cast("string").alias("sunday"), text.clock_text(i).alias("hh_mm"), text.minutes_text(F.col("completion_seconds")).alias("m_ss"), label.alias("label"), text.parsed_minute(label).cast("int").alias("parsed"))


@query(
    """ SELECT ticket_id, 'the ' || station || ' desk ' || (items % 9) AS norm, 'Ann-Lee ' || upper(station[1]) || station[2:] || '''S' AS title, 'first ' || (items % 9) AS line, CASE WHEN items % 4 = 0 THEN NULL ELSE 'x' || (items % 9) END AS filled,
    sha256('x' || (items % 9) || '||' || station) AS hash FROM tickets"""
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Views(spark, sf_dir).tickets
    n = (F.col("items") % 9).cast("string")
    rows = t.select(
        "ticket_id", F.concat(F.lit(" The\t"), F.upper("station"), F.lit(" \n desk  "), n, F.lit(" ")).alias("a"), F.concat(F.lit("ann-LEE "), F.upper("station"), F.lit("'s")).alias("b"), F.concat(F.lit("first "), n, F.lit(" \nB2\nmore")).alias("c"),
        F.when(F.col("items") % 4 == 0, "  ").otherwise(F.concat(F.lit(" x"), n, F.lit(" "))).alias("d"), F.concat(F.lit("x"), n).alias("e"), F.lit(None).cast("string").alias("f"), "station",
    )
    return rows.select("ticket_id", text.normal(F.col("a")).alias("norm"), text.title_case(F.col("b")).alias("title"), text.first_line(F.col("c")).alias("line"), text.blank_to_null(F.col("d")).alias("filled"), text.row_hash(["e", "f", "station"]).alias("hash"))


@query(" SELECT shift_id, level_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT r.shift_id, r.level_id, CASE WHEN EXISTS (SELECT 1 FROM assignments a WHERE a.shift_id = r.shift_id AND a.fills_level_id = r.level_id AND a.manual) THEN 1 END AS m FROM requirements r) x WHERE m IS NOT NULL GROUP BY ALL")
def manual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that a manual pick fills, of each slot once."""
    v = Views(spark, sf_dir)
    manual = v.assignments.where("manual").select("shift_id", F.col("fills_level_id").alias("level_id")).distinct()
    return v.requirements.join(manual, ["shift_id", "level_id"], "left_semi").groupBy("shift_id", "level_id").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT entry_id, CAST(end_min - start_min AS INTEGER) AS minutes FROM roster WHERE NOT EXISTS (SELECT 1 FROM rules WHERE min_shift_minutes <= end_min - start_min)")
def shifts_without_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that no rule reaches: none of them is in the plan."""
    v = Views(spark, sf_dir)
    alone = scheduling.anchored_breaks(v.roster, v.rules).select("entry_id").distinct()
    due = rules.entitled(v.roster, v.rules).where("rest_breaks + meal_breaks = 0").join(alone, "entry_id", "left_anti")
    return due.select("entry_id", (F.col("end_min") - F.col("start_min")).cast("int").alias("minutes"))
