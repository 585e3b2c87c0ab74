import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rosterlight.functions import text
from rosterlight.plans import applied
from rosterlight.sources import html_tables, imports, sinks
from rosterlight.sources import tables as stored

# the header is a fixed format of the export; the rows are made up for these tests
HEADER = "Device Name,Ticket Name,Order Source,Number of Items,Items in Ticket,Completion Time (seconds),Time Created,Time Completed,Time Due,Time Recalled"


def put(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_ticket_export_with_quotes_blanks_and_repeats(spark, tmp_path):
    rows = [
        'Grill,T-77,Phone,3,"3x Soup, large",131,11/28/2025 18:41,11/28/2025 18:44,,',
        'Grill,T-78,Table,1,"1x ""House"" salad\nno onions",95,11/28/2025 18:52,,,',
        "Fryer,T-79,Table,12,12x Dumpling,1204,11/28/2025 19:03,11/28/2025 19:23,11/28/2025 19:15,gone back",
        'Grill,T-77,Phone,3,"3x Soup, large",131,11/28/2025 18:41,11/28/2025 18:44,,',
        "Fryer,T-80,Table,,, ,11/28/2025 19:30,,,",
        "Fryer,T-81,Table,2,2x Tea,44,,,,",
        ",T-82,,,,7,1/2/2026 0:05,,,",
    ]
    t = imports.tickets(spark, put(tmp_path / "t.csv", "﻿" + "\n".join([HEADER, *rows]) + "\n")).cache()
    got = sorted((r.station, r.source, r.items, str(r.created_at), r.completion_seconds, r.recalled) for r in t.collect())
    assert got == [
        ("", "", 0, "2026-01-02 00:05:00", 7, False), ("Fryer", "Table", 12, "2025-11-28 19:03:00", 1204, True),
        ("Grill", "Phone", 3, "2025-11-28 18:41:00", 131, False), ("Grill", "Table", 1, "2025-11-28 18:52:00", 95, False),
    ]
    again = imports.tickets(spark, str(tmp_path / "t.csv"))
    assert sinks.absent(again, t, ["row_hash"], [F.col("created_at")]).count() == 0
    report = sinks.import_report(t, spark.createDataFrame([(6,)], "n long"), F.col("n"), recalled=t.where("recalled")).first()
    assert (report.created, report.skipped, report.recalled) == (4, 2, 1)


def test_ticket_export_without_a_column_or_with_a_bad_value_fails(spark, tmp_path):
    with pytest.raises(ValueError, match="Time Created"):
        imports.tickets(spark, put(tmp_path / "w.csv", "Device Name,Completion Time (seconds)\nGrill,3\n"))
    bad = imports.tickets(spark, put(tmp_path / "b.csv", f"{HEADER}\nGrill,T,Phone,1,x,soon,11/28/2025 18:41,,,\n"))
    with pytest.raises(Exception, match="soon"):
        bad.collect()


def row(**k):
    cells = [""] * 22
    for at, v in k.items():
        cells[int(at[1:])] = v
    return ",".join(cells)


def shift(name, role, day, start, end, **k):
    return row(c0=name, c1=day, c2=start, c3=day, c4=end, c10=role, **k)


def sheet():
    """Gil works three days and changes role, Hana two (one uploaded twice), Ivo never comes, Jo trains."""
    return "\n".join(
        [
            row(c0="Payroll Period 7"), row(c0="Harbour Street"), row(c0="Name", c10="Role"),
            shift("Gil Marsh", "Runner", "March 9 2025", "11:15am", "4:45pm", c9="77", c5="1:20pm", c6="1:35pm", c8="Unpaid meal"),
            row(c5="3:05pm", c6="3:15pm", c8="Paid rest"), row(c5="3:40pm", c8="Paid rest"),
            shift("Gil Marsh", "Cook", "March 11 2025", "7:05AM", "12:00pm"),
            row(c0="Totals for Gil", c9="x"), row(c5="9:00am", c6="9:12am", c8="Paid rest"),
            shift("Gil Marsh", "Cook", "March 12 2025", "7:00am", "12:10pm"),
            "just,three,cells",
            shift("Hana Ode", "Cook", "March 9 2025", "5:00pm", "11:30pm", c9="80"), shift("Hana Ode", "Cook", "March 9 2025", "5:00pm", "11:00pm"), row(c5="8:00pm", c6="8:10pm", c8="Paid rest"),
            shift("Hana Ode", "Cook", "March 10 2025", "12:05am", "6:00am"),
            row(c0="Ivo Lund", c1="March 10 2025", c10="Runner", c19="No call"), row(c5="8:00am", c6="8:10am"),
            row(c0="Ivo Lund", c1="March 10 2025", c10="Runner", c19="No call"),
            shift("Jo Abel", "Training", "March 9 2025", "9:00am", "10:00am"),
            row(c0="-"), row(c0="Nameless", c10="Cook", c19="Late"),
        ]
    )


def tables(spark):
    e = spark.createDataFrame([(1, "Gil Marsh", None, None), (2, "H. Ode", "80", None)], "employee_id long, name string, payroll_id string, location string")
    return {
        "employees": e,
        "levels": spark.createDataFrame([(5, "Cook", 60, True), (9, "Training", 1, False)], "level_id long, level_name string, rank int, counts_for_rating boolean"),
        "sessions": spark.createDataFrame([(1, 5, dt.datetime(2025, 3, 12, 7), dt.datetime(2025, 3, 12, 12))], "employee_id long, level_id long, clock_in timestamp_ntz, clock_out timestamp_ntz"),
        "breaks": spark.createDataFrame([], "employee_id long, clock_in timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz, paid boolean"),
        "no_shows": spark.createDataFrame([], "employee_id long, date date, reason string"),
        "employee_levels": spark.createDataFrame([(2, 5, dt.date(2024, 1, 1))], "employee_id long, level_id long, effective_from date"),
        "locations": spark.createDataFrame([(1, "Pier")], "location_id long, location string"),
    }


def test_timesheet_blocks(spark, tmp_path):
    got = imports.timesheet(spark, put(tmp_path / "s.csv", sheet()))
    assert sorted((r.name, r.role, str(r.clock_in)[5:16], str(r.clock_out)[5:16]) for r in got["sessions"].collect()) == [
        ("Gil Marsh", "Cook", "03-11 07:05", "03-11 12:00"), ("Gil Marsh", "Cook", "03-12 07:00", "03-12 12:10"), ("Gil Marsh", "Runner", "03-09 11:15", "03-09 16:45"),
        ("Hana Ode", "Cook", "03-09 17:00", "03-09 23:30"), ("Hana Ode", "Cook", "03-10 00:05", "03-10 06:00"), ("Jo Abel", "Training", "03-09 09:00", "03-09 10:00"),
    ]
    # Totals rows do not end a block; a repeated session owns nothing, nor does who did not come
    assert sorted((r.name, str(r.break_start)[5:16], str(r.break_end)[11:16], r.paid) for r in got["breaks"].collect()) == [
        ("Gil Marsh", "03-09 13:20", "13:35", False), ("Gil Marsh", "03-09 15:05", "15:15", True), ("Gil Marsh", "03-11 09:00", "09:12", True),
    ]
    assert [(r.name, str(r.date), r.reason) for r in got["no_shows"].collect()] == [("Ivo Lund", "2025-03-10", "No call")]
    assert got["rows"].first().session_rows == 7
    with pytest.raises(ValueError, match="no header row"):
        imports.timesheet(spark, put(tmp_path / "n.csv", row(c0="Gil", c10="Cook")))


def test_timesheet_import_and_its_repeat(spark, tmp_path):
    parsed = imports.timesheet(spark, put(tmp_path / "s.csv", sheet()))
    after, report = applied.timesheet_import(tables(spark), parsed)
    assert tuple(report.first()) == (5, 2, 1, 1)  # Gil's one session was there, Hana's came twice; only Gil's level is news
    people = {r.name: (r.employee_id, r.payroll_id) for r in after["employees"].collect()}
    assert people["Gil Marsh"] == (1, "77") and people["H. Ode"] == (2, "80") and set(people) == {"Gil Marsh", "H. Ode", "Ivo Lund", "Jo Abel"}
    assert {(r.level_name, r.rank, r.counts_for_rating) for r in after["levels"].collect()} == {("Cook", 60, True), ("Training", 1, False), ("Runner", 0, True)}
    assert [(r.employee_id, r.level_id, str(r.effective_from)) for r in after["employee_levels"].where("employee_id = 1").collect()] == [(1, 5, "2025-03-11")]
    assert after["breaks"].count() == 3
    kept = {k: spark.createDataFrame(df.collect(), df.schema) for k, df in after.items()}
    assert tuple(applied.timesheet_import(kept, parsed)[1].first()) == (0, 7, 0, 0)


def a_loop(known, rows):
    """The rules row by row: people as [id, name, payroll id], new ones numbered in order."""
    people, met, how = [list(k) for k in known], {}, {}
    holders = [(k[2], k) for k in people if k[2]]  # in the order in which they came to hold their ids
    for name, pay in rows:
        if name in met:
            who = met[name]
        else:
            who = min((p for p in people if p[1] == name), default=None)
            found = "name"
            if who is None and pay:
                who, found = next((p for q, p in holders if q == pay), None), "payroll"
            if who is None:
                who, found = [len(people) + 1, name, None], "new"
                people.append(who)
            met[name], how[name] = who, found
        if pay and not who[2]:
            who[2] = pay
            holders.append((pay, who))
    return people, met, how


@pytest.mark.parametrize("seed", range(25))
def test_names_are_identified_as_row_by_row(spark, seed):
    rnd = random.Random(seed)
    names, pays = ["Bo", "bo", "Al", "Cy", "Di", "Ed", "Fay", "Gus"], ["1", "2", "3", "4"]
    known = [(i + 1, n, rnd.choice([None, *pays])) for i, n in enumerate(rnd.sample(names, rnd.randrange(4)))]
    rows = [(rnd.choice(names), rnd.choice([None, "", *pays])) for _ in range(rnd.randrange(1, 14))]
    df = spark.createDataFrame([(n, p, "f", i) for i, (n, p) in enumerate(rows)], "name string, payroll_id string, file string, line_no long").repartition(3)
    people, met, how = a_loop(known, rows)
    after, who = applied._people(spark.createDataFrame(known, "employee_id long, name string, payroll_id string"), df)
    got = {r.name: r for r in who.collect()}
    assert {n: r.found_by for n, r in got.items()} == how
    assert sorted((r.name, r.payroll_id) for r in after.collect()) == sorted((p[1], p[2]) for p in people) if all(p[2] for p in people) else sorted((r.name, r.payroll_id or "") for r in after.collect()) == sorted((p[1], p[2] or "") for p in people)
    same = lambda of: sorted(sorted(n for n in met if of(n) == x) for x in {of(n) for n in met})
    assert same(lambda n: got[n].employee_id) == same(lambda n: met[n][0])


def test_two_new_names_of_one_payroll_id_are_one_person_and_case_counts(spark, tmp_path):
    day = "March 9 2025"
    line = lambda name, pay, start: row(c0=name, c1=day, c2=start, c3=day, c4="11:00PM", c9=pay, c10="Cook")
    text = "\n".join([row(c0="Name"), line("Ann Lee", "500", "7:00AM"), line("Ann Lee-Roy", "500", "8:00AM"), line("Bo", "", "9:00AM"), line("bo", "", "10:00AM")]) + "\n"
    after, report = applied.timesheet_import(tables(spark), imports.timesheet(spark, put(tmp_path / "s.csv", text)))
    assert report.first().created == 4
    fresh = {r.name: r.payroll_id for r in after["employees"].collect() if r.employee_id > 2 or r.employee_id < 0}
    assert fresh == {"Ann Lee": "500", "Bo": None, "bo": None}
    by = {r.employee_id: r.n for r in after["sessions"].groupBy("employee_id").agg(F.count("*").alias("n")).collect()}
    assert sorted(by.values()) == [1, 1, 1, 2]


def test_team_files_each_by_their_own_header(spark, tmp_path):
    one = "Role Name,Location,Last Name,First Name\nCook,Pier,Marsh,Gil\n,Dock,,\n,Quay,,\n"
    two = "﻿First Name,Last Name,Payroll ID,Role Name,Location\n,,lost,,Nowhere\nKit,,,Barista,\n,,91,,Dock\nHana,Ode,80,,Pier\n"
    put(tmp_path / "1.csv", one)
    put(tmp_path / "2.csv", two)
    team = imports.team(spark, str(tmp_path))
    assert sorted(map(tuple, team.select("name", "location", "payroll_id", "role", "more_rows", "other_locations").collect()), key=str) == sorted([("Gil Marsh", "Pier", None, "Cook", 2, ["Dock", "Quay"]), ("Kit", None, "91", "Barista", 1, ["Dock"]), ("Hana Ode", "Pier", "80", None, 0, [])], key=str)
    after, report = applied.team_import(tables(spark), team, "2025-06-01")
    assert tuple(report.first()) == (1, 2, ["Barista"], 3, 0)
    assert {(r.name, r.location, r.payroll_id) for r in after["employees"].collect()} == {("Gil Marsh", "Pier", None), ("H. Ode", "Pier", "80"), ("Kit", None, "91")}
    assert {r.location for r in after["locations"].collect()} == {"Pier", "Dock", "Quay"}
    held = after["employee_levels"].join(after["levels"], "level_id").join(after["employees"], "employee_id")
    assert {(r.name, r.level_name, str(r.effective_from)) for r in held.collect()} == {("H. Ode", "Cook", "2024-01-01"), ("Gil Marsh", "Cook", "2000-01-01"), ("Kit", "Barista", "2000-01-01")}
    with pytest.raises(ValueError, match="Location"):
        imports.team(spark, put(tmp_path / "bad.csv", "First Name,Last Name,Role Name\nA,B,C\n"))


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"shifts": x}, lambda x: {"data": x}])
def test_roster_feed(spark, tmp_path, wrap):
    rows = [
        {"start_at": "2025-04-01T08:20:00+02:00", "end_at": "2025-04-01T12:05:00+02:00", "first_name": "Kit", "last_name": "", "role": "Barista"},
        {"starts_at": "2025-04-01T20:00:00Z", "ends_at": "2025-04-02T01:00:00Z", "name": "Over Midnight"},
        {"start_at": "", "start": "2025-04-01T13:00:00Z", "end": "2025-04-01T13:45:00Z", "role": "", "role_name": "Cook"},
    ]
    got = imports.roster_json(spark, put(tmp_path / "r.json", json.dumps(wrap(rows)))).collect()
    assert sorted(map(tuple, got)) == [("Kit", "Barista", 500, 725), ("Unknown", "Cook", 780, 825)]


PAGE = """<ul><li>Crew</li><li>Time</li></ul><table><tr><td>Crew</td></tr></table>
<table><thead><tr><th><i>Crew</i> name</th><th>Time
 spent</th></tr></thead><tbody>
<tr><td><b>kIT o'NEAL-fox</b><p>Barista</p></td><td>8:00 to 3<span>Total: 6 hrs 24 min</span></td><td>extra</td></tr>
<tr><td>Lou<br>Cook</td><td>TOTAL: 11 hr</td></tr><tr><td>Max</td><td>did not come</td></tr><tr><td></td><td> </td></tr><tr><td>Short</td></tr></tbody></table>"""


def test_tables_of_pages(spark):
    df = spark.createDataFrame([(1, PAGE)], "id long, html string")
    wanted = {"name": ["crew"], "worked": ["hours", "time"]}
    assert sorted((r.name, r.hours) for r in html_tables.hours_rows(df, "id", "html", wanted["name"], wanted["worked"]).collect()) == [("Kit O'Neal-Fox", 6.4), ("Lou", 11.0)]
    rows = html_tables.table_rows(df, "id", "html", {**wanted, "pay": ["wage"]}).collect()
    assert [(r.row_no, r.name, r.worked, r.pay) for r in rows] == [(0, "kit o'neal-fox", "8:00 to 3 total: 6 hrs 24 min", None), (1, "lou", "total: 11 hr", None), (2, "max", "did not come", None), (3, "short", "", None)]
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>"), (4, "<table><tr><th>x</th></tr></table>")], "id long, html string")
    got = html_tables.best_tables(pages, "id", "html", {**wanted, "pay": ["wage"]})
    assert sorted(map(tuple, got.collect())) == [(1, 2, 4, "pay"), (2, 0, 0, "name,worked,pay"), (3, 0, 0, "name,worked,pay"), (4, 1, 0, "name,worked,pay")]
    with pytest.raises(Exception, match="no table with a name"):
        html_tables.hours_rows(pages, "id", "html", ["crew"], ["time"]).collect()


def test_pickups_by_nearest_header_and_row(spark):
    days = ["Wed, 4", "thu 5", "FRIDAY 6"]
    texts = [("a", f"  {d} ", 70.0 * i + 5, 2.0) for i, d in enumerate(days)] + [("a", "Kit", 1.0, 30.0), ("a", " LOU ", 1.0, 61.0), ("a", "traded shift", 80.0, 58.0), ("a", "Traded SHIFT", 79.0, 60.0), ("a", "traded shift", 400.0, 31.0), ("b", "Wed, 4", 0.0, 0.0), ("b", "Kit", 0.0, 5.0), ("b", "traded shift", 0.0, 5.0)]
    names = spark.createDataFrame([("Kit",), ("Lou",), ("lou",)], "name string")
    got = html_tables.pickups(spark.createDataFrame(texts, "page string, text string, x double, y double"), names, ["traded shift"], "2025-06-04").collect()
    assert sorted((r.page, r.name.lower(), str(r.date)) for r in got) == [("a", "kit", "2025-06-06"), ("a", "lou", "2025-06-05")]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 1)], "k int, v string, n int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.patched(old, new, ["k"])) == [(1, "a", 5), (2, "b", 7)]
    assert rows(sinks.replaced(old, new, ["k"]).select("k", "n")) == [(1, 5), (2, 7), (3, 1)]
    assert rows(sinks.absent(new, old, ["k"], [F.col("n")]).select("k")) == [(3,)]
    assert rows(sinks.replaced_where(old, F.col("n").isNotNull(), new).select("k")) == [(1,), (2,), (3,)]
    assert rows(sinks.without_parents(new, old.select("k"), "k").select("k")) == [(3,)]
    assert sinks.with_columns(old, {"n": 0, "z": 9}).columns == ["k", "v", "n", "z"]
    levels = spark.createDataFrame([(1, "Cook", 70)], "level_id long, level_name string, rank int")
    names = spark.createDataFrame([("Cook",), ("Host",), ("Host",), ("",)], "level_name string")
    grown = sinks.with_new_names(levels, names, "level_name", "level_id", {"rank": F.lit(0)})
    assert rows(grown.select("level_name", "rank")) == [("Cook", 70), ("Host", 0)]


def test_a_table_is_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored.current(spark, path) is None
    for n in range(4):
        old = stored.current(spark, path)
        new = spark.createDataFrame([(n, n)], "k int, n int")
        stored.written(new if old is None else old.union(new), path)
    assert sorted(r.k for r in stored.current(spark, path).collect()) == [0, 1, 2, 3]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    with pytest.raises(Exception):  # noqa: B017
        stored.written(stored.current(spark, path).select(F.raise_error(F.lit("no")).cast("int").alias("k"), "n"), path)
    assert stored.current(spark, path).count() == 4


def test_text_helpers(spark):
    df = spark.createDataFrame([("7:45am", 465), ("12:00 AM", 0), ("12:59 pm", 779), ("21:07", 1267), ("soon", None)], "t string, m int")
    assert all(r.p == r.m for r in df.select(text.parsed_minute(F.col("t")).alias("p"), "m").collect())
    r = spark.range(1).select(text.minute_label(F.lit(779)).alias("a"), text.clock_text(F.lit(65)).alias("b"), text.minutes_text(F.lit(3605)).alias("c"), text.sunday_of(F.lit("2025-11-30").cast("date")).alias("s"), text.monday_of(F.lit("2025-11-30").cast("date")).alias("m")).first()
    assert (r.a, r.b, r.c, str(r.s), str(r.m)) == ("12:59pm", "01:05", "60:05", "2025-11-30", "2025-11-24")
