"""Messy exports into typed tables: ticket, timesheet and team CSV, roster JSON.

A malformed value fails the whole import, as a half import would be counted as done.  Files whose rows depend on their
order are read whole by one task each (a file is one upload) and carry their line numbers from there on.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, row_hash
from .quoted import read_csv

# The columns of the exports.
TICKET_COLUMNS = ("Completion Time (seconds)", "Time Created")
TEAM_COLUMNS = ("First Name", "Last Name", "Location", "Role Name")
SKIPPED_PREFIXES = ("Totals", "Name", "Payroll Period", "-")


def _required(df: DataFrame, columns: tuple[str, ...]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))


def tickets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The ticket export as typed rows, one per distinct content; rows without a creation time or duration are left out.

    Cells may hold line feeds, and large files are read in splits all the same; without ``multi_line`` a line is a record,
    and the lines need not be put together.
    """
    raw = read_csv(spark, path) if multi_line else spark.read.options(header=True, escape='"').csv(path)
    _required(raw, TICKET_COLUMNS)
    get = lambda c: blank_to_null(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")
    when = lambda c: F.to_timestamp_ntz(get(c), F.lit("M/d/yyyy H:mm"))
    rows = raw.withColumn("row_hash", row_hash_of(raw.columns)).where(get("Time Created").isNotNull() & get("Completion Time (seconds)").isNotNull())
    typed = rows.select(
        F.coalesce(get("Device Name"), F.lit("")).alias("station"), F.coalesce(get("Order Source"), F.lit("")).alias("source"), F.coalesce(get("Number of Items").cast("int"), F.lit(0)).alias("items"),
        when("Time Created").alias("created_at"), when("Time Completed").alias("completed_at"), get("Completion Time (seconds)").cast("int").alias("completion_seconds"),
        get("Time Recalled").isNotNull().alias("recalled"), "row_hash",
    )
    return typed.dropDuplicates(["row_hash"])


def row_hash_of(columns: list[str]) -> Column:
    return row_hash([f"`{c}`" for c in columns])


def numbered_rows(spark: SparkSession, path: str | list[str], header: bool) -> DataFrame:
    """file, line_no, cells: CSV records in file order.  With a header cells is a map by the column names of the record's own file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = pa.map_(pa.string(), pa.string()) if header else pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))
                if header:
                    names = [c.strip() for c in rows[0]] if rows else []
                    rows = [list(dict(zip(names, r, strict=False)).items()) for r in rows]
                for i in range(0, len(rows), 10_000):
                    some = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(i, i + len(some)), pa.int64()), pa.array(some, kind)], ["file", "line_no", "cells"])

    return files.mapInArrow(run, f"file string, line_no long, cells {'map<string,string>' if header else 'array<string>'}")


def timesheet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """sessions, breaks, no_shows, people and rows of a block-structured timesheet export (22 columns by place).

    people are the names with a role, each with each of its payroll ids and the place where they first stand together; rows counts the session rows, repeated ones too.  A file without a header row is an
    error.  A named row with both times opens a session and owns the break rows below it; a no-show or repeated session owns
    none.  Rows of totals and titles do not end a block.  Break times are stamped with the clock-in day.
    """
    cell = lambda k: F.coalesce(F.trim(F.get("cells", F.lit(k))), F.lit(""))
    every = numbered_rows(spark, path, False).withColumn("name", cell(0))
    if bad := every.groupBy("file").agg(F.max((F.col("name") == "Name").cast("int")).alias("ok")).where("ok = 0").take(1):
        raise ValueError(f"not a timesheet export, no header row: {bad[0].file}")
    rows = every.where(F.size("cells") > 19)
    for p in SKIPPED_PREFIXES:
        rows = rows.where(~F.col("name").startswith(p))
    stamp = lambda day, time: F.to_timestamp_ntz(F.nullif(F.concat_ws(" ", day, F.upper(time)), F.lit(" ")), F.lit("MMMM d yyyy h:mma"))
    both = (cell(2) != "") & (cell(4) != "")
    rows = rows.where((F.col("name") == "") | (cell(10) != "") | (cell(19) != ""))
    named = F.col("name") != ""
    rows = rows.select(
        "file", "line_no", "name", cell(9).alias("payroll_id"), cell(10).alias("role"), cell(19).alias("reason"), cell(8).alias("break_type"), cell(5).alias("b1"), cell(6).alias("b2"), cell(1).alias("day"),
        F.when(named & both, stamp(cell(1), cell(2))).alias("clock_in"), F.when(named & both, stamp(cell(3), cell(4))).alias("clock_out"), F.when(named, F.col("line_no")).alias("opens"),
    )
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("owner", F.last("opens", ignorenulls=True).over(order))
    shifts = rows.where("clock_in IS NOT NULL")
    sessions = shifts.withColumn("n", F.row_number().over(Window.partitionBy("name", "clock_in").orderBy("file", "line_no"))).where("n = 1")
    sessions = sessions.select("file", F.col("opens").alias("session_line"), "name", "payroll_id", "role", "day", "clock_in", "clock_out")
    parts = rows.where("b1 <> '' AND b2 <> ''").select("file", F.col("owner").alias("session_line"), "b1", "b2", "break_type")
    breaks = parts.join(sessions.select("file", "session_line", "name", "clock_in", "day"), ["file", "session_line"])
    breaks = breaks.select("name", "clock_in", stamp(F.col("day"), F.col("b1")).alias("break_start"), stamp(F.col("day"), F.col("b2")).alias("break_end"), (~F.col("break_type").contains("Unpaid")).alias("paid"))
    gone = rows.where("name <> '' AND clock_in IS NULL AND reason <> ''").select("name", F.to_date("day", "MMMM d yyyy").alias("date"), "reason").distinct()
    people = rows.where("name <> '' AND role <> ''").groupBy("name", F.nullif("payroll_id", F.lit("")).alias("payroll_id")).agg(F.min(F.struct("file", "line_no")).alias("at")).select("name", "payroll_id", "at.*")
    counted = shifts.agg(F.count(F.lit(1)).alias("session_rows"))
    return {"sessions": sessions.drop("session_line", "day", "file"), "breaks": breaks, "no_shows": gone, "people": people, "rows": counted}


def team(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, location, payroll_id, role of each named row of a team export; unnamed rows below it fill its payroll id.

    named_payroll_id is that of the named row itself, file and line_no are its place, payroll_line that of payroll_id.
    Columns are looked up by the header of each file.  Location and role are those of the named row; ``more_rows`` counts
    the rows below it, whose locations are listed in ``other_locations`` but not applied.
    """
    rows = numbered_rows(spark, path, True)
    lacking = F.array_except(F.array(*map(F.lit, TEAM_COLUMNS)), F.map_keys("cells"))
    if bad := rows.where("line_no = 0").select("file", lacking.alias("m")).where(F.size("m") > 0).take(1):
        raise ValueError(f"missing columns in {bad[0].file}: " + ", ".join(bad[0].m))
    cell = lambda c: F.coalesce(F.trim(F.try_element_at("cells", F.lit(c))), F.lit(""))
    body = rows.where("line_no > 0").select("file", "line_no", (cell("First Name") != "").alias("named"), F.trim(F.concat_ws(" ", cell("First Name"), cell("Last Name"))).alias("name"), cell("Location").alias("location"), cell("Payroll ID").alias("payroll_id"), cell("Role Name").alias("role"))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owned = body.withColumn("owner", F.last(F.when(F.col("named"), F.col("line_no")), ignorenulls=True).over(order)).where("owner IS NOT NULL")
    head = lambda c: F.max(F.when(F.col("line_no") == F.col("owner"), F.nullif(F.col(c), F.lit("")))).alias(c)
    pay = F.min(F.when(F.col("payroll_id") != "", F.struct("line_no", "payroll_id")))["payroll_id"]
    more = F.collect_set(F.when(F.col("line_no") > F.col("owner"), F.nullif(F.col("location"), F.lit(""))))
    line = F.min(F.when(F.col("payroll_id") != "", F.col("line_no"))).alias("payroll_line")
    named = F.max(F.when(F.col("line_no") == F.col("owner"), F.nullif("payroll_id", F.lit("")))).alias("named_payroll_id")
    return owned.groupBy("file", F.col("owner").alias("line_no")).agg(head("name"), head("location"), pay.alias("payroll_id"), head("role"), F.count_if(F.col("line_no") > F.col("owner")).cast("int").alias("more_rows"), F.sort_array(more).alias("other_locations"), named, line)


def roster_json(spark: SparkSession, path: str) -> DataFrame:
    """name, role, start_min, end_min of a day's landed roster feed: a list, or an object with shifts or data.

    Of several spellings the first that is filled counts; an offset is read off, not applied; shifts that do not end
    after they start are left out.
    """
    shift = "struct<start_at:string,start:string,starts_at:string,end_at:string,end:string,ends_at:string,name:string,employee_name:string,first_name:string,last_name:string,role:string,role_name:string>"
    whole = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<{shift}>")
    held = F.from_json("v", f"struct<shifts:array<{shift}>,data:array<{shift}>>")
    s = whole.select(F.explode(F.when(F.col("v").startswith("["), listed).otherwise(F.coalesce(held["shifts"], held["data"]))).alias("s"))
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(f"s.{n}"), F.lit("")) for n in names])
    minute = lambda c: F.regexp_extract(c, r"[T ](\d{2}):(\d{2})", 1).try_cast("int") * 60 + F.regexp_extract(c, r"[T ](\d{2}):(\d{2})", 2).try_cast("int")
    name = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "s.first_name", "s.last_name")), F.lit("")), pick("employee_name", "name"), F.lit("Unknown"))
    out = s.select(name.alias("name"), F.coalesce(pick("role", "role_name"), F.lit("")).alias("role"), minute(pick("start_at", "starts_at", "start")).alias("start_min"), minute(pick("end_at", "ends_at", "end")).alias("end_min"))
    return out.where("end_min > start_min")
