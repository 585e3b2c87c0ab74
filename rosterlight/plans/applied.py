"""What the imports do to the tables: people, levels and sessions that they bring, and a report of what was new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import last_level_run
from ..sources import sinks

Tables = dict[str, DataFrame]


def _people(employees: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The employees after an import of rows (name, payroll_id, file, line_no), and each name with employee_id and found_by."""
    who = sinks.identified(incoming, employees, ["file", "line_no"])
    fill = who.where("found_by = 'name' AND fills IS NOT NULL").select("employee_id", "fills")
    old = employees.join(fill, "employee_id", "left").withColumn("payroll_id", F.coalesce("payroll_id", "fills")).drop("fills")
    born = who.where("found_by = 'new'").select("employee_id", "name", F.col("fills").alias("payroll_id"))
    return old.unionByName(born, allowMissingColumns=True), who.drop("fills")


def timesheet_import(tables: Tables, parsed: Tables) -> tuple[Tables, DataFrame]:
    """``tables`` (employees, levels, sessions, breaks, no_shows, employee_levels) after a parsed timesheet, and its report.

    New level names get rank 0 and count unless they are Training.  Sessions are absent or there by (employee, clock-in),
    no-shows by (employee, date, reason).  Everybody in the file whose last counting session has another level than the
    one they hold last gets that level, from the first day of its last unbroken run on.  The report is one row:
    created, skipped, no_shows, levels_updated.
    """
    out = dict(tables)
    out["employees"], known = _people(tables["employees"], parsed["people"])
    ids = known.select("name", "employee_id")
    counts = F.col("level_name") != "Training"
    names = parsed["sessions"].select(F.col("role").alias("level_name"))
    out["levels"] = sinks.with_new_names(tables["levels"], names, "level_name", "level_id", {"rank": F.lit(0), "counts_for_rating": counts})
    came = parsed["sessions"].join(ids, "name").join(out["levels"].select("level_id", F.col("level_name").alias("role")), "role").select("employee_id", "level_id", "clock_in", "clock_out")
    new = sinks.absent(came, tables["sessions"], ["employee_id", "clock_in"], [F.col("clock_out")])
    out["sessions"] = tables["sessions"].unionByName(new)
    pauses = parsed["breaks"].join(ids, "name").select("employee_id", "clock_in", "break_start", "break_end", "paid")
    out["breaks"] = tables["breaks"].unionByName(pauses.join(new.select("employee_id", "clock_in"), ["employee_id", "clock_in"], "left_semi"))
    gone = parsed["no_shows"].join(ids, "name").select("employee_id", "date", "reason")
    missed = sinks.absent(gone, tables["no_shows"], ["employee_id", "date", "reason"], [F.col("date")])
    out["no_shows"] = tables["no_shows"].unionByName(missed)
    worked = out["sessions"].join(ids.select("employee_id"), "employee_id", "left_semi").join(out["levels"].where("counts_for_rating").select("level_id"), "level_id", "left_semi")
    last = last_level_run(worked.select("employee_id", F.col("clock_in").alias("day"), "level_id"), "employee_id", "day", "level_id")
    held = tables["employee_levels"].groupBy("employee_id").agg(F.max_by("level_id", "effective_from").alias("held"))
    changed = last.join(held, "employee_id", "left").where(~F.col("level_id").eqNullSafe(F.col("held"))).select("employee_id", "level_id", F.to_date("since").alias("effective_from"))
    out["employee_levels"] = sinks.upserted(tables["employee_levels"].withColumn("n__", F.lit(0)), changed.withColumn("n__", F.lit(1)), ["employee_id", "effective_from"], [F.desc("n__")]).drop("n__")
    report = sinks.import_report(new, parsed["rows"], F.col("session_rows"), no_shows=missed, levels_updated=changed)
    return out, report


def team_import(tables: Tables, team: DataFrame, today: str, start: str = "2000-01-01") -> tuple[Tables, DataFrame]:
    """``tables`` (employees with location, levels, employee_levels, locations) after a team export, and its report.

    Locations of every row are registered, that of the named row is applied.  A role sets the level of who has none by
    ``today``, from ``start`` on; the level of others is kept and counted.  A name that its first row finds by payroll id
    stays that person's in the rest of the upload.  The report is one row: created, updated, new_levels (sorted),
    additional_locations_skipped, levels_kept_unchanged.
    """
    out = dict(tables)
    rows = team.where("name IS NOT NULL")
    below = rows.where("named_payroll_id IS NULL AND payroll_id IS NOT NULL").select("name", "payroll_id", "file", F.col("payroll_line").alias("line_no"))
    out["employees"], who = _people(tables["employees"], rows.select("name", F.col("named_payroll_id").alias("payroll_id"), "file", "line_no").union(below))
    known = rows.join(who, "name")
    here = known.where("location IS NOT NULL").groupBy("employee_id").agg(F.min("location").alias("l__"))
    out["employees"] = out["employees"].join(here, "employee_id", "left").withColumn("location", F.coalesce("l__", "location")).drop("l__")
    places = rows.select("location").union(rows.select(F.explode("other_locations")))
    out["locations"] = sinks.with_new_names(tables["locations"], places.where("location IS NOT NULL"), "location", "location_id", {})
    held = tables["employee_levels"].where(F.col("effective_from") <= F.lit(today).cast("date")).select("employee_id").distinct().withColumn("held", F.lit(True))
    roles = known.where("role IS NOT NULL").join(held, "employee_id", "left")
    given = roles.where("held IS NULL").groupBy("employee_id").agg(F.min("role").alias("level_name"))
    out["levels"] = sinks.with_new_names(tables["levels"], given, "level_name", "level_id", {"rank": F.lit(0), "counts_for_rating": F.lit(True)})
    rise = given.join(out["levels"].select("level_id", "level_name"), "level_name").select("employee_id", "level_id", F.lit(start).cast("date").alias("effective_from"))
    out["employee_levels"] = tables["employee_levels"].unionByName(rise)
    fresh = given.select("level_name").distinct().join(tables["levels"].select("level_name"), "level_name", "left_anti").agg(F.sort_array(F.collect_set("level_name")).alias("new_levels"))
    born = who.agg(F.count_if(F.col("found_by") == "new").alias("created"))
    people = rows.agg(F.count(F.lit(1)).alias("n__")).crossJoin(born).select("created", (F.col("n__") - F.col("created")).alias("updated"))  # one row each
    more = rows.agg(F.coalesce(F.sum("more_rows"), F.lit(0)).cast("long").alias("additional_locations_skipped"))
    kept = roles.agg(F.count_if(F.col("held").isNotNull()).alias("levels_kept_unchanged"))
    return out, people.crossJoin(fresh).crossJoin(more).crossJoin(kept)  # one row each
