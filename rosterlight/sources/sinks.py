"""Write semantics as DataFrame transformations: what a table holds after an insert, upsert, replacement or patch.

Parquet has no MERGE, so a write reads the old table, merges and commits a new version (``tables``); never the files it
reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.temporal import small

def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("n__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n__ = 1").drop("n__")


def absent(new: DataFrame, old: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` does not hold, one per key: what an insert-if-absent adds."""
    return first_by(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old and new rows, one per key, the first in ``order`` (latest first)."""
    return first_by(old.unionByName(new), keys, order)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def replaced_where(old: DataFrame, stays: Column, new: DataFrame) -> DataFrame:
    """``old`` where ``stays`` holds, and ``new``: manual picks stay, solver picks go."""
    return old.where(stays).unionByName(new)


def patched(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the non-null fields of ``patch``; a null patch changes nothing."""
    fields = [c for c in patch.columns if c not in keys]
    joined = old.alias("o").join(patch.alias("p"), keys, "left")
    return joined.select(*[F.coalesce(F.col(f"p.{c}"), F.col(f"o.{c}")).alias(c) if c in fields else F.col(c if c in keys else f"o.{c}") for c in old.columns])


def without_parents(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children less those of deleted parents."""
    return children.join(gone.select(key).distinct(), key, "left_anti")


def with_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Additive migration: missing columns with their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def copied_week(week: DataFrame, there: DataFrame, days: int) -> DataFrame:
    """Shifts moved by ``days``, except onto dates that have shifts."""
    return week.withColumn("date", F.date_add("date", days)).join(there.select("date").distinct(), "date", "left_anti").select(*week.columns)


def expanded_templates(templates: DataFrame, blocks: DataFrame, weeks: DataFrame, shifts: DataFrame) -> DataFrame:
    """Template shifts of the weeks (Mondays) that have no shift yet.  The product of weeks and templates is the result."""
    taken = shifts.select(F.date_trunc("week", "date").cast("date").alias("week")).distinct()
    empty = weeks.join(taken, "week", "left_anti")
    return templates.join(blocks, "block").crossJoin(small(empty)).withColumn("date", F.date_add("week", F.col("weekday")))


def matched_by_name(rows: DataFrame, people: DataFrame, said: str, name: str) -> DataFrame:
    """``rows`` with the employee_id of the name, without regard to case; null if none; of equal names the last id."""
    own = people.groupBy(F.lower(F.trim(name)).alias("key__")).agg(F.max("employee_id").alias("employee_id"))
    return rows.withColumn("key__", F.lower(F.trim(said))).join(own, "key__", "left").drop("key__")


def resolved(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(name, payroll_id) -> employee_id and found_by: by name, else by payroll id, else new (null id)."""
    a = known.groupBy("name").agg(F.min("employee_id").alias("by_name"))
    b = known.where("payroll_id IS NOT NULL").groupBy("payroll_id").agg(F.min("employee_id").alias("by_pay"))
    out = incoming.join(a, "name", "left").join(b, "payroll_id", "left")
    by = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_pay").isNotNull(), "payroll").otherwise("new")
    return out.select("name", "payroll_id", F.coalesce("by_name", "by_pay").alias("employee_id"), by.alias("found_by"))


def identified(incoming: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Who the names of an upload are, its rows being read in ``order``: name, employee_id, found_by, fills.

    ``incoming`` has name and payroll_id, ``known`` the employees.  A name's first row decides for all its rows: it is the
    person of that name, as written (of several the lowest id); else whoever holds the row's payroll id by then; else
    somebody new.  A row's payroll id goes to its person if they hold none, so a person that a row above has created, or
    given an id to, is found by the rows below.  ``fills`` is the payroll id that the person named so gets from the upload.

    No row waits for another: only somebody found by name or created can come to hold an id, at the first row of the name
    that has one, and of the names that first come with a certain id only the earliest can be new.  So the first holder
    of each id is a minimum over known people and names, and the other names join it.
    """
    at, pay = F.struct(*order), F.nullif(F.trim("payroll_id"), F.lit(""))
    rows = incoming.select("name", pay.alias("pay"), at.alias("t"))
    some = F.when(F.col("pay").isNotNull(), F.col("t"))
    names = rows.groupBy("name").agg(F.min("t").alias("t0"), F.min_by("pay", "t").alias("p0"), F.min(some).alias("t1"), F.min_by("pay", some).alias("p1"))
    own = known.groupBy("name").agg(F.min(F.struct("employee_id", "payroll_id")).alias("k"))
    names = names.join(own.select("name", F.col("k.employee_id").cast("long").alias("by_name"), F.col("k.payroll_id").alias("had")), "name", "left").withColumn("new_id", surrogate(F.col("name")))
    fills = F.when((F.col("by_name").isNotNull() & F.col("had").isNull()) | (F.col("by_name").isNull() & F.col("p0").isNull()), F.col("p1"))
    names = names.withColumn("fills", fills)
    never = F.lit(None).cast(names.schema["t0"].dataType)
    held = known.where("payroll_id IS NOT NULL").select(F.col("payroll_id").alias("p0"), F.struct(F.lit(0).alias("late"), never.alias("t"), F.col("employee_id").cast("long").alias("id")).alias("h"))
    later = lambda p, t, who: F.struct(F.lit(1).alias("late"), F.col(t).alias("t"), who.alias("id")).alias("h")
    given = names.where("fills IS NOT NULL").select(F.col("fills").alias("p0"), later("fills", "t1", F.coalesce("by_name", "new_id")))
    first = names.where("by_name IS NULL AND p0 IS NOT NULL").select("p0", later("p0", "t0", F.col("new_id")))
    holder = held.union(given).union(first).groupBy("p0").agg(F.min("h")["id"].alias("holder"))
    out = names.join(holder, "p0", "left")
    by_pay = F.when(F.col("p0").isNotNull(), F.col("holder"))
    who = F.coalesce("by_name", by_pay, "new_id")
    how = F.when(F.col("by_name").isNotNull(), "name").when(who != F.col("new_id"), "payroll").otherwise("new")
    return out.select("name", who.alias("employee_id"), how.alias("found_by"), F.when(how == "new", F.col("p1")).when(how == "name", F.col("fills")).alias("fills"))


def surrogate(name: Column) -> Column:
    """A stable id of a natural key, as it is written: the same in every run and task."""
    return F.xxhash64(F.trim(name))


def with_new_names(dimension: DataFrame, names: DataFrame, key: str, id_col: str, defaults: dict[str, Column]) -> DataFrame:
    """``dimension`` and a row for each name of ``names`` that it lacks."""
    new = names.where(F.trim(key) != "").select(key).distinct().join(dimension.select(key), key, "left_anti")
    return dimension.unionByName(new.select(surrogate(F.col(key)).alias(id_col), key, *[v.alias(c) for c, v in defaults.items()]))


def import_report(created: DataFrame, seen: DataFrame, n: Column, **others: DataFrame) -> DataFrame:
    """One row: created rows, skipped (what else of the ``n`` of ``seen``'s one row), and the rows of ``others``."""
    out = created.agg(F.count(F.lit(1)).alias("created")).crossJoin(seen.select(n.alias("n__"))).withColumn("skipped", F.col("n__") - F.col("created")).drop("n__")
    for name, df in others.items():
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row
    return out
