"""Temporal joins and runs: as-of, interval, merged windows, islands, carry-forward, rolling counts.

Spark has no interval join.  Intervals are bucketed by the hour here (and by keys such as a store), so the join is an
equi-join on the hour with the range as a residual; an interval is exploded over the hours that it touches, never over
other rows, and no bucket grows with the number of days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a configuration table may be broadcast; it is counted, not assumed.
SMALL_ROWS = 10_000

#: Rows of a range that a prefix scan carries in one task, and the most ranges that it makes.
RANGE_ROWS, MOST_RANGES = 1_000_000, 65_536


_COUNTED: dict[tuple[str, int, int], bool] = {}


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has at most ``SMALL_ROWS`` rows; one look at a table in a session serves every plan made from the same files."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), hash(frozenset(df.inputFiles())))
    if key not in _COUNTED:
        _COUNTED[key] = df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return _COUNTED[key]


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``SMALL_ROWS`` rows."""
    return F.broadcast(df) if is_small(df) else df


def with_until(df: DataFrame, start: str, keys: list[str], until: str = "until") -> DataFrame:
    """Effective-dated rows with the start of the next row of the same key; null for the last."""
    return df.withColumn(until, F.lead(start).over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(start)))


def asof_join(left: DataFrame, right: DataFrame, at: Column, start: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row of its key whose ``start`` is at or before ``at``; nulls if none.

    ``at`` names columns of ``left`` by the alias l.  With keys it is an equi-join.  Without, ``right`` is mostly a
    configuration table, broadcast if it is small; a larger one is carried along the distinct values of ``at`` and joined
    by value, so no plan holds a nested loop over a large side.
    """
    if not keys and not is_small(right):
        return asof_by_value(left, right, at, start)
    spans = with_until(right, start, list(keys), "until__")
    spans = spans if keys else F.broadcast(spans)
    hit = (F.col(f"r.{start}") <= at) & (F.col("r.until__").isNull() | (at < F.col("r.until__")))
    for k in keys:
        hit = hit & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    added = [F.col(f"r.{c}") for c in right.columns if c not in keys and c not in left.columns]
    return left.alias("l").join(spans.alias("r"), hit, "left").select("l.*", *added)


def _number(c: Column, kind: str) -> Column:
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("long")


def asof_by_value(left: DataFrame, right: DataFrame, at: Column, start: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``asof_join`` without keys for a large ``right``: its rows are carried along the distinct values of ``at`` by a
    prefix scan (``carried_by_range``), and the values then meet ``left`` in an equi-join.  Of rows with equal ``start`` one stays."""
    kind = dict(right.dtypes)[start]
    added = [c for c in right.columns if c not in left.columns]
    rows = left.alias("l").withColumn("at__", _number(at, kind))
    steps = right.select(_number(F.col(start), kind).alias("at__"), F.struct(*added).alias("v__")).where("at__ IS NOT NULL")
    values = steps.union(rows.select("at__", F.lit(None).cast(steps.schema["v__"].dataType)).where("at__ IS NOT NULL").distinct())
    values = values.groupBy("at__").agg(F.max("v__").alias("v__"))
    held = carried_by_range(values, F.col("v__"), "at__", None, "got__", range_rows).select("at__", "got__")
    return rows.join(held, "at__", "left").select(*left.columns, *[F.col(f"got__.{c}").alias(c) for c in added])


def hour_number(c: Column) -> Column:
    """Hours since 1970 of the wall clock."""
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) * 24 + F.hour(c)


def point_in_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points and intervals with start <= at < end (and equal ``keys``), each pair once; other column names must differ."""
    p = points.withColumn("hour__", hour_number(F.col(at)))
    i = intervals.where(F.col(start) < F.col(end)).withColumn("hour__", F.explode(F.sequence(hour_number(F.col(start)), hour_number(F.col(end)))))
    return p.join(i, [*keys, "hour__"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("hour__")


def merged_windows(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Windows of one key that overlap or touch, as one: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("new__", F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0))
    runs = opened.withColumn("run__", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run__").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("run__")


def day_runs(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive distinct days of each key: keys, run_start, run_end, run_days."""
    days = df.select(*keys, day).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    runs = days.withColumn("island__", F.date_sub(day, rank)).groupBy(*keys, "island__")
    return runs.agg(F.min(day).alias("run_start"), F.max(day).alias("run_end"), F.count(F.lit(1)).cast("int").alias("run_days")).drop("island__")


def carried(value: Column, order: str, keys: list[str]) -> Column:
    """The last non-null ``value`` at or before a row, in ``order``."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def range_bounds(df: DataFrame, order: str, range_rows: int = RANGE_ROWS) -> list[float]:
    """Ascending values of the number column ``order`` that cut ``df`` into ranges of about ``range_rows`` rows.

    Runs a job: rows are counted, and where one range is not enough, quantiles are taken from a sketch.  Any bounds give
    right results; these give even tasks wherever the values lie.  Rows of one value stay together.
    """
    n = df.where(F.col(order).isNotNull()).count()
    parts = min(MOST_RANGES, math.ceil(n / range_rows))
    if parts <= 1:
        return []
    shares = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    return sorted(set(df.agg(F.percentile_approx(order, shares, 10 * parts)).first()[0]))


def range_number(c: Column, bounds: list[float], kind: str) -> Column:
    """How many of the ascending ``bounds`` are at or below ``c``, by binary search in one constant array; 0 for a null."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(repr, bounds))), ",").cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(bounds)) & (F.get(held, n + step - 1) <= c), n + step).otherwise(n))


def carried_by_range(df: DataFrame, value: Column, order: str, key: str | None, name: str, range_rows: int = RANGE_ROWS, descending: bool = False, bounds: list[float] | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` of its key at or before a row, in the number column ``order``.

    A prefix scan in two levels.  ``order`` is cut into ranges of about equal numbers of rows (``range_bounds``, unless
    they are given), so a key that holds most rows, and values that lie anywhere, fill many tasks alike.  Inside a range
    the value is carried by a window; of each range only the last value goes on, and a window over one row a range and
    key fills the heads of the ranges behind it.  Without ``key`` the table is one run.  ``descending`` carries the other
    way.  Rows without an order are a range of their own, before the others.
    """
    bounds = range_bounds(df, order, range_rows) if bounds is None else bounds
    direction = F.desc_nulls_last if descending else F.asc_nulls_first
    number = F.when(F.col(order).isNotNull(), range_number(F.col(order), bounds, dict(df.dtypes)[order])).otherwise(-1)
    rows = df.withColumns({"value__": value, "range__": number})
    keys = [key] if key else []
    own = rows.withColumn("own__", F.last("value__", ignorenulls=True).over(Window.partitionBy(*keys, "range__").orderBy(direction(order))))
    pick = F.min_by if descending else F.max_by
    at = F.when(F.col("value__").isNotNull(), F.coalesce(order, F.lit(0).cast(dict(df.dtypes)[order])))
    ends = rows.groupBy(*keys, "range__").agg(pick("value__", at).alias("end__"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy(direction("range__")).rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*[F.col(k).alias("key__") for k in keys], F.col("range__").alias("of__"), F.last("end__", ignorenulls=True).over(before).alias("head__"))
    got = own.join(heads, [own["range__"] == heads["of__"], *[own[k].eqNullSafe(heads["key__"]) for k in keys]], "left")
    return got.withColumn(name, F.coalesce("own__", "head__")).select(*df.columns, name)


def last_level_run(df: DataFrame, key: str, day: str, level: str) -> DataFrame:
    """Per key the last level and the first day of its last unbroken run: key, level, since."""
    down = Window.partitionBy(key).orderBy(F.desc(day))
    last = F.first(level).over(down)
    broken = F.sum(F.when(F.col(level) != last, 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("b__", broken).where("b__ = 0").groupBy(key).agg(F.max_by(level, day).alias(level), F.min(day).alias("since"))


def rolling_days(df: DataFrame, key: str, day: str, span: int) -> DataFrame:
    """For each worked day how many days of the ``span`` that end there were worked: key, day, worked."""
    days = df.select(key, day).distinct().withColumn("n__", F.datediff(day, F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(key).orderBy("n__").rangeBetween(-(span - 1), 0)
    return days.select(key, day, F.count(F.lit(1)).over(w).cast("int").alias("worked"))
