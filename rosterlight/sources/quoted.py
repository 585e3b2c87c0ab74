"""Records of CSV files whose quoted cells may hold line feeds, read in many tasks a file.

Where a split begins, nobody knows yet whether it begins inside a quoted cell.  But each line, and so each split, is a
function of that: it keeps the state, flips it, or leaves it open or closed whatever it was.  Such functions compose, so
the splits are scanned by themselves, a window over one row a split says how each begins, and lines then become records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# a cell that is closed, and one that stays open at the end of the line; a quote inside an unquoted cell is text
_INSIDE = '[^"]*+(?:""[^"]*+)*+'
_CLOSED = f'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
_OPEN = f'(?:{_CLOSED},)*+"{_INSIDE}\\z'


def _ends_open(line: Column, begins_open: bool) -> Column:
    """1 if a cell is open behind ``line``, given whether one is before it; else 0."""
    quotes = F.contains(line, F.lit('"'))
    if not begins_open:
        return (quotes & F.rlike(line, F.lit(f"^{_OPEN}"))).cast("int")
    return (~quotes | F.rlike(line, F.lit(f"^{_INSIDE}\\z")) | F.rlike(line, F.lit(f'^{_INSIDE}"[^,]*+,{_OPEN}'))).cast("int")


def _xor(a: Column, b: Column) -> Column:
    return (a + b) % 2


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of each split (file, block) by number, with what they do to the state: line_no, value, blank, and

    flips: how many lines up to this one flip the state; set: the state that the last line set which does not depend on the
    one before it, less the flips until then, null if none.  Behind the line the state is (set, or the split's own
    beginning) + flips, modulo 2.  flips_b and set_b are the same before the line; began_0 and began_1 are the line where its
    record began, if the split begins closed or open, null if in a split before.  All windows go by one order, so there is one sort.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.ltrim("value", F.lit("\ufeff")).alias("value"))
    raw = raw.withColumns({"blank": F.col("value") == "", "out": _ends_open(F.col("value"), False), "in": _ends_open(F.col("value"), True)})
    order = Window.partitionBy("file", "block").orderBy("id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    own = raw.withColumns({"line_no": F.row_number().over(order), "flips": F.sum((F.col("out") > F.col("in")).cast("int")).over(upto)})
    own = own.withColumn("set", last(F.when(F.col("out") == F.col("in"), _xor(F.col("out"), F.col("flips")))))
    own = own.withColumns({"flips_b": F.lag("flips", 1, 0).over(order), "set_b": F.lag("set").over(order)})
    began = {f"began_{s}": last(F.when(_xor(F.coalesce("set_b", F.lit(s)), F.col("flips_b")) == 0, F.col("line_no"))) for s in (0, 1)}
    return own.withColumns(began).drop("id", "out", "in")


def heads(numbered: DataFrame) -> DataFrame:
    """file, block, begins (0 or 1), from_block, from_line, head: how each split begins, where the record began that reaches into it, and the line of the file's first record."""
    starts = [F.max(f"began_{s}").alias(f"last_{s}") for s in (0, 1)]
    per = numbered.groupBy("file", "block").agg(F.max("flips").alias("flips"), F.max_by("set", "line_no").alias("set"), F.min(F.when(~F.col("blank"), F.col("line_no"))).alias("head"), *starts)
    order = Window.partitionBy("file").orderBy("block")
    upto, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("flips").over(upto))
    fixed = F.when(F.col("set").isNotNull(), _xor(F.col("set") + F.col("flips"), F.col("total")))
    per = per.withColumn("begins", _xor(F.coalesce(F.last(fixed, ignorenulls=True).over(ahead), F.lit(0)), F.coalesce(F.sum("flips").over(ahead), F.lit(0))))
    last = F.when(F.col("begins") == 0, F.col("last_0")).otherwise(F.col("last_1"))
    at = F.when(last.isNotNull(), F.struct(F.col("block").alias("b"), last.alias("l")))
    head = F.max(F.when(F.col("block") == 0, F.col("head"))).over(Window.partitionBy("file"))
    return per.withColumns({"at": F.last(at, ignorenulls=True).over(ahead), "head": head}).select("file", "block", "begins", F.col("at.b").alias("from_block"), F.col("at.l").alias("from_line"), "head")


def records(spark: SparkSession, path: str | list[str], header: bool = False) -> DataFrame:
    """file, block, line_no, record: each record with the place where it begins; blank lines between records are left out,
    and with ``header`` the first record of each file.

    Lines end in a line feed, or a carriage return and one, which inside a cell become a line feed; a cell still open at the
    end of a file makes the rest of it one record.  Records of one line move once, to the window of their split; the lines
    of longer ones once more.
    """
    df = lines(spark, path)
    df = df.join(heads(df).withColumnsRenamed({"file": "file_h", "block": "block_h"}), (F.col("file") == F.col("file_h")) & (F.col("block") == F.col("block_h")))
    state = lambda held, flips: _xor(F.coalesce(held, "begins"), F.col(flips))
    df = df.withColumns({"was": state("set_b", "flips_b"), "is": state("set", "flips")})
    df = df.withColumn("began", F.when(F.col("begins") == 0, F.col("began_0")).otherwise(F.col("began_1")))
    body = lambda block, line: ~((F.col(block) == 0) & (F.col(line) == F.col("head"))) if header else F.lit(True)
    whole = df.where("was = 0 AND `is` = 0 AND value <> ''").where(body("block", "line_no")).select("file", "block", "line_no", F.col("value").alias("record"))
    parts = df.where("was = 1 OR `is` = 1").withColumns({"of_line": F.coalesce("began", "from_line"), "of_block": F.when(F.col("began").isNotNull(), F.col("block")).otherwise(F.col("from_block"))})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line_no", "value"))), lambda x: x.value), "\n")
    parts = parts.where(body("of_block", "of_line"))
    long = parts.groupBy("file", "of_block", "of_line").agg(text.alias("record")).withColumnsRenamed({"of_block": "block", "of_line": "line_no"})
    return whole.unionByName(long)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What ``spark.read`` gives for CSV with a header, quotes doubled and ``multiLine`` on, in as many tasks as the files have splits.

    Columns are those of the first file, by place; the first record of each file is its header.  An empty file has no columns.
    """
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    if not (columns := whole.columns):
        return whole
    name = lambda c: "`" + c.replace("`", "``") + "`"
    cells = F.from_csv("record", ", ".join(f"{name(c)} string" for c in columns), {"escape": '"'})
    return records(spark, path, header=True).select(cells.alias("x")).select("x.*")
