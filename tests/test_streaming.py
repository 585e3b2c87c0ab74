import datetime as dt

from pyspark.sql import functions as F

from rosterlight.sources import tables
from rosterlight.sources.testviews import Views
from rosterlight.streaming import adherence

DIR = "/root/testdata/sf0.001"


def drained(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_closed_hours_equal_the_batch(spark, tmp_path):
    v = Views(spark, DIR)
    t = v.tickets.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("row_hash", F.col("ticket_id").cast("string"))
    t.repartitionByRange(6, "created_at").sortWithinPartitions("created_at").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "t"))
    got = {r.hour_start: (r.tickets, r.on_time) for r in drained(spark, adherence.hourly_adherence(stream, v.sla), "hours").collect()}
    day = F.to_date("created_at")
    target = F.when(day < "2024-01-10", 300).when(day < "2024-01-20", 240).otherwise(420)
    want = {r.h: (r.n, r.ok) for r in t.where("NOT recalled").groupBy(F.date_trunc("hour", "created_at").alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("completion_seconds") <= target).alias("ok")).collect()}
    assert got and all(want[h] == x for h, x in got.items())
    assert len(got) >= len(want) - 4


def test_targets_that_change_each_day_of_many_years(spark):
    """More entries than are ever broadcast: each day's own target counts, the last one from then on, and 300 before the first."""
    v = Views(spark, DIR)
    t = v.tickets.withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, event_type string, value double, props string").parquet(DIR, pathGlobFilter="events.parquet")
    stream = stream.select(F.col("ts").alias("created_at"), F.floor(F.col("value") * 6).cast("int").alias("completion_seconds"), (F.col("event_type") == "error").alias("recalled"))
    first, last = F.lit("2024-01-04").cast("date"), F.lit("2024-01-24").cast("date")
    day = F.date_add(first, F.col("id").cast("int"))
    past = spark.range(12_000).select((100 + F.col("id") % 7 * 60).cast("int").alias("target_seconds"), F.date_sub(last, F.col("id").cast("int")).alias("effective_from"))
    for sla, start in ((past, None), (past.where(F.col("effective_from") >= first), first)):
        got = {r.hour_start: (r.tickets, r.on_time) for r in drained(spark, adherence.hourly_adherence(stream, sla), f"daily{start is None}").collect()}
        at = F.to_date("created_at")
        target = F.when(at < first, 300) if start is not None else F.when(F.lit(False), 0)
        target = target.otherwise(100 + F.greatest(F.datediff(last, at), F.lit(0)) % 7 * 60)
        want = {r.h: (r.n, r.ok) for r in t.where("NOT recalled").groupBy(F.date_trunc("hour", "created_at").alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("completion_seconds") <= target).alias("ok")).collect()}
        assert got and all(want[h] == x for h, x in got.items())


def test_repeated_files_add_nothing(spark, tmp_path):
    t = Views(spark, DIR).tickets.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("row_hash", F.col("ticket_id").cast("string")).where("ticket_id < 50")
    for _ in range(2):
        t.write.mode("append").parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "d"))
    assert drained(spark, adherence.once_each(stream), "once").count() == t.count()


def test_batches_are_upserted_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = [("a", 1, 10), ("b", 1, 20), ("a", 2, 30), ("c", 1, 40), ("a", 3, 5)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "key string, version int, value int").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, version int, value int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second run reads everything again
        q = adherence.upserted_batches(stream, str(tmp_path / "table"), ["key"], [F.desc("version")], str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r.key: (r.version, r.value) for r in tables.current(spark, str(tmp_path / "table")).collect()}
        assert got == {"a": (3, 5), "b": (1, 20), "c": (1, 40)}
    status = adherence.status_row([p if isinstance(p, dict) else {"numInputRows": p.numInputRows, "batchId": p.batchId} for p in q.recentProgress], "2025-05-05")
    assert status["ok"] and status["rows"] >= 5 and status["error"] == ""
    assert adherence.status_row([], "2025-05-05", "lost") == {"attempted_at": "2025-05-05", "ok": False, "error": "lost", "rows": 0, "last_batch": -1}


def test_a_file_that_comes_again_after_a_week_adds_nothing(spark, tmp_path):
    """Beyond any watermark, in the same stream and in a new one."""
    rows = "row_hash string, created_at timestamp, n int"
    put = lambda *r: spark.createDataFrame(list(r), rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    day = lambda d: dt.datetime(2024, 1, d)

    def run(checkpoint):
        stream = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        adherence.ingested_once(stream, str(tmp_path / "table"), ["row_hash"], [F.col("n")], str(tmp_path / checkpoint), 4).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.row_hash, r.n) for r in tables.current(spark, str(tmp_path / "table")).collect())

    put(("a", day(1), 1), ("b", day(1), 2), ("b", day(1), 3))
    assert run("c1") == [("a", 1), ("b", 2)]
    put(("c", day(9), 4))
    put(("a", day(1), 5), ("b", day(1), 6))  # a week late
    assert run("c1") == [("a", 1), ("b", 2), ("c", 4)]
    assert run("c2") == [("a", 1), ("b", 2), ("c", 4)]
