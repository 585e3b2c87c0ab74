import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlight.llm import warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_every_split_gives_every_record_once(tmp_path):
    members = [warc.record_bytes(i, f"http://x/{i}", (f"<p>{i}</p>" * (i * 7 + 1)).encode(), "d", "response", None) for i in range(30)]
    junk = b"\x1f\x8b\x08 not a member \x1f\x8b\x08\x00"
    data = members[0] + junk + b"".join(members[1:])
    for split in (1, 7, 100, 1000, len(data)):
        got = [(at, r["record_id"]) for s in range(0, len(data), split) for at, r in warc.records_in_range(pa.BufferReader(data), s, min(s + split, len(data)), 64)]
        assert [x for _, x in got] == [str(i) for i in range(30)], split
        assert len({at for at, _ in got}) == 30


def test_members_that_are_cut_off_or_no_records_are_passed_over():
    import gzip

    whole = warc.record_bytes(1, None, b"x" * 200, "d", "response", None)
    other = gzip.compress(b"hello, this is no record\r\n\r\n")
    data = other + whole + whole[:-20]
    assert [r["record_id"] for _, r in warc.records_in_range(pa.BufferReader(data), 0, len(data))] == ["1"]


def test_revisits_nulls_ties_and_extra_columns(spark):
    long = "a" * 100
    data = [(3, "u3", long), (1, "u1", long), (2, None, long), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (None, "n", long), (8, "é", "é" * 60), (9, "b", "\U0001f642" * 3000)]
    df = rows(spark, data).withColumn("digest", F.lit(1)).withColumn("payload", F.lit("x"))
    got = {r.page_id: r for r in warc.page_report(df).collect()}
    assert len(got) == len(data)
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1),
        4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None),
    }
    for k, _, html in data:
        raw = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_archives_keep_payloads_and_urls(spark):
    df = rows(spark, [(1, "http://a/\r\nX: y", "<b>one</b>"), (2, None, "two\r\n\r\nthree")])
    got = {r.record_id: (r.url, r.payload) for r in warc.archived(df)[1].collect()}
    assert got == {"1": ("http://a/ X: y", b"<b>one</b>"), "2": (None, b"two\r\n\r\nthree")}


def test_empty_table(spark):
    assert warc.page_report(rows(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_gzip_reads_the_archive_as_one_stream(n):
    import gzip

    data = b"".join(warc.record_bytes(i, "u", b"z" * 50, "d", "response", None) for i in range(n))
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1") == n


def test_a_url_of_megabytes_is_read():
    url = "data:," + "".join(hashlib.sha256(b"%d" % i).hexdigest() for i in range(40_000))
    data = warc.record_bytes(1, url, b"x", "d", "response", None) + warc.record_bytes(2, None, b"y", "d", "response", None)
    assert [(r["record_id"], r["url"]) for _, r in warc.records_in_range(pa.BufferReader(data), 0, len(data))] == [("1", url), ("2", None)]


class Counting(io.BytesIO):
    """Counts the bytes that are read."""

    got = 0

    def read(self, n=-1):
        x = super().read(n)
        self.got += len(x)
        return x


def test_a_member_of_many_blocks_is_read_once_and_split_points_inside_it_own_nothing():
    import random

    rnd = random.Random(1)
    payload = rnd.randbytes(3 * warc.BLOCK)
    data = warc.record_bytes(1, None, payload, "d", "response", None) + warc.record_bytes(2, None, b"y", "d", "response", None)
    source = Counting(data)
    got = [r["payload"] for _, r in warc.records_in_range(source, 0, len(data), 4096)]
    assert got == [payload, b"y"] and source.got < 1.2 * len(data)
    for split in (warc.BLOCK, 1_000_003):
        got = [r["record_id"] for s in range(0, len(data), split) for _, r in warc.records_in_range(pa.BufferReader(data), s, min(s + split, len(data)))]
        assert got == ["1", "2"]


def test_splits_are_read_by_several_tasks(spark):
    df = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 20).alias("html")).coalesce(1)
    files, _ = warc.archived(df)
    size = files.agg(F.sum("bytes")).first()[0]
    read = warc.read_archives(spark, files, split_bytes=size // 8)
    tasks = read.select("record_id", F.spark_partition_id().alias("t")).collect()
    assert sorted(int(r.record_id) for r in tasks) == list(range(400))
    assert len({r.t for r in tasks}) >= 6


def test_a_damaged_archive_is_an_error_not_a_shorter_table(spark, monkeypatch, tmp_path):
    df = rows(spark, [(i, "u", f"{i} " * 200) for i in range(20)]).coalesce(1)
    whole = warc.read_archives

    def cut(spark, files, **k):
        for r in files.collect():
            path = r.path.removeprefix("file://").removeprefix("file:")
            raw = open(path, "rb").read()
            open(path, "wb").write(raw[: len(raw) // 2])
        return whole(spark, files, **k)

    monkeypatch.setattr(warc, "read_archives", cut)
    with pytest.raises(RuntimeError, match="records lost"):
        warc.page_report(df)


def test_repeated_response_rows_are_responses_too(spark):
    long = "b" * 150
    got = warc.page_report(rows(spark, [(1, "u", long), (1, "u", long), (2, "v", long)])).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_ids_of_any_text_come_back_as_they_were(spark):
    ids = ["a b ", " c", "c\nd", "x>y<", "100%", "%41", "日本", "", None, "None", "urn:x-page:z"]
    rows = [(i, "http://u", f"page {k} " + "z" * 200) for k, i in enumerate(ids)]
    rows += [("zz", "http://u", rows[2][2]), ("zz " , "http://u", rows[4][2])]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    got = warc.page_report(df).collect()
    assert sorted((r.page_id is None, r.page_id or "", r.record_type) for r in got) == sorted((i is None, i or "", "revisit" if i and i.startswith("zz") else "response") for i, _, _ in rows)
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {"zz": "c\nd", "zz ": "100%"}
