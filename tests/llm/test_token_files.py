import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rosterlight.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(i, " ".join(rnd.choice(["alpha", "Beta,", "gamma.", "d", "été"]) for _ in range(rnd.choice([0, 3, 50, 400])))) for i in rnd.sample(range(-500, 5000), 300)]
    return out + [(10**12, "word " * 30000), (6000, ""), (6001, None), (6002, "x\x00y 日本 \U0001f642")]


def test_digests_equal_the_library(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(7)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.report(df, PATH).collect()}
    start, want = 0, {}
    for i, t in sorted(rows):
        ids = ids_of(t)
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_many_files_hold_the_documents_in_order(spark, rows, tmp_path):
    folder = str(tmp_path / "set")
    files = token_files.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, folder, file_bytes=4096).orderBy("first_document").collect()
    assert len(files) > 5 and files[0].first_id == 0
    for a, b in zip(files, files[1:], strict=False):
        assert b.first_document == a.first_document + a.documents and b.first_id == a.first_id + a.ids
    names, tokens = [], []
    for f in files:
        one = token_files.Mapped(folder, f.name)
        place = one.places(0, one.documents)
        assert place[0] == 0 and place[-1] == f.ids and (np.diff(place) > 0).all()
        own = [x for b in one.names() for x in b.to_pylist()]
        assert len(own) == f.documents
        names += own
        tokens += [one.document(k).tolist() for k in range(one.documents)]
        assert one.tokens(0, one.ids).tolist() == [t for x in tokens[-one.documents :] for t in x]
    want = sorted(rows)
    assert names == [i for i, _ in want] and tokens == [ids_of(t) for _, t in want]
    back = token_files.documents(spark, folder)
    assert {r.id: r.ids for r in back.collect()} == dict(zip(names, tokens, strict=True))


def test_the_files_are_flat_arrays_with_64_bit_places(spark, tmp_path):
    folder = tmp_path / "set"
    (f,) = token_files.written(spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string"), PATH, str(folder)).collect()
    want = [ids_of("a"), ids_of("b c")]
    assert f.width == 2 and np.fromfile(folder / f"{f.name}.ids", "<u2").tolist() == want[0] + want[1]
    raw = (folder / f"{f.name}.idx").read_bytes()
    assert raw[:8] == b"TOKENIDS" and np.frombuffer(raw[32:], "<u8").tolist() == [0, len(want[0]), len(want[0]) + len(want[1])]
    assert isinstance(token_files.Mapped(str(folder), f.name)._ids, pa.MemoryMappedFile)
    assert not list(Path(folder).glob("*.part"))


def test_one_file_is_read_by_several_tasks(spark, rows, tmp_path, monkeypatch):
    folder = str(tmp_path / "set")
    assert token_files.written(spark.createDataFrame(rows, "doc_id long, text string"), PATH, folder).count() == 1
    whole = sorted(map(tuple, token_files.documents(spark, folder, with_ids=False).collect()))
    monkeypatch.setattr(token_files, "READ_BYTES", 1000)
    back = token_files.documents(spark, folder, with_ids=False)
    assert back.rdd.getNumPartitions() > 20 and sorted(map(tuple, back.collect())) == whole


def test_repeated_rows_null_ids_and_text_ids(spark):
    df = spark.createDataFrame([("b", "x y"), (None, "first"), ("b", "x y"), ("a", None), ("b", "z")], "doc_id string, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.report(df, PATH).collect())
    assert [g[1] for g in got] == [None, "a", "b", "b", "b"]
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]


def test_what_a_lost_task_left_is_not_read_and_bad_files_are_told(spark, tmp_path):
    folder = tmp_path / "set"
    (f,) = token_files.written(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH, str(folder)).collect()
    (folder / "left.ids.part").write_bytes(b"12")
    (folder / "other.ids").write_bytes(b"12")
    assert token_files.documents(spark, str(folder)).count() == 1
    with (folder / f"{f.name}.ids").open("ab") as out:
        out.write(b"\0\0")
    with pytest.raises(ValueError, match="bytes"):
        token_files.Mapped(str(folder), f.name)


def test_empty_table(spark):
    got = token_files.report(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert got.count() == 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_wide_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "id_width", lambda vocabulary: 4)
    folder = str(tmp_path / "set")
    (f,) = token_files.written(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH, folder).collect()
    assert f.width == 4 and token_files.Mapped(folder, f.name).document(0).tolist() == ids_of("a b c")
