import random

import pytest

from rosterlight.sources import imports, quoted

SPLIT = "spark.sql.files.maxPartitionBytes"
HEAD = 'A,"B\nb",C c,(D)'


@pytest.fixture
def split(spark):
    yield lambda size: spark.conf.set(SPLIT, str(size))
    spark.conf.unset(SPLIT)


def rows(df):
    return sorted(map(repr, df.collect()))


def whole(spark, path):
    """The reader with a task a file."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def cell(rnd):
    t = "".join(rnd.choice(["a", "b", " ", "x y", "ü"]) for _ in range(rnd.randrange(6)))
    return rnd.choice([t, t, t, f'"{t}\n{t}"', f'"{t}, ""{t}""\n\n,{t}"', f'{t}5" pipe', '""', '"\n"', f'"{t}"""', f'"{t}\n"",""\n{t}"'])


@pytest.mark.parametrize("size", [61, 700])
def test_splits_give_the_rows_of_whole_files(spark, tmp_path, split, size):
    """Line feeds, commas and doubled quotes in cells, stray quotes in cells without, blank lines, short and long rows, marks at the start."""
    rnd = random.Random(size)
    for f in range(3):
        lines = [",".join(cell(rnd) for _ in range(rnd.choice([3, 4, 5]))) for _ in range(60)]
        (tmp_path / f"{f}.csv").write_text(("﻿" if f else "") + "\n".join([HEAD, "", *lines]) + "\n" * (f % 2), encoding="utf-8", newline="")
    split(size)
    got = quoted.read_csv(spark, str(tmp_path))
    assert quoted.lines(spark, str(tmp_path)).select("file", "block").distinct().count() >= sum(p.stat().st_size for p in tmp_path.iterdir()) // size - 3
    here = rows(got)
    split(1 << 27)
    assert got.columns == whole(spark, str(tmp_path)).columns == ["A", "B\nb", "C c", "(D)"]
    assert here == rows(whole(spark, str(tmp_path))) and len(here) == 180


@pytest.mark.parametrize("size", [16, 1 << 20])
@pytest.mark.parametrize(
    "text",
    [
        "A,B\r\n1,\"x\r\ny\"\r\n2,z\r\n", "A,B\n1,\"never closed\n2,3\n4,5", "A,B\n", "A,B", "\n\nA,B\n\n1,2\n\n", '"A long\nhead\nof many\nlines","B ""b"""\n1,2\n"3\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n4",5\n',
        "A,B\n" + "1,\"" + '""' * 3000 + "\n\"\n2,3\n",
    ],
    ids=["crlf", "open", "head", "head-only", "blank", "long-head", "many-quotes"],
)
def test_ends_of_lines_and_files(spark, tmp_path, split, text, size):
    (tmp_path / "t.csv").write_text(text, newline="")
    split(size if len(text) < 1000 else max(size, 512))
    here = rows(quoted.read_csv(spark, str(tmp_path)))
    split(1 << 27)
    assert here == rows(whole(spark, str(tmp_path)))


def test_a_record_over_many_splits_and_an_empty_file(spark, tmp_path, split):
    (tmp_path / "t.csv").write_text("A,B\n0,p\n1,\"" + "word, and \"\"more\"\"\n" * 400 + "\"\n2,q\n")
    split(64)
    got = {r.A: r.B for r in quoted.read_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"0": "p", "1": 'word, and "more"\n' * 400, "2": "q"}
    (tmp_path / "e.csv").write_text("")
    assert quoted.read_csv(spark, str(tmp_path / "e.csv")).columns == []
    with pytest.raises(ValueError, match="missing columns"):
        imports.tickets(spark, str(tmp_path / "e.csv"))


def test_lines_of_one_record_are_all_that_moves_twice(spark, tmp_path):
    """One shuffle by split for all lines; the plan groups only the lines of longer records."""
    (tmp_path / "t.csv").write_text("A,B\n1,2\n")
    plan = quoted.records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and plan.count("collect_list") == 1
