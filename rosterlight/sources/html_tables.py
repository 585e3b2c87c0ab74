"""Tables in web pages, and positions on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hours_total, title_case
from ..operators.temporal import RANGE_ROWS, carried_by_range, range_bounds


class _Tables(HTMLParser):
    """Rows of cells by table, in page order; a cell is the list of its stripped text nodes.  A nested table's rows are its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list[str]]]] = []
        self.open: list[list[list[list[str]]]] = []
        self.cells: list[list[str] | None] = []  # the open cell of each open table

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
            self.cells.append(None)
        elif tag == "tr" and self.open:
            self.open[-1].append([])
            self.cells[-1] = None
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cells[-1] = []
            self.open[-1][-1].append(self.cells[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr") and self.open:
            self.cells[-1] = None
        elif tag == "table" and self.open:
            self.open.pop()
            self.cells.pop()

    def handle_data(self, data: str) -> None:
        if self.cells and self.cells[-1] is not None and data.strip():
            self.cells[-1].append(data.strip())


def tables_of(html: str | None) -> list[list[list[str]]]:
    """Each table's rows of cell texts, text nodes apart by line feeds; tables without a row are left out."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    return [[["\n".join(c) for c in r] for r in t] for t in p.tables if t]


def _flat(text: str) -> str:
    return " ".join(text.lower().split())


def chosen(tables: list[list[list[str]]], keywords: dict[str, list[str]]) -> tuple[int, dict[str, int]]:
    """The table whose header has most of the wanted columns (the first of equals) and their places; -1 if none has any."""
    best: tuple[int, dict[str, int]] = (-1, {})
    for k, rows in enumerate(tables):
        head = [_flat(c) for c in rows[0]]
        found = {}
        for name, words in keywords.items():
            at = next((i for w in words for i, c in enumerate(head) if w in c), None)
            if at is not None:
                found[name] = at
        if len(found) > len(best[1]):
            best = (k, found)
    return best


def records(tables: list[list[list[str]]], keywords: dict[str, list[str]], names: tuple[str, ...]) -> list[dict[str, str]]:
    """The rows of the best table by field, in lower case and with single blanks; of fields in ``names`` the first line only.

    Cells that a row lacks are empty; rows without any text are left out.
    """
    k, found = chosen(tables, keywords)
    out = []
    for r in tables[k][1:] if k >= 0 else []:
        cell = {f: r[i] if i < len(r) else "" for f, i in found.items()}
        row = {f: _flat(x.split("\n")[0] if f in names else x) for f, x in cell.items()}
        if r and any(row.values()):
            out.append(row)
    return out


def _per_page(pages: DataFrame, id_col: str, html_col: str, rows_of: Callable[[object, str | None], list[tuple]], columns: str) -> DataFrame:
    """Each page's rows, made in the tasks that read it."""
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(key, *r) for key, html in zip(pdf["id"], pdf["html"], strict=True) for r in rows_of(key, html)], columns=names)

    return own.mapInPandas(run, f"id {dict(own.dtypes)['id']}, {columns}").withColumnRenamed("id", id_col)


def best_tables(pages: DataFrame, id_col: str, html_col: str, keywords: dict[str, list[str]], names: tuple[str, ...] = ("name", "covered_by", "released_by")) -> DataFrame:
    """id, n_tables, n_rows (with text, below the header) and missing (fields without a column, comma-joined) of each page's best table."""

    def rows_of(key: object, html: str | None) -> list[tuple]:
        tables = tables_of(html)
        _, found = chosen(tables, keywords)
        return [(len(tables), len(records(tables, keywords, names)), ",".join(f for f in keywords if f not in found))]

    return _per_page(pages, id_col, html_col, rows_of, "n_tables int, n_rows int, missing string")


def table_rows(pages: DataFrame, id_col: str, html_col: str, keywords: dict[str, list[str]], names: tuple[str, ...] = ("name", "covered_by", "released_by")) -> DataFrame:
    """id, row_no and a column for each field: the rows of each page's best table; null where it has no such column."""
    fields = list(keywords)

    def rows_of(key: object, html: str | None) -> list[tuple]:
        return [(n, *(r.get(f) for f in fields)) for n, r in enumerate(records(tables_of(html), keywords, names))]

    return _per_page(pages, id_col, html_col, rows_of, ", ".join(["row_no int", *(f"{f} string" for f in fields)]))


def hours_rows(pages: DataFrame, id_col: str, html_col: str, name: list[str], worked: list[str]) -> DataFrame:
    """id, name, hours of each page's hours table; cells without a total (no-shows) have no row; a page without the columns is an error."""
    wanted = {"name": name, "worked": worked}

    def rows_of(key: object, html: str | None) -> list[tuple]:
        tables = tables_of(html)
        if len(chosen(tables, wanted)[1]) < 2:
            raise ValueError(f"page {key}: no table with a name and a worked column")
        return [(r["name"], r["worked"]) for r in records(tables, wanted, ("name",))]

    cells = _per_page(pages, id_col, html_col, rows_of, "name string, cell string")
    return cells.select(id_col, title_case(F.col("name")).alias("name"), hours_total(F.col("cell")).alias("hours")).where("hours IS NOT NULL AND name <> ''")


def nearest(marks: DataFrame, heads: DataFrame, ids: str | list[str], at: str, place: str, order: str, page: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each mark (its columns ``ids``) with the ``order`` of the head of its page nearest by place; of equally near ones the lowest.

    Two prefix scans over the distinct places of heads and marks find the last head at or before each mark and the first
    at or after it, whatever number of heads a page has.  Marks without a place, and marks of a page without heads, are
    left out; heads without a place count for nothing.
    """
    ids = [ids] if isinstance(ids, str) else ids
    head = heads.where(F.col(place).isNotNull()).select(F.col(page).alias("page__"), F.col(place).cast("double").alias("x__"), F.col(order).alias("o__"))
    mark = marks.where(F.col(at).isNotNull()).select(*ids, F.col(page).alias("page__"), F.col(at).cast("double").alias("x__"))
    none = F.lit(None).cast(head.schema["o__"].dataType)
    places = head.union(mark.select("page__", "x__", none).distinct()).groupBy("page__", "x__").agg(F.min("o__").alias("o__"))
    value = F.when(F.col("o__").isNotNull(), F.struct("x__", "o__"))
    bounds = range_bounds(places, "x__", range_rows)
    both = carried_by_range(places, value, "x__", "page__", "before__", bounds=bounds)
    both = carried_by_range(both, value, "x__", "page__", "after__", bounds=bounds, descending=True)
    near = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.x__") - F.col("x__")).alias("d"), F.col(f"{side}.o__").alias("o")))
    best = both.select("page__", "x__", F.least(near("before__"), near("after__"))["o"].alias(order)).where(F.col(order).isNotNull())
    return mark.join(best, ["page__", "x__"]).select(*ids, order)


def pickups(texts: DataFrame, names: DataFrame, marker: list[str], week_start: str) -> DataFrame:
    """Positioned texts (page, text, x, y) -> page, name, date of open-shift pickups: a marker's nearest day header and row.

    Pages with fewer than two day headers give nothing.  A header's day is its rank by x.  One row per name and date.
    """
    t = F.trim("text")
    across, down = Window.partitionBy("page").orderBy("x"), Window.partitionBy("page").orderBy("y", "name")
    heads = texts.where(t.rlike(r"(?i)^(sun|mon|tue|wed|thu|fri|sat)\w*,?\s*\d{1,2}$"))
    heads = heads.join(heads.groupBy("page").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "page").select("page", "x", (F.row_number().over(across) - 1).alias("day"))
    own = names.select(F.lower(F.trim("name")).alias("k"), "name").dropDuplicates(["k"])
    rows = texts.join(own, F.lower(t) == F.col("k")).select("page", "y", "name").withColumn("row", F.row_number().over(down))
    marks = texts.where(F.exists(F.array(*map(F.lit, marker)), lambda m: F.lower("text").contains(m))).select("page", "x", "y").distinct()
    day = nearest(marks, heads, ["page", "x", "y"], "x", "x", "day", "page")
    who = nearest(day, rows, ["page", "day"], "y", "y", "row", "page").join(rows.select("page", "row", "name"), ["page", "row"])
    return who.select("page", "name", F.date_add(F.lit(week_start).cast("date"), F.col("day")).alias("date")).distinct()
