"""HTML tables out of a pages DataFrame.

Only the tokenising runs in Python, on bounded slices of Arrow batches inside the tasks: a page
becomes one record with its tables as nested arrays. Choosing the table, naming
and typing cells stay native and need no shuffle.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import to_number
from ..session import c, ships_with_tasks

ships_with_tasks(__name__)

_CELL = pa.struct([(n, pa.string()) for n in ("text", "cls", "link", "href")])
_ROW = pa.struct([("cls", pa.string()), ("cells", pa.list_(_CELL)), ("inner", pa.list_(_CELL))])
_TABLE = pa.struct(
    [
        ("id", pa.string()), ("cls", pa.string()), ("in_comment", pa.bool_()),
        ("headers", pa.list_(pa.string())), ("rows", pa.list_(_ROW)),
    ]
)
TABLES_TYPE = (
    "array<struct<id:string,cls:string,in_comment:boolean,headers:array<string>,"
    f"rows:array<struct<cls:string,cells:array<{(_C := 'struct<text:string,cls:string,link:string,href:string>')}>,"
    f"inner:array<{_C}>>>>>"
)


_HIDDEN = re.compile(r"<!--(.*?)-->|<(script|style)\b.*?</\2\s*>", re.S | re.I)
_TAG = re.compile(
    r"""<(?:(t[dh])>([^<]*)</\1>|(/?)(table|tr|td|th|a)\b([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>)""", re.I
)
_ATTR = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ANY_TAG = re.compile(r"<[^>]*>")
_NONE: dict[str, str] = {}
SLICE_PAGES, SLICE_CHARS = 256, 1 << 20


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(x or y or z) for k, x, y, z in _ATTR.findall(text)} if "=" in text else {}


def _tables(source: str) -> list[dict]:
    """Tables of one markup text in page order, each with its rows and raw cells."""
    found, open_tables, t = [], [], None
    for m in _TAG.finditer(source):
        plain, inside, closing, tag, attributes = m.groups()
        if plain:  # a cell of text alone, opened and closed at once
            if t is None:
                continue
            if t["cell"] is not None:
                _close_cell(t, source, m.start())
            if t["rows"]:
                if "&" in inside:
                    inside = unescape(inside)
                cell = {
                    "text": " ".join(inside.split()), "cls": "", "link": None, "href": None, "across": 1, "down": 1,
                    "head": plain in ("th", "TH", "tH", "Th"),
                }
                t["rows"][-1]["cells"].append(cell)
                for outer in open_tables:
                    if outer["rows"]:
                        outer["rows"][-1]["inner"].append(cell)
            continue
        tag = tag.lower()
        if tag == "table":
            if closing:
                if t:
                    _close_cell(t, source, m.start())
                    open_tables.pop()
                    t = open_tables[-1] if open_tables else None
                continue
            a = _attributes(attributes)
            t = {"id": a.get("id", ""), "cls": a.get("class", ""), "rows": [], "cell": None}
            found.append(t)
            open_tables.append(t)
        elif t is None:
            continue
        elif tag == "a":
            cell = t["cell"]
            if cell is None:
                continue
            if not closing and cell["from"] is None:
                cell["from"] = m.end()
                cell["href"] = _attributes(attributes).get("href")
            elif closing and cell["from"] is not None and cell["link"] is None:
                cell["link"] = _text(source[cell["from"] : m.start()])
        else:
            if t["cell"] is not None:
                _close_cell(t, source, m.start())
            if closing:
                continue
            a = _attributes(attributes) if attributes else _NONE
            if tag == "tr":
                t["rows"].append({"cls": a.get("class", ""), "cells": [], "inner": [], "spans": False})
            elif t["rows"]:
                t["cell"] = cell = {
                    "at": m.end(), "from": None, "link": None, "href": None, "cls": "", "across": 1, "down": 1, "text": "",
                    "head": tag == "th",
                }
                if a:
                    cell["cls"] = a.get("class", "")
                    cell["across"], cell["down"] = _span(a.get("colspan"), 1000), _span(a.get("rowspan"), 65_534)
                    if cell["across"] > 1 or cell["down"] > 1:
                        t["rows"][-1]["spans"] = True
                t["rows"][-1]["cells"].append(cell)
                for outer in open_tables:
                    if outer["rows"]:
                        outer["rows"][-1]["inner"].append(cell)
    return found


def _close_cell(table: dict, source: str, end: int) -> None:
    if table["cell"] is not None:
        table["cell"]["text"] = _text(source[table["cell"]["at"] : end])
        table["cell"] = None


def _span(v, most: int) -> int:
    """A span attribute; HTML ends column spans at 1,000 and row spans at 65,534."""
    return min(int(v), most) if v and v.isascii() and v.isdigit() and int(v) > 0 else 1


_BLANK = {"text": "", "cls": "", "link": None, "href": None}


def _grid(rows) -> list[list[dict]]:
    """Cells laid out with row and column spans repeated; rows above reach down as intervals of columns."""
    out, reaching = [], []
    for row in rows:
        if not reaching and not row["spans"]:
            out.append(row["cells"])
            continue
        line, later, k = [], [], 0
        for cell in (*row["cells"], None):
            while k < len(reaching) and (cell is None or reaching[k][0] <= len(line)):
                start, end, above, left = reaching[k]
                k += 1
                line += [_BLANK] * (start - len(line))
                line += [above] * (end - len(line))
                if left > 1:
                    later.append((start, end, above, left - 1))
            if cell is not None:
                if cell["down"] > 1:
                    later.append((len(line), len(line) + cell["across"], cell, cell["down"] - 1))
                line += [cell] * cell["across"]
        reaching = sorted(later, key=lambda x: x[:2]) if later else later
        out.append(line)
    return out


def _text(markup: str) -> str:
    if "<" in markup:
        markup = _ANY_TAG.sub("", markup)
    if "&" in markup:
        markup = unescape(markup)
    return " ".join(markup.split())


def _header_levels(rows) -> int:
    """How many rows at the top name columns: two, or one where a row of data follows a row of header cells.

    Of two header rows the lower alone would never name more columns than both, so that reading is not tried.
    """
    heads = [all(x["head"] for x in r["cells"]) for r in rows[:2]]
    return 1 if heads[:1] == [True] and heads[1:] != [True] else 2


def _headers(lines, levels: int) -> list[str]:
    """Lowest level unless blank, else the one above; repeats get .1, .2, ..."""
    width = max((len(x) for x in lines), default=0)
    names, seen = [], {}
    for i in range(width):
        stack = [x[i]["text"] for x in lines[:levels] if i < len(x)]
        name = next((s for s in reversed(stack) if s), f"Unnamed: {i}")
        k = seen.get(name, 0)
        seen[name] = k + 1
        names.append(f"{name}.{k}" if k else name)
    return names


def _page_tables(html: str | None, header_levels: int | None, only: str | None = None) -> list[dict]:
    """Visible tables first, then those in comments, each in page order; with ``only`` those of that id.

    Without ``header_levels`` each table's own rows tell how many of them are its header.

    A row's ``inner`` lists all its cells and those of tables nested in it, in page order, where there are such.
    Cells hold more than ``_CELL`` names; Arrow takes the fields it names.
    """
    if not html or "<table" not in html.lower():
        return []
    notes = [m.group(1) for m in _HIDDEN.finditer(html) if m.group(1) and "<table" in m.group(1).lower()]
    out = []
    for hidden, parts in ((False, [_HIDDEN.sub("", html)]), (True, notes)):
        parts = [p for p in parts if only is None or only in p or "&" in p]  # an id may be written in entities
        for t in (t for p in parts for t in _tables(p) if only is None or t["id"] == only):
            rows = [r for r in t["rows"] if r["cells"]]
            lines = _grid(rows)
            levels = _header_levels(rows) if header_levels is None else header_levels
            names = _headers(lines, levels) if levels else []
            body = [
                {
                    "cls": row["cls"],
                    "cells": line,
                    "inner": row["inner"] if len(row["inner"]) > len(row["cells"]) else None,
                }
                for row, line in zip(rows[levels:], lines[levels:])
            ]
            out.append(
                {"id": t["id"], "cls": t["cls"], "in_comment": hidden, "headers": names, "rows": body}
            )
    return out


def _slices(batch: pa.RecordBatch):
    """A batch in parts of a bounded number of pages and, but for one page alone, of characters.

    Parsed tables take many times the memory of their markup, so no more than a part is held in that form.
    """
    start = chars = 0
    for i, x in enumerate(batch.column("_html")):
        n = len(x.as_py() or "")
        if i > start and (i - start >= SLICE_PAGES or chars + n > SLICE_CHARS):
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += n
    if batch.num_rows > start:
        yield batch.slice(start)


def read_tables(pages: DataFrame, page: str = "page_id", html: str = "html", header_levels: int | None = 2, keep=(), only: str | None = None) -> DataFrame:
    """(page, keep..., tables): one record per page; with ``only`` just the tables of that id are built.

    ``header_levels`` rows of a table are its header; None takes one or two, as each table has them.
    """
    carried = [page, *keep]
    kinds = dict(pages.dtypes)

    def read(batches):
        for b in (part for whole in batches for part in _slices(whole)):
            tables = [_page_tables(h, header_levels, only) for h in b.column("_html").to_pylist()]
            cols = [b.column(x) for x in carried] + [pa.array(tables, pa.list_(_TABLE))]
            yield pa.RecordBatch.from_arrays(cols, names=[*carried, "tables"])

    schema = ", ".join(f"`{x}` {kinds[x]}" for x in carried) + f", tables {TABLES_TYPE}"
    return pages.select(*[c(x) for x in carried], c(html).alias("_html")).mapInArrow(read, schema)


def first_table(condition) -> Column:
    return F.try_element_at(F.filter("tables", condition), F.lit(1))


def cell(header: str) -> Column:
    """Text under ``header`` in row ``r`` of table ``t``, NULL when there is none or it is blank."""
    at = F.nullif(F.array_position("t.headers", header), F.lit(0)).cast("int")
    return F.nullif(F.try_element_at("r.cells", at)["text"], F.lit(""))


def table_cells(pages: DataFrame, page: str = "page_id", html: str = "html", header_levels: int = 2) -> DataFrame:
    """Every cell of every table in long form."""
    t = read_tables(pages, page, html, header_levels).select(c(page), F.posexplode("tables").alias("table_ix", "t"))
    r = t.select(c(page), "table_ix", "t.id", "t.in_comment", "t.headers", F.posexplode("t.rows").alias("row_ix", "r"))
    x = r.select(
        c(page), "table_ix", "id", "in_comment", "headers", "row_ix", F.posexplode("r.cells").alias("col_ix", "x")
    )
    header = F.try_element_at("headers", F.col("col_ix") + 1)
    return x.select(
        c(page), "table_ix", F.col("id").alias("table_id"), "in_comment", "row_ix", "col_ix",
        header.alias("header"), "x.text", "x.link",
    )


def stat_table(
    pages: DataFrame, table_id: str, columns: list[str], page: str = "page_id", html: str = "html",
    header_levels: int | None = None, report_absent: bool = False,
) -> DataFrame:
    """One stat table by id, visible or in a comment; repeated header lines (Rk = 'Rk') left out.

    With ``report_absent`` a column ``table_found`` is added, and every page without the table, NULL pages too,
    gives one row with false and NULLs, in the same pass; a table without rows gives one with true.
    """
    if not report_absent:
        pages = pages.where(F.contains(c(html), F.lit(table_id)))
    t = read_tables(pages, page, html, header_levels, only=table_id).select(
        c(page), first_table(lambda x: x["id"] == table_id).alias("t")
    )
    if not report_absent:
        rows = t.select(c(page), "t", F.posexplode("t.rows").alias("row_ix", "r"))
        out = rows.select(c(page), "row_ix", cell("Rk").alias("_rk"), *[cell(x).alias(x) for x in columns])
        return out.where(~F.col("_rk").eqNullSafe(F.lit("Rk"))).drop("_rk")
    rk = F.array_position("t.headers", "Rk").cast("int")
    again = lambda r: (rk > 0) & F.coalesce(F.get(r["cells"], rk - 1)["text"] == "Rk", F.lit(False))
    kept = F.filter(F.transform("t.rows", lambda r, i: F.struct(i.alias("at"), r.alias("r"))), lambda x: ~again(x["r"]))
    rows = t.select(c(page), "t", F.explode_outer(kept).alias("x")).select(c(page), "t", "x.at", "x.r")
    return rows.select(
        c(page), F.col("t").isNotNull().alias("table_found"), F.col("at").alias("row_ix"),
        *[cell(x).alias(x) for x in columns],
    )


def pages_without(pages: DataFrame, table_id: str, page: str = "page_id", html: str = "html") -> DataFrame:
    """Pages on which the table is absent (the error list of an extraction job)."""
    t = read_tables(pages, page, html)
    return t.where(~F.exists("tables", lambda x: x["id"] == table_id)).select(c(page))


def squad_rows(pages: DataFrame, page: str = "page_id", html: str = "html", keep=()) -> DataFrame:
    """Players and raw values of squad pages: linked name, last cell as value; nested tables count."""
    t = read_tables(pages, page, html, 0, keep).select(
        c(page), *[c(k) for k in keep],
        first_table(lambda x: F.array_contains(F.split(x["cls"], " "), "items")).alias("t"),
    )
    rows = t.select(c(page), *[c(k) for k in keep], F.posexplode("t.rows").alias("row_ix", "r")).where(
        F.arrays_overlap(F.split("r.cls", " "), F.array(F.lit("odd"), F.lit("even")))
    )
    cells = F.coalesce("r.inner", "r.cells")
    named = F.filter(
        cells,
        lambda x: F.array_contains(F.split(x["cls"], " "), "hauptlink")
        & (F.coalesce(x["link"], F.lit("")) != "")
        & ~x["link"].rlike(r"^[0-9]+$"),
    )
    return rows.select(
        c(page), *[c(k) for k in keep], "row_ix",
        F.try_element_at(named, F.lit(1))["link"].alias("player_name_tm"),
        F.try_element_at(cells, F.lit(-1))["text"].alias("market_value_raw"),
    ).where(F.col("player_name_tm").isNotNull())


def standings_rows(pages: DataFrame, known_id: str | None = None, page: str = "page_id", html: str = "html", least_rows: int = 10) -> DataFrame:
    """Rk and Squad of the page's league table.

    Taken from the known id, else the first table in a comment with both
    headers, else the first visible one with both and enough rows.
    """

    def both(x):
        return F.array_contains(x["headers"], "Rk") & F.array_contains(x["headers"], "Squad")

    choice = F.coalesce(
        first_table(lambda x: both(x) & (x["id"] == F.lit(known_id))),
        first_table(lambda x: both(x) & x["in_comment"]),
        first_table(lambda x: both(x) & ~x["in_comment"] & (F.size(x["rows"]) >= least_rows)),
    )
    rows = read_tables(pages, page, html, 1).select(c(page), choice.alias("t"))
    return (
        rows.select(c(page), "t", F.explode("t.rows").alias("r"))
        .select(c(page), to_number(cell("Rk")).cast("int").alias("Rk"), cell("Squad").alias("Squad"))
        .where(F.col("Rk").isNotNull())
    )


def club_links(
    pages: DataFrame, page: str = "page_id", html: str = "html", marker: str = "/verein/",
    table_class: str = "items", cell_class: str = "hauptlink",
) -> DataFrame:
    """Clubs linked in cells of ``cell_class`` of visible tables of ``table_class``: id, slug and link text.

    The first link per page and id counts; anchors elsewhere, such as crests, menus and comments, do not.
    """

    def has(x, name):
        return F.array_contains(F.split(x["cls"], " "), name)

    tables = F.filter("tables", lambda x: ~x["in_comment"] & has(x, table_class))
    cells = F.flatten(F.flatten(F.transform(tables, lambda t: F.transform(t["rows"], lambda r: r["cells"]))))
    links = F.filter(cells, lambda x: has(x, cell_class) & F.contains(F.coalesce(x["href"], F.lit("")), F.lit(marker)))
    found = read_tables(pages, page, html, 0).select(c(page), F.posexplode(links).alias("at", "x"))
    parts = F.split(F.col("x.href"), F.lit(f"\\Q{marker}\\E"))
    found = found.where(F.size(parts) == 2).select(
        c(page), "at", F.substring_index(parts.getItem(1), "/", 1).alias("id"),
        F.substring_index(F.regexp_replace("x.href", "^/+", ""), "/", 1).alias("slug"), F.col("x.link").alias("name"),
    ).where(F.col("id") != "")
    return (
        found.groupBy(c(page), "id").agg(F.min_by(F.struct("slug", "name"), "at").alias("l"))
        .select(c(page), "id", "l.slug", "l.name")
    )
