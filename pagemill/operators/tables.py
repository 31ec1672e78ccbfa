"""Tables and forms of a page as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.html import (
    OPTION,
    attr,
    element_pattern,
    element_text,
    find_all,
    has_attr,
    inner,
    tag_name,
    void_pattern,
    without_code,
)
from pagemill.functions.rules import Page, element_value, numbers_inside, select_elements, staged
from pagemill.functions.structure import inside_each, table_cells
from pagemill.functions.text import last_wins_map, let

def _records_of(parts: Column) -> Column:
    """Records from header texts and the cell texts of each row; rows without cells are left out."""

    def record(headers: Column, cells: Column) -> Column:
        return last_wins_map(
            F.transform(
                cells,
                lambda c, i: F.struct(
                    F.coalesce(F.get(headers, i), F.concat(F.lit("column_"), i.cast("string"))).alias("key"),
                    c.alias("value"),
                ),
            )
        )

    def build(t: Column) -> Column:
        filled = F.filter(t["rows"], lambda cells: F.size(cells) > 0)
        return F.transform(filled, lambda cells: record(t["headers"], cells))

    return let(parts, build)


def _tagged(page: Page, *tags: str) -> Column:
    return F.filter(page.all, lambda e: e["tag"].isin(*tags))


def table_structs(page: Page, rule: str = "//table", header_rule: str | None = None, row_rule: str | None = None) -> Column:
    """ARRAY of the records of each table that ``rule`` finds, in document order; with the other rules, these
    name the header cells and the rows inside it.

    By default header cells are the ``th`` cells of the head and all cells of a row that is the first of its parent; data
    rows are those of a body and those that are not the first of their parent. All descendants count: a nested
    table is found on its own, and its rows and cells count for the outer one as well. A cell past the headers is
    ``column_i``, the last of equal headers counts."""
    if (header_rule is None) != (row_rule is None):
        raise ValueError("give both the rule of the headers and that of the rows, or none")
    tables = select_elements(page, rule)

    def text(number: Column) -> Column:
        return element_value(page, F.get(page.all, number), "text")

    if header_rule is None:
        rows = _tagged(page, "tr")
        firsts = F.filter(rows, lambda e: e["nth"] == 1)
        found = table_cells(
            tables, _tagged(page, "thead"), _tagged(page, "tbody"), rows, firsts, _tagged(page, "td", "th"), _tagged(page, "th")
        )
        return F.transform(found, lambda t: texts_of(t["headers"], t["rows"], text))
    headers = numbers_inside(page, tables, header_rule)
    rows = numbers_inside(page, tables, row_rule)
    # The cells of every element that may be a row of a table, looked up by its place among them.
    flat = F.array_sort(F.array_distinct(F.flatten(rows)))
    cells = inside_each(page.at(flat), ["//"], [_tagged(page, "td", "th")])
    of_row = F.map_from_arrays(flat, cells)
    return let(
        F.struct(headers.alias("headers"), rows.alias("rows"), of_row.alias("cells")),
        lambda t: F.transform(
            t["headers"],
            lambda header, i: texts_of(header, F.transform(F.get(t["rows"], i), lambda r: F.try_element_at(t["cells"], r)), text),
        ),
    )


def texts_of(headers: Column, rows: Column, text) -> Column:
    """Records of a table from the numbers of its header cells and of the cells of its rows."""
    cells = F.transform(rows, lambda row: F.transform(row, text))
    return _records_of(F.struct(F.transform(headers, text).alias("headers"), cells.alias("rows")))


def extract_tables(
    pages: DataFrame, rule: str = "//table", header_rule: str | None = None, row_rule: str | None = None
) -> DataFrame:
    """(page_id, table_no, row_no, cells MAP<STRING, STRING>)."""
    rows, page = staged(pages, "page_id")
    tables = rows.select("page_id", F.posexplode_outer(table_structs(page, rule, header_rule, row_rule)).alias("table_no", "_t"))
    return tables.select("page_id", "table_no", F.posexplode_outer("_t").alias("row_no", "cells")).filter("row_no IS NOT NULL")


_FIELD = (
    rf"{void_pattern('(?:input|textarea)')}|{element_pattern('select', '/?form[\\s>]')}"
)


def _field(el: Column) -> Column:
    def text(name: str, default: str = "") -> Column:
        return F.coalesce(attr(el, name), F.lit(default))

    options = F.transform(
        find_all(inner(el), OPTION),
        lambda o: F.struct(
            F.coalesce(attr(o, "value"), F.lit("")).alias("value"), element_text(o).alias("text")
        ),
    )
    return F.struct(
        text("type", "text").alias("type"),
        text("name").alias("name"),
        text("id").alias("id"),
        text("value").alias("value"),
        has_attr(el, "required").alias("required"),
        F.when(tag_name(el) == "select", options).alias("options"),
    )


def form_structs(doc: Column) -> Column:
    """ARRAY<STRUCT<action, method, name, id, fields>> of the forms of a page."""

    def form(el: Column) -> Column:
        return F.struct(
            F.coalesce(attr(el, "action"), F.lit("")).alias("action"),
            F.upper(F.coalesce(attr(el, "method"), F.lit("get"))).alias("method"),
            F.coalesce(attr(el, "name"), F.lit("")).alias("name"),
            F.coalesce(attr(el, "id"), F.lit("")).alias("id"),
            F.transform(find_all(inner(el), _FIELD), _field).alias("fields"),
        )

    return F.transform(find_all(doc, element_pattern("form")), form)


def extract_forms(pages: DataFrame) -> DataFrame:
    """(page_id, form_no, action, method, name, id, fields)."""
    staged = pages.select("page_id", without_code(F.col("html")).alias("_doc"))
    return staged.select("page_id", F.posexplode(form_structs(F.col("_doc"))).alias("form_no", "form")).select(
        "page_id", "form_no", "form.*"
    )
