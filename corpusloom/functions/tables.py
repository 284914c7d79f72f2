"""Tables as array<array<string>> to Markdown, and their injection at anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import strip

ANCHOR = r"<!-- TABLE_ANCHOR_p\d+_t\d+ -->"
HEADING = "### [Tabela Detectada]"


def render_table(table: Column) -> Column:
    """Null cells are empty, newlines in cells are spaces, blank rows go; the first row left is the header and sets the width.
    A table without content is the empty string; any other ends with two newlines."""
    cell = lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = F.filter(F.transform(table, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))

    def lines(rows: Column) -> Column:
        width = F.size(F.get(rows, 0))
        bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)
        ruler = bar(F.array_repeat(F.lit("---"), width))
        all_lines = F.concat(F.array(bar(F.get(rows, 0)), ruler), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: bar(fit(r))))
        return F.concat(F.array_join(all_lines, "\n"), F.lit("\n\n"))

    # the cleaned rows are bound once, as the element of an array of one
    made = F.get(F.transform(F.array(F.coalesce(rows, F.array().cast("array<array<string>>"))), lambda r: F.when(F.size(r) > 0, lines(r)).otherwise("")), 0)
    return F.coalesce(made, F.lit(""))


def inject_tables(text: Column, tables: Column) -> Column:
    """The i-th table stands at the i-th anchor, literally; anchors without a table go, tables without an anchor are left out."""
    pieces = F.split(text, ANCHOR)
    n = F.size(pieces) - 1
    blocks = F.transform(tables, lambda t: F.concat(F.lit(f"\n\n{HEADING}\n\n"), t, F.lit("\n\n")))
    fill = F.slice(F.concat(F.array(F.lit("")), blocks, F.array_repeat(F.lit(""), n)), F.lit(1), n + 1)
    return F.array_join(F.zip_with(fill, pieces, lambda b, p: F.concat(b, p)), "")


def anchors(zones: Column) -> Column:
    """Anchor comments for structs (page, number), in their order."""
    one = lambda z: F.concat(F.lit("\n\n<!-- TABLE_ANCHOR_p"), z["page"].cast("string"), F.lit("_t"), z["number"].cast("string"), F.lit(" -->\n"))
    return F.array_join(F.transform(zones, one), "")
