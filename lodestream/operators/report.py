"""Reports as lines of text (S31, S34): (n, line) rows from aggregates that are small by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, order: list[Column], line: Column, head: list[str]) -> DataFrame:
    """The lines of ``head``, then one for each row of an aggregate, in order, numbered from zero."""
    w = Window.orderBy(*order)  # a report's aggregate has some hundred rows
    body = df.select((F.row_number().over(w) - 1 + len(head)).alias("n"), line.alias("line"))
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "n int, line string")
    return top.unionByName(body)


def markdown_table(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """A table with its header; a bar in a cell is escaped, null is empty."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    return lines(df, order, row, [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"])


def html_table(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """The rows of a table for a static page, escaped."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return lines(df, order, F.concat(F.lit("<tr>"), *map(cell, columns), F.lit("</tr>")), ["<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"])
