"""Tables as Markdown and CSV, in Python for readers of files and as native expressions for DataFrames."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_text(value: object) -> str:
    """A cell for a Markdown row: pipes escaped, line ends as spaces, nothing for a missing value."""
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def header_names(row: list) -> list[str]:
    """Column names of a header row; a missing one is named by its place."""
    return [f"Col{i + 1}" if v is None else str(v) for i, v in enumerate(row)]


def padded(rows: list[list]) -> list[list]:
    """Rows filled up with missing values to the widest one."""
    most = max(map(len, rows), default=0)
    return [[*r, *[None] * (most - len(r))] for r in rows]


def markdown_table(rows: list[list], max_rows: int = 500) -> str:
    """First row as header; no rows give an empty text, rows beyond the maximum a notice."""
    if not rows:
        return ""
    full = padded(rows)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    out = [line([cell_text(h) for h in header_names(full[0])]), line(["---"] * len(full[0]))]
    out += [line([cell_text(c) for c in r]) for r in full[1 : max_rows + 1]]
    if len(full) > max_rows + 1:
        out.append(f"\n*... {len(full) - max_rows - 1} more rows truncated*")
    return "\n".join(out)


def csv_text(headers: list[str], rows: list[list], include_headers: bool = True) -> str:
    """Comma-separated text with \\r\\n line ends; missing values are empty, an empty header is not written."""
    out = io.StringIO()
    writer = csv.writer(out)
    if include_headers and headers:
        writer.writerow(headers)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue()


def markdown_cell(c: Column) -> Column:
    """Native form of :func:`cell_text`."""
    return F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))


def csv_cell(c: Column) -> Column:
    """Native CSV quoting of one value."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def _row(columns: list[Column], before: str, between: str, after: str) -> Column:
    return F.concat(F.lit(before), F.concat_ws(between, *columns), F.lit(after))


def frame_lines(df: DataFrame, columns: list[str], kind: str = "markdown") -> DataFrame:
    """Each row of a DataFrame as a Markdown or CSV line (column ``line``), row-local."""
    if kind == "csv":
        return df.withColumn("line", _row([csv_cell(F.col(c)) for c in columns], "", ",", ""))
    return df.withColumn("line", _row([markdown_cell(F.col(c)) for c in columns], "| ", " | ", " |"))


def frame_header(columns: list[str], kind: str = "markdown") -> list[str]:
    """Header lines that go with :func:`frame_lines`."""
    if kind == "csv":
        return [csv_text(columns, []).rstrip("\r\n")]
    return ["| " + " | ".join(map(cell_text, columns)) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]


def row_groups(df: DataFrame, order: list[str], columns: list[str], sheet: str, size: int = 50) -> DataFrame:
    """Rows of a sheet-like table in groups of ``size``: group, first_row, last_row (counted from 2, after the header) and
    the group's Markdown text.  Ranks come from a range partitioning, not from one task."""
    from corpusloom.plans.ranking import positions

    ranked = positions(df.withColumn("__sheet", F.lit(sheet)), ["__sheet"], [F.col(c) for c in order], "__n")
    grouped = frame_lines(ranked, columns).withColumn("row_group", F.floor((F.col("__n") - 1) / size).cast("bigint"))
    head = "\n".join(frame_header(columns))
    first, last = F.min("__n").cast("bigint") + 1, F.max("__n").cast("bigint") + 1
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "line"))), lambda r: r["line"]), "\n")
    body = grouped.groupBy("row_group").agg(first.alias("first_row"), last.alias("last_row"), lines.alias("__lines"))
    text = F.concat(F.lit("[Rows "), F.col("first_row").cast("string"), F.lit("-"), F.col("last_row").cast("string"), F.lit(f"]\n{head}\n"), F.col("__lines"))
    return body.select("row_group", "first_row", "last_row", text.alias("content"))
