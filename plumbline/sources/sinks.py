"""Report writers."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_text(rows: DataFrame, columns: list[str], most: int = 100_000) -> bytes:
    """A report as one ;-separated UTF-8 file with a byte order mark.

    A report has a row for each sheet of a run; more than ``most`` is an error, and
    is for ``write_csv``.
    """
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; use write_csv")
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in r] for r in got])
    return out.getvalue().encode("utf-8-sig")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Part files with a header each, ;-separated."""
    rows.select(*columns).write.mode("overwrite").option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_xlsx(rows: DataFrame, stats: DataFrame, path: str, most: int = 100_000) -> str | None:
    """Two sheets, result and statistics; None where the spreadsheet library is missing.

    More than ``most`` rows in either are an error, and are for ``write_csv``.
    """
    try:
        import openpyxl
    except ImportError:
        return None
    book = openpyxl.Workbook()
    for title, t in (("result", rows), ("statistics", stats)):
        sheet = book.create_sheet(title)
        sheet.append(t.columns)
        got = t.limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} rows; use write_csv")
        for r in got:
            sheet.append(list(r))
    book.remove(book.worksheets[0])
    book.save(path)
    return path


def write_bytes(rows: DataFrame, name: str, data: str, write) -> None:
    """Calls write(name, bytes) for each row, on the executors."""

    def each(part) -> None:
        for r in part:
            write(r[name], bytes(r[data]))

    rows.select(name, data).foreachPartition(each)
