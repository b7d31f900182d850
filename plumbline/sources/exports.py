"""Whole runs and detections as nested JSON documents, one for each run or drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import spatial

_KEEP = {"ignoreNullFields": "false"}


def _list(t: DataFrame, by: list[str], first: list[str], value: Column, name: str) -> DataFrame:
    """The values of each group as an array, in the order of the first columns."""
    rows = t.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(first)], value.alias("v")))).alias(name))
    return rows.withColumn(name, F.transform(name, lambda x: x.v))


def run_documents(runs: DataFrame, pages: DataFrame, by: list[str], page: str = "page_number") -> DataFrame:
    """(by, document): what is known of a run, and its pages in order with prompts and replies.

    ``runs`` has a row for each run (names, times, counters: all its columns are kept);
    ``pages`` a row for each page.  A run is some sheets; it has one document.
    """
    own = [c for c in runs.columns if c not in by]
    each = F.to_json(F.struct(*[c for c in pages.columns if c not in by]), _KEEP)
    listed = _list(pages, by, [page], each, "pages")
    out = runs.join(listed, by, "left")
    head = F.to_json(F.struct(*own), _KEEP)
    body = F.concat(F.lit(', "pages": ['), F.array_join(F.coalesce("pages", F.array().cast("array<string>")), ", "), F.lit("]}"))
    return out.select(*by, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), body).alias("document"))


def detection_documents(lines: DataFrame, numbers: DataFrame, orphans: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, document) of each sheet: its lines with their family, its numbers, those without a line, its statistics.

    ``lines`` comes from ``spatial.hierarchy`` over detected lines.
    """
    mark = lambda x: F.concat(F.lit("P"), x.cast("string"))
    box = F.array(*[F.bround(c, 2) for c in spatial.BOX])
    family = F.to_json(F.struct(mark(F.col("idx")).alias("id"), "kind", "label", "value", mark(F.col("parent")).alias("parent"), F.transform("children", mark).alias("children")), _KEEP)
    said = F.to_json(F.struct("text", box.alias("bbox")))
    parts = {"hierarchy": _list(lines, by, ["idx"], family, "hierarchy"), "numbers": _list(numbers, by, ["y0", "x0"], said, "numbers"), "orphans": _list(orphans, by, ["y0", "x0"], said, "orphans")}
    out = stats.select(*by, F.to_json(F.struct(*[c for c in stats.columns if c not in by]), _KEEP).alias("stats"))
    for t in parts.values():
        out = out.join(t, by, "left")
    lists = [F.concat(F.lit(f'"{n}": ['), F.array_join(F.coalesce(n, F.array().cast("array<string>")), ", "), F.lit("], ")) for n in parts]
    return out.select(*by, F.concat(F.lit("{"), *lists, F.lit('"stats": '), "stats", F.lit("}")).alias("document"))
