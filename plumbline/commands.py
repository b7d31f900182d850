"""Commands over a folder of decoded tables and a folder of experiments.

    python -m plumbline.commands dims TABLES --pages 1-3
    python -m plumbline.commands report TABLES --out report.csv
    python -m plumbline.commands run TABLES RESEARCH/exp_05 --client mine:client --out RUNS --model m
    python -m plumbline.commands experiments RESEARCH

``TABLES`` holds sheets, paths, words and spans, and, for report and stats,
responses as Parquet.  ``run`` asks a model for every sheet through a client of your
own and writes the folder of the run; its replies are then read like any others.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry
from plumbline.functions import text as words
from plumbline.operators import annotate, drawing, selection, sequence, textmap
from plumbline.settings import Options
from plumbline.sources import adapters, experiments, pages, schemas, sinks

SHEET = drawing.SHEET


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__.split("\n")[0])
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("extract", "dims", "text", "report", "analyze"):
        v = verbs.add_parser(name)
        v.add_argument("tables")
        v.add_argument("--pages", default="all", help="1-3,7; all by default")
        if name == "text":
            v.add_argument("--numbers-only", action="store_true")
        if name == "dims":
            v.add_argument("--no-rejected", action="store_true")
        if name == "report":
            v.add_argument("--out", help="a ;-separated file with a byte order mark")
        if name == "analyze":
            v.add_argument("--regions", action="store_true")
    v = verbs.add_parser("run")
    v.add_argument("tables")
    v.add_argument("folder", help="the experiment")
    v.add_argument("--pages", default="all", help="1-3,7; all by default")
    v.add_argument("--client", required=True, help="module:attribute, called with a model and an effort, gives prompt -> reply")
    v.add_argument("--out", required=True, help="the folder that holds the folders of runs")
    v.add_argument("--model", help="in place of the experiment's")
    v.add_argument("--effort", help="in place of the experiment's")
    for name in ("experiments", "schema", "prompt"):
        v = verbs.add_parser(name)
        v.add_argument("folder")
        if name == "schema":
            v.add_argument("--out")
        if name == "prompt":
            v.add_argument("--part", choices=("system", "user"), default="system")
    return p


class Tables:
    """The decoded tables of a folder, filtered by pages at the scan."""

    def __init__(self, spark: SparkSession, folder: str, pages: str = "all"):
        self.spark, self.folder, self.pages = spark, folder, pages

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        t = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return t if self.pages.strip().lower() in ("", "all") else sequence.pages_of_spec(t.withColumn("__spec", F.lit(self.pages)), "__spec", "page_number").drop("__spec")

    def view(self, options: Options) -> DataFrame:
        """Zoom and offset of each sheet's picture."""
        zoom = geometry.zoom_for(F.col("width_pt"), F.col("height_pt"), options.dpi, float(options.longest_px))
        return self.sheets.select(*SHEET, zoom.alias("zoom"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.rint(F.col("width_pt") * zoom).cast("int").alias("width"), F.rint(F.col("height_pt") * zoom).cast("int").alias("height"))


def _show(rows: DataFrame, out: Callable[[str], None], line: Callable) -> int:
    """Rows in sheet order, streamed to the driver partition by partition."""
    n = 0
    for n, r in enumerate(rows.orderBy(*SHEET).toLocalIterator(), 1):
        out(line(r))
    return n


def extract(t: Tables, a: argparse.Namespace, o: Options, out) -> int:
    view = t.view(o)
    items = textmap.text_items(t.spans, view.select(*SHEET, "zoom", "dx", "dy"), SHEET).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("items"))
    n = _show(view.join(items, SHEET, "left"), out, lambda r: f"{r.doc_id} {r.page_number}: {r.width}x{r.height} px, {r.items or 0} labels")
    out(f"{n} sheets")
    return 0 if n else 1


def dims(t: Tables, a: argparse.Namespace, o: Options, out) -> int:
    found = drawing.detect(t.sheets, t.paths, t.words, t.spans)
    blocks = drawing.prompt_block(drawing.marks_in_pixels(found["lines"], t.view(o).select(*SHEET, "zoom", "dx", "dy")))
    rows = found["stats"].join(blocks, SHEET, "left").join(drawing.rejected(found["numbers"]), SHEET, "left")

    def line(r) -> str:
        told = f"\nnot dimensions: {', '.join(r.texts)}" if r.texts and not a.no_rejected else ""
        return f"# {r.doc_id} {r.page_number}: {r['lines']} dimensions, scale {r.scale:.3f} ({r.scale_source})\n{r.block or 'none'}{told}\n"

    return 0 if _show(rows, out, line) else 1


def text(t: Tables, a: argparse.Namespace, o: Options, out) -> int:
    view = t.view(o)
    items = textmap.text_items(t.spans, view.select(*SHEET, "zoom", "dx", "dy"), SHEET, most=o.text_items or None)
    if a.numbers_only:
        items = textmap.numbers(items)
    return 0 if _show(textmap.prompt_block(items, view, SHEET), out, lambda r: f"# {r.doc_id} {r.page_number}\n{r.block}\n") else 1


def _replies(t: Tables) -> DataFrame:
    return t.responses.withColumn("raw", F.col("response")).withColumn("response", F.try_parse_json("response"))


def report(t: Tables, a: argparse.Namespace, o: Options, out) -> int:
    found = drawing.detect(t.sheets, t.paths, t.words, t.spans)["lines"]
    marks = drawing.marks_in_pixels(found, t.view(o).select(*SHEET, "zoom", "dx", "dy")).withColumn("ord", F.regexp_extract("mark_id", "(\\d+)", 1).cast("int"))
    rows = selection.report(_replies(t), marks, SHEET)
    columns = ["sheet", "line", "length_mm", "length_m", "formula", "segments", "status", "notes"]
    ordered = rows.orderBy(*sequence.sheet_order(F.col("sheet"), F.col("page_number")))
    if a.out:
        with open(a.out, "wb") as f:
            f.write(sinks.csv_text(ordered, columns))
    else:
        for r in ordered.select(*columns).toLocalIterator():
            out("; ".join("" if v is None else str(v) for v in r))
    return 1 if rows.where(F.col("status") == selection.FAILED).limit(1).count() else 0


def analyze(t: Tables, a: argparse.Namespace, o: Options, out) -> int:
    rows = t.responses
    _show(rows.select(*SHEET, "response", "error"), out, lambda r: f"--- {r.doc_id} {r.page_number}\n{'error: ' + r.error if r.error else r.response}")
    if a.regions:
        own = annotate.model_regions(annotate.walk(rows, SHEET), t.view(o).select(*SHEET, "width", "height"), SHEET)
        _show(own, out, lambda r: f"  [{r.kind}] {r.label} ({r.x0:.0f},{r.y0:.0f})-({r.x1:.0f},{r.y1:.0f})")
    return 0


def prompts(t: Tables, e: experiments.Experiment, o: Options) -> DataFrame:
    """(sheet, prompt): the system prompt with each sheet's blocks, then the instruction."""
    view = t.view(o)
    place = view.select(*SHEET, "zoom", "dx", "dy")
    found = drawing.marks_in_pixels(drawing.detect(t.sheets, t.paths, t.words, t.spans)["lines"], place)
    items = textmap.text_items(t.spans, place, SHEET, most=o.text_items or None)
    blocks = textmap.prompt_block(items, view, SHEET).withColumnRenamed("block", "text_block")
    rows = blocks.join(drawing.prompt_block(found).withColumnRenamed("block", "dims_block"), SHEET, "left").join(view.select(*SHEET, "width", "height"), SHEET)
    said = F.udf(lambda texts, marks: experiments.render(e, texts, marks), "string", useArrow=True)
    asked = words.instruction(F.lit(e.user or ""), F.col("page_number"), F.col("width"), F.col("height"))
    return rows.select(*SHEET, F.concat(said("text_block", "dims_block"), F.lit("\n\n"), asked).alias("prompt"))


def run(t: Tables, a: argparse.Namespace, o: Options, out) -> int:
    """Asks a model about every sheet; the run's folder gets prompts, replies, the report and its statistics."""
    e = experiments.load(a.folder)
    e = replace(e, model=a.model or e.model or o.model, effort=a.effort or e.effort or o.effort)
    client, schema, began = pages.named(a.client), schemas.strict(e.schema), datetime.now(UTC)
    where = os.path.join(a.out, f"{e.name}_{began:%Y%m%d_%H%M%S}")

    def wrong(reply: str) -> str | None:
        try:
            found = schemas.problems(json.loads(reply), schema)
        except ValueError:
            return "it is not JSON"
        return "; ".join(found[:3]) or None

    prompts(t, e, o).write.parquet(os.path.join(where, "prompts"))
    asked = t.spark.read.parquet(os.path.join(where, "prompts"))
    adapters.call_models(asked, partial(client, e.model, e.effort), wrong, o.attempts, o.parallel).write.parquet(os.path.join(where, "responses.parquet"))
    done = Tables(t.spark, t.folder, t.pages)
    done.responses = t.spark.read.parquet(os.path.join(where, "responses.parquet"))
    a.out = os.path.join(where, "report.csv")
    code = report(done, a, o, out)
    sums = done.responses.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("pages_failed"), F.sum("attempts").alias("calls"), F.round(F.sum("elapsed"), 2).alias("elapsed")).first().asDict()
    stats = {"experiment": e.name, "model": e.model, "effort": e.effort, "started": began.isoformat(), "seconds": round((datetime.now(UTC) - began).total_seconds(), 2), **sums}
    with open(os.path.join(where, "stats.json"), "w", encoding="utf-8") as f:
        json.dump(stats, f, ensure_ascii=False, indent=2)
    out(f"{where}: {sums['pages'] - sums['pages_failed']} of {sums['pages']} sheets")
    return code


def catalogue(a: argparse.Namespace, out) -> int:
    found = experiments.catalogue(a.folder)
    for name, e, error in found:
        out(f"{name}: error: {error}" if e is None else f"{name}: model {e.model or '-'}, effort {e.effort or '-'}, files {', '.join(e.files)}, fields {', '.join(e.schema.get('properties', {}))}" + (f", {e.notes}" if e.notes else ""))
    return 0 if found else 1


def main(argv: list[str] | None = None, out: Callable[[str], None] = print, spark: SparkSession | None = None) -> int:
    """0: done, 1: nothing or failed sheets, 2: a wrong folder, table or setting."""
    a = parser().parse_args(argv)
    try:
        if a.verb == "experiments":
            return catalogue(a, out)
        if a.verb in ("schema", "prompt"):
            e = experiments.load(a.folder)
            said = json.dumps(schemas.strict(e.schema), ensure_ascii=False, indent=2) if a.verb == "schema" else e.system if a.part == "system" else e.user or "(no user.md: the usual instruction)"
            if getattr(a, "out", None):
                with open(a.out, "w", encoding="utf-8") as f:
                    f.write(said)
            else:
                out(said)
            return 0
        spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
        verb = {"extract": extract, "dims": dims, "text": text, "report": report, "analyze": analyze, "run": run}[a.verb]
        return verb(Tables(spark, a.tables, a.pages), a, Options.read(), out)
    except (ValueError, OSError) as e:
        out(f"error: {e}")
        return 2
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out(f"error: {str(e).splitlines()[0]}")
        return 2


if __name__ == "__main__":
    sys.exit(main())
