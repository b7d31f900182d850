"""Selected marks to measured values, sums and report rows.

A model answers with marks, never with numbers; the marks are joined to measured
values and Spark does the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import json, num

#: Names of lists and lengths in replies that bring their own numbers.
SEGMENT_LISTS = ("segments", "dimensions", "parts", "sections", "runs", "branches", "items")
BRANCH_LISTS = ("branches", "legs", "runs", "routes", "sections")
LENGTHS = ("length_mm", "length", "value_mm", "total_mm", "value")
PARENT_LENGTHS = ("parent_length", "parent_total", "overall_length", "summary_length", "total_length", "total_length_mm", "total_mm")
#: Report columns and the reply fields that fill them, by priority.
COLUMNS = {
    "sheet": ("sheet_number", "sheet", "list_number"),
    "line": ("line_designation", "line", "designation", "line_id", "marking"),
    "length_mm": ("total_length_mm", "length_mm", "total_mm", "length"),
    "length_m": ("total_length_m", "length_m", "total_m"),
    "formula": ("formula", "calculation", "computation", "calculation_formula"),
    "segments": ("segments_count", "segment_count", "segments_total"),
    "status": ("status", "confidence", "state"),
    "notes": ("notes", "issues", "remarks", "warnings", "comment"),
}


def references(responses: DataFrame, by: list[str], column: str = "response") -> DataFrame:
    """(by, list, pos, ref, reason): the marks that each reply lists, in order.

    Replies without a list of included marks are not about marks and give nothing;
    entries that name no mark are skipped.
    """
    v = F.col(column)
    rows = responses.select(*by, json.first_list(v, json.INCLUDED).alias("inc"), json.first_list(v, json.EXCLUDED).alias("exc")).where("inc is not null")
    parts = [rows.select(*by, F.lit(name).alias("list"), F.posexplode(c).alias("pos", "e")) for name, c in (("included", "inc"), ("excluded", "exc"))]
    return parts[0].unionAll(parts[1]).select(*by, "list", "pos", json.reference(F.col("e")).alias("ref"), json.reason(F.col("e")).alias("reason")).where("ref is not null")


def answered(responses: DataFrame, by: list[str], column: str = "response") -> DataFrame:
    """Sheets whose reply has a list of included marks, be it empty."""
    return responses.where(json.first_list(F.col(column), json.INCLUDED).isNotNull()).select(*by).distinct()


def resolve(refs: DataFrame, marks: DataFrame, by: list[str], sheets: DataFrame | None = None) -> DataFrame:
    """Marks and references with their outcome, a row for each.

    ``sheets`` are those with an answer about marks (``answered``); by default those
    with a reference.  Sheets without marks are left to other readings of a reply.

    ``marks`` has mark_id, value and ord (order on the sheet).  ``outcome``:
    included (a mark named, once however often), unclassified (a mark that no list
    names: it counts too), excluded (named there; it still counts if it is also
    included) or unresolved (no such mark: never counted).

    Marks, references and answers are one tagged union, dealt once by sheet, in as many
    parts as the session has: a few, as small as they are when packed, fill a task's memory.
    """
    null = lambda kind: F.lit(None).cast(kind)
    kind = {c: marks.schema[c].dataType.simpleString() for c in ("value", "ord")}
    parts = [
        marks.select(*by, F.col("mark_id").alias("ref"), F.lit("mark").alias("list"), null("long").alias("pos"), null("string").alias("reason"), "value", "ord"),
        refs.select(*by, "ref", "list", F.col("pos").cast("long"), "reason", null(kind["value"]), null(kind["ord"])),
    ]
    if sheets is not None:
        parts.append(sheets.select(*by, null("string"), F.lit("sheet"), null("long"), null("string"), null(kind["value"]), null(kind["ord"])))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    at = lambda name: F.when(F.col("list") == name, F.col("pos"))
    asks = F.col("list") == "sheet" if sheets is not None else F.col("list").isin("included", "excluded")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, *by).groupBy(*by, "ref").agg(
        F.max("value").alias("value"), F.max("ord").alias("ord"), F.bool_or(F.col("list") == "mark").alias("known"), F.bool_or(asks).alias("asks"),
        F.min(at("included")).alias("inc"), F.min(at("excluded")).alias("exc"), F.min_by("reason", at("excluded")).alias("reason"),
    )
    sheet = Window.partitionBy(*by)
    found = found.withColumn("asked", F.bool_or("asks").over(sheet) & F.bool_or("known").over(sheet)).where("asked and ref is not null")
    outcome = (
        F.when(~F.col("known"), "unresolved")
        .when(F.col("inc").isNotNull(), "included")
        .when(F.col("exc").isNotNull(), "excluded")
        .otherwise("unclassified")
    )
    reason = F.when(F.col("exc").isNotNull(), F.col("reason"))
    return found.select(*by, F.col("ref").alias("mark_id"), "value", "ord", F.col("inc").alias("included_pos"), F.col("exc").alias("excluded_pos"), reason.alias("reason"), outcome.alias("outcome"))


def counted() -> Column:
    return F.col("outcome").isin("included", "unclassified")


def formula(texts: Column, total: Column) -> Column:
    """``320 + 200 = 520 мм`` from written values, which are written once a row and not in a loop."""
    return F.concat(F.array_join(texts, " + "), F.lit(" = "), num.fmt_g(total), F.lit(" мм"))


def summarize(resolved: DataFrame, by: list[str]) -> DataFrame:
    """One row for each sheet: length_mm, length_m, segments, excluded, unresolved, formula.

    Included marks go in the order of the reply, then unclassified ones in the
    order of the sheet.
    """
    written = F.when(counted() & F.col("value").isNotNull(), num.fmt_g(F.col("value")))
    order = F.struct((F.col("outcome") == "unclassified").alias("late"), F.coalesce("included_pos", "ord").alias("p"), "value", "written")
    rows = resolved.withColumn("written", written).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(counted(), F.col("value"))), F.lit(0.0)).alias("length_mm"),
        F.count_if(counted()).alias("segments"), F.count_if(F.col("excluded_pos").isNotNull()).alias("excluded"),
        F.count_if(F.col("outcome") == "unclassified").alias("unclassified"),
        F.sort_array(F.collect_set(F.when(F.col("outcome") == "unresolved", F.col("mark_id")))).alias("unresolved"),
        F.sort_array(F.collect_list(F.when(counted(), order))).alias("__v"),
    )
    return rows.select(*by, "length_mm", F.bround(F.col("length_mm") / 1000, 3).alias("length_m"), "segments", "excluded", "unclassified", "unresolved", formula(F.transform("__v", lambda x: x.written), F.col("length_mm")).alias("formula"))


#: What a report says of failures, gaps and differences.
FAILED, NO_REPLY = "ошибка", "нет ответа модели"
NO_LENGTH, DIFFERS = "участок %d: длина не определена", "расхождение %.0f мм"
NOT_THERE, LEFT_OUT = "в ответе есть метки размеров, которых нет на листе: ", "исключено размеров: "
CLAIMED, SUMMED = "модель указала ", " мм, сумма участков %.0f мм"


def report(responses: DataFrame, marks: DataFrame, by: list[str], column: str = "response", page: str | None = None) -> DataFrame:
    """Report rows of all replies: by marks, by branches, by segments, or errors.

    ``responses`` has ``error`` (null if the call went well) and a VARIANT reply; a
    sheet that the reply does not name is its ``page`` (the last key by default).  Of
    several names of a field the first that holds something counts, of a segment's
    length the first that is there: what is no number then is a problem and not
    replaced by another name.  Lengths that the reply claims are compared with the
    computed sum; a difference above 1 mm becomes the status.  Every sheet gives one row.
    """
    v, page = F.col(column), page or by[-1]
    good = responses.where("error is null")
    bymark = summarize(resolve(references(good, by, column), marks, by, answered(good, by, column)), by)
    bymark = bymark.select(*by, F.struct("length_mm", "segments", "excluded", "unresolved", "formula").alias("m"))
    branches = F.filter(json.first_list(v, BRANCH_LISTS), lambda b: json.kind_of(b) == "OBJECT")
    roots = F.filter(F.transform(branches, lambda b: json.first_number(b, PARENT_LENGTHS, strict=True)), lambda x: x.isNotNull())
    parts = F.filter(json.first_list(v, SEGMENT_LISTS), lambda s: json.kind_of(s) == "OBJECT")
    lengths = F.transform(parts, lambda s: json.as_length(json.first_present(s, LENGTHS)))
    own = {k: json.first_filled(v, names) for k, names in COLUMNS.items()}
    told = F.transform(branches, lambda b: F.when(F.trim(json.field(b, "notes", "string")) != "", F.concat(F.coalesce(F.nullif(json.field(b, "branch_id", "string"), F.lit("")), F.lit("?")), F.lit(" ("), F.coalesce(F.nullif(json.field(b, "axis", "string"), F.lit("")), F.lit("?")), F.lit("): "), F.trim(json.field(b, "notes", "string")))))
    claimed = own["length_mm"]
    rows = responses.select(
        *by, "error", F.col(page).cast("string").alias("page_text"), F.size(branches).alias("n_branches"), roots.alias("roots"), F.size(parts).alias("n_parts"), lengths.alias("lengths"),
        json.as_length(claimed).alias("claimed"), F.when(json.kind_of(claimed) == "BIGINT", F.try_variant_get(claimed, "$", "bigint").cast("string")).otherwise(json.as_length(claimed).cast("string")).alias("claimed_text"),
        json.as_length(own["length_m"]).alias("claimed_m"), F.array_join(F.filter(told, lambda x: x.isNotNull()), "; ").alias("branch_notes"), json.notes_text(own["notes"]).alias("own_notes"),
        *[F.try_variant_get(own[k], "$", "string").alias(f"own_{k}") for k in ("sheet", "line", "formula", "segments", "status")],
    )
    rows = rows.join(bymark, by, "left")
    tree = F.coalesce(F.size("roots") > 0, F.lit(False)) & F.col("m").isNull()
    known = F.filter("lengths", lambda x: x.isNotNull())
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("computed", F.when(F.col("m").isNotNull(), F.col("m.length_mm")).when(tree, add(F.col("roots"))).otherwise(F.coalesce(add(known), F.lit(0.0))))
    rows = rows.withColumn("length_mm", F.when(tree, F.col("computed")).otherwise(F.coalesce("claimed", F.when(F.col("claimed_text").isNull(), F.nullif(F.col("computed"), F.lit(0.0))))))
    gap = F.abs(F.col("length_mm") - F.col("computed"))
    differs = (F.col("computed") != 0) & (gap > 1.0)
    write = lambda values: F.transform(values, num.fmt_g)
    written = F.when(F.col("m").isNotNull(), F.col("m.formula")).when(tree, formula(write(F.col("roots")), F.col("computed"))).when(F.col("n_parts") > 0, formula(write(known), F.col("computed")))
    holes = F.array_join(F.transform(F.filter(F.transform("lengths", lambda x, i: F.when(x.isNull(), i + 1)), lambda i: i.isNotNull()), lambda i: F.format_string(NO_LENGTH, i)), "; ")
    filled = lambda x: F.nullif(x, F.lit(""))
    notes = F.concat_ws(
        "; ", filled(F.col("own_notes")), filled(F.when(tree, F.col("branch_notes"))), filled(F.when(~tree & F.col("m").isNull(), holes)),
        F.when(F.size("m.unresolved") > 0, F.concat(F.lit(NOT_THERE), F.array_join("m.unresolved", ", "))),
        F.when(F.col("m.excluded") > 0, F.concat(F.lit(LEFT_OUT), F.col("m.excluded").cast("string"))),
        F.when(differs, F.concat(F.lit(CLAIMED), F.col("claimed_text"), F.format_string(SUMMED, F.bround("computed", 0)))),
    )
    ok = F.col("error").isNull()
    return rows.select(
        *by,
        F.coalesce(F.when(ok, F.col("own_sheet")), F.col("page_text")).alias("sheet"),
        F.when(ok, F.col("own_line")).alias("line"),
        F.when(ok, F.col("length_mm")).alias("length_mm"),
        F.when(ok, F.coalesce(F.when(~tree, F.col("claimed_m")), F.bround(F.col("length_mm") / 1000, 3))).alias("length_m"),
        F.when(ok, F.coalesce(F.when(~tree, F.col("own_formula")), written)).alias("formula"),
        F.when(ok, F.coalesce(F.col("m.segments"), F.when(tree, F.col("n_branches")), F.nullif(F.greatest("n_parts", F.lit(0)), F.lit(0)), F.col("own_segments").try_cast("int"))).cast("long").alias("segments"),
        F.when(~ok, FAILED).when(differs, F.format_string(DIFFERS, F.bround(gap, 0))).otherwise(F.col("own_status")).alias("status"),
        F.when(ok, notes).otherwise(F.coalesce(filled(F.col("error")), F.lit(NO_REPLY))).alias("notes"),
    )


def latest(responses: DataFrame, by: list[str], at: str) -> DataFrame:
    """The last reply of each sheet, for stores that keep several runs."""
    last = Window.partitionBy(*by).orderBy(F.desc(at))
    return responses.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
