"""Token costs, tariffs and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import num

MILLION = 1_000_000.0
PRICES = ("input", "output", "reasoning", "cache_write", "cache_read")
COUNTERS = ("prompt", "completion", "reasoning", "cache_write", "cache_read")


def with_pricing(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Calls with the tariff of their model, else the row ``default``, else none.

    A missing or zero reasoning price is the output price.  ``price_source`` is
    model, default or unknown.  The tariff table has a row for each model; of several
    rows of one model one counts, so no call is doubled.
    """
    named = pricing.groupBy("model").agg(F.first(F.struct(*[F.col(p).cast("double").alias(p) for p in PRICES])).alias("__own")).withColumnRenamed("model", "__m")
    usual = named.where("__m = 'default'").select("__own").first()  # one row at most
    out = calls.join(F.broadcast(named), F.col("model") == F.col("__m"), "left")  # a row for each model; calls of one model are not gathered in a task
    other = F.struct(*[F.lit(usual[0][p]).cast("double").alias(p) for p in PRICES]) if usual else F.lit(None).cast(named.schema["__own"].dataType)
    out = out.withColumn("__other", other)
    chosen = F.coalesce("__own", "__other")
    zero = F.lit(0.0)
    price = {p: F.coalesce(chosen[p].cast("double"), zero) for p in PRICES}
    price["reasoning"] = F.coalesce(F.nullif(price["reasoning"], zero), price["output"])
    source = F.when(F.col("__own").isNotNull(), "model").when(F.col("__other").isNotNull(), "default").otherwise("unknown")
    return out.select(*calls.columns, *[price[p].alias(f"price_{p}") for p in PRICES], source.alias("price_source"))


def split_tokens() -> dict[str, Column]:
    """Counters as they are billed: nothing twice, nothing below zero.

    Completion includes reasoning, prompt includes both kinds of cached tokens.
    """
    zero = F.lit(0).cast("bigint")
    c = {k: F.coalesce(F.col(k).cast("bigint"), zero) for k in COUNTERS}
    reasoning = F.least(c["reasoning"], c["completion"])
    write = F.least(c["cache_write"], c["prompt"])
    read = F.least(c["cache_read"], F.greatest(c["prompt"] - write, zero))
    return {"plain": F.greatest(c["prompt"] - write - read, zero), "visible": c["completion"] - reasoning, "billed_reasoning": reasoning, "billed_write": write, "billed_read": read}


def costs(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Calls with five costs; calls of an unknown tariff cost nothing."""
    priced = with_pricing(calls, pricing).select("*", *[x.alias(k) for k, x in split_tokens().items()])
    parts = zip(("input_cost", "output_cost", "reasoning_cost", "cache_write_cost", "cache_read_cost"), ("plain", "visible", "billed_reasoning", "billed_write", "billed_read"), PRICES)
    return priced.select("*", *[(F.col(t) / MILLION * F.col(f"price_{p}")).alias(name) for name, t, p in parts])


COSTS = ("input_cost", "output_cost", "reasoning_cost", "cache_write_cost", "cache_read_cost")


def pricing_enabled(pricing: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether any tariff has a price: of all, or of each group."""
    return pricing.groupBy(*(by or [])).agg(F.coalesce(F.bool_or(F.greatest(*[F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in PRICES]) > 0), F.lit(False)).alias("enabled"))


def usage_totals(costed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters and costs summed; ``pricing_known`` only if every call's tariff is.

    Where calls have them, ``retry_reason`` (null for a first try), ``failed`` and
    ``at`` (order) give retries, failures and the list of reasons in order.  Partial
    aggregates merge as totals do.
    """
    sums = [F.coalesce(F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))), F.lit(0)).alias(f"{c}_tokens") for c in COUNTERS]
    sums += [F.coalesce(F.sum("visible"), F.lit(0)).alias("visible_tokens")] if "visible" in costed.columns else []
    sums += [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in COSTS]
    if "retry_reason" in costed.columns:
        told = F.when(F.col("retry_reason").isNotNull(), F.struct("at", "retry_reason"))
        sums += [F.count("retry_reason").alias("retries"), F.count_if("failed").alias("failures"), F.transform(F.sort_array(F.collect_list(told)), lambda x: x.retry_reason).alias("retry_reasons")]
    return costed.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("calls"), *sums, F.coalesce(F.bool_and(F.col("price_source") != "unknown"), F.lit(True)).alias("pricing_known"))


def run_stats(pages: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """One row for each run: pages, failures, what a page took and cost, and what was found on it.

    ``pages`` has a row for each page: error, elapsed, and, as far as they are known,
    trimmed, area_ratio, dimensions, pointers and rejected.  ``totals`` comes from
    ``usage_totals`` by the same keys.  Shares of nothing are 0, the mean area 1.
    """
    has = set(pages.columns)
    own = [F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("pages_failed"), F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("elapsed")]
    own += [F.count_if("trimmed").alias("pages_trimmed")] if "trimmed" in has else []
    own += [F.bround(F.coalesce(F.avg("area_ratio"), F.lit(1.0)), 4).alias("area_ratio_mean")] if "area_ratio" in has else []
    own += [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in ("dimensions", "pointers", "rejected") if c in has]
    sums = pages.groupBy(*by).agg(*own)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in COSTS[1:]), F.coalesce(F.col(COSTS[0]), F.lit(0.0)))
    return sums.join(totals, by, "left").select(
        "*", (F.col("pages") - F.col("pages_failed")).alias("pages_ok"), F.bround(num.safe_share(F.col("elapsed"), F.col("pages")), 2).alias("elapsed_per_page"),
        F.bround(num.safe_share(F.coalesce("calls", F.lit(0)), F.col("pages")), 2).alias("calls_per_page"), F.bround(total, 6).alias("total_cost"), F.bround(num.safe_share(total, F.col("pages")), 6).alias("cost_per_page"),
    )


def page_errors(pages: DataFrame, by: list[str], page: str = "page_number") -> DataFrame:
    """Errors of each run in page order, as structs (page, error)."""
    return pages.where(F.col("error").isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("page"), "error"))).alias("errors"))
