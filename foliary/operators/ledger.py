"""Usage ledger: tallies by stage, prices, totals and cross-checks.

``usage``: run_id, ts, seq, stage, model_id, input, output, thoughts, cached_input, pages,
page_cost_usd, batch -- one row per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Prices per million tokens (input, output), discounts, and the order of stages.
PRICES = {
    "gemini-3.5-flash": (1.5, 9.0),
    "gemini-3.5-flash-lite": (0.3, 2.5),
    "gemini-3.6-flash": (0.75, 3.75),
    "gemini-3.7-flash": (0.75, 3.75),
    "gemini-3.8-flash": (0.75, 3.75),
    "gemini-3.1-flash-lite": (0.25, 1.5),
}
BATCH_FACTOR = 0.5
CACHED_FACTOR = 0.1
STAGES = [
    "ocr", "classify", "sections", "locate", "extract", "verify", "continuation", "config", "epic",
]
COUNTERS = ["calls", "input", "output", "thoughts", "cached_input", "pages"]


def stage_tallies(usage: DataFrame) -> DataFrame:
    """L1: summed counters per run and stage, with the model named last."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return usage.groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("calls"),
        *[zero(c).alias(c) for c in COUNTERS[1:]],
        F.round(F.coalesce(F.sum("page_cost_usd"), F.lit(0.0)), 9).alias("page_cost_usd"),
        F.max_by("model_id", F.struct("ts", "seq")).alias("model_id"),
        F.bool_or("batch").alias("batch"),
    )


def usd_of_tally() -> Column:
    """L2: price of a tally row; null when the model has no price, 0 for an unused stage."""
    part = lambda k: F.create_map(*[F.lit(v) for m, p in PRICES.items() for v in (m, p[k])])
    in_price, out_price = (F.try_element_at(part(k), F.col("model_id")) for k in (0, 1))
    factor = F.when(F.col("batch"), BATCH_FACTOR).otherwise(1.0)
    by_page = (F.col("pages") > 0) & (F.col("input") == 0) & (F.col("output") == 0)
    cached = F.least("cached_input", "input")
    billable = F.col("input") - cached * (1 - CACHED_FACTOR)
    tokens = (billable * in_price / 1_000_000 + F.col("output") * out_price / 1_000_000) * factor
    return (
        F.when(F.coalesce(F.col("model_id"), F.lit("")) == "", F.when(F.col("calls") == 0, F.lit(0.0)))
        .when(by_page, F.col("page_cost_usd") * factor)
        .otherwise(tokens)
    )


def priced_tallies(usage: DataFrame) -> DataFrame:
    return stage_tallies(usage).withColumn("cost_usd", F.round(usd_of_tally(), 9))


def ledger_totals(priced: DataFrame) -> DataFrame:
    """L3: total of the priced stages per run, and whether every used stage had a price."""
    used = priced.where("calls > 0")
    return used.groupBy("run_id").agg(
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("usd"),
        F.bool_and(F.col("cost_usd").isNotNull()).alias("complete"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_stages"),
    )


def ledger_rows(priced: DataFrame) -> DataFrame:
    """L4: stage rows by cost, unpriced first, and a TOTAL row per run, with shares.

    One rollup over a handful of stages per run; the windows stay inside a run's stage rows.
    """
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    rolled = (
        priced.where("calls > 0")
        .rollup("run_id", "stage")
        .agg(
            *sums,
            F.sum("cost_usd").alias("_cost"),
            F.count_if(F.col("cost_usd").isNull()).alias("unpriced"),
            F.max("model_id").alias("_model"),
            F.grouping_id().alias("_level"),
        )
        .where("run_id is not null")
    )
    total = F.col("_level") == 1
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    by_cost = W.partitionBy("run_id").orderBy(
        total, F.col("_cost").desc_nulls_first(), order
    )
    run = W.partitionBy("run_id")
    run_total = F.coalesce(F.max(F.when(total, F.col("_cost"))).over(run), F.lit(0.0))
    return rolled.select(
        "run_id",
        F.when(total, "TOTAL").otherwise(F.col("stage")).alias("stage"),
        F.row_number().over(by_cost).alias("line"),
        *COUNTERS,
        F.round(F.when(total, F.coalesce("_cost", F.lit(0.0))).otherwise(F.col("_cost")), 6).alias("cost_usd"),
        F.round(F.when(~total & (run_total > 0), F.col("_cost") / run_total * 100), 6).alias("share_pct"),
        F.when(~total, F.col("_model")).alias("model_id"),
        F.when(total, F.col("unpriced") == 0).alias("complete"),
        F.when(total & (F.col("input") > 0), F.round(F.col("cached_input") / F.col("input") * 100, 6)).alias("cached_pct"),
    )


def ledger_cross_check(usage: DataFrame, flat: DataFrame) -> DataFrame:
    """Counters whose stage sums differ from the flat totals (run_id, counter, total)."""
    t = stage_tallies(usage).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    pairs = ", ".join(f"'{c}', {c}" for c in COUNTERS)
    long = t.selectExpr("run_id", f"stack({len(COUNTERS)}, {pairs}) as (counter, by_stage)")
    return (
        long.join(flat, ["run_id", "counter"], "full_outer")
        .where(~F.col("by_stage").eqNullSafe(F.col("total")))
        .select("run_id", "counter", "by_stage", "total")
    )
