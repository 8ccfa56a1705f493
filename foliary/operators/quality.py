"""Page quality: geometry statistics, ink completeness, attempts, gate report (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import PAGE, js_round, median_of, pack_lines
from foliary.functions.differ import without_space

# Thresholds of the page checks.
MIN_LINES_FOR_STATISTICS = 8
COLLAPSED_HEIGHT_MULTIPLE = 2
COLLAPSED_TEXT_ASPECT = 4
COLLAPSED_ALARM = 2
NORMAL_LINE_MIN = 0.6
NORMAL_LINE_MAX = 1.6
THIN_PAGE_RATIO = 0.7
MIN_INK_COVERAGE = 0.9
MAX_UNCOVERED_SHARE = 0.06
ATTEMPTS = 3


def page_geometry(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Q1: characters, coverage, median height, collapsed lines and density per page."""
    chars = F.length(without_space("text")).alias("chars")
    line = F.struct("w", "h", (F.col("y") + F.col("h")).alias("bottom"), "origin", chars)
    packed = lines.groupBy(*PAGE).agg(F.collect_list(line).alias("ls"))
    p = pages.select(*PAGE, "height").join(packed, PAGE, "left")
    p = p.withColumn("ls", F.coalesce("ls", F.filter(F.array(F.lit(None).cast(packed.schema["ls"].dataType.elementType)), lambda v: F.lit(False))))
    ls = F.col("ls")

    def total(f) -> Column:
        return F.aggregate(F.transform(ls, f), F.lit(0.0), lambda a, v: a + v)

    p = p.withColumn("n", F.size(ls))
    p = p.withColumn("transcribed_chars", total(lambda l: l["chars"].cast("double")).cast("int"))
    p = p.withColumn(
        "vertical_coverage",
        F.when(
            F.col("height") > 0,
            F.coalesce(F.greatest(F.array_max(F.transform(ls, lambda l: l["bottom"])), F.lit(0.0)), F.lit(0.0))
            / F.col("height"),
        ).otherwise(0.0),
    )
    p = p.withColumn(
        "median_line_height",
        F.coalesce(median_of(F.transform(ls, lambda l: l["h"])), F.lit(0.0)),
    )
    med = F.col("median_line_height")
    enough = (F.col("n") >= MIN_LINES_FOR_STATISTICS) & (med > 0)

    def collapsed(l: Column) -> Column:
        aspect = F.when((l["w"] > 0) & (l["chars"] > 0), l["h"] * l["chars"] / l["w"]).otherwise(0.0)
        tall = enough & (l["origin"] == "measured") & (l["h"] > med * COLLAPSED_HEIGHT_MULTIPLE)
        return l["origin"].isNotNull() & ((aspect > COLLAPSED_TEXT_ASPECT) | tall)

    p = p.withColumn("collapsed_lines", F.size(F.filter(ls, collapsed)))
    normal = F.filter(
        ls, lambda l: (l["h"] >= med * NORMAL_LINE_MIN) & (l["h"] <= med * NORMAL_LINE_MAX)
    )
    density = lambda l: F.when(l["w"] * l["h"] > 0, l["chars"] / (l["w"] * l["h"])).otherwise(0.0)
    p = p.withColumn("_ref", F.coalesce(median_of(F.transform(normal, density)), F.lit(0.0)))
    p = p.withColumn("_area", total(lambda l: l["w"] * l["h"]))
    page_density = F.when(F.col("_area") > 0, F.col("transcribed_chars") / F.col("_area")).otherwise(0.0)
    p = p.withColumn(
        "density_ratio", F.when(F.col("_ref") > 0, page_density / F.col("_ref")).otherwise(1.0)
    )
    reasons = F.concat_ws(
        ",",
        F.when(F.col("collapsed_lines") >= COLLAPSED_ALARM, "collapsed-lines"),
        F.when(enough & (F.col("density_ratio") < THIN_PAGE_RATIO), "thin-page"),
    )
    return p.select(
        *PAGE,
        F.col("n").alias("lines"),
        "transcribed_chars",
        "vertical_coverage",
        "median_line_height",
        "collapsed_lines",
        "density_ratio",
        reasons.alias("reasons"),
    )


def page_completeness(lines: DataFrame, ink_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Q2: how far boxes reach down the ink, and the longest inked stretch no box covers.

    Box tops, box bottoms and inked rows are swept as events down each page: one shuffle, and no
    box is exploded into pixels.  Blank rows never break a stretch, covered inked rows do.
    """
    top, bottom = js_round("y"), js_round(F.col("y") + F.col("h"))
    ends = lines.join(pages.select(*PAGE, "height"), PAGE).select(
        *PAGE,
        F.greatest(F.lit(0), top).cast("int").alias("top"),
        F.least(F.col("height"), bottom).cast("int").alias("bottom"),
    ).where("bottom > top")
    events = (
        ends.select(*PAGE, F.col("top").alias("at"), F.lit(1).alias("delta"), F.lit(False).alias("ink"))
        .unionByName(
            ends.select(*PAGE, F.col("bottom").alias("at"), F.lit(-1).alias("delta"), F.lit(False).alias("ink"))
        )
        .unionByName(
            ink_rows.select(*PAGE, F.col("y").alias("at"), F.lit(0).alias("delta"), F.lit(True).alias("ink"))
        )
    )
    down = W.partitionBy(*PAGE).orderBy("at", "ink").rowsBetween(W.unboundedPreceding, 0)
    swept = events.withColumn("covered", F.sum("delta").over(down) > 0).where("ink")
    island = F.count_if("covered").over(
        W.partitionBy(*PAGE).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    )
    runs = (
        swept.withColumn("island", island)
        .groupBy(*PAGE, "island")
        .agg(F.count_if(~F.col("covered")).alias("run"), F.max("at").alias("at"))
        .groupBy(*PAGE)
        .agg(F.max("run").cast("int").alias("run"), F.max("at").alias("ink_bottom"))
    )
    reach = lines.groupBy(*PAGE).agg(F.max(F.col("y") + F.col("h")).alias("box_bottom"))
    m = pages.select(*PAGE, "height").join(runs, PAGE, "left").join(reach, PAGE, "left")
    box_bottom = F.greatest(F.coalesce("box_bottom", F.lit(0.0)), F.lit(0.0))
    extent = F.coalesce(F.col("ink_bottom"), F.lit(-1)) + 1
    m = m.select(
        *PAGE,
        (extent - 1).cast("int").alias("ink_bottom"),
        box_bottom.alias("box_bottom"),
        F.when(extent > 0, box_bottom / extent).otherwise(1.0).alias("ink_coverage"),
        F.coalesce("run", F.lit(0)).alias("uncovered_run"),
        F.when(F.col("height") > 0, F.coalesce("run", F.lit(0)) / F.col("height"))
        .otherwise(0.0)
        .alias("uncovered_share"),
    )
    short = F.col("ink_coverage") < MIN_INK_COVERAGE
    bare = F.col("uncovered_share") > MAX_UNCOVERED_SHARE
    return m.withColumn("complete", ~short & ~bare).withColumn(
        "shortfalls",
        F.concat_ws(",", F.when(short, "short-reach"), F.when(bare, "uncovered-ink")),
    )


def best_attempt(attempts: DataFrame, limit: int = ATTEMPTS) -> DataFrame:
    """Q3: which reading of a page is kept.

    ``attempts`` carries run_id, page_index, attempt, complete and error (null when it parsed).
    The first complete reading wins and later ones do not count.  Otherwise the last parsed
    reading is kept as short, unless any attempt failed outright.  One partial aggregate.
    """
    a = attempts.where(F.col("attempt") <= limit)
    ok = F.col("error").isNull()
    g = a.groupBy(*PAGE).agg(
        F.min(F.when(ok & F.col("complete"), F.col("attempt"))).alias("_full"),
        F.max(F.when(ok, F.col("attempt"))).alias("_last"),
        F.bool_or(~ok).alias("_failed"),
        F.max("attempt").cast("int").alias("_tried"),
    )
    full = F.col("_full").isNotNull()
    kept = F.when(full, F.col("_full")).when(~F.col("_failed"), F.col("_last"))
    return g.select(
        *PAGE,
        kept.cast("int").alias("kept_attempt"),
        F.when(full, "complete").when(~F.col("_failed"), "short").otherwise("refused").alias("outcome"),
        F.when(full, F.col("_full")).otherwise(F.col("_tried")).cast("int").alias("attempts_used"),
    )


def quality_report(metrics: DataFrame) -> DataFrame:
    """Q5: one row per run over measured page metrics.

    ``metrics`` joins Q1 with ink_coverage and uncovered_share (null when not measured), plus
    interpolated_lines per page.
    """
    measured = F.col("ink_coverage").isNotNull()
    short = measured & (F.col("ink_coverage") < MIN_INK_COVERAGE)
    bare = F.col("uncovered_share").isNotNull() & (F.col("uncovered_share") > MAX_UNCOVERED_SHARE)
    flagged = (F.col("reasons") != "") | short | bare
    return metrics.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(short).alias("short_pages"),
        F.count_if(bare).alias("uncovered_pages"),
        F.count_if(~measured).alias("unmeasured"),
        F.sum("lines").alias("lines"),
        F.sum("interpolated_lines").alias("interpolated"),
        F.coalesce(F.try_divide(F.sum("interpolated_lines") * 100.0, F.sum("lines")), F.lit(0.0)).alias(
            "interpolated_pct"
        ),
    )
