"""Does a captured block run on to the next page (V13-V18)?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import PAGE, in_range, joined_text, pack_lines
from foliary.operators.furniture import page_bottoms
from foliary.operators.geometry import CROP_PADDING, box_of_range, range_error, trim_footer

# Fixed value: most continuations followed from one capture.
MAX_CHAIN = 12
DEFINITE = ("above-last-content", "no-next-page")

DOC = ["run_id", "source_id"]
CAPTURE = ["run_id", "key"]


def page_context(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: where content ends (F2), its place, and whether its document goes on."""
    last = pages.groupBy(*DOC).agg(F.max("page_in_doc").alias("_last"))
    return (
        page_bottoms(lines, pages)
        .join(pages.select(*DOC, "page_index", "page_in_doc"), [*DOC, "page_index"])
        .join(last, DOC)
        .select(
            *DOC,
            "page_index",
            "page_in_doc",
            "last_content",
            "last_line",
            "slack",
            (F.col("page_in_doc") < F.col("_last")).alias("has_next"),
        )
    )


def verdict(to: Column, whole_page: Column) -> Column:
    """V13 over a row of ``page_context``."""
    bottom = F.greatest(
        F.lit(0), F.least(F.col("last_content"), F.col("last_line") - F.col("slack"))
    )
    return (
        F.when(whole_page, "whole-page-capture")
        .when(~F.col("has_next"), "no-next-page")
        .when(F.col("last_content").isNull(), "no-content-line")
        .when(to < bottom, "above-last-content")
        .when(to > F.col("last_content"), "past-last-content")
        .otherwise("at-page-bottom")
    )


def looks_on(v: Column) -> Column:
    return v.isin("past-last-content", "at-page-bottom")


def check_zones(zones: DataFrame, context: DataFrame) -> DataFrame:
    """Verdict of each zone.  ``zones``: run_id, key, page_index, to_line, whole_page."""
    z = zones.join(context, PAGE)
    v = verdict(F.col("to_line"), F.col("whole_page"))
    return z.withColumn("verdict", v).select(
        *zones.columns, "verdict", looks_on(F.col("verdict")).alias("looks_like_continuation")
    )


def confirm_replies(
    replies: DataFrame, zones: DataFrame, lines: DataFrame, pages: DataFrame
) -> DataFrame:
    """Each continuation reply resolved on the page it is about.

    ``replies``: run_id, key, step (1 = the page after the zone), continues, from_pos, to_pos,
    confidence.  Positions count the page's lines.
    """
    home = pages.select(*PAGE, "source_id", "page_in_doc")
    start = zones.select(*CAPTURE, "page_index").join(home, PAGE).drop("page_index")
    about = pages.select(*DOC, "page_in_doc", "page_index", "width", "height")
    r = (
        replies.join(start, CAPTURE)
        .withColumn("page_in_doc", F.col("page_in_doc") + F.col("step"))
        .join(about, [*DOC, "page_in_doc"])
        .join(pack_lines(lines), PAGE, "left")
    )
    L, f, t = F.col("lines"), F.col("from_pos"), F.col("to_pos")
    first = F.try_element_at(L, f + 1)["i"]
    last = F.try_element_at(L, t + 1)["i"]
    r = r.withColumn("from_line", first).withColumn("_raw_to", last)
    r = r.withColumn("to_line", trim_footer(L, F.col("from_line"), F.col("_raw_to")))
    error = (
        F.when(~F.col("continues"), F.lit(None).cast("string"))
        .when(f.isNull() | t.isNull(), "null-range")
        .when(f > t, "reversed")
        .when(F.col("from_line").isNull() | F.col("_raw_to").isNull(), "not-on-page")
        .otherwise(range_error(L, F.col("from_line"), F.col("to_line")))
    )
    r = r.withColumn("error", error)
    ok = F.col("continues") & F.col("error").isNull()
    box = box_of_range(L, F.col("from_line"), F.col("to_line"), CROP_PADDING, F.col("width"), F.col("height"))
    return r.withColumn("_b", F.when(ok, box)).select(
        *CAPTURE,
        "step",
        "page_index",
        F.when(~F.col("continues"), "model-declined").when(ok, "found").otherwise("model-error").alias("outcome"),
        "error",
        F.when(ok, F.col("from_line")).alias("from_line"),
        F.when(ok, F.col("to_line")).cast("int").alias("to_line"),
        "_b.*",
        F.when(ok, joined_text(in_range(L, F.col("from_line"), F.col("to_line")))).alias("text"),
        F.when(ok, F.col("confidence")).alias("confidence"),
    )


def find_continuations(zones: DataFrame, confirmed: DataFrame, context: DataFrame) -> DataFrame:
    """The steps of every capture's walk, page by page, until something stops it.

    The walk is a straight line, and what a reply says does not depend on the step before it, so
    every step is judged on its own and the longest unbroken prefix is kept.  A step without a
    reply is ``pending``: silence is not a no.
    """
    start = zones.select(
        *CAPTURE, F.lit(1).alias("step"), "page_index", "to_line", "whole_page"
    )
    after = (
        confirmed.where((F.col("outcome") == "found") & (F.col("step") <= MAX_CHAIN))
        .join(zones.select(*CAPTURE, "whole_page"), CAPTURE)
        .select(*CAPTURE, (F.col("step") + 1).alias("step"), "page_index", "to_line", "whole_page")
    )
    states = start.unionByName(after).join(context, PAGE)
    reply = confirmed.select(
        *CAPTURE,
        "step",
        F.col("outcome").alias("_reply"),
        F.col("page_index").alias("found_page"),
        F.col("from_line").alias("found_from"),
        F.col("to_line").alias("found_to"),
    )
    s = states.join(reply, [*CAPTURE, "step"], "left")
    s = s.withColumn("verdict", verdict(F.col("to_line"), F.col("whole_page")))
    outcome = (
        F.when(F.col("step") > MAX_CHAIN, "cap")
        .when(~looks_on(F.col("verdict")), "declined")
        .otherwise(F.coalesce("_reply", F.lit("pending")))
    )
    s = s.withColumn("outcome", outcome)
    walked = W.partitionBy(*CAPTURE).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    unbroken = F.coalesce(F.min(F.when(F.col("outcome") == "found", 1).otherwise(0)).over(walked), F.lit(1)) == 1
    # states beyond a break exist only where a later reply was given anyway
    in_line = F.coalesce(F.count(F.lit(1)).over(walked), F.lit(0)) == F.col("step") - 1
    found = F.col("outcome") == "found"
    return (
        s.withColumn("_keep", unbroken & in_line)
        .where("_keep")
        .select(
            *CAPTURE,
            "step",
            F.col("page_index").alias("from_page"),
            "outcome",
            F.when(F.col("outcome") == "declined", F.col("verdict")).alias("verdict"),
            *[F.when(found, F.col(c)).alias(c) for c in ("found_page", "found_from", "found_to")],
        )
    )


def walk_answers(captures: DataFrame, slots: DataFrame, pages: DataFrame, steps: DataFrame) -> DataFrame:
    """Per capture, how many continuations were found, whether nothing is left to look for,
    and why the walk ended; unknown slots and pages are answered without a walk."""
    form = slots.select("run_id", "slot_key", F.lit(True).alias("_slot"))
    known = pages.select(*PAGE, F.lit(True).alias("_page"))
    end = steps.groupBy(*CAPTURE).agg(
        F.max_by(F.struct("outcome", "verdict"), "step").alias("_end"),
        F.count_if(F.col("outcome") == "found").alias("_found"),
    )
    c = (
        captures.join(form, ["run_id", "slot_key"], "left")
        .join(known, PAGE, "left")
        .join(end, CAPTURE, "left")
    )
    stop = (
        F.when(F.col("_slot").isNull(), "no-such-slot")
        .when(F.col("_page").isNull(), "page-not-supplied")
        .otherwise(F.col("_end.outcome"))
    )
    walkable = F.col("_slot").isNotNull() & F.col("_page").isNotNull()
    definite = (F.col("_end.outcome") == "model-declined") | (
        (F.col("_end.outcome") == "declined") & F.col("_end.verdict").isin(*DEFINITE)
    )
    return c.select(
        *CAPTURE,
        F.when(walkable, F.col("_found")).otherwise(0).alias("found"),
        F.coalesce(walkable & definite, F.lit(False)).alias("checked"),
        stop.alias("ended"),
    )


def outstanding_continuations(checked: DataFrame, slots: DataFrame) -> DataFrame:
    """Zones that may run on, with section and label."""
    form = slots.select("run_id", "slot_key", "section_title", "label")
    return checked.where("looks_like_continuation").join(form, ["run_id", "slot_key"])


def continuation_answered(checked: DataFrame) -> DataFrame:
    return checked.withColumn(
        "answered", F.col("looks_like_continuation") | F.col("verdict").isin(*DEFINITE)
    )


def continuation_hints(checked: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs-on / stops-short / none, and the next page of the same source."""
    here = pages.select(*PAGE, "source_id", "page_in_doc")
    nxt = pages.select(
        *DOC, (F.col("page_in_doc") - 1).alias("page_in_doc"), F.col("page_index").alias("next_page")
    )
    hint = (
        F.when(F.col("looks_like_continuation"), "runs-on")
        .when(F.col("verdict") == "above-last-content", "stops-short")
        .otherwise("none")
    )
    return (
        checked.join(here, PAGE)
        .join(nxt, [*DOC, "page_in_doc"], "left")
        .select(*CAPTURE, "page_index", "next_page", hint.alias("hint"))
    )
