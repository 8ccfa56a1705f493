"""Where a run's captures stand against its form.

``captures``: run_id, key, slot_key, ordinal, pos, status, page_index (null without a zone),
from_line, to_line, origin, checked_for.  ``slots``: the form per run -- run_id, section_id,
section_title, layout, slot_key, label, fillable, added, pos.

A slot may hold any number of captures, so slots are only ever aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import PAGE
from foliary.functions.keys import continuation_checked

SLOT = ["run_id", "slot_key"]
OPEN = ("pending", "outstanding", "proposed")


def _zoned() -> Column:
    return F.col("page_index").isNotNull()


def satisfied_slots(slots: DataFrame, captures: DataFrame) -> DataFrame:
    """A5: fillable slots with any zone."""
    held = captures.where(_zoned()).select(*SLOT)
    return slots.where("fillable").select(*SLOT).join(held, SLOT, "left_semi")


def outstanding_slots(slots: DataFrame, captures: DataFrame, reasons: DataFrame, never: DataFrame) -> DataFrame:
    """A5: fillable slots without a zone that were searched.  ``reasons``: run_id, slot_key, reason."""
    held = captures.where(_zoned()).select(*SLOT)
    return (
        slots.where("fillable")
        .join(held, SLOT, "left_anti")
        .join(never.select(*SLOT), SLOT, "left_anti")
        .join(reasons, SLOT, "left")
        .select(*SLOT, "label", "section_title", F.coalesce("reason", F.lit("searched-not-found")).alias("reason"))
    )


def manual_slots(slots: DataFrame, captures: DataFrame, paged_sections: DataFrame) -> DataFrame:
    """A5: fillable slots of added sections that name no pages: nothing searches for them."""
    held = captures.where(_zoned()).select(*SLOT)
    return (
        slots.where("fillable and added")
        .join(paged_sections.select("run_id", "section_id"), ["run_id", "section_id"], "left_anti")
        .join(held, SLOT, "left_anti")
        .select(*SLOT, "label", "section_title")
    )


def slot_status(slots: DataFrame, captures: DataFrame) -> DataFrame:
    """Highest ordinal, captures, found, unchecked and status of every slot."""
    status = F.col("status")
    checked = continuation_checked("checked_for", "page_index", "from_line", "to_line")
    g = captures.groupBy(*SLOT).agg(
        F.count(F.lit(1)).alias("captures"),
        F.max("ordinal").alias("max_ordinal"),
        F.count_if(_zoned()).alias("found"),
        F.count_if(_zoned() & ~checked).alias("unchecked"),
        F.count_if((status == "confirmed") & _zoned()).alias("_confirmed"),
        F.count_if(status.isin(*OPEN)).alias("_open"),
        F.bool_or(status == "proposed").alias("_proposed"),
        F.bool_or(status == "outstanding").alias("_outstanding"),
    )
    verdict = (
        F.when(F.col("captures").isNull(), "pending")
        .when(F.col("_proposed"), "proposed")
        .when((F.col("_open") > 0) & (F.col("_confirmed") > 0), "partial")
        .when((F.col("_open") > 0) & F.col("_outstanding"), "outstanding")
        .when(F.col("_open") > 0, "pending")
        .when(F.col("_confirmed") > 0, "confirmed")
        .otherwise("unfilled")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return slots.join(g, SLOT, "left").select(
        *SLOT,
        "section_id",
        "section_title",
        "label",
        "fillable",
        "pos",
        zero("captures"),
        F.coalesce("max_ordinal", F.lit(1)).alias("max_ordinal"),
        zero("found"),
        zero("unchecked"),
        verdict.alias("status"),
    )


STATUSES = ["pending", "proposed", "confirmed", "outstanding", "unfilled", "partial"]


def progress(slot_states: DataFrame) -> DataFrame:
    """Per run, fillable slots by status, decided ones, and those nothing looked past."""
    f = slot_states.where("fillable")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return (
        f.groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("fillable"), *counts, F.count_if(F.col("unchecked") > 0).alias("unchecked"))
        .withColumn("decided", F.col("confirmed") + F.col("unfilled"))
    )


def capture_standings(captures: DataFrame, pages: DataFrame) -> DataFrame:
    """What becomes of each capture: ships, lost (its page or zone is gone), or its status."""
    known = pages.select(*PAGE, F.lit(True).alias("_known"))
    c = captures.join(known, PAGE, "left")
    confirmed = F.col("status") == "confirmed"
    ships = confirmed & F.col("_known").isNotNull()
    return c.withColumn(
        "standing", F.when(ships, "ships").when(confirmed, "lost").otherwise(F.col("status"))
    ).drop("_known")


def slot_totals(slots: DataFrame, standings: DataFrame) -> DataFrame:
    """Per slot, captures held and shipping, and how the slot counts in the packet."""
    st = F.col("standing")
    g = standings.groupBy(*SLOT).agg(
        F.count(F.lit(1)).alias("held"),
        F.count_if(st == "ships").alias("ships"),
        F.bool_and(st == "unfilled").alias("_unfilled"),
        F.bool_and(st == "outstanding").alias("_outstanding"),
        F.max("ordinal").alias("max_ordinal"),
    )
    kind = (
        F.when(~F.col("fillable"), "extra")
        .when((F.col("ships") > 0) & (F.col("ships") == F.col("held")), "complete")
        .when(F.col("ships") > 0, "partial")
        .when(F.col("_unfilled"), "blank-by-choice")
        .when(F.col("_outstanding"), "blank-not-found")
        .otherwise("blank-other")
    )
    return (
        slots.join(g, SLOT, "left")
        .withColumn("held", F.coalesce("held", F.lit(0)))
        .withColumn("ships", F.coalesce("ships", F.lit(0)))
        .withColumn("kind", kind)
        .select(
            *SLOT,
            "section_title",
            "label",
            "fillable",
            "pos",
            F.coalesce("max_ordinal", F.lit(1)).alias("max_ordinal"),
            "held",
            "ships",
            "kind",
        )
    )


def export_tally(totals: DataFrame) -> DataFrame:
    """The run's packet in numbers."""
    kind, fill = F.col("kind"), F.col("fillable")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return totals.groupBy("run_id").agg(
        n(fill, "fillable_slots"),
        n(kind == "complete", "complete"),
        n(kind == "partial", "partial"),
        n(kind.like("blank%"), "blank"),
        n(kind == "blank-by-choice", "blank_by_choice"),
        n(kind == "blank-not-found", "blank_not_found"),
        n(kind == "blank-other", "blank_other"),
        F.sum(F.when(fill, F.col("held")).otherwise(0)).alias("captures_held"),
        F.sum(F.when(fill, F.col("ships")).otherwise(0)).alias("captures_shipping"),
        F.sum(F.when(fill, 0).otherwise(F.col("ships"))).alias("captures_extra"),
    )


def unmatched_captures(slots: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures whose slot the form does not have."""
    return captures.join(slots.select(*SLOT), SLOT, "left_anti")


def blocking_items(slots: DataFrame, standings: DataFrame) -> DataFrame:
    """What still stops the packet, with the order key of the form."""
    fillable = slots.where("fillable")
    form = fillable.select(*SLOT, "section_title", "label", F.col("pos").alias("form_pos"))
    held = standings.where(F.col("standing").isin("proposed", "pending", "lost")).join(form, SLOT)
    empty = form.join(standings.select(*SLOT), SLOT, "left_anti")
    orphans = unmatched_captures(slots, standings).where(_zoned())
    none = F.lit(None)
    return (
        held.select("run_id", F.col("standing").alias("kind"), "section_title", "label", "ordinal", F.col("pos").alias("capture_pos"), "form_pos")
        .unionByName(
            empty.select(
                "run_id", F.lit("pending").alias("kind"), "section_title", "label", F.lit(1).alias("ordinal"),
                F.lit(-1).alias("capture_pos"), "form_pos",
            )
        )
        .unionByName(
            orphans.select(
                "run_id", F.lit("orphan").alias("kind"), none.cast("string").alias("section_title"),
                F.col("key").alias("label"), "ordinal", F.lit(-1).alias("capture_pos"), none.cast("int").alias("form_pos"),
            )
        )
    )


def reported_positions(captures: DataFrame, reported: DataFrame) -> DataFrame:
    """Positions of reported captures, unzoned ones first per key.

    ``reported``: run_id, key -- one row per report.  A key repeats only by mistake, so its group
    is small and only keys that were reported are ranked.
    """
    wanted = reported.groupBy("run_id", "key").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("run_id", "key").orderBy(_zoned(), "pos")
    ranked = captures.join(wanted, ["run_id", "key"]).withColumn("_r", F.row_number().over(order))
    return ranked.where("_r <= _n").select("run_id", "key", "pos")


def proposed_positions(slots: DataFrame, captures: DataFrame) -> DataFrame:
    """Positions of proposed captures with their section."""
    form = slots.select(*SLOT, "section_id")
    return captures.where("status = 'proposed'").join(form, SLOT).select("run_id", "section_id", "pos")


def empty_reasons(captures: DataFrame, slots: DataFrame) -> DataFrame:
    """Why each capture without a zone is empty, with its section and label."""
    form = slots.select(*SLOT, "section_title", "label", F.lit(True).alias("_known"), "added")
    c = captures.where(~_zoned()).join(form, SLOT, "left")
    searchable = F.col("_known").isNotNull() & ~F.coalesce("added", F.lit(False))
    reason = (
        F.when(F.col("status") == "unfilled", "emptied")
        .when(~searchable, "undrawn")
        .when(F.col("status") == "pending", "unsearched")
        .when(F.col("origin") == "llm", "rejected")
        .otherwise("notfound")
    )
    return c.select("run_id", "key", "section_title", F.coalesce("label", "key").alias("label"), reason.alias("reason"))


def source_proposals(sources: DataFrame, pages: DataFrame, proposals: DataFrame, added: DataFrame) -> DataFrame:
    """A10: per source, whether asked and fenced, its proposals, and pages nothing claims.

    ``proposals`` and ``added``: run_id, source_id, section_id, page_index -- one row per page.
    """
    doc = ["run_id", "source_id"]
    claimed = proposals.select(*doc, "page_index").unionByName(added.select(*doc, "page_index"))
    free = pages.select(*doc, "page_index").join(claimed, [*doc, "page_index"], "left_anti")
    n_free = free.groupBy(*doc).agg(F.count(F.lit(1)).alias("unclaimed"))
    n_prop = proposals.groupBy(*doc).agg(F.count_distinct("section_id").alias("proposals"))
    return (
        sources.join(n_prop, doc, "left")
        .join(n_free, doc, "left")
        .select(
            *doc,
            "name",
            F.coalesce("sections_asked", F.lit(False)).alias("asked"),
            (~F.coalesce("ai", F.lit(True))).alias("fenced"),
            F.coalesce("proposals", F.lit(0)).alias("proposals"),
            F.coalesce("unclaimed", F.lit(0)).alias("unclaimed"),
        )
    )


def section_removal_cost(slots: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures and confirmed captures removing a section would drop."""
    form = slots.select(*SLOT, "section_id")
    held = captures.where(_zoned()).join(form, SLOT)
    return held.groupBy("run_id", "section_id").agg(
        F.count(F.lit(1)).alias("captures"), F.count_if(F.col("status") == "confirmed").alias("confirmed")
    )
