"""A run's changes to its form: resolve, check, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import is_blank

# Limits and the keys an overlay may never carry.
MAX_ID = 200
MAX_LABEL = 200
FENCED_KEYS = ["ask", "hint", "docType", "layout", "pageOrdinal", "fillable"]

# Sections without a stated place follow those that have one; added ones follow the form's.
UNPLACED = 10_000_000
ADDED = 1_000_000


def resolve_form(
    slots: DataFrame,
    section_patches: DataFrame,
    slot_patches: DataFrame,
    added: DataFrame,
    order: DataFrame,
) -> DataFrame:
    """Each run's form with its overlay applied.

    ``slots``: the base form per run (section_id, section_pos, section_title, slot_key, pos, label).
    Patches: run_id, section_id / slot_key, title / label, removed.  ``added``: run_id, section_id,
    section_title, origin, section_pos, slot_key, label, pos.  ``order``: run_id, section_id, place.
    An added id the form already declares comes out as ``clash`` and is not appended.
    """
    sp = section_patches.select("run_id", "section_id", "title", F.col("removed").alias("_sr"))
    lp = slot_patches.select("run_id", "slot_key", F.col("label").alias("_label"), F.col("removed").alias("_lr"))
    base = (
        slots.join(sp, ["run_id", "section_id"], "left")
        .join(lp, ["run_id", "slot_key"], "left")
        .where("not coalesce(_sr, false) and not coalesce(_lr, false)")
        .select(
            "run_id",
            "section_id",
            F.coalesce("title", "section_title").alias("section_title"),
            "section_pos",
            "slot_key",
            "pos",
            F.coalesce("_label", "label").alias("label"),
            "layout",
            "fillable",
            "page_ordinal",
            F.lit(None).cast("string").alias("origin"),
        )
    )
    declared = (
        slots.select("run_id", F.col("section_id").alias("id"))
        .unionByName(slots.select("run_id", F.col("slot_key").alias("id")))
        .distinct()
    )
    ids = declared.withColumn("_taken", F.lit(True))
    a = (
        added.join(ids.withColumnRenamed("id", "section_id"), ["run_id", "section_id"], "left_anti")
        .join(ids.withColumnRenamed("id", "slot_key"), ["run_id", "slot_key"], "left_anti")
        .select(
            "run_id",
            "section_id",
            "section_title",
            (F.col("section_pos") + ADDED).cast("int").alias("section_pos"),
            "slot_key",
            "pos",
            "label",
            F.lit("images").alias("layout"),
            F.lit(True).alias("fillable"),
            F.col("pos").alias("page_ordinal"),
            "origin",
        )
    )
    both = base.unionByName(a).join(order, ["run_id", "section_id"], "left")
    at = F.coalesce("place", F.col("section_pos") + UNPLACED).cast("int")
    return both.withColumn("section_order", at).drop("place", "section_pos")


def id_clashes(slots: DataFrame, added: DataFrame) -> DataFrame:
    """Added section or slot ids the form already declares."""
    declared = (
        slots.select("run_id", F.col("section_id").alias("id"))
        .unionByName(slots.select("run_id", F.col("slot_key").alias("id")))
        .distinct()
    )
    used = (
        added.select("run_id", F.col("section_id").alias("id"))
        .unionByName(added.select("run_id", F.col("slot_key").alias("id")))
        .distinct()
    )
    return used.join(declared, ["run_id", "id"], "left_semi")


def overlay_violations(nodes: DataFrame) -> DataFrame:
    """Rules an overlay's nodes break.

    ``nodes``: run_id, list ('sections', 'slots', 'added', 'added-slots', 'proposed', 'order'),
    id, label (null where the list needs none), origin, raw (the node's JSON text).
    """
    section_like = F.col("list").isin("sections", "added", "proposed")
    space = F.when(section_like, "section").when(F.col("list") == "order", "order").otherwise("slot")
    uses = nodes.withColumn("_space", space)
    counts = uses.groupBy("run_id", "_space", "id").agg(F.count(F.lit(1)).alias("_n"))
    key_anywhere = '"(' + "|".join(FENCED_KEYS) + r')"\s*:'
    needs_label = F.col("list").isin("added", "added-slots", "proposed")
    rule = (
        F.when(F.regexp_like("raw", F.lit(key_anywhere)), "forbidden-key")
        .when(F.coalesce(F.length("id"), F.lit(0)) == 0, "id-empty")
        .when(F.length("id") > MAX_ID, "id-too-long")
        .when(F.contains("id", F.lit("#")), "id-has-separator")
        .when(needs_label & F.col("label").isNull(), "label-missing")
        .when(F.col("label").isNotNull() & is_blank("label"), "label-empty")
        .when(F.length("label") > MAX_LABEL, "label-too-long")
        .when((F.col("list") == "added") & ~F.coalesce(F.col("origin").isin("human", "llm"), F.lit(False)), "origin")
        .when(F.col("_n") > 1, "id-used-twice")
    )
    return (
        uses.join(counts, ["run_id", "_space", "id"], "left")
        .withColumn("rule", rule)
        .where("rule is not null")
        .select("run_id", "list", "id", "rule")
    )


def hidden_sections(slots: DataFrame, resolved: DataFrame, section_patches: DataFrame) -> DataFrame:
    """Declared sections the run's form no longer shows, under their latest title."""
    base = slots.groupBy("run_id", "section_id").agg(F.first("section_title").alias("section_title"))
    shown = resolved.select("run_id", "section_id").distinct()
    p = section_patches.select("run_id", "section_id", "title")
    return (
        base.join(shown, ["run_id", "section_id"], "left_anti")
        .join(p, ["run_id", "section_id"], "left")
        .select("run_id", "section_id", F.coalesce("title", "section_title").alias("title"))
    )


def section_rows(slots: DataFrame, resolved: DataFrame) -> DataFrame:
    """Place in the packet, provenance and slot count of each section shown.

    The ranking is over the sections of one form.
    """
    base = slots.groupBy("run_id", "section_id").agg(F.first("section_title").alias("_was"))
    g = resolved.groupBy("run_id", "section_id").agg(
        F.first("section_title").alias("title"),
        F.min("section_order").alias("_o"),
        F.count(F.lit(1)).alias("slots"),
        F.first("origin").alias("origin"),
    )
    kind = (
        F.when(F.col("origin").isNotNull(), F.col("origin"))
        .when(F.col("_was") != F.col("title"), "renamed")
        .otherwise("declared")
    )
    run = W.partitionBy("run_id")
    return g.join(base, ["run_id", "section_id"], "left").select(
        "run_id",
        "section_id",
        "title",
        F.row_number().over(run.orderBy("_o", "section_id")).alias("place"),
        F.count(F.lit(1)).over(run).alias("sections"),
        "slots",
        kind.alias("provenance"),
        F.when(kind == "renamed", F.col("_was")).alias("was_called"),
    )
