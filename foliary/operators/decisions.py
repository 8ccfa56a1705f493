"""Decisions on compared entries, and what two snapshots of them lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.core import last_by
from foliary.functions.cells import MAX_COLUMN, MAX_ROW, is_cell_ref, parse_ref
from foliary.functions.differ import label_key

# Decisions, id prefixes, characters a cell may not hold.
UNDECIDED = "belum"
DECISIONS = ["belum", "setuju", "tolak", "manual"]
CONFIG_PREFIX = "konfigurasi/entry/"
SCREEN_PREFIX = "epic/entry/"
RESEARCHED_ID = "konfigurasi/researched"
BASIS_ID = "epic/basis"
FORBIDDEN_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

ENTRY = ["run_id", "entry_id"]


def config_entry_id(field_id: Column) -> Column:
    return F.concat(F.lit(CONFIG_PREFIX), field_id)


def screen_entry_id(field_id: Column, label: Column) -> Column:
    return F.when(field_id.isNull(), F.concat(F.lit(SCREEN_PREFIX + "l:"), label_key(label))).otherwise(
        F.concat(F.lit(SCREEN_PREFIX + "f:"), field_id)
    )


def effective_value() -> Column:
    """Accepted document value, typed value, else the cell as it is."""
    d = F.col("decision")
    return (
        F.when(d == "setuju", F.coalesce("document_value", "excel_value"))
        .when(d == "manual", F.coalesce("manual_value", F.lit("")))
        .otherwise(F.col("excel_value"))
    )


def effective_fields(entries: DataFrame) -> DataFrame:
    return entries.withColumn("effective", effective_value())


def pending_edits(entries: DataFrame) -> DataFrame:
    """Cells whose effective value differs from what they hold."""
    e = effective_fields(entries)
    return e.where(F.col("effective") != F.col("excel_value")).select(
        "run_id", "sheet", "ref", F.col("effective").alias("value")
    )


def record_comparison(fresh: DataFrame, held: DataFrame) -> DataFrame:
    """New verdicts keep the decisions already taken on the same id."""
    h = held.where(F.col("decision") != UNDECIDED).select(
        *ENTRY, F.col("decision").alias("_d"), F.col("manual_value").alias("_m")
    )
    return (
        fresh.drop("decision", "manual_value")
        .join(h, ENTRY, "left")
        .withColumn("decision", F.coalesce("_d", F.lit(UNDECIDED)))
        .withColumn("manual_value", F.when(F.col("_d") == "manual", F.col("_m")))
        .drop("_d", "_m")
    )


def decision_violations(decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """D3: decisions that cannot be applied, with the rule they break."""
    known = entries.select(*ENTRY, F.lit(True).alias("_known"))
    d = decisions.join(known, ENTRY, "left")
    rule = (
        F.when(~F.col("decision").isin(*DECISIONS), "not-a-decision")
        .when((F.col("decision") == "manual") & F.col("manual_value").isNull(), "manual-without-value")
        .when((F.col("decision") != "manual") & F.col("manual_value").isNotNull(), "value-without-manual")
        .when(F.col("_known").isNull(), "no-such-entry")
    )
    return d.withColumn("rule", rule).where("rule is not null").select(*ENTRY, "seq", "decision", "rule")


def apply_decisions(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """D3: the latest sound decision of each entry (``seq`` orders them)."""
    sound = decisions.where(
        F.col("decision").isin(*DECISIONS)
        & ((F.col("decision") == "manual") == F.col("manual_value").isNotNull())
    )
    last = last_by(sound.select(*ENTRY, "seq", "decision", "manual_value"), ENTRY, ["seq"]).select(
        *ENTRY, F.col("decision").alias("_d"), F.col("manual_value").alias("_m")
    )
    j = entries.join(last, ENTRY, "left")
    taken = F.col("_d").isNotNull()
    return (
        j.withColumn("manual_value", F.when(taken, F.col("_m")).otherwise(F.col("manual_value")))
        .withColumn("decision", F.coalesce("_d", "decision"))
        .drop("_d", "_m")
    )


def discarded_decisions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Decisions the incoming snapshot would lose."""
    n = incoming.select(*ENTRY, F.col("decision").alias("_d"), F.col("manual_value").alias("_m"))
    s = stored.where(F.col("decision") != UNDECIDED).join(n, ENTRY, "left")
    gone = F.coalesce(F.col("_d"), F.lit(UNDECIDED)) == UNDECIDED
    untyped = (F.col("decision") == "manual") & F.col("_m").isNull()
    return s.where(gone | untyped).select(*ENTRY, F.when(gone, "undecided").otherwise("value-lost").alias("loss"))


def discarded_flags(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Run-level decisions lost: the re-search was spent, the basis was chosen.

    Both: run_id, researched, basis.
    """
    n = incoming.select("run_id", F.col("researched").alias("_r"), F.col("basis").alias("_b"))
    s = stored.join(n, "run_id", "left")
    lost = F.array_compact(
        F.array(
            F.when(F.coalesce("researched", F.lit(False)) & ~F.coalesce("_r", F.lit(False)), RESEARCHED_ID),
            F.when(
                (F.coalesce("basis", F.lit(UNDECIDED)) != UNDECIDED)
                & (F.coalesce("_b", F.lit(UNDECIDED)) == UNDECIDED),
                BASIS_ID,
            ),
        )
    )
    return s.select("run_id", F.explode(lost).alias("lost_id"))


def discarded_authorship(
    stored_sections: DataFrame,
    stored_slots: DataFrame,
    stored_added: DataFrame,
    next_sections: DataFrame,
    next_slots: DataFrame,
    next_added: DataFrame,
) -> DataFrame:
    """Renames, notes and added headings the next overlay would lose.

    Patches: run_id, id, title / label, note; added: run_id, id.
    """
    titles = stored_sections.where("title is not null").join(
        next_sections.where("title is not null").select("run_id", "id"), ["run_id", "id"], "left_anti"
    )
    n = next_slots.select("run_id", "id", F.col("label").alias("_l"), F.col("note").alias("_n"))
    slots = stored_slots.join(n, ["run_id", "id"], "left").where(
        "(label is not null and _l is null) or (note is not null and _n is null)"
    )
    added = stored_added.join(next_added.select("run_id", "id"), ["run_id", "id"], "left_anti")
    tag = lambda df, k: df.select("run_id", "id", F.lit(k).alias("kind"))
    return tag(titles, "title").unionByName(tag(slots, "slot")).unionByName(tag(added, "added"))


def snapshot_losses(
    stored_pages: DataFrame,
    next_pages: DataFrame,
    stored_captures: DataFrame,
    next_captures: DataFrame,
    allowed: DataFrame,
) -> DataFrame:
    """Pages and zone-bearing captures missing from the next snapshot and not named.

    Pages: run_id, id; captures: run_id, key, page_index; ``allowed``: run_id, kind, id.
    """
    pages = stored_pages.select("run_id", "id").join(next_pages.select("run_id", "id"), ["run_id", "id"], "left_anti")
    held = next_captures.where("page_index is not null").select("run_id", "key")
    captures = stored_captures.where("page_index is not null").join(held, ["run_id", "key"], "left_anti")
    lost = pages.select("run_id", F.lit("page").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(
        captures.select("run_id", F.lit("capture").alias("kind"), F.col("key").alias("id"))
    )
    return lost.join(allowed, ["run_id", "kind", "id"], "left_anti")


def check_summary(entries: DataFrame, researched: DataFrame) -> DataFrame:
    """Verdict counts, what is owed, and edits per run.  ``researched``: run_id, researched."""
    v = F.col("verdict")
    n = lambda c, name: F.count_if(c).alias(name)
    g = effective_fields(entries).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        n(v == "cocok", "matches"),
        n(v == "beda", "differs"),
        n(v == "tidak-ditemukan", "not_found"),
        n(v == "tidak-ada-di-excel", "not_in_sheet"),
        n((v == "beda") & (F.col("decision") == UNDECIDED), "owed"),
        n(F.col("effective") != F.col("excel_value"), "edits"),
    )
    return g.join(researched, "run_id", "left").select(
        *g.columns,
        (~F.coalesce("researched", F.lit(False)) & (F.col("not_found") > 0)).alias("can_research"),
    )


def download_blocked(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Why a run's workbook may not be downloaded.  ``runs``: run_id, has_workbook."""
    owed = entries.where(F.col("decision") == UNDECIDED).groupBy("run_id").agg(F.count(F.lit(1)).alias("owed"))
    r = runs.join(owed, "run_id", "left").withColumn("owed", F.coalesce("owed", F.lit(0)))
    return r.select(
        "run_id",
        "owed",
        F.when(~F.col("has_workbook"), "no-workbook").when(F.col("owed") > 0, "entries-undecided").alias("blocked"),
    )


def edit_violations(edits: DataFrame) -> DataFrame:
    """Edits that cannot be written: address, size, characters, or two for one cell."""
    at = parse_ref("ref")
    twice = edits.groupBy("run_id", "sheet", "ref").agg(F.count(F.lit(1)).alias("_n"))
    rule = (
        F.when(~is_cell_ref("ref"), "not-an-address")
        .when((at["col"] > MAX_COLUMN) | (at["row"] > MAX_ROW), "outside-sheet-limits")
        .when(F.regexp_like("value", F.lit(FORBIDDEN_CHARACTERS)), "control-character")
        .when(F.col("_n") > 1, "two-edits-for-one-cell")
    )
    return (
        edits.join(twice, ["run_id", "sheet", "ref"])
        .withColumn("rule", rule)
        .where("rule is not null")
        .select("run_id", "sheet", "ref", "value", "rule")
    )
