"""Changes to a run's captures, sources and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE, first_by, joined_text, key_bucket, number_rows, pack_lines
from foliary.functions.keys import capture_key_for, continuation_checked, zone_fingerprint

SLOT = ["run_id", "slot_key"]
DOC = ["run_id", "source_id"]
ZONE = ["page_index", "from_line", "to_line"]


def searchable_captures(captures: DataFrame, slots: DataFrame) -> DataFrame:
    """Whether a search may fill a capture's slot."""
    form = slots.select(*SLOT, "added")
    return captures.join(form, SLOT, "left").withColumn(
        "searchable", F.coalesce(~F.col("added"), F.lit(False))
    ).drop("added")


def wanted_captures(captures: DataFrame, slots: DataFrame) -> DataFrame:
    """Open first captures without a zone that may be searched."""
    c = searchable_captures(captures, slots)
    return c.where(
        "page_index is null and status in ('pending', 'outstanding') and ordinal = 1 and searchable"
    ).select("run_id", "key")


def captures_to_walk(captures: DataFrame, slots: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Zoned captures nothing has looked past, on pages open to search."""
    fenced = sources.where("ai = false").select(*DOC)
    open_ = pages.select(*PAGE, "source_id").join(fenced, DOC, "left_anti").select(*PAGE)
    c = searchable_captures(captures, slots).where(
        "page_index is not null and status in ('proposed', 'confirmed') and searchable"
    )
    c = c.where(~continuation_checked("checked_for", *ZONE))
    return c.join(open_, PAGE, "left_semi").select("run_id", "key", *ZONE)


def sources_to_discover(sources: DataFrame, again: DataFrame) -> DataFrame:
    """Open sources not asked yet, or asked for again."""
    a = again.select(*DOC).withColumn("_again", F.lit(True))
    s = sources.join(a, DOC, "left")
    asked = F.coalesce("sections_asked", F.lit(False))
    return s.where(F.coalesce("ai", F.lit(True)) & (F.col("_again").isNotNull() | ~asked)).select(*DOC)


def apply_proposals(captures: DataFrame, results: DataFrame) -> DataFrame:
    """Proposals and outstanding answers onto open captures without a zone.

    ``results``: run_id, key, outcome (V7) with zone and text.  A proposal beats an outstanding
    answer; an out-of-scope key is left alone.
    """
    o = F.col("outcome")
    g = results.groupBy("run_id", "key").agg(
        F.bool_or(o == "out-of-scope").alias("_out"),
        F.max(F.when(o == "proposal", F.struct(*ZONE, "text"))).alias("_p"),
        F.bool_or(o == "outstanding").alias("_o"),
    )
    c = captures.join(g, ["run_id", "key"], "left")
    open_ = (
        F.col("status").isin("pending", "outstanding")
        & F.col("page_index").isNull()
        & ~F.coalesce("_out", F.lit(False))
    )
    takes = open_ & F.col("_p").isNotNull()
    kept = [x for x in captures.columns if x not in (*ZONE, "status", "origin", "text")]
    text = F.col("text") if "text" in captures.columns else F.lit(None).cast("string")
    return c.select(
        *kept,
        F.when(takes, "proposed")
        .when(open_ & F.coalesce("_o", F.lit(False)), "outstanding")
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(takes, "llm").otherwise(F.col("origin")).alias("origin"),
        *[F.when(takes, F.col(f"_p.{z}")).otherwise(F.col(z)).alias(z) for z in ZONE],
        F.when(takes, F.col("_p.text")).otherwise(text).alias("text"),
    )


def apply_continuations(captures: DataFrame, found: DataFrame, checked: DataFrame) -> DataFrame:
    """Found continuations appended under their slot, and searched captures stamped.

    ``found``: run_id, after (key), seq (order of the answers), zone, text, checked.
    ``checked``: run_id, key.  A zone the slot already holds is skipped; ordinals go on from the
    highest one, two at least.  Order inside a slot is numbered in buckets.
    """
    stamp = checked.select("run_id", "key").distinct().withColumn("_stamp", F.lit(True))
    fp = zone_fingerprint(*ZONE)
    c = captures.join(stamp, ["run_id", "key"], "left")
    stamped = c.withColumn(
        "checked_for",
        F.when(F.col("_stamp") & F.col("page_index").isNotNull(), fp).otherwise(F.col("checked_for")),
    ).drop("_stamp")
    parents = captures.where("page_index is not null and status <> 'unfilled'").select(
        "run_id", F.col("key").alias("after"), "slot_key"
    )
    held = captures.where("page_index is not null").select(*SLOT, fp.alias("_fp"))
    fresh = first_by(
        found.join(parents, ["run_id", "after"]).withColumn("_fp", fp), [*SLOT, "_fp"], ["seq"]
    ).join(held, [*SLOT, "_fp"], "left_anti")
    top = captures.groupBy(*SLOT).agg(F.max("ordinal").alias("_top"))
    numbered = number_rows(fresh, SLOT, ["seq"], key_bucket("seq"), "_n").join(top, SLOT)
    ordinal = (F.greatest(F.lit(2), F.col("_top") + 1) + F.col("_n")).cast("int")
    last = captures.groupBy("run_id").agg(F.max("pos").alias("_last"))
    new = (
        number_rows(numbered, ["run_id"], ["seq"], key_bucket("seq"), "_at")
        .join(last, "run_id")
        .withColumn("ordinal", ordinal)
        .select(
            "run_id",
            capture_key_for("slot_key", "ordinal").alias("key"),
            "slot_key",
            "ordinal",
            (F.col("_last") + 1 + F.col("_at")).cast("int").alias("pos"),
            F.lit("proposed").alias("status"),
            *ZONE,
            F.lit("llm").alias("origin"),
            F.when(F.col("checked"), F.col("_fp")).alias("checked_for"),
        )
    )
    return stamped.select(*new.columns).unionByName(new)


def drop_captures(captures: DataFrame, targets: DataFrame, include_target: bool) -> DataFrame:
    """What stays after dropping a capture (or only those after it) per slot.

    ``targets``: run_id, slot_key, ordinal -- at most one per slot.  The first capture stays.
    """
    t = targets.select(*SLOT, F.col("ordinal").alias("_from"))
    c = captures.join(t, SLOT, "left")
    later = F.col("ordinal") > F.col("_from")
    own = (F.col("ordinal") == F.col("_from")) if include_target else F.lit(False)
    doomed = (F.col("ordinal") > 1) & F.coalesce(later | own, F.lit(False))
    return c.where(~doomed).drop("_from")


def page_moves(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Old to new page number per run; null for pages of a removed source."""
    gone = removed.select(*DOC).withColumn("_gone", F.lit(True))
    p = pages.select(*PAGE, "source_id").join(gone, DOC, "left")
    kept = number_rows(
        p.where("_gone is null"), ["run_id"], ["page_index"], key_bucket("page_index"), "new_page"
    )
    lost = p.where("_gone is not null").withColumn("new_page", F.lit(None).cast("int"))
    return kept.unionByName(lost).select(
        *PAGE, "new_page", F.col("_gone").isNotNull().alias("removed")
    )


def _after_removal(captures: DataFrame, moves: DataFrame) -> DataFrame:
    c = captures.join(moves, PAGE, "left")
    cut = (
        c.where("removed").groupBy(*SLOT).agg(F.min("ordinal").alias("_cut"))
    )
    return c.join(cut, SLOT, "left").withColumn(
        "_hit", F.coalesce(F.col("ordinal") >= F.col("_cut"), F.lit(False))
    )


def remove_sources(captures: DataFrame, pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Captures after sources are removed.

    A slot is cut from its lowest capture that lost its page: later ones go, the first is reset to
    pending, and the slot's last survivor must be looked past again.
    """
    c = _after_removal(captures, page_moves(pages, removed))
    c = c.where(~(F.col("_hit") & (F.col("ordinal") > 1)))
    end = c.where("_cut is not null").groupBy(*SLOT).agg(F.max("pos").alias("_end"))
    c = c.join(end, SLOT, "left")
    hit = F.col("_hit")
    moved = zone_fingerprint("new_page", "from_line", "to_line")
    stamp = F.when(F.col("checked_for") == zone_fingerprint(*ZONE), moved)
    plain = F.when(F.col("page_index").isNull(), F.col("checked_for")).otherwise(stamp)
    return c.select(
        "run_id",
        "key",
        "slot_key",
        "ordinal",
        "pos",
        F.when(hit, "pending").otherwise(F.col("status")).alias("status"),
        F.when(~hit, F.col("new_page")).alias("page_index"),
        F.when(~hit, F.col("from_line")).alias("from_line"),
        F.when(~hit, F.col("to_line")).alias("to_line"),
        F.when(~hit, F.col("origin")).alias("origin"),
        F.when(~hit & (F.col("pos") != F.coalesce("_end", F.lit(-1))), plain).alias("checked_for"),
    )


def removal_cost(captures: DataFrame, pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages, captures and confirmed captures a removal drops, per run."""
    moves = page_moves(pages, removed)
    n = moves.where("removed").groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"))
    hit = _after_removal(captures, moves).where("_hit and page_index is not null")
    k = hit.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("captures"), F.count_if(F.col("status") == "confirmed").alias("confirmed")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(k, "run_id", "left").select("run_id", "pages", zero("captures"), zero("confirmed"))


def remap_citations(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """Citations follow their page; one whose page is gone is dropped, the verdict stays."""
    j = entries.join(moves.select(*PAGE, "new_page"), PAGE, "left")
    keep = F.col("new_page").isNotNull()
    rest = [c for c in entries.columns if c not in ZONE]
    return j.select(
        *rest,
        F.col("new_page").alias("page_index"),
        F.when(keep, F.col("from_line")).alias("from_line"),
        F.when(keep, F.col("to_line")).alias("to_line"),
    )


def remap_proposals(proposals: DataFrame, moves: DataFrame, removed: DataFrame) -> DataFrame:
    """Page lists of proposals (one row per page).

    A proposal of a removed source stays as it is; any other that lost a page disappears.
    """
    own = proposals.join(removed.select(*DOC), DOC, "left_semi")
    other = proposals.join(removed.select(*DOC), DOC, "left_anti")
    moved = other.join(moves.select(*PAGE, "new_page"), PAGE, "left")
    broken = moved.where("new_page is null").select("run_id", "section_id").distinct()
    kept = moved.join(broken, ["run_id", "section_id"], "left_anti")
    rest = [c for c in proposals.columns if c != "page_index"]
    return own.select(*rest, "page_index").unionByName(
        kept.select(*rest, F.col("new_page").alias("page_index"))
    )


def fully_claimed(proposals: DataFrame, added: DataFrame) -> DataFrame:
    """Proposals whose pages one added section already holds.

    Containment by counting: as many shared pages with one section as the proposal has pages.
    """
    sizes = proposals.groupBy("run_id", "section_id").agg(F.count(F.lit(1)).alias("_size"))
    held = added.select("run_id", F.col("section_id").alias("holder"), "page_index").distinct()
    shared = (
        proposals.select("run_id", "section_id", "page_index")
        .join(held, PAGE)
        .groupBy("run_id", "section_id", "holder")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    full = shared.join(sizes, ["run_id", "section_id"]).where("_n = _size")
    return full.groupBy("run_id", "section_id").agg(F.min("holder").alias("holder"))


def record_proposals(stored: DataFrame, fresh: DataFrame, added: DataFrame, answered: DataFrame) -> DataFrame:
    """An answered source's proposals are replaced; those already held are not filed."""
    taken = fully_claimed(fresh, added).select("run_id", "section_id")
    filed = fresh.join(taken, ["run_id", "section_id"], "left_anti")
    return stored.join(answered.select(*DOC), DOC, "left_anti").unionByName(filed.select(*stored.columns))


def accept_proposals(
    proposals: DataFrame, accepted: DataFrame, added: DataFrame, pages: DataFrame, lines: DataFrame
) -> DataFrame:
    """One whole-page capture per page of each accepted proposal, or why there is none."""
    chosen = proposals.join(accepted.select("run_id", "section_id"), ["run_id", "section_id"], "left_semi")
    held = fully_claimed(chosen, added)
    p = (
        chosen.join(held, ["run_id", "section_id"], "left")
        .join(pages.select(*PAGE, "width", "height", F.lit(True).alias("_known")), PAGE, "left")
        .join(pack_lines(lines), PAGE, "left")
    )
    reason = (
        F.when(F.col("holder").isNotNull(), "already-held")
        .when(F.col("_known").isNull(), "no-such-page")
        .when(F.col("lines").isNull(), "no-readable-text")
    )
    ok = F.col("reason").isNull()
    return p.withColumn("reason", reason).select(
        "run_id",
        "section_id",
        "page_index",
        F.when(ok, "proposed").alias("status"),
        F.when(ok, 0).alias("from_line"),
        F.when(ok, F.size("lines") - 1).alias("to_line"),
        F.when(ok, joined_text(F.col("lines"))).alias("text"),
        "reason",
    )


def reject_proposals(proposals: DataFrame, rejected: DataFrame) -> DataFrame:
    return proposals.join(rejected.select("run_id", "section_id"), ["run_id", "section_id"], "left_anti")


def fence_report(sources: DataFrame, recorded: DataFrame, checks: DataFrame) -> DataFrame:
    """Sources a check skipped, and those since opened.

    ``recorded``: run_id, source_id fenced at check time.  ``checks``: run_id, known (whether the
    check recorded its fences at all).  Without a record: unknown, told from today's fences.
    """
    s = sources.join(checks, "run_id")
    r = recorded.select(*DOC).withColumn("_was", F.lit(True))
    j = s.join(r, DOC, "left")
    was = F.col("_was").isNotNull()
    state = (
        F.when(F.col("known") & was & (F.col("ai") == F.lit(False)), "skipped")
        .when(F.col("known") & was, "now-read")
        .when(~F.col("known") & (F.col("ai") == F.lit(False)), "skipped")
        .when(~F.col("known") & F.col("ai"), "now-read")
    )
    return j.withColumn("state", state).where("state is not null").select(*DOC, "name", "known", "state")


def extraction_signature(sources: DataFrame) -> DataFrame:
    """Digest per run of which sources are open, in order.

    A sum of per-source hashes over (source, order, open): equal lists give equal sums, one partial
    aggregate, and no run's sources are gathered.
    """
    one = F.xxhash64(
        F.concat_ws(":", "source_id", F.col("pos").cast("string"), F.coalesce("ai", F.lit(True)).cast("string"))
    )
    return sources.groupBy("run_id").agg(
        F.sum(one.cast("decimal(38,0)")).alias("signature"), F.count(F.lit(1)).alias("sources")
    )


def usable_extractions(cached: DataFrame, sources: DataFrame) -> DataFrame:
    """Cached values whose run still has the same open list."""
    return cached.join(extraction_signature(sources), ["run_id", "signature", "sources"], "left_semi")


def merge_zones(zones: DataFrame) -> DataFrame:
    """The earliest round's first zone of each slot wins (round, pos)."""
    return first_by(zones, SLOT, ["round", "pos"])


def seed_slots(slots: DataFrame, existing: DataFrame) -> DataFrame:
    """A pending first capture for each fillable slot that has none."""
    return (
        slots.where("fillable")
        .join(existing.select(*SLOT), SLOT, "left_anti")
        .select("run_id", F.col("slot_key").alias("key"), "label", F.lit("pending").alias("status"))
    )


def list_runs(sources: DataFrame, created: DataFrame) -> DataFrame:
    """Runs with a label (first source and how many more) and their document count."""
    g = sources.groupBy("run_id").agg(
        F.min_by("name", "pos").alias("_first"),
        F.count(F.lit(1)).alias("documents"),
        F.count("digest").alias("with_digest"),
    )
    more = F.concat("_first", F.lit(" +"), (F.col("documents") - 1).cast("string"), F.lit(" berkas lagi"))
    r = created.join(g, "run_id", "left")
    return r.select(
        "run_id",
        "created_at",
        F.when(F.col("documents").isNull(), "(belum ada dokumen)")
        .when(F.col("documents") == 1, F.col("_first"))
        .otherwise(more)
        .alias("label"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("with_digest", F.lit(0)).alias("with_digest"),
    )
