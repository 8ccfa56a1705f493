"""Section headings proposed for a source: refusals, overlaps, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import in_range, pack_lines
from foliary.functions.differ import fold_key

# Sections in a reply, title length, lines a title may be taken from.
MAX_SECTIONS = 20
MAX_TITLE = 80
MAX_TITLE_LINES = 4

DOC = ["run_id", "source_id"]


def reply_faults(entries: DataFrame, most: int = MAX_SECTIONS) -> DataFrame:
    """V8: run_id, source_id, fault of the replies that fail as a whole: one bad title or number, or too many sections."""
    size = F.coalesce(F.length("title"), F.lit(0))
    numbers = [F.coalesce(F.col(c), F.lit(-1)) < 0 for c in ("from_page", "to_page", "title_from", "title_to")]
    g = entries.groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or((size < 1) | (size > MAX_TITLE)).alias("_title"),
        F.bool_or(numbers[0] | numbers[1] | numbers[2] | numbers[3]).alias("_number"),
    )
    fault = F.when(F.col("_title"), "title-length").when(F.col("_number"), "not-a-number").when(F.col("_n") > most, "too-many-sections")
    return g.select(*DOC, fault.alias("fault")).where("fault is not null")


def judge_sections(entries: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """V8: every entry with the first rule it breaks.

    ``entries``: run_id, source_id, pos, title, from_page, to_page, title_from, title_to (pages by
    place in the source).  A reply with a fault is refused with all its entries.  Spans are exploded only once they are
    known to lie inside the source.
    """
    counts = pages.groupBy(*DOC).agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    e = entries.join(counts, DOC).join(reply_faults(entries), DOC, "left")
    place = F.when(F.col("fault").isNotNull(), F.concat(F.lit("reply-refused-"), "fault")).when(F.col("from_page") > F.col("to_page"), "span-reversed").when(
        F.col("to_page") >= F.col("n_pages"), "past-last-page"
    )
    e = e.withColumn("_place", place)
    readable = lines.select("run_id", "page_index").distinct()
    bare = (
        pages.select(*DOC, "page_in_doc", "page_index")
        .join(readable, ["run_id", "page_index"], "left_anti")
        .select(*DOC, "page_in_doc")
    )
    spans = e.where("_place is null").select(
        *DOC, "pos", F.explode(F.sequence("from_page", "to_page")).alias("page_in_doc")
    )
    empty = spans.join(bare, [*DOC, "page_in_doc"]).groupBy(*DOC, "pos").agg(
        F.min("page_in_doc").alias("_bare")
    )
    first = pages.select(*DOC, F.col("page_in_doc").alias("from_page"), "run_id", "page_index").select(
        *DOC, "from_page", "page_index"
    )
    e = (
        e.join(empty, [*DOC, "pos"], "left")
        .join(first, [*DOC, "from_page"], "left")
        .join(pack_lines(lines), ["run_id", "page_index"], "left")
    )
    f, t = F.col("title_from"), F.col("title_to")
    cited = in_range(F.col("lines"), f, t)
    text = F.array_join(F.transform(cited, lambda l: l["text"]), " ")
    reason = (
        F.when(F.col("_place").isNotNull(), F.col("_place"))
        .when(F.col("_bare") == F.col("from_page"), "first-page-has-no-lines")
        .when(F.col("_bare").isNotNull(), "page-in-span-has-no-lines")
        .when(f > t, "title-lines-reversed")
        .when(t - f + 1 > MAX_TITLE_LINES, "title-lines-too-wide")
        .when(F.coalesce(F.size(cited), F.lit(0)) != t - f + 1, "title-line-missing")
        .when(~F.contains(fold_key(text), fold_key("title")), "title-not-in-lines")
    )
    return e.select(*entries.columns, "page_index", reason.alias("reason"))


def refuse_overlaps(judged: DataFrame) -> DataFrame:
    """V9: both sides of overlapping spans are refused, naming the last partner.

    A reply holds at most twenty sections (more and the whole reply fails), so a source's kept
    spans fit one row and no self-join is needed.
    """
    sized = judged.groupBy(*DOC).agg(F.count(F.lit(1)).alias("_n"))
    kept = judged.where("reason is null").join(sized.where(F.col("_n") <= MAX_SECTIONS), DOC, "left_semi")
    spans = kept.groupBy(*DOC).agg(
        F.collect_list(F.struct("pos", "from_page", "to_page", "title")).alias("_spans")
    )
    j = judged.join(sized, DOC).join(spans, DOC, "left")
    hits = F.filter(
        "_spans",
        lambda s: (s["pos"] != F.col("pos"))
        & (s["from_page"] <= F.col("to_page"))
        & (F.col("from_page") <= s["to_page"]),
    )
    partner = F.array_max(
        F.transform(hits, lambda s: F.struct(s["pos"].alias("pos"), s["title"].alias("title")))
    )
    ok = F.col("reason").isNull()
    return (
        j.withColumn("_p", F.when(ok, partner))
        .withColumn(
            "reason",
            F.when(F.col("_n") > MAX_SECTIONS, "too-many-sections")
            .when(~ok, F.col("reason"))
            .when(F.col("_p").isNotNull(), "overlaps"),
        )
        .select(*judged.columns, F.col("_p.title").alias("overlaps_with"))
    )


def section_notes(wanted: DataFrame, pages: DataFrame, final: DataFrame, failed: DataFrame) -> DataFrame:
    """Per requested source, sections kept and refused, and a note code.

    ``pages`` are the open pages.  ``failed``: sources whose reply could not be used.
    """
    n_pages = pages.groupBy(*DOC).agg(F.count(F.lit(1)).alias("pages"))
    n = final.groupBy(*DOC).agg(
        F.count_if(F.col("reason").isNull()).alias("sections"),
        F.count_if(F.col("reason").isNotNull()).alias("refused"),
    )
    w = (
        wanted.select(*DOC)
        .distinct()
        .join(n_pages, DOC, "left")
        .join(n, DOC, "left")
        .join(failed.select(*DOC).distinct().withColumn("_failed", F.lit(True)), DOC, "left")
    )
    for c in ("pages", "sections", "refused"):
        w = w.withColumn(c, F.coalesce(c, F.lit(0)))
    lost = (F.col("pages") == 0) | F.col("_failed").isNotNull()
    w = w.withColumn("sections", F.when(lost, 0).otherwise(F.col("sections")))
    w = w.withColumn("refused", F.when(lost, 0).otherwise(F.col("refused")))
    note = (
        F.when(F.col("pages") == 0, "nothing-to-read")
        .when(F.col("_failed").isNotNull(), "discovery-failed")
        .when((F.col("sections") == 0) & (F.col("refused") == 0), "no-heading-found")
        .when(F.col("sections") == 0, "none-could-be-checked")
        .when(F.col("refused") == 0, "all-proposed")
        .otherwise("some-refused")
    )
    return w.select(
        *DOC,
        "pages",
        "sections",
        "refused",
        note.alias("note"),
        F.format_string(
            "%d judul proposed across %d page(s); %d refused", "sections", "pages", "refused"
        ).alias("note_text"),
    )


def section_pages(final: DataFrame, pages: DataFrame) -> DataFrame:
    """Kept sections mapped back to run pages, one row per page."""
    kept = final.where("reason is null").select(
        *DOC, "pos", "title", F.explode(F.sequence("from_page", "to_page")).alias("page_in_doc")
    )
    return kept.join(pages.select(*DOC, "page_in_doc", "page_index"), [*DOC, "page_in_doc"])
