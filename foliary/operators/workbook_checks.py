"""Workbook fields: interpretation, comparison with documents and with screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import first_by, is_blank, key_bucket, number_rows, strip_space
from foliary.functions.cells import is_cell_ref, parse_ref
from foliary.functions.differ import fold_key, fold_label
from foliary.operators.citations import whole_citations
from foliary.sources.replies import parse_replies, reply_entries

# Reply limits, how far a value cell may lie past the sheet, verdicts.
MAX_LABEL = 200
MAX_GROUP = 120
BLANK_MARGIN = 8
FIELDS_PER_CALL = 40
VERDICTS = ["cocok", "beda", "tidak-ditemukan"]
NOT_FOUND = "tidak-ditemukan"
NOT_IN_SHEET = "tidak-ada-di-excel"

SHEET = ["book_id", "sheet"]
FIELD = ["run_id", "field_id"]


def _bits(size):
    """Bits of the smallest power of two that is no less than a size."""
    return F.length(F.bin(F.greatest(size - 1, F.lit(0)).cast("long")))


def covered_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """The cells (book_id, sheet, row, col, ...) inside a merge, other than its first cell, once for each such merge.

    A merge is filed under the tiles of a grid about as coarse as itself, four at most, and a cell asks the grids that its
    sheet's merges use: some three hundred shapes at most.  Merges of a sheet don't overlap, so a tile holds a few.
    """
    shape = [_bits(F.col("r2") - F.col("r1") + 1).alias("_kr"), _bits(F.col("c2") - F.col("c1") + 1).alias("_kc")]
    m = merges.select(*SHEET, "r1", "c1", "r2", "c2", *shape)
    tile = lambda c, k: F.call_function("shiftright", F.col(c).cast("long"), F.col(k))
    filed = m.select("*", F.explode(F.sequence(tile("r1", "_kr"), tile("r2", "_kr"))).alias("_tr"))
    filed = filed.select("*", F.explode(F.sequence(tile("c1", "_kc"), tile("c2", "_kc"))).alias("_tc"))
    shapes = m.groupBy(*SHEET).agg(F.collect_set(F.struct("_kr", "_kc")).alias("_shapes"))
    asked = cells.join(shapes, SHEET).select(*cells.columns, F.explode("_shapes").alias("_s")).select(*cells.columns, "_s.*")
    asked = asked.withColumns({"_tr": tile("row", "_kr"), "_tc": tile("col", "_kc")})
    met = asked.join(filed, [*SHEET, "_kr", "_kc", "_tr", "_tc"])
    return met.where("row between r1 and r2 and col between c1 and c2 and not (row = r1 and col = c1)").select(*cells.columns)


def validate_interpretation(
    entries: DataFrame, cells: DataFrame, extents: DataFrame, merges: DataFrame
) -> DataFrame:
    """Each named field accepted, or refused with its first broken rule.

    ``entries``: book_id, sheet, pos, label, label_ref, value_ref, group.  ``merges``: book_id,
    sheet, r1, c1, r2, c2.  Rules that look at one entry come first, so that the claim rule (one
    field per value cell, earliest wins) is a single minimum over the survivors.
    """
    at = cells.select(*SHEET, "ref", "text")
    label_cell = at.select(*SHEET, F.col("ref").alias("label_ref"), F.col("text").alias("_label_text"))
    value_cell = at.select(*SHEET, F.col("ref").alias("value_ref"), F.col("text").alias("_value_text"))
    e = (
        entries.join(extents.select(*SHEET, "rows", "cols"), SHEET, "left")
        .join(label_cell, [*SHEET, "label_ref"], "left")
        .join(value_cell, [*SHEET, "value_ref"], "left")
        .withColumn("_l", parse_ref("label_ref"))
        .withColumn("_v", parse_ref("value_ref"))
    )
    cells_at = e.where("_v is not null").select(*SHEET, "pos", "_v.row", "_v.col")
    covered = covered_cells(cells_at, merges).select(*SHEET, "pos").distinct().withColumn("_covered", F.lit(True))
    e = e.join(covered, [*SHEET, "pos"], "left")

    def outside(p: str, text: str):
        inside = (F.col(f"{p}.col") <= F.coalesce("cols", F.lit(0)) + BLANK_MARGIN) & (
            F.col(f"{p}.row") <= F.coalesce("rows", F.lit(0)) + BLANK_MARGIN
        )
        return F.col(text).isNull() & ~inside

    shape = (
        F.col("label").isNull()
        | (F.length("label") == 0)
        | (F.length("label") > MAX_LABEL)
        | (F.length(F.coalesce("group", F.lit(""))) > MAX_GROUP)
        | F.col("label_ref").isNull()
        | F.col("value_ref").isNull()
    )
    reason = (
        F.when(shape, "not-a-field")
        .when(~is_cell_ref("label_ref"), "label-ref-no-address")
        .when(~is_cell_ref("value_ref"), "value-ref-no-address")
        .when(outside("_l", "_label_text"), "label-outside-sheet")
        .when(is_blank("_label_text"), "label-cell-empty")
        .when(outside("_v", "_value_text"), "value-outside-sheet")
        .when(F.col("_covered"), "value-covered-by-merge")
        .when(F.col("value_ref") == F.col("label_ref"), "value-is-label")
        .when(fold_key("label") == "", "label-blank")
        .when(~F.contains(fold_key("_label_text"), fold_key("label")), "label-not-in-cell")
    )
    e = e.withColumn("reason", reason)
    alive = e.where("reason is null")
    claims = alive.groupBy(*SHEET, "value_ref").agg(F.min("pos").alias("_claim"))
    accepted_labels = (
        alive.join(claims, [*SHEET, "value_ref"])
        .where("pos = _claim")
        .select(*SHEET, F.col("label_ref").alias("value_ref"))
        .distinct()
        .withColumn("_is_label", F.lit(True))
    )
    out = e.join(claims, [*SHEET, "value_ref"], "left").join(
        accepted_labels, [*SHEET, "value_ref"], "left"
    )
    late = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("pos") > F.col("_claim"), "value-cell-claimed")
        .when(F.col("_is_label"), "value-is-a-field-name")
    )
    return out.select(
        *SHEET,
        "pos",
        strip_space("label").alias("label"),
        "label_ref",
        "value_ref",
        strip_space(F.coalesce("group", F.lit(""))).alias("group"),
        F.coalesce("_value_text", F.lit("")).alias("excel_value"),
        late.alias("reason"),
    )


def interpret_workbooks(sheets: DataFrame, judged: DataFrame) -> DataFrame:
    """Per sheet, fields kept and refused, and a note code.

    ``sheets``: book_id, sheet, cells (0 for an empty sheet, which is never asked about).
    """
    n = judged.groupBy(*SHEET).agg(
        F.count_if(F.col("reason").isNull()).alias("fields"),
        F.count_if(F.col("reason").isNotNull()).alias("refused"),
    )
    s = sheets.join(n, SHEET, "left")
    s = s.withColumn("fields", F.coalesce("fields", F.lit(0))).withColumn("refused", F.coalesce("refused", F.lit(0)))
    note = (
        F.when(F.col("cells") == 0, "empty-sheet")
        .when((F.col("fields") == 0) & (F.col("refused") == 0), "no-field-found")
        .when(F.col("fields") == 0, "none-could-be-checked")
        .when(F.col("refused") == 0, "all-read")
        .otherwise("some-refused")
    )
    return s.select(*SHEET, "cells", "fields", "refused", note.alias("note"))


ANSWER = "id string, verdict string, documentValue string, page string, `from` string, `to` string"


def compare_answers(replies: DataFrame) -> DataFrame:
    """Entries of comparison replies, each parsed on its own; the first per id counts.

    ``replies``: run_id, chunk, reply.  An entry that cannot be read still takes its id.
    """
    e = reply_entries(replies, "fields").withColumn("a", F.from_json("entry", ANSWER))
    value = F.col("a.documentValue")
    readable = F.col("a.verdict").isin(*VERDICTS) & ~F.coalesce(
        F.regexp_like(value, F.lit(r"^\s*[\[{]")), F.lit(False)
    )
    whole = lambda c: F.when(F.regexp_like(c, F.lit("^[0-9]{1,9}$")), c).try_cast("int")
    rows = e.where("a.id is not null").select(
        "run_id",
        F.col("a.id").alias("field_id"),
        "chunk",
        "pos",
        F.coalesce(readable, F.lit(False)).alias("readable"),
        F.col("a.verdict").alias("verdict"),
        value.alias("document_value"),
        whole(F.col("a.page")).alias("position"),
        whole(F.col("a.from")).alias("from_line"),
        whole(F.col("a.to")).alias("to_line"),
    )
    return first_by(rows, FIELD, ["chunk", "pos"])


def refused_answers(replies: DataFrame) -> DataFrame:
    """run_id, chunk, pos, field_id, reason of everything in comparison replies that answers nothing.

    A reply that cannot be read is a row without a place; an entry is one if it has no id or its id was answered before.
    """
    whole = parse_replies(replies, "fields array<string>")
    reason = F.coalesce("error", F.when(F.col("parsed.fields").isNull(), "no-fields"))
    lost = whole.select("run_id", "chunk", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("field_id"), reason.alias("reason"))
    e = reply_entries(replies, "fields").withColumn("field_id", F.from_json("entry", ANSWER)["id"])
    first = e.where("field_id is not null").groupBy(*FIELD).agg(F.min(F.struct("chunk", "pos")).alias("_first"))
    e = e.join(first, FIELD, "left")
    again = F.struct("chunk", "pos") != F.col("_first")
    late = e.select("run_id", "chunk", "pos", "field_id", F.when(F.col("field_id").isNull(), "no-id").when(again, "answered-before").alias("reason"))
    return lost.unionByName(late).where("reason is not null")


def fold_comparison(
    fields: DataFrame, answers: DataFrame, pool: DataFrame, lines: DataFrame, pages: DataFrame
) -> DataFrame:
    """One verdict per field.

    ``fields``: run_id, field_id, excel_value.  ``answers`` from ``compare_answers``.  ``pool``:
    run_id, position, page_index of the open pages; a run without any finds nothing.
    """
    searched = pool.select("run_id").distinct().withColumn("_searched", F.lit(True))
    at = answers.join(pool.select("run_id", "position", "page_index"), ["run_id", "position"], "left")
    cited = whole_citations(
        at.select(*FIELD, "page_index", "from_line", "to_line"), lines, pages
    ).select(*FIELD, "page_index", "cited", "cited_text")
    f = (
        fields.join(searched, "run_id", "left")
        .join(answers, FIELD, "left")
        .join(cited, FIELD, "left")
    )
    value = strip_space(F.coalesce("document_value", F.lit("")))
    squeezed = lambda c: strip_space(F.regexp_replace(c, r"\s+", " "))
    v = F.col("verdict")
    reason = (
        F.when(F.col("_searched").isNull(), "nothing-searchable")
        .when(F.col("readable").isNull(), "model-silent")
        .when(~F.col("readable"), "answer-unreadable")
        .when(v == NOT_FOUND, "searched-and-absent")
        .when((v == "cocok") & is_blank("excel_value"), "match-on-empty-cell")
        .when((v == "beda") & (value == ""), "difference-without-value")
    )
    f = f.withColumn("reason", reason)
    same = squeezed(value) == squeezed(F.col("excel_value"))
    verdict = (
        F.when(F.col("reason").isNotNull(), NOT_FOUND)
        .when((v == "beda") & ~same, "beda")
        .otherwise("cocok")
    )
    f = f.withColumn("final", verdict)
    shown = (F.col("final") != NOT_FOUND) & F.coalesce("cited", F.lit(False))
    return f.select(
        *FIELD,
        "excel_value",
        F.col("final").alias("verdict"),
        "reason",
        F.when(F.col("final") == "beda", value).alias("document_value"),
        *[F.when(shown, F.col(c)).alias(c) for c in ("page_index", "from_line", "to_line", "cited_text")],
    )


def field_chunks(fields: DataFrame, size: int = FIELDS_PER_CALL) -> DataFrame:
    """The call each field goes into, forty to a call in field order (``pos``)."""
    numbered = number_rows(fields, ["run_id"], ["pos"], key_bucket("pos"), "_n")
    return numbered.withColumn("chunk", F.floor(F.col("_n") / size).cast("int")).drop("_n")


def fold_screens(
    fields: DataFrame, answers: DataFrame, extras: DataFrame, captures: DataFrame, lines: DataFrame, max_extra: int | None = None
) -> DataFrame:
    """One finding per field, then what the screens show that no field covers.

    ``captures``: run_id, page_index (the capture's position).  ``answers``: run_id, field_id, pos,
    verdict, value, page_index, from_line, to_line.  ``extras``: run_id, pos, label and the same.
    A failed citation keeps its reason and the verdict stands.  With
    ``max_extra``, the extras of a run that has more are one row of reason ``too-many-extras``; its fields stay.
    """
    seen = captures.where("page_index is not null").select("run_id").distinct().withColumn("_seen", F.lit(True))
    asked = fields.select("run_id").distinct()
    too_many = None
    if max_extra is not None:
        sized = extras.join(asked, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
        too_many = sized.where(F.col("_n") > max_extra).select("run_id")
        extras = extras.join(too_many, "run_id", "left_anti")
    first = first_by(answers, FIELD, ["pos"])
    claims = whole_citations(first, lines, captures).select(
        *FIELD, "verdict", "value", "page_index", "from_line", "to_line", "cited", F.col("reason").alias("cite_reason")
    )
    f = fields.join(seen, "run_id", "left").join(claims, FIELD, "left")
    value = strip_space(F.coalesce("value", F.lit("")))
    v = F.col("verdict")
    reason = (
        F.when(F.col("_seen").isNull(), "no-captures")
        .when(v.isNull(), "model-silent")
        .when((v == "beda") & (value == ""), "difference-without-value")
        .when(v == NOT_FOUND, "on-no-capture")
    )
    f = f.withColumn("_r", reason)
    lost = F.col("_r").isNotNull()
    shown = ~lost & F.coalesce("cited", F.lit(False))
    found = f.select(
        *FIELD,
        "label",
        F.when(lost, NOT_FOUND).otherwise(v).alias("verdict"),
        F.when(~lost & (value != ""), value).alias("screen_value"),
        *[F.when(shown, F.col(c)).alias(c) for c in ("page_index", "from_line", "to_line")],
        F.coalesce("_r", F.when(~lost, F.col("cite_reason"))).alias("reason"),
    )
    x = (
        extras.join(asked, "run_id", "left_semi")
        .join(seen, "run_id", "left_semi")
        .withColumn("label", strip_space("label"))
        .withColumn("value", strip_space(F.coalesce("value", F.lit(""))))
        .withColumn("_fold", fold_label("label"))
        .where("label <> '' and value <> ''")
    )
    known = fields.select("run_id", fold_label("label").alias("_fold")).distinct()
    x = first_by(x.join(known, ["run_id", "_fold"], "left_anti"), ["run_id", "_fold"], ["pos"])
    cited = whole_citations(x, lines, captures)
    here = F.col("cited")
    more = cited.select(
        "run_id",
        F.lit(None).cast("string").alias("field_id"),
        "label",
        F.lit(NOT_IN_SHEET).alias("verdict"),
        F.col("value").alias("screen_value"),
        *[F.when(here, F.col(c)).alias(c) for c in ("page_index", "from_line", "to_line")],
        "reason",
    )
    out = found.unionByName(more)
    if too_many is None:
        return out
    gone = too_many.withColumn("reason", F.lit("too-many-extras"))
    return out.unionByName(gone, allowMissingColumns=True)
