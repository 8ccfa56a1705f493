"""Request tables: what a model would be asked, as text parts.

A request is a question plus a listing.  Listings are built once per pool or source and cut into
parts of a bounded number of pages, so that no listing of a huge source is gathered into one cell;
bundles of ordinary size have exactly one part.  Requests refer to their listing by pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import PAGE, in_range, is_blank, key_bucket, number_rows, pack_lines, strip_space
from foliary.functions.cells import format_ref
from foliary.operators.pools import DOC, head_lines, page_heads
from foliary.operators.workbook_checks import field_chunks

# Listing limits of sheets and continuation context.
MAX_CELLS = 4000
MAX_MERGES = 200
MAX_CELL_TEXT = 120
CONTEXT_LINES = 6

PAGES_PER_PART = 200
SHEET = ["book_id", "sheet"]


def _joined(order: str, text: Column, sep: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda z: z["t"]), sep)


def _part(position: str, pages_per_part: int) -> Column:
    return F.floor(F.col(position) / pages_per_part).cast("int").alias("part")


def _numbered_lines(lines: Column) -> Column:
    return F.array_join(
        F.transform(lines, lambda l: F.concat(l["i"].cast("string"), F.lit(": "), l["text"])), "\n"
    )


def classify_listing(lines: DataFrame, pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """One line per page head, per source."""
    heads = page_heads(lines)
    p = pages.select(*PAGE, "source_id", "page_in_doc").join(heads, PAGE, "left")
    text = F.concat(F.lit("page "), F.col("page_in_doc").cast("string"), F.lit(": "), F.coalesce("head", F.lit("")))
    return p.groupBy(*DOC, _part("page_in_doc", pages_per_part)).agg(_joined("page_in_doc", text, "\n").alias("text"))


def pool_listing(pool: DataFrame, lines: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """R2: numbered lines of every page of a pool under its position (run_id, pool_id, position)."""
    listed = pack_lines(lines).select(*PAGE, _numbered_lines(F.col("lines")).alias("body"))
    p = pool.join(listed, PAGE, "left")
    text = F.concat(F.lit("--- page "), F.col("position").cast("string"), F.lit(" ---\n"), F.coalesce("body", F.lit("")))
    return p.groupBy("run_id", "pool_id", _part("position", pages_per_part)).agg(
        _joined("position", text, "\n\n").alias("text")
    )


def locate_questions(slots: DataFrame) -> DataFrame:
    """R2: one question per slot; ``slots``: run_id, slot_key, pool_id, label, hint."""
    q = F.concat(F.lit('field: "'), "label", F.lit('"\nmeaning: '), F.coalesce("hint", F.lit("")))
    return slots.select("run_id", "slot_key", "pool_id", q.alias("question"))


def pool_questions(slots: DataFrame, per_call: int = 1) -> DataFrame:
    """The slots of a pool in groups of ``per_call`` (``pos`` orders them)."""
    n = number_rows(slots, ["run_id", "pool_id"], ["pos"], key_bucket("pos"), "_n")
    item = F.concat(
        F.lit("- key: "), "slot_key", F.lit('\n  field: "'), "label", F.lit('"\n  meaning: '), F.coalesce("hint", F.lit(""))
    )
    return n.groupBy("run_id", "pool_id", F.floor(F.col("_n") / per_call).cast("int").alias("call")).agg(
        F.count(F.lit(1)).cast("int").alias("slots"), _joined("pos", item, "\n").alias("question")
    )


def field_questions(groups: DataFrame, hints: DataFrame) -> DataFrame:
    """The keys of a group, their definitions first.

    ``groups``: form_id, signature, keys (P4).  ``hints``: field_key, hint.
    """
    each = groups.select("form_id", "signature", "keys", F.posexplode(F.split("keys", ", ")).alias("at", "field_key"))
    defined = each.join(hints, "field_key", "left")
    line = F.when(F.col("hint").isNotNull(), F.concat(F.lit("  "), "field_key", F.lit(": "), "hint"))
    ordered = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("at", line.alias("t")))))
    g = defined.groupBy("form_id", "signature", "keys").agg(
        F.array_join(F.transform(ordered, lambda z: z["t"]), "\n").alias("definitions")
    )
    ask = F.concat(F.lit("Fields: "), "keys")
    return g.select(
        "form_id",
        "signature",
        F.when(F.col("definitions") == "", ask)
        .otherwise(F.concat(F.lit("FIELD DEFINITIONS\n"), "definitions", F.lit("\n\n"), ask))
        .alias("question"),
    )


def sections_listing(lines: DataFrame, pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Opening lines of every page of a source; a page without text is listed as such."""
    heads = pack_lines(head_lines(lines))
    p = pages.select(*PAGE, "source_id", "page_in_doc").join(heads, PAGE, "left")
    at = F.concat(F.lit("page "), F.col("page_in_doc").cast("string"), F.lit(":"))
    body = F.array_join(
        F.transform("lines", lambda l: F.concat(F.lit("\n  "), l["i"].cast("string"), F.lit(": "), l["text"])), ""
    )
    text = F.when(F.col("lines").isNull(), F.concat(at, F.lit(" (no text was recognised on this page)"))).otherwise(
        F.concat(at, body)
    )
    return p.groupBy(*DOC, _part("page_in_doc", pages_per_part)).agg(_joined("page_in_doc", text, "\n").alias("text"))


def continuation_questions(zones: DataFrame, lines: DataFrame, pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """The last lines of a block without furniture, and the next page by position.

    ``zones``: run_id, key, page_index, from_line, to_line.  ``furniture`` from F1.
    """
    f = furniture.groupBy(*PAGE).agg(F.collect_set("i").alias("_f"))
    here = pages.select(*PAGE, "source_id", "page_in_doc")
    nxt = pages.select(*DOC, (F.col("page_in_doc") - 1).alias("page_in_doc"), F.col("page_index").alias("next_page"))
    own = pack_lines(lines).withColumnRenamed("lines", "_own")
    after = pack_lines(lines).select("run_id", F.col("page_index").alias("next_page"), F.col("lines").alias("_next"))
    z = (
        zones.join(here, PAGE)
        .join(nxt, [*DOC, "page_in_doc"])
        .join(own, PAGE)
        .join(f, PAGE, "left")
        .join(after, ["run_id", "next_page"])
    )
    none = F.array().cast("array<int>")
    tail = F.filter(
        in_range(F.col("_own"), F.col("from_line"), F.col("to_line")),
        lambda l: ~F.array_contains(F.coalesce("_f", none), l["i"]),
    )
    z = z.withColumn("_tail", F.transform(tail, lambda l: l["text"]))
    n = F.size("_tail")
    shown = F.slice("_tail", F.greatest(n - CONTEXT_LINES, F.lit(0)) + 1, F.lit(CONTEXT_LINES))
    listing = F.array_join(
        F.transform("_next", lambda l, k: F.concat(k.cast("string"), F.lit(": "), l["text"])), "\n"
    )
    return z.select(
        "run_id",
        "key",
        F.least(n, F.lit(CONTEXT_LINES)).alias("shown"),
        F.array_join(shown, "\n").alias("tail"),
        F.concat(F.lit("--- next page ---\n"), listing).alias("listing"),
    )


def comparison_questions(fields: DataFrame, retry: bool = False, size: int = 40) -> DataFrame:
    """Field listings of forty fields to a call; an empty cell is marked.

    ``fields``: run_id, field_id, pos, label, group, excel_value.
    """
    quote = lambda c: F.to_json(F.struct(c.alias("v")))
    bare = lambda c: F.regexp_extract(quote(c), r'(?s)^\{"v":(.*)\}$', 1)
    item = F.concat(
        F.lit("- id: "), "field_id", F.lit("\n  field: "), bare(F.col("label")),
        F.when(F.coalesce("group", F.lit("")) != "", F.concat(F.lit("\n  row: "), bare(F.col("group")))).otherwise(""),
        F.when(is_blank("excel_value"), "\n  the spreadsheet cell is EMPTY").otherwise(
            F.concat(F.lit("\n  the spreadsheet says: "), bare(F.col("excel_value")))
        ),
    )
    return field_chunks(fields, size).groupBy("run_id", "chunk").agg(
        F.count(F.lit(1)).cast("int").alias("fields"),
        F.lit(retry).alias("retry"),
        _joined("pos", item, "\n").alias("question"),
    )


def screen_listing(captures: DataFrame, lines: DataFrame, per_part: int = PAGES_PER_PART) -> DataFrame:
    """Numbered lines of every capture; one without text is marked.

    ``captures``: run_id, page_index (its position).
    """
    listed = pack_lines(lines).select(*PAGE, _numbered_lines(F.col("lines")).alias("body"))
    c = captures.select(*PAGE).join(listed, PAGE, "left")
    text = F.concat(
        F.lit("--- capture "), F.col("page_index").cast("string"), F.lit(" ---\n"),
        F.coalesce("body", F.lit("(no text was recognised on this screen capture)")),
    )
    return c.groupBy("run_id", _part("page_index", per_part)).agg(_joined("page_index", text, "\n\n").alias("text"))


# ------------------------------------------------------------------ sheets


def cell_text(c: str) -> Column:
    """Text of a cell on one line, cut with a note of how much was cut."""
    flat = strip_space(F.regexp_replace(F.regexp_replace(F.col(c), r"[\x00-\x1F\x7F]", " "), r"\s+", " "))
    return (
        F.when(flat == "", "(blank)")
        .when(F.length(flat) <= MAX_CELL_TEXT, flat)
        .otherwise(
            F.concat(
                F.substring(flat, 1, MAX_CELL_TEXT), F.lit("... (+"), (F.length(flat) - MAX_CELL_TEXT).cast("string"), F.lit(" chars cut)")
            )
        )
    )


def _gap(frm: Column, to: Column, row: Column) -> Column:
    one = F.concat(F.lit("<"), format_ref(frm, row), F.lit(" empty>"))
    many = F.concat(F.lit("<"), format_ref(frm, row), F.lit(":"), format_ref(to, row), F.lit(" empty>"))
    return F.when(frm == to, one).otherwise(many)


def sheet_rows(cells: DataFrame, extents: DataFrame, max_cells: int | None = None) -> DataFrame:
    """One text line per sheet row with empty-gap markers.

    With ``max_cells``, only the first cells in row-major order are listed -- the limit of one listing.
    They are ranked in buckets of rows, so a sheet of millions of cells is never sorted in one task; without
    a limit nothing is ranked.
    """
    ranked = cells
    if max_cells is not None:
        bucket = F.floor(F.col("row") / 4096)
        ranked = number_rows(cells, SHEET, ["row", "col"], bucket, "_at").where(F.col("_at") < max_cells)
    prev = F.lag("col").over(W.partitionBy(*SHEET, "row").orderBy("col"))
    tag = F.when(F.col("kind") == "text", "").otherwise(F.concat(F.lit(" ("), "kind", F.lit(")")))
    item = F.concat("ref", F.lit(": "), cell_text("text"), tag)
    gap = _gap(F.col("_p") + 1, F.col("col") - 1, F.col("row"))
    c = ranked.withColumn("_p", prev).withColumn(
        "piece", F.when(F.col("col") > F.col("_p") + 1, F.concat(gap, F.lit(" | "), item)).otherwise(item)
    )
    rows = c.groupBy(*SHEET, "row").agg(_joined("col", F.col("piece"), " | ").alias("body"), F.max("col").alias("_last"))
    r = rows.join(extents.select(*SHEET, "cols"), SHEET)
    tail = F.when(
        F.col("cols") > F.col("_last"), F.concat(F.lit(" | "), _gap(F.col("_last") + 1, F.col("cols"), F.col("row")))
    ).otherwise("")
    # the row above within its 4,096 rows, and for the first of those the last row of an earlier bucket
    r = r.withColumn("_b", F.floor(F.col("row") / 4096))
    above = F.lag("row").over(W.partitionBy(*SHEET, "_b").orderBy("row"))
    before = F.max("_top").over(W.partitionBy(*SHEET).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    tops = r.groupBy(*SHEET, "_b").agg(F.max("row").alias("_top")).select(*SHEET, "_b", before.alias("_before"))
    r = r.withColumn("_above", above).join(tops, [*SHEET, "_b"]).withColumn("_above", F.coalesce("_above", "_before"))
    first, last = F.col("_above") + 1, F.col("row") - 1
    skip = F.when(first == last, F.concat(F.lit("<row "), first.cast("string"), F.lit(" empty>\n"))).otherwise(
        F.concat(F.lit("<rows "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" empty>\n"))
    )
    text = F.concat(F.lit("r"), F.col("row").cast("string"), F.lit(" | "), "body", tail)
    return r.select(
        *SHEET, "row", F.when(F.col("row") > F.col("_above") + 1, F.concat(skip, text)).otherwise(text).alias("text")
    )


def sheet_listings(
    cells: DataFrame, extents: DataFrame, merges: DataFrame, max_cells: int = MAX_CELLS, max_merges: int = MAX_MERGES
) -> DataFrame:
    """The listing of each sheet with its merges and truncation note.

    ``merges``: book_id, sheet, range, pos.  Bounded by the two limits.
    """
    rows = sheet_rows(cells, extents, max_cells).groupBy(*SHEET).agg(_joined("row", F.col("text"), "\n").alias("body"))
    top = number_rows(merges, SHEET, ["pos"], key_bucket("pos"), "_at")
    m = top.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("_m"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_at") < max_merges, F.struct("_at", "range")))), lambda z: z["range"]
            ),
            ", ",
        ).alias("_ranges"),
    )
    s = extents.join(rows, SHEET, "left").join(m, SHEET, "left")
    n = F.coalesce("_m", F.lit(0))
    merged = F.when(n == 0, "merged: none").otherwise(
        F.concat(
            F.lit("merged: "), "_ranges",
            F.when(n > max_merges, F.concat(F.lit(f" ({max_merges} of "), n.cast("string"), F.lit(" shown)"))).otherwise(""),
        )
    )
    cut = F.concat_ws(
        ", and ",
        F.when(F.col("cells") > max_cells, F.concat(F.col("cells").cast("string"), F.lit(f" non-empty cells cut to the first {max_cells}"))),
        F.when(n > max_merges, F.concat(n.cast("string"), F.lit(f" merged ranges cut to the first {max_merges}"))),
    )
    head = F.concat(
        F.lit('--- sheet "'), "sheet", F.lit('" ---\ndimension '), "dimension", F.lit(" ("), F.col("rows").cast("string"), F.lit(" rows x "),
        F.col("cols").cast("string"), F.lit(" columns), "), F.col("cells").cast("string"), F.lit(" non-empty cells"),
    )
    return s.select(
        *SHEET,
        F.concat_ws("\n", head, merged, F.coalesce("body", F.lit("(no non-empty cells)"))).alias("listing"),
        F.nullif(cut, F.lit("")).alias("truncation"),
    )


# ------------------------------------------------------------------ work lists


def work_requests(
    wanted: DataFrame, walk: DataFrame, discover: DataFrame, pages: DataFrame, sources: DataFrame
) -> DataFrame:
    """One table of what a run would send: pages (fenced ones without lines) and work lists."""
    fenced = sources.where("ai = false").select(*DOC).withColumn("_shut", F.lit(True))
    p = pages.select(*PAGE, "source_id").join(fenced, DOC, "left")
    row = lambda df, kind, key, flag: df.select(
        "run_id", F.lit(kind).alias("kind"), key.cast("string").alias("item"), flag.alias("searchable")
    )
    yes = F.lit(True)
    return (
        row(p, "page", F.col("page_index"), F.col("_shut").isNull())
        .unionByName(row(wanted, "wanted", F.col("key"), yes))
        .unionByName(row(walk, "walk", F.col("key"), yes))
        .unionByName(row(discover, "discover", F.col("source_id"), yes))
    )
