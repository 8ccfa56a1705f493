"""Raw spreadsheet cells to typed cells and sheet extents.

``cells_raw``: book_id, sheet, ref, t, v, inline, s, has_formula.  Shared strings and styles are
keyed by book_id, so a corpus of many books is one table each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import first_by, strip_space
from foliary.functions.cells import (
    format_class,
    number_to_col,
    parse_ref,
    plain_number,
    serial_to_date,
)

SHEET = ["book_id", "sheet"]


def style_formats(styles: DataFrame) -> DataFrame:
    """Format class of every style; ``styles``: book_id, s, format_id, format_code."""
    return styles.select("book_id", "s", format_class("format_id", "format_code").alias("format"))


def type_cells(
    cells_raw: DataFrame, shared_strings: DataFrame, styles: DataFrame, books: DataFrame
) -> DataFrame:
    """The typed text, raw text (when it differs) and kind of each non-blank cell."""
    strings = shared_strings.select(
        "book_id", F.col("idx").alias("_idx"), F.col("text").alias("_shared")
    )
    c = (
        cells_raw.join(style_formats(styles), ["book_id", "s"], "left")
        .join(books.select("book_id", "date1904"), "book_id")
        .withColumn("_idx", F.when(F.col("t") == "s", F.col("v").try_cast("int")))
        .join(strings, ["book_id", "_idx"], "left")
    )
    t = F.coalesce("t", F.lit("n"))
    c = c.withColumn("_stored", strip_space(F.coalesce("v", F.lit(""))))
    stored, blank = F.col("_stored"), F.col("_stored") == ""
    number = ~t.isin("s", "inlineStr", "str", "b", "e") & ~blank
    # each step is a column of its own, so that the number text is worked out once
    c = c.withColumn("_x", F.when(number, stored.try_cast("double")))
    x = F.col("_x")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    c = c.withColumn(
        "_date", F.when(finite & (F.col("format") == "date"), serial_to_date(x, "date1904"))
    )
    c = c.withColumn("_percent", F.coalesce(finite & (F.col("format") == "percent"), F.lit(False)))
    shown = F.when(F.col("_percent"), (x * 100).cast("string")).otherwise(stored)
    c = c.withColumn("_plain", F.when(number & F.col("_date").isNull(), plain_number(shown)))
    text = (
        F.when(t == "s", F.when(~blank, F.col("_shared")))
        .when(t == "inlineStr", F.coalesce("inline", F.lit("")))
        .when(t.isin("str", "e"), F.coalesce("v", F.lit("")))
        .when(blank, F.lit(None).cast("string"))
        .when(t == "b", F.when(stored == "1", "TRUE").otherwise("FALSE"))
        .when(F.col("_date").isNotNull(), F.col("_date"))
        .when(F.col("_percent"), F.concat("_plain", F.lit("%")))
        .otherwise(F.col("_plain"))
    )
    kind = (
        F.when(t.isin("s", "inlineStr", "e"), "text")
        .when(t == "str", "formula")
        .when(t == "b", "boolean")
        .when(F.col("_date").isNotNull(), "date")
        .otherwise("number")
    )
    raw = (
        F.when(t.isin("s", "inlineStr", "str", "e"), F.lit(None).cast("string"))
        .when(t == "b", F.when(stored == "1", "1").otherwise("0"))
        .when(F.col("_date").isNotNull() | F.col("_percent"), stored)
        .when(F.col("_plain") != stored, stored)
    )
    at = parse_ref("ref")
    extra = [k for k in ("pos",) if k in cells_raw.columns]
    typed = c.select(
        *SHEET,
        "ref",
        at["row"].alias("row"),
        at["col"].cast("int").alias("col"),
        strip_space(text).alias("text"),
        raw.alias("raw"),
        F.when(F.col("has_formula"), "formula").otherwise(kind).alias("kind"),
        *extra,
    )
    return typed.where("text <> ''")


def sheet_extents(cells: DataFrame) -> DataFrame:
    """Rows, columns and dimension of each sheet."""
    g = cells.groupBy(*SHEET).agg(
        F.max("row").alias("rows"), F.max("col").alias("cols"), F.count(F.lit(1)).alias("cells")
    )
    return g.withColumn(
        "dimension", F.concat(F.lit("A1:"), number_to_col("cols"), F.col("rows").cast("string"))
    )


def first_at_address(cells: DataFrame) -> DataFrame:
    """The first cell stated for an address wins."""
    return first_by(cells, [*SHEET, "ref"], ["pos"])
