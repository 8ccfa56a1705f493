"""Boxes, lines and zones on a page.

``lines`` carries run_id, page_index, i, text, x, y, w, h, origin.  Operators that need a page's
lines pack them once per page and work in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import (
    BOX,
    PAGE,
    bind,
    col,
    in_range,
    joined_text,
    key_bucket,
    median_of,
    number_rows,
    pack_lines,
    padded,
    union_box_aggs,
    union_of,
)
from foliary.functions.keys import to_fixed
from foliary.sources.annotation_text import BOX_TYPE, joined, less, lists_of, offsets_of, pieces, places, row_type, sizes_of

# Padding, footer trimming, snapping, drag and resolution constants.
CROP_PADDING = 12.0
FOOTER_GAP_MULTIPLE = 16
MIN_LINES_FOR_TRIM = 4
MAX_FOOTER_LINES = 4
TOUCH_RATIO = 0.4
MIN_DRAG = 24
SPANS_PAGE_RATIO = 0.8
DOTS_PER_INCH = 300
ROW_TOLERANCE = 0.5
NO_LINE = -1


def union_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """G1: smallest box covering every box of a key."""
    return boxes.groupBy(*keys).agg(*union_box_aggs())


def pad_boxes(boxes: DataFrame, pad: float) -> DataFrame:
    """Grow and clip; expects x, y, w, h and the page's width and height."""
    box = F.struct(*BOX)
    return boxes.withColumn("_b", padded(box, pad, F.col("width"), F.col("height"))).select(
        *[c for c in boxes.columns if c not in BOX], "_b.*"
    )


# ------------------------------------------------------------------ words -> lines


def grown(v: Column, group: Column | None = None) -> Column:
    """A group (top, bottom, members) with a member more, or one of its own."""
    top, bottom = v["y"], v["y"] + v["h"]
    if group is None:
        return F.struct(top.alias("top"), bottom.alias("bottom"), F.array(v).alias("members"))
    return F.struct(
        F.least(group["top"], top).alias("top"),
        F.greatest(group["bottom"], bottom).alias("bottom"),
        F.concat(group["members"], F.array(v)).alias("members"),
    )


def fold_groups(df: DataFrame, order: list[str], starts: Column, follows: Column, member: Column, step) -> DataFrame:
    """An order-dependent fold of a page's rows into numbered groups, without Python.

    ``starts`` marks rows (in ``order``) that cannot belong to a group before them.  Between two marks the
    rows are packed; a run whose rows all ``follows`` is one group, any other is folded by ``step(groups, member)``.
    Runs hold what touches on a page, so a page of any length is a window and a sum over its runs.  Gives ``PAGE``,
    ``number`` and the group's ``members``.
    """
    w = W.partitionBy(*PAGE).orderBy(*order)
    marked = df.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    marked = marked.withColumn("_follows", (F.col("_starts") == 1) | F.coalesce(follows, F.lit(False)))
    runs = marked.groupBy(*PAGE, "_run").agg(
        F.array_sort(F.collect_list(member)).alias("_ms"), F.bool_and("_follows").alias("_one")
    )
    kind = runs.schema["_ms"].dataType.elementType.simpleString()
    none = F.array().cast(f"array<struct<top:double,bottom:double,members:array<{kind}>>>")
    folds = F.transform(F.aggregate("_ms", none, step), lambda g: g["members"])
    groups = F.when(F.col("_one"), F.array("_ms")).otherwise(folds)
    folded = runs.select(*PAGE, "_run", groups.alias("_gs"))
    before = W.partitionBy(*PAGE).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    folded = folded.withColumn("_before", F.coalesce(F.sum(F.size("_gs")).over(before), F.lit(0)))
    each = folded.select(*PAGE, "_before", F.posexplode("_gs").alias("_k", "members"))
    return each.select(*PAGE, (F.col("_before") + F.col("_k")).cast("int").alias("number"), "members")


def member_box(members: Column) -> list[Column]:
    """Union box of a group's members."""
    least = lambda f: F.array_min(F.transform(members, f))
    most = lambda f: F.array_max(F.transform(members, f))
    x, y = least(lambda v: v["x"]), least(lambda v: v["y"])
    return [
        x.alias("x"),
        y.alias("y"),
        (most(lambda v: v["x"] + v["w"]) - x).alias("w"),
        (most(lambda v: v["y"] + v["h"]) - y).alias("h"),
    ]


def _first_fit(tolerance: float):
    """The first row whose growing extent the word overlaps enough takes it; else it opens a row."""

    def step(rows: Column, v: Column) -> Column:
        top, bottom = v["y"], v["y"] + v["h"]
        fits = F.transform(rows, lambda r: F.least(bottom, r["bottom"]) - F.greatest(top, r["top"]) >= v["h"] * tolerance)
        return bind(
            F.array_position(fits, True),
            lambda at: F.when(at == 0, F.concat(rows, F.array(grown(v)))).otherwise(
                F.transform(rows, lambda r, k: F.when(k + 1 == at, grown(v, r)).otherwise(r))
            ),
        )

    return step


def group_words_into_lines(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Greedy first-fit of words into rows, then rows numbered in order of creation.

    A word below every word before it opens a row in any case, so a page falls into short runs; one shuffle, by page.
    Words come by their tops, so as long as a run has one row, its extent is from the first top to the deepest bottom.
    """
    extra = [c for c in words.columns if c in ("interpolated",)]
    deepest = F.max(F.col("y") + F.col("h")).over(W.partitionBy(*PAGE).orderBy("y", "seq").rowsBetween(W.unboundedPreceding, -1))
    member = F.struct("y", "seq", "x", "w", "h", "text", *extra)
    overlap = F.least(F.col("y") + F.col("h"), deepest) - F.col("y")
    rows = fold_groups(words, ["y", "seq"], F.col("y") > deepest, overlap >= F.col("h") * tolerance, member, _first_fit(tolerance))
    by_x = F.array_sort(F.transform("members", lambda v, k: F.struct(v["x"].alias("x"), k.alias("k"), v["text"].alias("text"))))
    out = rows.select(
        *PAGE,
        F.col("number").alias("i"),
        F.array_join(F.transform(by_x, lambda t: t["text"]), " ").alias("text"),
        *member_box(F.col("members")),
        F.size("members").alias("n_words"),
        *[F.when(F.exists("members", lambda v: v["interpolated"]), "interpolated").otherwise("measured").alias("origin") for _ in extra],
    )
    return out


LINE_TYPE = pa.struct([("text", pa.string()), *BOX_TYPE, ("n_words", pa.int32())])
# Fixed value: how many words are grouped at a time.
PIECE_WORDS = 200_000


def _first_fits(top: list[float], bottom: list[float], height: list[float]) -> list[int]:
    """The row of each word of a run; NaN is above all numbers, as it is in Spark."""
    below = lambda a, b: a < b or (b != b and a == a)
    least, most = (lambda a, b: b if below(b, a) else a), (lambda a, b: b if below(a, b) else a)
    rows, found = [], []
    for t, b, h in zip(top, bottom, height):
        for at, r in enumerate(rows):
            if not below(least(b, r[1]) - most(t, r[0]), h * ROW_TOLERANCE):
                r[:] = least(r[0], t), most(r[1], b)
                break
        else:
            at = len(rows)
            rows.append([t, b])
        found.append(at)
    return found


def _packed_lines(pages: pa.Array) -> pa.Array:
    page, seq = places(sizes_of(pages))
    words = pages.flatten()
    if not len(words):
        return lists_of(pa.array([], LINE_TYPE), np.zeros(len(pages), dtype=np.int64))
    x, y, w, h = (pc.struct_field(words, c).to_numpy(zero_copy_only=False) for c in BOX)
    order = np.lexsort((seq, y, page))
    x, y, w, h = (v[order] for v in (x, y, w, h))
    bottom, deepest = y + h, np.full(len(y), -np.inf)
    at = np.flatnonzero(np.diff(page, prepend=-1, append=-1))
    for begin, end in zip(at[:-1], at[1:]):
        deepest[begin + 1 : end] = np.maximum.accumulate(bottom[begin : end - 1])
    starts = less(deepest, y)
    starts[at[:-1]] = True
    follows = starts | ~less(np.fmin(bottom, deepest) - y, h * ROW_TOLERANCE)
    runs = np.flatnonzero(starts)
    rows, number = np.ones(len(runs), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    ends = np.append(runs[1:], len(y))
    for run in np.flatnonzero(~np.logical_and.reduceat(follows, runs)):
        inside = slice(runs[run], ends[run])
        number[inside] = _first_fits(y[inside].tolist(), bottom[inside].tolist(), h[inside].tolist())
        rows[run] = number[inside].max() + 1
    line = offsets_of(rows)[np.cumsum(starts) - 1] + number
    by_x = np.lexsort((np.arange(len(x)), x, line))
    x, y, right, bottom = x[by_x], y[by_x], (x + w)[by_x], bottom[by_x]
    sizes = np.bincount(line)
    begin = offsets_of(sizes)[:-1]
    left, top = np.fmin.reduceat(x, begin), np.fmin.reduceat(y, begin)
    box = [left, top, np.maximum.reduceat(right, begin) - left, np.maximum.reduceat(bottom, begin) - top]
    text = joined(pc.struct_field(words, "text").take(pa.array(order[by_x])), sizes, " ")
    columns = [text, *map(pa.array, box), pa.array(sizes, pa.int32())]
    per_page = np.bincount(page[runs], weights=rows, minlength=len(pages)).astype(np.int64)
    return lists_of(pa.StructArray.from_arrays(columns, fields=list(LINE_TYPE)), per_page)


@F.arrow_udf(row_type(pa.list_(LINE_TYPE)))
def group_packed_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """G3 in a page's row: its words, an array in the order of ``seq``, to an array of lines; no value is null."""
    for pages in batches:
        for part in pieces(sizes_of(pages), PIECE_WORDS):
            yield _packed_lines(pages[part])


# ------------------------------------------------------------------ checks on lines


def line_violations(lines: DataFrame, pages: DataFrame, pos: str = "pos") -> DataFrame:
    """Every line that breaks a rule, with the first rule it breaks.

    Rules in order: number differs from position, box not finite, no area, off the page, above the
    line before it.
    """
    prev = F.lag("y").over(W.partitionBy(*PAGE).orderBy(pos))
    rows = lines.withColumn("_prev", prev).join(
        pages.select(*PAGE, "width", "height"), PAGE
    )
    finite = F.lit(True)
    for c in BOX:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rule = (
        F.when(F.col("i") != F.col(pos), "number-is-not-position")
        .when(~finite, "box-not-finite")
        .when((F.col("w") <= 0) | (F.col("h") <= 0), "no-area")
        .when(
            (F.col("x") < 0)
            | (F.col("y") < 0)
            | (F.col("x") + F.col("w") > F.col("width"))
            | (F.col("y") + F.col("h") > F.col("height")),
            "off-page",
        )
        .when(F.col("y") < F.col("_prev"), "above-previous")
    )
    return rows.withColumn("rule", rule).where("rule is not null").select(*PAGE, pos, "i", "rule")


# ------------------------------------------------------------------ ranges (packed lines)


def with_page_lines(zones: DataFrame, lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Zones with their page's packed ``lines`` (null when the page has none) and its size."""
    out = zones.join(pack_lines(lines), PAGE, "left")
    if pages is not None:
        size = pages.select(*PAGE, "width", "height", F.lit(True).alias("page_exists"))
        out = out.join(size, PAGE, "left")
    return out


def clamp_range(lines: Column, frm: Column, to: Column) -> Column:
    """End of the range cut to the page's highest line number, and whether that happened."""
    last = F.array_max(F.transform(lines, lambda l: l["i"]))
    clamped = F.coalesce((frm <= last) & (to > last), F.lit(False))
    return F.struct(
        F.when(clamped, last).otherwise(to).cast("int").alias("to_line"), clamped.alias("clamped")
    )


def _pitches(picked: Column) -> Column:
    def steps(ys: Column) -> Column:
        n = F.greatest(F.size(ys) - 1, F.lit(0))
        return F.zip_with(F.slice(ys, F.lit(2), n), F.slice(ys, F.lit(1), n), lambda b, a: b - a)

    return bind(F.transform(picked, lambda l: l["y"]), steps)


def _last_wide_gap(pitches: Column, typical: Column) -> Column:
    """0-based place of the last wide gap, or null."""
    at = F.transform(
        pitches, lambda p, k: F.when(p >= typical * FOOTER_GAP_MULTIPLE, k).otherwise(F.lit(-1))
    )
    return F.nullif(F.array_max(at), F.lit(-1))


def trim_footer(lines: Column, frm: Column, to: Column) -> Column:
    """End of the range without a running footer; unchanged wherever the test declines."""

    def judge(picked: Column) -> Column:
        n = F.size(picked)

        def cut_at(pitches: Column) -> Column:
            return bind(
                median_of(pitches),
                lambda typical: F.when(typical > 0, _last_wide_gap(pitches, typical)),
            )

        def end(cut: Column) -> Column:
            kept = cut + 1
            fires = (
                (n >= MIN_LINES_FOR_TRIM)
                & (n - kept <= MAX_FOOTER_LINES)
                & (kept >= MIN_LINES_FOR_TRIM)
            )
            last_kept = F.try_element_at(picked, kept.cast("int"))["i"]
            return F.when(F.coalesce(fires, F.lit(False)), last_kept).otherwise(to)

        return bind(bind(_pitches(picked), cut_at), end)

    return bind(F.transform(in_range(lines, frm, to), lambda l: F.struct(l["i"], l["y"])), judge)


def range_error(lines: Column, frm: Column, to: Column) -> Column:
    """Why a range has no box: 'reversed', 'missing-lines', or null."""
    have = F.coalesce(F.size(in_range(lines, frm, to)), F.lit(0))
    return F.when(frm > to, "reversed").when(have != to - frm + 1, "missing-lines")


def box_of_range(lines: Column, frm: Column, to: Column, pad: float, w: Column, h: Column) -> Column:
    """Padded union of the lines in the range."""
    return bind(
        in_range(lines, frm, to), lambda picked: bind(union_of(picked), lambda b: padded(b, pad, w, h))
    )


def boxes_for_ranges(
    zones: DataFrame, lines: DataFrame, pages: DataFrame, pad: float = CROP_PADDING
) -> DataFrame:
    """G5 over a table of zones: box columns, or an ``error``."""
    z = with_page_lines(zones, lines, pages)
    f, t = F.col("from_line"), F.col("to_line")
    err = F.when(F.col("page_exists").isNull(), "unknown-page").otherwise(
        range_error(F.col("lines"), f, t)
    )
    box = box_of_range(F.col("lines"), f, t, pad, F.col("width"), F.col("height"))
    return z.withColumn("error", err).withColumn("_b", F.when(F.col("error").isNull(), box)).select(
        *zones.columns, "_b.*", "error"
    )


def resolve_ranges(answers: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Clamp, trim, box and text of each answered range.

    Answers carry page_index, from_line, to_line and confidence; any of the first three being
    null means the model found nothing.
    """
    z = with_page_lines(answers, lines, pages)
    f, L = F.col("from_line"), F.col("lines")
    found = F.col("page_index").isNotNull() & f.isNotNull() & F.col("to_line").isNotNull()
    z = z.withColumn("_c", clamp_range(L, f, F.col("to_line")))
    z = z.withColumn("_to", trim_footer(L, f, F.col("_c.to_line")))
    err = (
        F.when(~found, F.lit(None).cast("string"))
        .when(F.col("page_exists").isNull(), "not-a-page-offered")
        .otherwise(range_error(L, f, F.col("_to")))
    )
    z = z.withColumn("error", err)
    ok = found & F.col("error").isNull()
    box = box_of_range(L, f, F.col("_to"), CROP_PADDING, F.col("width"), F.col("height"))
    keep = [c for c in answers.columns if c not in ("to_line", "confidence")]
    return (
        z.withColumn("_b", F.when(ok, box))
        .withColumn("text", F.when(ok, joined_text(in_range(L, f, F.col("_to")))))
        .select(
            *keep,
            F.when(ok, F.col("_to")).cast("int").alias("to_line"),
            "_b.*",
            "text",
            F.when(ok, F.when(F.col("_c.clamped"), "low").otherwise(F.col("confidence"))).alias(
                "confidence"
            ),
            F.when(F.col("error").isNotNull(), "error")
            .when(found, "found")
            .otherwise("none")
            .alias("outcome"),
            "error",
        )
    )


# ------------------------------------------------------------------ drags


def touched_lines(lines: Column, y: Column, h: Column, ratio: float = TOUCH_RATIO) -> Column:
    """Lines of which at least ``ratio`` of the height lies inside the box's extent."""
    return F.filter(
        lines,
        lambda l: (l["h"] > 0)
        & (F.least(y + h, l["y"] + l["h"]) - F.greatest(y, l["y"]) >= l["h"] * ratio),
    )


def lines_inside(lines: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Lines whose box lies fully inside."""
    return F.filter(
        lines,
        lambda l: (l["y"] >= y)
        & (l["y"] + l["h"] <= y + h)
        & (l["x"] >= x)
        & (l["x"] + l["w"] <= x + w),
    )


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box cut to the page."""
    wide, high = width.cast("double"), height.cast("double")
    cx = F.greatest(F.lit(0.0), F.least(x, wide))
    cy = F.greatest(F.lit(0.0), F.least(y, high))
    r = F.least(wide, F.greatest(x + w, cx))
    b = F.least(high, F.greatest(y + h, cy))
    return F.struct(cx.alias("x"), cy.alias("y"), (r - cx).alias("w"), (b - cy).alias("h"))


def normalize_drag(x1: str, y1: str, x2: str, y2: str) -> Column:
    """Two corners to a box."""
    return F.struct(
        F.least(x1, x2).alias("x"),
        F.least(y1, y2).alias("y"),
        F.abs(F.col(x1) - F.col(x2)).alias("w"),
        F.abs(F.col(y1) - F.col(y2)).alias("h"),
    )


def is_meaningful_drag(w: Column, h: Column) -> Column:
    return (w >= MIN_DRAG) & (h >= MIN_DRAG)


def draw_zones(
    drags: DataFrame, lines: DataFrame, pages: DataFrame, pad: float = CROP_PADDING
) -> DataFrame:
    """A snapped zone over the touched lines, else a free box citing what it contains.

    ``drags`` carries run_id, page_index, x, y, w, h and a Boolean ``snap``.
    """
    z = drags.join(pages.select(*PAGE, "width", "height"), PAGE).join(
        pack_lines(lines), PAGE, "left"
    )
    x, y, w, h = (F.col(c) for c in BOX)
    none = F.array().cast("array<int>")
    touched = F.coalesce(F.transform(touched_lines(F.col("lines"), y, h), lambda l: l["i"]), none)
    z = z.withColumn("_t", F.when(F.col("snap"), touched).otherwise(none))
    z = z.withColumn("_free", clamp_box(x, y, w, h, F.col("width"), F.col("height")))
    whole = lines_inside(
        F.col("lines"), F.col("_free.x"), F.col("_free.y"), F.col("_free.w"), F.col("_free.h")
    )
    z = z.withColumn("_in", F.coalesce(F.transform(whole, lambda l: l["i"]), none))
    snapped = F.size("_t") > 0
    f, t = F.array_min("_t"), F.array_max("_t")
    box = box_of_range(F.col("lines"), f, t, pad, F.col("width"), F.col("height"))
    keep = [c for c in drags.columns if c not in (*BOX, "snap")]
    return z.withColumn("_b", F.when(snapped, box).otherwise(F.col("_free"))).select(
        *keep,
        "_b.*",
        F.when(snapped, f).otherwise(F.coalesce(F.array_min("_in"), F.lit(NO_LINE))).alias("from_line"),
        F.when(snapped, t).otherwise(F.coalesce(F.array_max("_in"), F.lit(NO_LINE))).alias("to_line"),
        F.when(snapped, "snapped").otherwise("free").alias("mode"),
    )


# ------------------------------------------------------------------ citation cards


def resolve_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Source name, place among the source's pages, and pages in the document.

    ``pages`` needs run_id, page_index and source_id only; the place is numbered in buckets.
    """
    placed = number_rows(
        pages, ["run_id", "source_id"], ["page_index"], key_bucket("page_index"), "place"
    )
    siblings = pages.groupBy("run_id", "source_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    named = sources.select(
        "run_id", "source_id", F.col("name").alias("_name"), F.col("page_count").alias("_count")
    )
    return (
        placed.join(siblings, ["run_id", "source_id"])
        .join(named, ["run_id", "source_id"], "left")
        .select(
            *pages.columns,
            F.coalesce("_name", "source_id").alias("source_name"),
            "place",
            F.coalesce("_count", "_n").alias("pages_in_doc"),
        )
    )


def size_in_cm(w: Column, h: Column, dpi: int = DOTS_PER_INCH) -> Column:
    cm = lambda px: F.translate(to_fixed(px / dpi * 2.54, 1), ".", ",")
    return F.concat(cm(w), F.lit(" x "), cm(h), F.lit(" cm"))


def interpolated_in(lines: Column, frm: Column, to: Column) -> Column:
    """How many lines of the range were sliced rather than returned."""
    return F.size(F.filter(in_range(lines, frm, to), lambda l: l["origin"] == "interpolated"))


def cite_zones(zones: DataFrame, lines: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """One citation card per zone that names a page of its run."""
    card = resolve_pages(pages.select(*PAGE, "source_id"), sources).drop("source_id")
    z = with_page_lines(zones, lines).join(pages.select(*PAGE, "width", "height"), PAGE)
    z = z.join(card, PAGE)
    f, t, x, y, w, h = (F.col(c) for c in ("from_line", "to_line", *BOX))
    cited = (f >= 0) & (t >= 0)
    whole = (
        (F.col("width") > 0)
        & (F.col("height") > 0)
        & (x <= 0)
        & (y <= 0)
        & (w >= F.col("width"))
        & (h >= F.col("height"))
    )
    share = F.when(F.col("height") > 0, h / F.col("height")).otherwise(0.0)
    keep = [c for c in zones.columns if c not in (*BOX, "from_line", "to_line")]
    return z.select(
        *keep,
        "source_name",
        (F.col("place") + 1).alias("page"),
        "pages_in_doc",
        F.when(cited, f).alias("from_line"),
        F.when(cited, t).alias("to_line"),
        F.when(cited, t - f + 1).otherwise(0).cast("int").alias("line_count"),
        F.when(cited, F.coalesce(interpolated_in(F.col("lines"), f, t), F.lit(0)))
        .otherwise(0)
        .alias("interpolated_lines"),
        size_in_cm(w, h).alias("size"),
        share.alias("height_share"),
        (~whole & (share >= SPANS_PAGE_RATIO)).alias("spans_page"),
        whole.alias("whole_page"),
    )


def cite_ranges(ranges: DataFrame, lines: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Citation and text of bare line ranges."""
    card = resolve_pages(pages.select(*PAGE, "source_id"), sources).drop("source_id")
    z = with_page_lines(ranges, lines).join(card, PAGE)
    f, t, L = F.col("from_line"), F.col("to_line"), F.col("lines")
    text = F.when((f < 0) | (t < f), "").otherwise(F.coalesce(joined_text(in_range(L, f, t)), F.lit("")))
    return z.select(
        *ranges.columns,
        "source_name",
        (F.col("place") + 1).alias("page"),
        "pages_in_doc",
        (t - f + 1).cast("int").alias("line_count"),
        F.coalesce(interpolated_in(L, f, t), F.lit(0)).alias("interpolated_lines"),
        text.alias("text"),
    )


def interpolation_of(zones: DataFrame, lines: DataFrame) -> DataFrame:
    """Interpolated and covered line counts per zone."""
    z = with_page_lines(zones, lines)
    f, t, L = F.col("from_line"), F.col("to_line"), F.col("lines")
    return z.select(
        *zones.columns,
        F.coalesce(F.size(in_range(L, f, t)), F.lit(0)).alias("covered"),
        F.coalesce(interpolated_in(L, f, t), F.lit(0)).alias("interpolated"),
    )


def whole_page_zones(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Full-page box citing every line; ``error`` when numbers are not positions."""
    last = lines.groupBy(*PAGE).agg(
        (F.count(F.lit(1)) - 1).cast("int").alias("to_line"),
        F.max("i").alias("_max"),
    )
    return pages.join(last, PAGE, "left").select(
        *PAGE,
        F.lit(0.0).alias("x"),
        F.lit(0.0).alias("y"),
        F.col("width").cast("double").alias("w"),
        F.col("height").cast("double").alias("h"),
        F.when(F.col("to_line").isNotNull(), 0).alias("from_line"),
        "to_line",
        F.when(F.col("_max") != F.col("to_line"), "number-is-not-position").alias("error"),
    )


def gap_metrics(zones: DataFrame, lines: DataFrame) -> DataFrame:
    """Q4: lines after the page's last wide gap, and the widest gap of a range over its median."""
    z = with_page_lines(zones, lines)
    L, f, t = F.col("lines"), F.col("from_line"), F.col("to_line")
    z = z.withColumn("_p", _pitches(L)).withColumn("_q", _pitches(in_range(L, f, t)))
    z = z.withColumn("_tp", median_of(F.col("_p"))).withColumn("_tq", median_of(F.col("_q")))
    cut = _last_wide_gap(F.col("_p"), F.col("_tp"))
    tail = F.when(
        (F.size("lines") >= MIN_LINES_FOR_TRIM) & (F.col("_tp") > 0) & cut.isNotNull(),
        F.size("lines") - (cut + 1),
    ).otherwise(0)
    widest = F.when(
        (F.size("_q") >= MIN_LINES_FOR_TRIM - 1) & (F.col("_tq") > 0),
        F.array_max("_q") / F.col("_tq"),
    )
    return z.select(
        *zones.columns, tail.cast("int").alias("footer_tail_lines"), widest.alias("max_gap_ratio")
    )
