"""Duplicate screening, run comparison, cached replies, input checks, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import PAGE, first_by, js_round, pack_lines
from foliary.functions.cells import format_ref, is_cell_ref, parse_ref
from foliary.functions.keys import relative, to_fixed
from foliary.functions.readings import best_substring_match, line_signature, window_within
from foliary.operators.geometry import box_of_range, line_violations, CROP_PADDING
from foliary.operators.quality import page_geometry
from foliary.operators.signatures import LEAST_TOLERANCE, TOLERANCE_SHARE, page_signature_spans

# ------------------------------------------------------------------ U1, U2


def screen_digested(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """The first of each digest is accepted unless it is held; others name the holder.

    ``candidates``: run_id, name, digest, pos.  ``held``: run_id, name, digest, pos.  A digest
    repeated a billion times costs a partial minimum per task, not a sort.
    """
    key = ["run_id", "digest"]
    keep = held.where("digest is not null").groupBy(*key).agg(F.min_by("name", "pos").alias("_held"))
    first = candidates.groupBy(*key).agg(
        F.min("pos").alias("_first"), F.min_by("name", "pos").alias("_own")
    )
    c = candidates.join(first.join(keep, key, "left"), key)
    accepted = F.col("_held").isNull() & (F.col("pos") == F.col("_first"))
    return c.select(
        *candidates.columns,
        accepted.alias("accepted"),
        F.when(~accepted, F.coalesce("_held", "_own")).alias("held_as"),
        F.when(~accepted, F.col("_held").isNull()).alias("in_same_drop"),
    )


def find_in_other_runs(candidates: DataFrame, held: DataFrame, runs: DataFrame) -> DataFrame:
    """Other runs holding a candidate's digest, each once; sort by created_at descending.

    ``runs``: run_id, created_at.
    """
    once = first_by(
        held.where("digest is not null").select("run_id", "digest", "name", "pos"), ["run_id", "digest"], ["pos"]
    )
    other = once.join(runs, "run_id").select(
        F.col("run_id").alias("other_run"), "digest", F.col("name").alias("held_as"), "created_at"
    )
    return candidates.join(other, "digest").where("other_run <> run_id")


def linked_holders(held: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run that holds a digest, once, with the next older run that does: a row for each holder.

    Whoever holds a digest is found from its newest holder on along the links, newest first, so a digest that every run
    holds costs as many rows as runs, not their square.  run_id, digest, held_as, created_at, older_run, is_newest.
    """
    once = first_by(
        held.where("digest is not null").select("run_id", "digest", "name", "pos"), ["run_id", "digest"], ["pos"]
    )
    h = once.join(runs, "run_id").select("run_id", "digest", F.col("name").alias("held_as"), "created_at")
    # a digest is held once a run, so a window holds no more rows than there are runs
    newest = W.partitionBy("digest").orderBy(F.desc("created_at"), "run_id")
    return h.withColumn("older_run", F.lead("run_id").over(newest)).withColumn("is_newest", F.row_number().over(newest) == 1)


def newest_other_holder(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """For each candidate the newest other run with its digest, where its list begins; null when there is none.

    ``links`` from ``linked_holders``: the newest holder, or the one after it if that is the candidate's own run.
    """
    top = links.where("is_newest").select("digest", F.col("run_id").alias("_top"), F.col("older_run").alias("_next"))
    other = F.when(F.col("_top") != F.col("run_id"), F.col("_top")).otherwise(F.col("_next"))
    return candidates.join(top, "digest", "left").withColumn("other_run", other).drop("_top", "_next")


# ------------------------------------------------------------------ U5

# What counts as moved and as a concern.
MOVED_LINES = 2
MOVED_CHARS_PCT = 5
CHARS_CONCERN_PCT = -3
LINES_CONCERN_PCT = -5
COLLAPSED_RISE = 1.5
COLLAPSED_LEAST = 3

METRICS = ["lines", "chars", "cover", "ink", "uncovered", "collapsed", "interpolated"]
PAIR = ["pair_id", "page"]


def paired_pages(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both readings of each page; which side has it, and whether the reading moved.

    Both: pair_id, page and the metric columns.
    """
    b = base.select(*PAIR, *[F.col(m).alias(f"b_{m}") for m in METRICS], F.lit(True).alias("_b"))
    c = candidate.select(*PAIR, *[F.col(m).alias(f"c_{m}") for m in METRICS], F.lit(True).alias("_c"))
    j = b.join(c, PAIR, "full_outer")
    both = F.col("_b").isNotNull() & F.col("_c").isNotNull()
    chars = F.abs(relative("b_chars", "c_chars"))
    moved = (
        (F.abs(F.col("c_lines") - F.col("b_lines")) >= MOVED_LINES)
        | F.coalesce(chars >= MOVED_CHARS_PCT, F.lit(False))
        | (F.col("c_collapsed") != F.col("b_collapsed"))
    )
    side = F.when(both, "both").when(F.col("_b").isNotNull(), "baseline-only").otherwise("candidate-only")
    return j.withColumn("side", side).withColumn("moved", both & F.coalesce(moved, F.lit(False))).drop("_b", "_c")


def compare_metrics(paired: DataFrame) -> DataFrame:
    """Mean of each metric on both sides, delta and relative change (long form)."""
    p = paired.where("side = 'both'")
    means = [F.avg(f"{s}_{m}").alias(f"{s}_{m}") for m in METRICS for s in ("b", "c")]
    g = p.groupBy("pair_id").agg(*means)
    rows = ", ".join(f"'{m}', b_{m}, c_{m}" for m in METRICS)
    long = g.selectExpr("pair_id", f"stack({len(METRICS)}, {rows}) as (metric, baseline, candidate)")
    return long.select(
        "pair_id",
        "metric",
        F.round("baseline", 6).alias("baseline"),
        F.round("candidate", 6).alias("candidate"),
        F.round(F.col("candidate") - F.col("baseline"), 6).alias("delta"),
        F.round(relative("baseline", "candidate"), 6).alias("relative_pct"),
    )


def compare_runs(paired: DataFrame, short_reads: DataFrame) -> DataFrame:
    """Totals and concerns of each pair.  ``short_reads``: pair_id, short_reads."""
    side = F.col("side")
    both = side == "both"
    total = lambda c: F.sum(F.when(both, F.col(c)))
    g = paired.groupBy("pair_id").agg(
        F.count_if(both).alias("paired"),
        F.count_if(side == "baseline-only").alias("baseline_only"),
        F.count_if(side == "candidate-only").alias("candidate_only"),
        F.count_if("moved").alias("moved"),
        *[total(f"{s}_{m}").alias(f"{s}_{m}") for m in ("lines", "chars", "collapsed") for s in ("b", "c")],
    )
    g = g.join(short_reads, "pair_id", "left")
    chars, lines = relative("b_chars", "c_chars"), relative("b_lines", "c_lines")
    rise = F.col("c_collapsed") - F.col("b_collapsed")
    return g.select(
        *g.columns[:5],
        F.round(lines, 6).alias("lines_pct"),
        F.round(chars, 6).alias("chars_pct"),
        rise.alias("collapsed_rise"),
        F.concat_ws(
            ",",
            F.when(chars < CHARS_CONCERN_PCT, "fewer-characters"),
            F.when(lines < LINES_CONCERN_PCT, "fewer-lines"),
            F.when((F.col("c_collapsed") > F.col("b_collapsed") * COLLAPSED_RISE) & (rise >= COLLAPSED_LEAST), "more-collapsed"),
            F.when(F.coalesce("short_reads", F.lit(0)) > 0, "short-reads"),
        ).alias("concerns"),
    )


# ------------------------------------------------------------------ U6


def fingerprint(model: Column, thinking: Column, max_tokens: Column) -> Column:
    """Readable settings key; a missing setting is a question mark."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat_ws("/", part(model), part(thinking), part(max_tokens))


def request_key(settings: Column, label: Column, prompt: Column) -> Column:
    """Settings, label and the first sixteen digits of the prompt's SHA-256."""
    return F.concat_ws("|", settings, label, F.substring(F.sha2(prompt, 256), 1, 16))


def cached_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their stored reply, or none: those are the ones to send."""
    c = first_by(cache.select("request_key", "reply", "stored_at"), ["request_key"], ["stored_at"])
    return requests.join(c.select("request_key", "reply"), "request_key", "left").withColumn(
        "hit", F.col("reply").isNotNull()
    )


# ------------------------------------------------------------------ U7 - U9


def page_violations(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages that cannot be searched, with the rule.

    ``pages``: run_id, page_index, source_id, page_in_doc, width, height.  Dense numbering is told
    from count, distinct count and extremes, so no run is sorted.
    """
    n = pages.groupBy("run_id", "source_id").agg(F.count(F.lit(1)).alias("_in_doc"))
    twice = pages.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_same"))
    run = pages.groupBy("run_id").agg(F.count(F.lit(1)).alias("_pages"))
    bad_lines = line_violations(lines, pages.dropDuplicates(PAGE)).select(*PAGE).distinct().withColumn("_bad", F.lit(True))
    p = (
        pages.join(n, ["run_id", "source_id"])
        .join(twice, PAGE)
        .join(run, "run_id")
        .join(bad_lines, PAGE, "left")
    )
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    rule = (
        F.when(F.col("page_index").isNull() | F.col("source_id").isNull(), "keys")
        .when(~(positive("width") & positive("height")), "size")
        .when(F.col("page_in_doc") < 0, "page-in-document")
        .when(F.col("page_in_doc") >= F.col("_in_doc"), "beyond-document")
        .when(F.col("_bad"), "line-geometry")
        .when((F.col("page_index") < 0) | (F.col("page_index") >= F.col("_pages")) | (F.col("_same") > 1), "not-dense")
    )
    return p.withColumn("rule", rule).where("rule is not null").select(*PAGE, "source_id", "rule")


# Request ceilings and cell kinds.
MAX_CELLS = 20_000
MAX_FIELDS = 500
MAX_CAPTURES = 40
MAX_CAPTURE_LINES = 20_000
CELL_KINDS = ["text", "number", "date", "boolean", "formula"]

SHEET = ["book_id", "sheet"]


def cell_violations(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """U8: cells and sheets that contradict themselves.

    ``cells``: book_id, sheet, pos, ref, row, col, kind.  ``declared``: book_id, sheet, rows, cols,
    dimension.  Order is checked against the cell just before, found by position.
    """
    at = parse_ref("ref")
    before = cells.select(*SHEET, (F.col("pos") + 1).alias("pos"), at["row"].alias("_pr"), at["col"].alias("_pc"))
    c = cells.join(before, [*SHEET, "pos"], "left")
    r, k = at["row"], at["col"]
    rule = (
        F.when(~is_cell_ref("ref"), "not-an-address")
        .when((F.col("row") != r) | (F.col("col") != k), "address-disagrees")
        .when(~F.col("kind").isin(*CELL_KINDS), "unknown-kind")
        .when((r < F.col("_pr")) | ((r == F.col("_pr")) & (k < F.col("_pc"))), "out-of-order")
    )
    per_cell = c.withColumn("rule", rule).where("rule is not null").select(*SHEET, "pos", "rule")
    g = cells.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("_n"), F.max(at["row"]).alias("_rows"), F.max(at["col"]).alias("_cols")
    )
    d = declared.join(g, SHEET, "left")
    rows, cols = F.coalesce("_rows", F.lit(0)), F.coalesce("_cols", F.lit(0))
    dim = F.when(F.coalesce("_n", F.lit(0)) == 0, "").otherwise(F.concat(F.lit("A1:"), format_ref(cols, rows)))
    sheet_rule = (
        F.when(F.col("_n") > MAX_CELLS, "too-many-cells")
        .when((F.col("rows") != rows) | (F.col("cols") != cols), "extent-disagrees")
        .when(F.col("dimension") != dim, "dimension-disagrees")
    )
    per_sheet = d.withColumn("rule", sheet_rule).where("rule is not null").select(
        *SHEET, F.lit(None).cast("bigint").alias("pos"), "rule"
    )
    return per_cell.unionByName(per_sheet)


def field_violations(fields: DataFrame) -> DataFrame:
    """U8: configuration fields without what an answer or an edit needs.

    ``fields``: run_id, pos, id, sheet, label, label_ref, value_ref, excel_value.
    """
    n = fields.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    first = fields.groupBy("run_id", "id").agg(F.min("pos").alias("_first"))
    empty = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    rule = (
        F.when(F.col("_n") > MAX_FIELDS, "too-many-fields")
        .when(empty("id"), "id-missing")
        .when(F.col("pos") > F.col("_first"), "id-used-twice")
        .when(empty("sheet"), "sheet-missing")
        .when(empty("label"), "label-missing")
        .when(~is_cell_ref("label_ref"), "label-ref")
        .when(~is_cell_ref("value_ref"), "value-ref")
        .when(F.col("excel_value").isNull(), "cell-text-missing")
    )
    f = fields.join(n, "run_id").join(first, ["run_id", "id"], "left")
    return f.withColumn("rule", rule).where("rule is not null").select("run_id", "pos", "rule")


def screen_violations(captures: DataFrame, lines: DataFrame) -> DataFrame:
    """U8: screen captures: ceilings, unique ids, dense line numbers.

    ``captures``: run_id, pos, id.  ``lines``: run_id, pos, i (one row per line): a line is of a capture,
    whatever id the capture gives itself, so that those of two captures with one id don't mix.
    """
    n = captures.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    first = captures.groupBy("run_id", "id").agg(F.min("pos").alias("_first"))
    dense = lines.groupBy("run_id", "pos").agg(
        F.count(F.lit(1)).alias("_c"), F.count_distinct("i").alias("_d"), F.min("i").alias("_lo"), F.max("i").alias("_hi")
    )
    total = lines.groupBy("run_id").agg(F.count(F.lit(1)).alias("_lines"))
    c = (
        captures.join(n, "run_id")
        .join(first, ["run_id", "id"])
        .join(dense, ["run_id", "pos"], "left")
        .join(total, "run_id", "left")
    )
    rule = (
        F.when(F.col("_n") > MAX_CAPTURES, "too-many-captures")
        .when(F.coalesce(F.length("id"), F.lit(0)) == 0, "id-missing")
        .when(F.col("pos") > F.col("_first"), "id-used-twice")
        .when(F.col("_lines") > MAX_CAPTURE_LINES, "too-many-lines")
        .when((F.col("_lo") != 0) | (F.col("_hi") != F.col("_c") - 1) | (F.col("_d") != F.col("_c")), "lines-not-dense")
    )
    return c.withColumn("rule", rule).where("rule is not null").select("run_id", "pos", "rule")


def capture_violations(captures: DataFrame) -> DataFrame:
    """Captures to walk: key, page and two non-negative line numbers."""
    bad = lambda c: F.coalesce(F.col(c) < 0, F.lit(True))
    rule = (
        F.when(F.coalesce(F.length("key"), F.lit(0)) == 0, "key")
        .when(bad("page_index"), "page")
        .when(bad("from_line") | bad("to_line"), "line-range")
    )
    return captures.withColumn("rule", rule).where("rule is not null").select("run_id", "pos", "rule")


def entry_violations(entries: DataFrame) -> DataFrame:
    """Entries nothing can address, and ids two entries answer to.

    ``entries``: run_id, pos, field_id, label, entry_id.
    """
    n = entries.groupBy("run_id", "entry_id").agg(F.count(F.lit(1)).alias("_n"))
    none = (F.coalesce(F.length("field_id"), F.lit(0)) == 0) & (F.coalesce(F.length("label"), F.lit(0)) == 0)
    rule = F.when(none, "no-id-or-label").when(F.col("_n") > 1, "id-used-twice")
    return (
        entries.join(n, ["run_id", "entry_id"], "left")
        .withColumn("rule", rule)
        .where("rule is not null")
        .select("run_id", "pos", "rule")
    )


# ------------------------------------------------------------------ V22, V29, U3, U4

# How much wider or taller than needed an answer may be, and the pass mark.
OVERSHOOT = 2
INFLATION = 2
PASS_MARK = 11


def crop_signatures(crops: DataFrame) -> DataFrame:
    """Signature of each crop from its lines (crop_id, i, text); a crop is one picture."""
    s = crops.select("crop_id", "i", line_signature("text").alias("sig"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("sig") != "", F.struct("i", "sig"))))
    return s.groupBy("crop_id").agg(
        F.array_join(F.transform(ordered, lambda t: t["sig"]), " ").alias("crop_sig")
    )


def required_ranges(pairs: DataFrame, crops: DataFrame, lines: DataFrame, explain: bool = True) -> DataFrame:
    """Lines of a page a crop's text comes from, or why there are none.

    ``pairs``: crop_id, run_id, page_index.  Exact hits stay in the JVM; only near misses reach the
    Arrow edit-distance function, one pair per row.  Without ``explain`` the distance of a pair that
    doesn't match is null, and pairs with too few common q-grams never reach that function.
    """
    spans = page_signature_spans(lines)
    ordered = F.array_sort(F.collect_list(F.struct("i", "start", "end", "sig")))
    sigs = spans.groupBy(*PAGE).agg(ordered.alias("spans")).withColumn(
        "page_sig", F.array_join(F.transform("spans", lambda s: s["sig"]), " ")
    )
    p = (
        pairs.join(crop_signatures(crops), "crop_id", "left")
        .join(sigs, PAGE, "left")
        .withColumn("crop_sig", F.coalesce("crop_sig", F.lit("")))
        .withColumn("page_sig", F.coalesce("page_sig", F.lit("")))
    )
    both = (F.col("crop_sig") != "") & (F.col("page_sig") != "")
    tolerance = F.greatest(
        F.lit(LEAST_TOLERANCE), js_round(F.length("crop_sig") * TOLERANCE_SHARE)
    ).cast("int")
    nearest = best_substring_match("crop_sig", "page_sig") if explain else window_within("crop_sig", "page_sig", tolerance)
    p = p.withColumn("_m", nearest)
    hit = F.filter(
        "spans", lambda s: (s["start"] < F.col("_m.end")) & (s["end"] > F.col("_m.start"))
    )
    p = p.withColumn("tolerance", tolerance).withColumn("_hit", F.transform(hit, lambda s: s["i"]))
    cause = (
        F.when(F.col("crop_sig") == "", "empty-crop")
        .when(F.col("page_sig") == "", "empty-page")
        .when(F.coalesce(F.col("_m.distance") > F.col("tolerance"), F.lit(True)), "no-match")
        .when(F.size("_hit") == 0, "no-lines-covered")
    )
    p = p.withColumn("cause", cause)
    ok = F.col("cause").isNull()
    return p.select(
        "crop_id",
        *PAGE,
        "cause",
        F.when(ok, F.array_min("_hit")).alias("min_line"),
        F.when(ok, F.array_max("_hit")).alias("max_line"),
        F.when(both, F.col("_m.distance")).alias("distance"),
        "tolerance",
        F.length("crop_sig").alias("crop_chars"),
        F.length("page_sig").alias("page_chars"),
    )


def describe_no_window(ranges: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Why a crop has no range on a page, with the sizes that say so."""
    cover = page_geometry(lines, pages).select(*PAGE, "vertical_coverage")
    r = ranges.where("cause is not null").join(cover, PAGE, "left")
    share = F.coalesce(F.try_divide(F.col("page_chars") * 100.0, F.col("crop_chars")), F.lit(0.0))
    kind = F.when(F.col("cause") != "no-match", F.col("cause")).otherwise(
        F.when(share < 100, "page-reads-short").otherwise("readings-disagree")
    )
    text = F.concat(
        F.lit("page "), F.col("page_index").cast("string"), F.lit(" read "), F.col("page_chars").cast("string"),
        F.lit(" characters against the crop's "), F.col("crop_chars").cast("string"), F.lit(" ("), to_fixed(share, 0),
        F.lit("%); boxes reach "), to_fixed("vertical_coverage", 3), F.lit(" of the height; off by "),
        F.coalesce(F.col("distance").cast("string"), F.lit("-")), F.lit(" against "), F.col("tolerance").cast("string"),
    )
    return r.select("crop_id", *PAGE, kind.alias("kind"), text.alias("detail"))


def gate_evaluate(
    results: DataFrame, gold: DataFrame, crops: DataFrame, lines: DataFrame, pages: DataFrame
) -> DataFrame:
    """Each answer against its crop: right page, contains the needed lines, not far too big.

    ``results``: crop_id, run_id, page_index (null when nothing was found), from_line, to_line, h.
    ``gold``: crop_id, run_id, accepted (pages), whole_document.
    """
    r = gold.join(results, ["crop_id", "run_id"], "left")
    on_page = F.coalesce(F.array_contains("accepted", F.col("page_index")), F.lit(False))
    r = r.withColumn("page_ok", on_page)
    need = required_ranges(r.where("page_ok").select("crop_id", *PAGE), crops, lines, explain=False).select(
        "crop_id", *PAGE, "cause", "min_line", "max_line"
    )
    r = (
        r.join(need, ["crop_id", *PAGE], "left")
        .join(pack_lines(lines), PAGE, "left")
        .join(pages.select(*PAGE, "width", "height"), PAGE, "left")
    )
    f, t, a, b = (F.col(c) for c in ("from_line", "to_line", "min_line", "max_line"))
    ids = F.transform("lines", lambda l: l["i"])
    r = r.withColumn("_first", F.array_min(ids)).withColumn("_last", F.array_max(ids))
    r = r.withColumn(
        "_need_h", box_of_range(F.col("lines"), a, b, CROP_PADDING, F.col("width"), F.col("height"))["h"]
    )
    whole = (f <= F.col("_first")) & (t >= F.col("_last"))
    need_whole = (a <= F.col("_first")) & (b >= F.col("_last"))
    big = ~F.col("whole_document")
    inflation = F.try_divide("h", "_need_h")
    detail = (
        F.when(F.col("page_index").isNull(), "no-match")
        .when(~F.col("page_ok"), "wrong-page")
        .when(F.col("cause").isNotNull(), F.col("cause"))
        .when(~((f <= a) & (t >= b)), "does-not-contain")
        .when(big & (t - f + 1 > (b - a + 1) * OVERSHOOT), "too-many-lines")
        .when(big & whole & ~need_whole, "whole-page-grab")
        .when(big & (inflation > INFLATION), "too-tall")
        .otherwise("ok")
    )
    return r.withColumn("detail", detail).select(
        "crop_id",
        "run_id",
        "whole_document",
        "page_ok",
        (F.col("detail") == "ok").alias("passed"),
        "detail",
        "min_line",
        "max_line",
        F.round(inflation, 6).alias("inflation"),
    )


def gate_summary(evaluated: DataFrame, pass_mark: int = PASS_MARK) -> DataFrame:
    """U4: one row over all answers."""
    ok, whole = F.col("passed"), F.col("whole_document")
    return evaluated.agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(ok).alias("passed"),
        F.count_if(~whole).alias("field_answers"),
        F.count_if(ok & ~whole).alias("field_passed"),
        F.count_if(whole).alias("whole_answers"),
        F.count_if(ok & whole).alias("whole_passed"),
        F.count_if("page_ok").alias("right_page"),
        F.max(F.when(~whole, F.col("inflation"))).alias("widest_inflation"),
        (F.count_if(ok) >= pass_mark).alias("passes"),
    )
