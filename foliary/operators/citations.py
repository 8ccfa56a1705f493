"""Cited lines, located answers and second readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE, first_by, in_range, is_blank, joined_text, pack_lines, strip_space
from foliary.functions.readings import best_substring_match, normalize_reading
from foliary.operators.geometry import range_error, resolve_ranges
from foliary.operators.pools import RankedPools
from foliary.sources.replies import parse_replies

SLOT = ["run_id", "slot_key"]


def _line_numbers(lines: DataFrame) -> DataFrame:
    """Line numbers per page without their texts."""
    return lines.groupBy(*PAGE).agg(F.collect_list("i").alias("_is"))


def citation_outcomes(claims: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """V1: cited / uncited / invalid with a reason; only the two end lines must exist.

    ``claims`` carries run_id, page_index, from_line, to_line, each nullable.
    """
    known = pages.select(*PAGE, F.lit(True).alias("_known"))
    c = claims.join(known, PAGE, "left").join(_line_numbers(lines), PAGE, "left")
    p, f, t = F.col("page_index"), F.col("from_line"), F.col("to_line")
    nones = sum(F.when(v.isNull(), 1).otherwise(0) for v in (p, f, t))
    has = lambda v: F.coalesce(F.array_contains("_is", v), F.lit(False))
    reason = (
        F.when(nones == 3, F.lit(None).cast("string"))
        .when(nones > 0, "incomplete")
        .when(F.col("_known").isNull(), "unknown-page")
        .when(f > t, "reversed")
        .when(~has(f), "missing-first-line")
        .when(~has(t), "missing-last-line")
    )
    c = c.withColumn("reason", reason)
    status = F.when(nones == 3, "uncited").when(F.col("reason").isNull(), "cited").otherwise("invalid")
    return c.withColumn("status", status).drop("_known", "_is")


def whole_citations(claims: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """V2 and V3: a citation only when every line inside exists, with the cited text.

    ``reason`` is null when nothing was cited at all; callers that drop failed citations silently
    ignore it (V2), the screen check keeps it (V3) together with the first missing line.
    """
    known = pages.select(*PAGE, F.lit(True).alias("_known"))
    c = claims.join(known, PAGE, "left").join(pack_lines(lines), PAGE, "left")
    p, f, t, L = F.col("page_index"), F.col("from_line"), F.col("to_line"), F.col("lines")
    nones = sum(F.when(v.isNull(), 1).otherwise(0) for v in (p, f, t))
    picked = F.coalesce(in_range(L, f, t), F.filter(L, lambda l: F.lit(False)))
    in_step = F.transform(picked, lambda l, k: l["i"] == f + k)
    off = F.array_position(in_step, F.lit(False))
    missing = f + F.when(off > 0, off - 1).otherwise(F.coalesce(F.size(picked), F.lit(0)))
    reason = (
        F.when(nones == 3, F.lit(None).cast("string"))
        .when(nones > 0, "incomplete")
        .when(F.col("_known").isNull(), "unknown-page")
        .when(f > t, "reversed")
        .when(F.coalesce(F.size(picked), F.lit(0)) != t - f + 1, "missing-line")
    )
    c = c.withColumn("reason", reason)
    ok = (nones == 0) & F.col("reason").isNull()
    return c.select(
        *claims.columns,
        ok.alias("cited"),
        F.when(ok, joined_text(picked)).alias("cited_text"),
        "reason",
        F.when(F.col("reason") == "missing-line", missing).cast("int").alias("missing_line"),
    )


FIELD_REPLY = "values array<struct<fieldKey: string, value: string, pageIndex: int, `from`: int, `to`: int>>"


def judged_field_replies(replies: DataFrame) -> DataFrame:
    """V4: field replies with `parsed`, and the `reason` for which a reply is refused as a whole."""
    parsed = parse_replies(replies, FIELD_REPLY)
    below = lambda n: F.coalesce(n < 0, F.lit(False))
    # one negative number fails the whole reply
    bad = F.exists("parsed.values", lambda v: below(v["pageIndex"]) | below(v["from"]) | below(v["to"]))
    reason = F.coalesce("error", F.when(F.col("parsed.values").isNull(), "no-values").when(bad, "negative-number"))
    return parsed.withColumn("reason", reason)


def refused_field_replies(replies: DataFrame) -> DataFrame:
    """V4: the replies that give no claims, each with its reason and as it came."""
    return judged_field_replies(replies).where("reason is not null").drop("parsed", "error")


def field_claims(replies: DataFrame, keys: DataFrame) -> DataFrame:
    """V4: wanted, non-blank values of field replies with their claims, in reply order.

    ``replies``: run_id, pool_id, reply.  ``keys``: run_id, field_key.
    """
    parsed = judged_field_replies(replies).where("reason is null")
    v = parsed.select("run_id", "pool_id", F.posexplode("parsed.values").alias("seq", "v"))
    rows = v.select(
        "run_id",
        "pool_id",
        "seq",
        F.col("v.fieldKey").alias("field_key"),
        F.col("v.value").alias("value"),
        F.col("v.pageIndex").alias("position"),
        F.col("v.from").alias("from_line"),
        F.col("v.to").alias("to_line"),
    )
    return rows.where(~is_blank("value")).join(
        keys.select("run_id", "field_key").distinct(), ["run_id", "field_key"], "left_semi"
    )


def pooled_values(
    claims: DataFrame, pool: RankedPools, lines: DataFrame, pages: DataFrame, sources: DataFrame
) -> DataFrame:
    """V5: positions mapped to run pages, checked, with source name and page in document.

    The result is the input of ``reconcile`` (A1).
    """
    mapped = pool.remap(claims)
    beyond = F.col("position").isNotNull() & F.col("page_index").isNull()
    page = F.when(beyond, F.lit(-1)).otherwise(F.col("page_index")).cast("int")
    judged = citation_outcomes(mapped.withColumn("page_index", page), lines, pages)
    where = pages.select(*PAGE, "source_id", "page_in_doc").join(
        sources.select("run_id", "source_id", F.col("name").alias("source_name")), ["run_id", "source_id"]
    )
    cited = F.col("status") == "cited"
    return judged.join(where.drop("source_id"), PAGE, "left").select(
        "run_id",
        "field_key",
        "seq",
        "value",
        "status",
        "reason",
        *[F.when(cited, F.col(c)).alias(c) for c in ("page_index", "from_line", "to_line", "source_name", "page_in_doc")],
    )


def locate_outcomes(
    slots: DataFrame, answers: DataFrame, pool: RankedPools, lines: DataFrame, pages: DataFrame
) -> DataFrame:
    """V6: per searched slot the first answer resolved; a bad answer affects its own slot only.

    ``slots``: run_id, slot_key, pool_id.  ``answers``: run_id, slot_key, pos, position,
    from_line, to_line, confidence.
    """
    first = first_by(answers, SLOT, ["pos"]).join(slots, SLOT)
    at = pool.remap(first)
    beyond = F.col("position").isNotNull() & F.col("page_index").isNull()
    at = at.withColumn("page_index", F.when(beyond, F.lit(-1)).otherwise(F.col("page_index")).cast("int"))
    resolved = resolve_ranges(at.drop("pos", "position", "pool_id"), lines, pages)
    return slots.select(*SLOT).join(resolved, SLOT, "left").select(
        *SLOT,
        F.coalesce("outcome", F.lit("no-answer")).alias("outcome"),
        "error",
        *[F.when(F.col("outcome") == "found", F.col(c)).alias(c) for c in ("page_index", "from_line")],
        "to_line",
        "x",
        "y",
        "w",
        "h",
        "text",
        "confidence",
    )


def with_fallback(grouped: DataFrame, single: DataFrame) -> DataFrame:
    """Answers of single-slot replies where the grouped reply was unusable.

    Both: run_id, slot_key, usable and answer columns.
    """
    rest = [c for c in grouped.columns if c not in (*SLOT, "usable")]
    s = single.where("usable").select(*SLOT, F.struct(*rest).alias("_s"))
    g = grouped.select(*SLOT, F.when(F.col("usable"), F.struct(*rest)).alias("_g"))
    both = g.join(s, SLOT, "full_outer").withColumn("_a", F.coalesce("_g", "_s"))
    from_ = F.when(F.col("_g").isNotNull(), "grouped").when(F.col("_s").isNotNull(), "single")
    return both.select(*SLOT, "_a.*", F.coalesce(from_, F.lit("none")).alias("answered_by"))


def route_wanted(
    wanted: DataFrame, slots: DataFrame, located: DataFrame, whole_pages: DataFrame
) -> DataFrame:
    """V7: every wanted capture ends as exactly one of proposal, outstanding or out-of-scope.

    ``wanted``: run_id, key, slot_key, pos.  ``located`` is V6, ``whole_pages`` is P7.
    """
    form = slots.select(*SLOT, "layout", "fillable", "added", F.lit(True).alias("_known"))
    firsts = wanted.groupBy(*SLOT).agg(F.min("pos").alias("_first"))
    w = wanted.join(form, SLOT, "left").join(firsts, SLOT)
    scope = F.when(F.col("_known").isNull(), "no-such-slot").when(F.col("added"), "added-by-hand")
    w = w.withColumn("_scope", scope)
    images = F.col("_scope").isNull() & (F.col("layout") == "images")
    zone = ["page_index", "from_line", "to_line", "text"]
    whole = w.where(images).select("run_id", "key").join(
        whole_pages.select("run_id", "key", "outcome", "reason", *zone), ["run_id", "key"], "left"
    )
    whole = whole.withColumn("outcome", F.coalesce("outcome", F.lit("outstanding"))).withColumn(
        "reason",
        F.when((F.col("outcome") == "outstanding") & F.col("reason").isNull(), "by-hand").otherwise(F.col("reason")),
    )
    rest = w.where(~images).join(
        located.select(*SLOT, F.col("outcome").alias("_located"), *zone), SLOT, "left"
    )
    reason = (
        F.when(F.col("_scope").isNotNull(), F.col("_scope"))
        .when(~F.col("fillable"), "by-hand")
        .when(F.col("_located").isNull(), "no-outcome")
        .when(F.col("_located").isin("error", "no-answer"), "search-failed")
        .when(F.col("_located") == "none", "not-found")
        .when(F.col("pos") > F.col("_first"), "extra-capture")
    )
    rest = rest.withColumn("reason", reason)
    outcome = (
        F.when(F.col("_scope").isNotNull(), "out-of-scope")
        .when(F.col("reason").isNull(), "proposal")
        .otherwise("outstanding")
    )
    rest = rest.withColumn("outcome", outcome)
    shown = F.col("outcome") == "proposal"
    rest = rest.select("run_id", "key", "outcome", "reason", *[F.when(shown, F.col(c)).alias(c) for c in zone])
    return whole.select("run_id", "key", "outcome", "reason", *zone).unionByName(rest)


# ------------------------------------------------------------------ second readings


def verify_values(
    values: DataFrame, readings: DataFrame, lines: DataFrame, pages: DataFrame, tolerance: int = 0
) -> DataFrame:
    """Cited values against a second reading of the cited lines.

    ``values``: run_id, field_key, value, conflict, page_index, from_line, to_line.
    ``readings``: run_id, field_key, reading (null when the crop could not be read).
    A disagreement blanks the value.  At tolerance 0 nothing leaves the JVM.
    """
    known = pages.select(*PAGE, F.lit(True).alias("_known"))
    v = (
        values.join(known, PAGE, "left")
        .join(pack_lines(lines), PAGE, "left")
        .join(readings, ["run_id", "field_key"], "left")
        .withColumn("needle", normalize_reading("value"))
        .withColumn("hay", normalize_reading(F.coalesce("reading", F.lit(""))))
    )
    f, t = F.col("from_line"), F.col("to_line")
    skipped = F.coalesce(F.col("conflict"), F.lit(False)) | is_blank("value")
    unverified = (
        F.when(skipped, F.lit(None).cast("string"))
        .when(F.col("page_index").isNull(), "no-citation")
        .when(F.col("needle") == "", "nothing-comparable")
        .when(F.col("_known").isNull(), "page-not-in-run")
        .when(range_error(F.col("lines"), f, t).isNotNull(), range_error(F.col("lines"), f, t))
        .when(F.col("reading").isNull(), "no-reading")
    )
    v = v.withColumn("unverified", unverified)
    if tolerance == 0:
        agree = F.contains("hay", F.col("needle"))
    else:
        agree = best_substring_match("needle", "hay")["distance"] <= tolerance
    v = v.withColumn("_agree", agree)
    outcome = (
        F.when(skipped, "skipped")
        .when(F.col("unverified").isNotNull(), "unverified")
        .when(F.col("_agree"), "agreed")
        .otherwise("disagreed")
    )
    v = v.withColumn("outcome", outcome)
    return v.select(
        "run_id",
        "field_key",
        F.when(F.col("outcome") == "disagreed", "").otherwise(F.col("value")).alias("value"),
        "outcome",
        F.col("unverified").alias("reason"),
        F.when(F.col("outcome") == "disagreed", F.col("value")).alias("page_reading"),
        F.when(F.col("outcome") == "disagreed", F.col("reading")).alias("crop_reading"),
    )


def verify_report(verified: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return (
        verified.groupBy("run_id")
        .agg(n("agreed"), n("disagreed"), n("unverified"), n("skipped"))
        .withColumn("checked", F.col("agreed") + F.col("disagreed"))
    )


# ------------------------------------------------------------------ order kind

# The label, what may stand around a code, and the known codes.
ORDER_LINE = r"(?i)jenis\s*order\s*(?:\([^)]*\))?(.*)$"
ORDER_CODE = r"^([A-Za-z]{2,4})\b(.*)$"
ORDER_TRAILER = r"^[\s:.,;-]*(?:\([^)]*\))?[\s.,;]*$"
ORDER_CODES = ["AO", "MO", "DO"]


def order_kind_candidates(lines: DataFrame) -> DataFrame:
    """What stands beside every order-kind label; an empty value when it is no code."""
    raw = strip_space(F.regexp_replace(F.regexp_extract("text", ORDER_LINE, 1), r"^[\s:.\-]+", ""))
    c = lines.where(F.regexp_like("text", F.lit(ORDER_LINE))).withColumn("raw", raw).where("raw <> ''")
    printed = F.regexp_extract("raw", ORDER_CODE, 1)
    code = F.upper(printed)
    reads = code.isin(*ORDER_CODES) | ((F.length(printed) <= 3) & (printed == code))
    ok = (
        F.regexp_like("raw", F.lit(ORDER_CODE))
        & F.regexp_like(F.regexp_extract("raw", ORDER_CODE, 2), F.lit(ORDER_TRAILER))
        & reads
    )
    return c.select(*PAGE, "i", "raw", F.when(ok, code).otherwise("").alias("value"))


def resolve_order_kind(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flag, then environment, then the one value the documents agree on.

    ``runs``: run_id, flag, env.  Distinct values are counted, not collected.
    """
    c = candidates.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("value") != "", F.col("value"))).alias("distinct_values"),
        F.max(F.when(F.col("value") != "", F.col("value"))).alias("one"),
        F.count(F.lit(1)).alias("candidates"),
    )
    tidy = lambda v: F.nullif(F.regexp_replace(strip_space(F.coalesce(v, F.lit(""))), r"\s+", " "), F.lit(""))
    flag, env = tidy("flag"), tidy("env")
    n = F.coalesce("distinct_values", F.lit(0))
    single = F.when(n == 1, F.col("one"))
    return runs.join(c, "run_id", "left").select(
        "run_id",
        F.coalesce(flag, env, single, F.lit("")).alias("value"),
        F.when(flag.isNotNull(), "flag")
        .when(env.isNotNull(), "env")
        .when(n == 1, "documents")
        .when(n > 1, "conflict")
        .otherwise("none")
        .alias("origin"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def outstanding_headers(order_kinds: DataFrame) -> DataFrame:
    """Runs whose header field stays open."""
    return order_kinds.where("value = ''").select(
        "run_id", F.lit("jenisOrder").alias("key"), F.col("origin").alias("reason")
    )
