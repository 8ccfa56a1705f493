"""Page heads, classification spans and ranked page pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import PAGE, joined_text, key_bucket, number_rows, pack_lines, prefix_sums
from foliary.session import kept

# How much of a page's opening is shown.
HEAD_LINES = 12
HEAD_CHARS = 400

DOC = ["run_id", "source_id"]


def page_heads(lines: DataFrame) -> DataFrame:
    """H1: first lines of each page joined by spaces and cut."""
    first = lines.where(F.col("i") < HEAD_LINES)
    ordered = F.array_sort(F.collect_list(F.struct("i", "text")))
    text = F.array_join(F.transform(ordered, lambda t: t["text"]), " ")
    return first.groupBy(*PAGE).agg(F.substring(text, 1, HEAD_CHARS).alias("head"))


def head_lines(lines: DataFrame) -> DataFrame:
    """H4: whole lines while fewer than the cut's characters were shown before them."""
    before = W.partitionBy(*PAGE).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    shown = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return lines.withColumn("_shown", shown).where(F.col("_shown") < HEAD_CHARS).drop("_shown")


def span_issues(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """H2: every reason a source's spans cannot be used.

    ``spans``: run_id, source_id, doc_type, from_page, to_page in page-in-document numbers.
    Reversed and overrunning spans are reported alone; otherwise every page must be covered once.
    A reversed or overrunning span is never exploded, so a bad reply cannot blow up.
    """
    last = pages.groupBy(*DOC).agg((F.count(F.lit(1)) - 1).cast("int").alias("last_page"))
    s = spans.join(last, DOC)
    shape = F.when(F.col("from_page") > F.col("to_page"), "reversed").when(
        F.col("to_page") > F.col("last_page"), "past-last-page"
    )
    bad = s.withColumn("issue", shape).where("issue is not null").select(
        *DOC, F.col("to_page").alias("page"), "issue", F.lit(0).alias("times")
    )
    sound = spans.join(bad.select(*DOC).distinct(), DOC, "left_anti")
    covered = (
        sound.select(*DOC, F.explode(F.sequence("from_page", "to_page")).alias("page_in_doc"))
        .groupBy(*DOC, "page_in_doc")
        .agg(F.count(F.lit(1)).cast("int").alias("times"))
    )
    judged = pages.select(*DOC, "page_in_doc").join(sound.select(*DOC).distinct(), DOC, "left_semi")
    off = (
        judged.join(covered, [*DOC, "page_in_doc"], "left")
        .withColumn("times", F.coalesce("times", F.lit(0)))
        .where("times <> 1")
    )
    return bad.unionByName(
        off.select(
            *DOC,
            F.col("page_in_doc").alias("page"),
            F.when(F.col("times") == 0, "not-covered").otherwise("covered-twice").alias("issue"),
            "times",
        )
    )


def pages_by_type(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """H3: document type of every page of the sources whose spans are sound."""
    failed = span_issues(spans, pages).select(*DOC).distinct()
    ok = spans.join(failed, DOC, "left_anti")
    each = ok.select(*DOC, "doc_type", F.explode(F.sequence("from_page", "to_page")).alias("page_in_doc"))
    return (
        each.join(pages.select(*DOC, "page_in_doc", "page_index"), [*DOC, "page_in_doc"])
        .select(*PAGE, "source_id", "doc_type")
        .dropDuplicates([*PAGE, "doc_type"])
    )


def pool_for_types(typed_pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages of the wanted types; ``wanted``: run_id, pool_id, doc_type."""
    return (
        typed_pages.join(wanted, ["run_id", "doc_type"])
        .select("run_id", "pool_id", "page_index")
        .distinct()
    )


class RankedPools:
    """The open pages of each run as every pool ranks them, preferred types first, each in page order.

    ``wanted``: run_id, pool_id, doc_type (a null type ranks nothing first).  ``pages`` is already fenced.  Pages are
    numbered once a run and the preferred ones once a pool; where another page stands follows by arithmetic, so no row
    is made for a page and pool unless the whole ranking is asked for.
    """

    def __init__(self, pages: DataFrame, typed_pages: DataFrame, wanted: DataFrame):
        self.pools = wanted.select("run_id", "pool_id").distinct()
        self.pages = kept(number_rows(pages.select(*PAGE), ["run_id"], ["page_index"], key_bucket("page_index"), "ordinal"))
        preferred = pool_for_types(typed_pages, wanted).join(self.pages, PAGE)
        self.preferred = kept(number_rows(preferred, ["run_id", "pool_id"], ["ordinal"], key_bucket("ordinal"), "rank"))

    def rows(self) -> DataFrame:
        """run_id, page_index, pool_id, preferred, position of every page of every pool."""
        ranks = self.preferred.select(*PAGE, "pool_id", F.lit(True).alias("preferred"))
        ranked = (
            self.pages.select(*PAGE)
            .join(self.pools, "run_id")
            .join(ranks, [*PAGE, "pool_id"], "left")
            .withColumn("preferred", F.coalesce("preferred", F.lit(False)))
        )
        after = F.when(F.col("preferred"), F.lit(0)).otherwise(F.lit(1))
        bucket = after.cast("long") * (1 << 40) + key_bucket("page_index")
        return number_rows(ranked, ["run_id", "pool_id"], [after, "page_index"], bucket, "position").select(
            "run_id", "page_index", "pool_id", "preferred", "position"
        )

    def remap(self, citations: DataFrame) -> DataFrame:
        """A pool position to a run page; null where the pool holds no such position.

        Position k of a pool with a preferred pages is the k-th of them, or else the (k - a)-th other page; that page's
        ordinal is k - a and as many preferred pages as have no more than k - a others before them.
        """
        place = ["run_id", "pool_id", "position"]
        counts = self.preferred.groupBy("run_id", "pool_id").agg(F.count(F.lit(1)).alias("_a"))
        asked = citations.select(*place).where("position is not null").distinct().join(self.pools, ["run_id", "pool_id"])
        asked = asked.join(counts, ["run_id", "pool_id"], "left")
        asked = asked.withColumn("others", (F.col("position") - F.coalesce("_a", F.lit(0))).cast("long"))
        early = asked.where("others < 0").join(
            self.preferred.select("run_id", "pool_id", F.col("rank").alias("position"), "page_index"), place
        )
        steps = self.preferred.groupBy("run_id", "pool_id", (F.col("ordinal") - F.col("rank")).cast("long").alias("others"))
        marks = steps.agg(F.count(F.lit(1)).alias("_n")).withColumn("position", F.lit(None).cast("int"))
        marks = marks.unionByName(asked.where("others >= 0").select(*place, "others", F.lit(0).cast("long").alias("_n")))
        # a pool's preferred pages that follow each other are one mark, so a bucket of marks is bounded
        order = F.struct("others", F.col("position").isNotNull(), "position")
        passed = prefix_sums(marks, ["run_id", "pool_id"], order, "_n", key_bucket("others"), "_passed").where("position is not null")
        late = passed.withColumn("ordinal", (F.col("others") + F.col("_passed")).cast("int")).join(self.pages, ["run_id", "ordinal"])
        found = early.select(*place, "page_index").unionByName(late.select(*place, "page_index"))
        return citations.join(found, place, "left")


def default_types(slots: DataFrame) -> DataFrame:
    """Types of a form's fillable whole-page slots, in form order."""
    want = (F.col("layout") == "images") & F.col("fillable") & F.col("doc_type").isNotNull()
    return slots.where(want).groupBy("form_id", "doc_type").agg(F.min("pos").alias("pos"))


def form_field_keys(rows: DataFrame) -> DataFrame:
    """Distinct non-empty field keys of a form with their first row."""
    return (
        rows.where("field_key is not null and field_key <> ''")
        .groupBy("form_id", "field_key")
        .agg(F.min("pos").alias("pos"))
    )


def extractable_keys(rows: DataFrame, never: DataFrame) -> DataFrame:
    return form_field_keys(rows).join(never, "field_key", "left_anti")


def key_groups(keys: DataFrame, field_types: DataFrame, defaults: DataFrame) -> DataFrame:
    """A form's keys grouped by the types they are looked for in (a form is a small table).

    ``field_types``: field_key, signature; keys without one use the form's default types.
    """
    in_order = F.array_sort(F.collect_list(F.struct("pos", "doc_type")))
    base = defaults.groupBy("form_id").agg(
        F.array_join(F.transform(in_order, lambda t: t["doc_type"]), "|").alias("_default")
    )
    signed = (
        keys.join(field_types, "field_key", "left")
        .join(base, "form_id", "left")
        .withColumn("signature", F.coalesce("signature", "_default", F.lit("")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "field_key")))
    return signed.groupBy("form_id", "signature").agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(ordered, lambda t: t["field_key"]), ", ").alias("keys"),
    )


# Order key of slots the form does not know: after every slot it does.
UNKNOWN_RANK = 2**31 - 1


def in_form_order(zones: DataFrame, slots: DataFrame) -> DataFrame:
    """P5: rank of each zone's slot; sort by (rank, discovery order)."""
    rank = slots.select("form_id", "slot_key", F.col("pos").alias("rank"))
    return zones.join(rank, ["form_id", "slot_key"], "left").withColumn(
        "rank", F.coalesce("rank", F.lit(UNKNOWN_RANK)).cast("int")
    )


def open_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of sources that are not fenced off; only an explicit false fences."""
    fenced = sources.where("ai = false").select(*DOC)
    return pages.join(fenced, DOC, "left_anti")


def searchable_page_counts(pages: DataFrame, sources: DataFrame) -> DataFrame:
    return open_pages(pages, sources).groupBy("run_id").agg(F.count(F.lit(1)).alias("searchable"))


def typed_positions(typed_pages: DataFrame) -> DataFrame:
    """Position of each page among its run's pages of the same type."""
    return number_rows(
        typed_pages, ["run_id", "doc_type"], ["page_index"], key_bucket("page_index"), "ordinal"
    )


def whole_page_proposals(
    wanted: DataFrame, typed_pages: DataFrame, pages: DataFrame, lines: DataFrame
) -> DataFrame:
    """Each whole-page slot takes the n-th page of its type.

    ``wanted``: run_id, slot_key, key, pos, doc_type, page_ordinal (captures of whole-page slots).
    The first capture of a slot gets the page; further ones and absent pages are outstanding.
    """
    nth = typed_positions(typed_pages).select(
        "run_id", "doc_type", F.col("ordinal").alias("page_ordinal"), "page_index"
    )
    firsts = wanted.groupBy("run_id", "slot_key").agg(F.min("pos").alias("_first"))
    w = (
        wanted.join(firsts, ["run_id", "slot_key"])
        .join(nth, ["run_id", "doc_type", "page_ordinal"], "left")
        .join(pages.select(*PAGE, "width", "height"), PAGE, "left")
        .join(pack_lines(lines), PAGE, "left")
    )
    found = F.col("page_index").isNotNull()
    reason = (
        F.when(F.col("doc_type").isNull(), "no-document-type")
        .when(~found, "no-such-page")
        .when(F.col("lines").isNull(), "no-readable-text")
        .when(F.col("pos") > F.col("_first"), "extra-capture-of-whole-page-slot")
    )
    w = w.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return w.select(
        "run_id",
        "key",
        "slot_key",
        F.when(ok, "proposal").otherwise("outstanding").alias("outcome"),
        "reason",
        F.when(ok, F.col("page_index")).alias("page_index"),
        F.when(ok, 0).alias("from_line"),
        F.when(ok, F.size("lines") - 1).alias("to_line"),
        F.when(ok, F.col("width").cast("double")).alias("w"),
        F.when(ok, F.col("height").cast("double")).alias("h"),
        F.when(ok, joined_text(F.col("lines"))).alias("text"),
    )


def later_round_positions(slots: DataFrame, satisfied: DataFrame) -> DataFrame:
    """In a later round a whole-page slot's position drops by the earlier siblings of its type
    already satisfied.  ``slots``: run_id, slot_key, doc_type, page_ordinal.

    A running count along the ordinal, not a self-join: slots of one form are few.
    """
    done = satisfied.select("run_id", "slot_key").distinct().withColumn("_done", F.lit(1))
    marked = slots.join(done, ["run_id", "slot_key"], "left")
    before = (
        W.partitionBy("run_id", "doc_type")
        .orderBy("page_ordinal")
        .rangeBetween(W.unboundedPreceding, -1)
    )
    shift = F.coalesce(F.sum("_done").over(before), F.lit(0))
    return (
        marked.withColumn("position", (F.col("page_ordinal") - shift).cast("int"))
        .where("_done is null")
        .drop("_done")
    )
