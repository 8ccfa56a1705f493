"""Field values across pages: reconcile, lists, dispositions, outstanding.

``values``: run_id, field_key, seq, value, status ('cited', 'uncited', 'invalid'), page_index,
from_line, to_line.  A field of a run may have any number of values: they are first reduced to
distinct spellings by a partial aggregate, and lists or conflicts stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import is_blank, key_bucket, number_rows, strip_space
from foliary.functions.names import canonical_rank, same_entity

FIELD = ["run_id", "field_key"]
CITATION = ["status", "page_index", "from_line", "to_line"]

# Keys never extracted and keys never trusted.
NEVER_EXTRACTED = ["namaProyek"]
NEVER_HIGH = ["cc"]


def field_spellings(values: DataFrame) -> DataFrame:
    """Distinct non-blank spellings of a field with their first position and its citation."""
    answered = values.where(~is_blank("value")).withColumn("spelling", strip_space("value"))
    first = F.min_by(F.struct(*CITATION), F.col("seq")).alias("carrier")
    return answered.groupBy(*FIELD, "spelling").agg(F.min("seq").alias("pos"), first)


def reconcile(values: DataFrame, list_fields: DataFrame) -> DataFrame:
    """A1: one row per field: settled value, list, conflict or blank.

    Every spelling is compared with the canonical one only, as equality is not transitive.
    ``list_fields``: field_key, small.  Lists and conflicts are spelled out by
    ``spelling_rows``; the row here carries their number and the citation of A2.
    """
    spell = field_spellings(values)
    canon = spell.groupBy(*FIELD).agg(
        F.max_by("spelling", canonical_rank("spelling", "pos")).alias("canonical")
    )
    judged = spell.join(canon, FIELD)
    cited = F.col("carrier.status") == "cited"
    invalid = F.col("carrier.status") == "invalid"
    summary = judged.groupBy(*FIELD).agg(
        F.first("canonical").alias("canonical"),
        F.bool_and(same_entity("spelling", "canonical")).alias("agree"),
        F.count(F.lit(1)).cast("int").alias("spellings"),
        F.min_by("carrier", F.when(F.col("spelling") == F.col("canonical"), F.col("pos"))).alias("own"),
        F.min_by("carrier", F.when(invalid, F.col("pos"))).alias("first_invalid"),
        F.min_by("carrier", F.when(cited, F.col("pos"))).alias("first_cited"),
        F.bool_and(cited).alias("all_cited"),
    )
    fields = values.groupBy(*FIELD).agg(
        F.min_by(F.struct("value", *CITATION), F.col("seq")).alias("opening")
    )
    lists = list_fields.select("field_key", F.lit(True).alias("is_list"))
    r = fields.join(summary, FIELD, "left").join(lists, "field_key", "left")
    outcome = (
        F.when(F.col("canonical").isNull(), "blank")
        .when(F.col("agree"), "settled")
        .when(F.col("is_list"), "list")
        .otherwise("conflict")
    )
    r = r.withColumn("outcome", outcome)
    is_settled, is_list, is_blank_ = (F.col("outcome") == o for o in ("settled", "list", "blank"))
    list_status = (
        F.when(F.col("first_invalid").isNotNull(), "invalid")
        .when(F.col("all_cited"), "cited")
        .otherwise("uncited")
    )
    pick = lambda f: (
        F.when(is_settled, F.col(f"own.{f}"))
        .when(is_list, F.col(f"first_cited.{f}"))
        .when(is_blank_, F.col(f"opening.{f}"))
    )
    return r.select(
        *FIELD,
        "outcome",
        F.when(is_settled, F.col("canonical")).when(is_blank_, F.col("opening.value")).otherwise("").alias("value"),
        F.coalesce("spellings", F.lit(0)).alias("spellings"),
        F.when(is_list, list_status).otherwise(pick("status")).alias("status"),
        *[pick(c).alias(c) for c in CITATION[1:]],
    )


def spelling_rows(values: DataFrame, reconciled: DataFrame) -> DataFrame:
    """A2: members of every list value and sides of every conflict, in order of appearance.

    The joined text of a list is these rows in order; they are never gathered into one cell.
    """
    kept = reconciled.where(F.col("outcome").isin("list", "conflict")).select(*FIELD, "outcome")
    rows = field_spellings(values).join(kept, FIELD)
    placed = number_rows(rows, FIELD, ["pos"], key_bucket("pos"), "place")
    return placed.select(*FIELD, "outcome", "place", "spelling", "carrier.*")


def list_values_text(values: DataFrame, reconciled: DataFrame) -> DataFrame:
    """A2 as text chunks: at most 1,000 list members to a row, joined by newlines."""
    rows = spelling_rows(values, reconciled).where("outcome = 'list'")
    chunk = F.floor(F.col("place") / 1000).cast("int").alias("chunk")
    ordered = F.array_sort(F.collect_list(F.struct("place", "spelling")))
    return rows.groupBy(*FIELD, chunk).agg(
        F.array_join(F.transform(ordered, lambda t: t["spelling"]), "\n").alias("text")
    )


def dispositions(keys: DataFrame, reconciled: DataFrame, page_counts: DataFrame) -> DataFrame:
    """A3: one row per run and form key.

    ``keys``: run_id, field_key.  ``page_counts``: run_id, pages, searchable.
    """
    r = keys.join(reconciled, FIELD, "left").join(page_counts, "run_id", "left")
    pages, openp = F.coalesce("pages", F.lit(0)), F.coalesce("searchable", F.lit(0))
    never = F.col("field_key").isin(*NEVER_EXTRACTED)
    blank = is_blank("value") & (F.col("outcome") != "conflict")
    status = (
        F.when(never | (pages == 0) | (openp == 0), "not-searched")
        .when(F.col("outcome").isNull(), "not-found")
        .when(F.col("outcome") == "conflict", "conflict")
        .when((F.col("outcome") != "list") & blank, "not-found")
        .when(F.col("status") == "cited", "cited")
        .when(F.col("status") == "invalid", "citation-invalid")
        .otherwise("uncited")
    )
    reason = (
        F.when(never, "never-extracted")
        .when(pages == 0, "no-pages")
        .when(openp == 0, "nothing-open")
    )
    shown = F.col("disposition").isin("cited", "citation-invalid", "uncited")
    return (
        r.withColumn("disposition", status)
        .withColumn("reason", reason)
        .select(
            *FIELD,
            "disposition",
            F.when(shown, F.col("value")).otherwise("").alias("value"),
            F.when(
                (F.col("disposition") == "cited") & ~F.col("field_key").isin(*NEVER_HIGH), "high"
            )
            .otherwise("low")
            .alias("confidence"),
            F.coalesce(
                "reason", F.when(F.col("field_key").isin(*NEVER_HIGH) & shown, "never-high")
            ).alias("reason"),
            F.when(F.col("disposition") == "cited", F.col("page_index")).alias("page_index"),
        )
    )


def field_pages(pages: DataFrame) -> DataFrame:
    """Source name falls back to the id, page-in-document to the place in the source.

    ``pages``: run_id, page_index, source_id, source_name, page_in_doc (both nullable).
    """
    placed = number_rows(
        pages, ["run_id", "source_id"], ["page_index"], key_bucket("page_index"), "_place"
    )
    return placed.select(
        "run_id",
        "page_index",
        "source_id",
        F.coalesce("source_name", "source_id").alias("source_name"),
        F.coalesce("page_in_doc", "_place").alias("page_in_doc"),
    )


def outstanding_fields(rows: DataFrame, reconciled: DataFrame) -> DataFrame:
    """A4: form keys without a value, and why.  ``rows``: run_id, field_key, label, pos."""
    form = rows.where("field_key is not null and field_key <> ''").groupBy(*FIELD).agg(
        F.min_by("label", "pos").alias("label")
    )
    filled = (F.col("outcome") == "list") | ~is_blank("value")
    r = form.join(reconciled.select(*FIELD, "outcome", "value"), FIELD, "left")
    return r.where(~F.coalesce(filled, F.lit(False))).select(
        *FIELD,
        "label",
        F.when(F.col("field_key").isin(*NEVER_EXTRACTED), "never-extracted")
        .when(F.col("outcome") == "conflict", "documents-disagree")
        .otherwise("searched-not-found")
        .alias("reason"),
    )


def unmapped_values(rows: DataFrame, reconciled: DataFrame) -> DataFrame:
    """A4: values read for keys the form has no row for."""
    form = rows.where("field_key is not null and field_key <> ''").select(*FIELD).distinct()
    has = (F.col("outcome") == "list") | ((F.col("outcome") != "conflict") & ~is_blank("value"))
    return reconciled.where(has).join(form, FIELD, "left_anti").select(*FIELD, "value")
