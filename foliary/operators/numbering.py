"""Run-global page numbers and positions inside a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import key_bucket, number_rows
from foliary.session import kept


def page_in_source(pages: DataFrame, order: str) -> DataFrame:
    """0-based position of each page inside its source, along an integer ``order`` column."""
    return number_rows(
        pages, ["run_id", "source_id"], [order], key_bucket(order), "page_in_doc"
    )


TASK_BITS = 33


def range_numbers(keys: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Dense 0-based numbers inside each group along ``order``, from one range sort of the keys.

    Each task's rows lie in a row, so a group is a few segments, one a task: a row's number is the rows of the segments
    before and its distance from the first of its own.  Rows are sorted once and never meet in a window; only segments do.
    """
    at = [*group, *order]
    sorted_ = keys.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_at", F.monotonically_increasing_id())
    rows = kept(sorted_)
    task = F.shiftright("_at", TASK_BITS).alias("_task")
    segments = rows.groupBy(*group, task).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = segments.select(*group, "_task", (F.col("_from") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero"))
    r, s = rows.select("*", task).alias("r"), starts.alias("s")
    same = F.col("r._task") == F.col("s._task")
    for g in group:  # null-safe so that a null group is numbered too
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    number = (F.col("_at") - F.col("_zero")).cast("int").alias(out)
    return r.join(s, same).select(*[F.col(f"r.{c}") for c in keys.columns], number)


def global_page_index(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Dense page numbers over a run's sources in their stated order (``pos``).

    Only keys are sorted; no run is ever held in one task.
    """
    keys = pages.select("run_id", "source_id", "page_in_doc").join(sources.select("run_id", "source_id", "pos"), ["run_id", "source_id"])
    numbers = range_numbers(keys, ["run_id"], ["pos", "source_id", "page_in_doc"], "page_index").drop("pos")
    return pages.join(numbers, ["run_id", "source_id", "page_in_doc"]).select(*pages.columns, "page_index")
