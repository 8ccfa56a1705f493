"""Page signatures and the line range a crop's text comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import PAGE, js_round
from foliary.functions.readings import best_substring_match, line_signature

# Least tolerance and its share of the crop's signature.
LEAST_TOLERANCE = 4
TOLERANCE_SHARE = 0.25


def page_signature_spans(lines: DataFrame) -> DataFrame:
    """Folded text of each line with its character span in the page's signature."""
    w = W.partitionBy(*PAGE).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    sig = lines.select(*PAGE, "i", line_signature("text").alias("sig"))
    # blank lines go after the window, as the folding would be done once more for a filter before it
    start = F.coalesce(F.sum(F.when(F.col("sig") != "", F.length("sig") + 1)).over(w), F.lit(0)).cast("int")
    return sig.withColumn("start", start).where("sig <> ''").withColumn(
        "end", (F.col("start") + F.length("sig")).cast("int")
    )
