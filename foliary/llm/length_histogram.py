"""Token counts from an exact histogram of encoded lengths.

Documents are summed by encoded length (the end id included), before the shuffle as well, so what travels is one row for
each length and task. Sums over longer lengths then answer, for each length as a context limit: how many documents and
tokens there are, how many documents reach the limit, the tokens kept if each document is cut there, and the share of
documents that fit. They are worked out in buckets of lengths with the totals of the buckets above added, so no task
sees all lengths.

Defined cases: a null or empty text is the end id alone, of length 1. Texts are whole. Rows that repeat count each time.
Ids don't matter. An empty table gives an empty histogram. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import bpe
from foliary.llm import common as C

BUCKET = 1024


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`length, docs`: how many documents have each encoded length."""
    path = tokenizer or bpe.default_path()

    def run(batches):
        encode = bpe.encoder(path)
        seen: dict[int, int] = {}
        for batch in batches:
            for b in C.slices(batch):
                for n, k in zip(*np.unique([len(x) // 4 + 1 for x in encode(b.column("text").to_pylist())], return_counts=True), strict=True):
                    seen[int(n)] = seen.get(int(n), 0) + int(k)
        yield pa.record_batch([pa.array(list(x), pa.int64()) for x in (seen.keys(), seen.values())], ["length", "docs"])

    return docs.select("text").mapInArrow(run, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(lengths: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """`length, docs` with `docs_from, tokens_from` (sums over this and greater lengths) and the totals."""
    rows = lengths.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("bucket", F.expr(f"length div {bucket}"))
    # a bucket row for each 1024 lengths: their suffix sums nest once more, by 1024 buckets
    sums = rows.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).withColumn("upper", F.expr(f"bucket div {bucket}"))
    tops = sums.groupBy("upper").agg(F.sum("d").alias("ud"), F.sum("t").alias("ut"))
    above = Window.orderBy(F.desc("upper")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    none = lambda c: F.coalesce(c, F.lit(0))
    tops = tops.select(
        "upper", none(F.sum("ud").over(above)).alias("ud"), none(F.sum("ut").over(above)).alias("ut"), F.sum("ud").over(total).alias("total_docs"), F.sum("ut").over(total).alias("total_tokens")
    )
    inner = Window.partitionBy("upper").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"pd": none(F.sum("d").over(inner)), "pt": none(F.sum("t").over(inner))}).join(tops, "upper")
    sums = sums.select("bucket", (F.col("pd") + F.col("ud")).alias("d"), (F.col("pt") + F.col("ut")).alias("t"), "total_docs", "total_tokens")
    within = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"d0": F.sum("docs").over(within), "t0": F.sum("tokens").over(within)}).join(sums, "bucket")
    return rows.select(
        "length", "docs", (F.col("d0") + F.col("d")).alias("docs_from"), (F.col("t0") + F.col("t")).alias("tokens_from"), "total_docs", "total_tokens"
    )


def truncated(limit: Column, docs_from: Column, tokens_from: Column, total_tokens: Column) -> Column:
    """Tokens left if documents are cut at a limit, from the sums of the first length that is not below it."""
    return total_tokens - tokens_from + limit * docs_from


def context_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row for each length that occurs, as a context limit.

    `context_limit, docs, docs_from, tokens_from, total_docs, total_tokens, truncated_tokens, docs_within, quantile`; the
    length is the q-quantile of all lengths for q up to `quantile` and above that of the row before.
    """
    # sums read the histogram at three depths: texts are encoded once
    s = suffix_sums(C.Scratch(docs.sparkSession).table(histogram(docs, tokenizer), "histogram"))
    within = F.col("total_docs") - F.col("docs_from") + F.col("docs")
    return s.select(
        F.col("length").alias("context_limit"), "docs", "docs_from", "tokens_from", "total_docs", "total_tokens",
        truncated(F.col("length"), F.col("docs_from"), F.col("tokens_from"), F.col("total_tokens")).alias("truncated_tokens"),
        within.alias("docs_within"), (within / F.col("total_docs")).alias("quantile"),
    )
