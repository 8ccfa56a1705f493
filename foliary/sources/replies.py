"""Model replies as columns: the JSON object in a free-text reply, and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.core import ColumnLike, col

# Fixed value: a fenced block in a reply.
_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def extract_json(reply: ColumnLike) -> Column:
    """First fenced block if any, then first ``{`` to last ``}``; null when there is none."""
    r = col(reply)
    body = F.when(F.regexp_like(r, F.lit(_FENCE)), F.regexp_extract(r, _FENCE, 1)).otherwise(r)
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_replies(replies: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """Whole-reply strict parsing: ``parsed`` or an ``error`` naming what failed.

    A reply that is no JSON, or has a value of another type than asked for, is kept as a corrupt record by the parser.
    """
    body = extract_json(reply)
    parsed = F.from_json(body, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return (
        replies.withColumn("_body", body)
        .withColumn("parsed", parsed)
        .withColumn(
            "error",
            F.when(F.col("_body").isNull(), "no-json-object").when(
                F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull(), "unreadable-json"
            ),
        )
        .drop("_body")
    )


def reply_entries(replies: DataFrame, list_field: str, reply: str = "reply") -> DataFrame:
    """Per-entry tolerant parsing: one row per list element, kept as raw text with its place."""
    raw = F.from_json(extract_json(reply), f"`{list_field}` array<string>")
    keep = [c for c in replies.columns if c != reply]
    return replies.select(*keep, F.posexplode(raw[list_field]).alias("pos", "entry"))


def repair_doubled_keys(reply: ColumnLike) -> Column:
    """Drop a ``"label":`` that is followed by another quoted key.

    The possessive loop keeps the match iterative: a reply may hold strings of any length.
    """
    return F.regexp_replace(col(reply), r'"label"\s*:\s*(?="(?:[^"\\]|\\.)*+"\s*:)', "")
