"""Small building blocks shared by every operator: keys, boxes, ordering, numbering.

Two rules run through the package.

* A *page* is the unit of locality.  Its lines fit one row (``pack_lines``), so work inside a
  page happens in higher-order functions on that row and never needs a second shuffle.
* Anything wider than a page (a source, a run, a field, a digest) may be hot.  Such groups are
  only ever aggregated with map-side partial aggregates, or numbered in bounded buckets
  (``number_rows``); they are never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAGE = ["run_id", "page_index"]
BOX = ["x", "y", "w", "h"]

# Fixed value: what the reference's regular-expression dialect calls white space.
SPACE_CLASS = (
    r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

# What any text but a blank one has a character of.
NO_SPACE_CLASS = "[^" + SPACE_CLASS[1:]

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: ColumnLike) -> Column:
    """Half-up rounding towards plus infinity, unlike Spark's half-away-from-zero."""
    return F.floor(col(c) + F.lit(0.5))


def strip_space(c: ColumnLike) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def is_blank(c: ColumnLike) -> Column:
    return ~F.regexp_like(F.coalesce(col(c), F.lit("")), F.lit(NO_SPACE_CLASS))


def first_by(df: DataFrame, keys: Sequence[str], pos: Sequence[str]) -> DataFrame:
    """Keep, per key, the whole row with the least ``pos``.

    A partial ``min_by`` aggregate rather than ``row_number() = 1``: a hot key is reduced on the
    map side and never sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    order = F.struct(*[F.col(p) for p in pos])
    best = F.min_by(F.struct(*rest), order).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def last_by(df: DataFrame, keys: Sequence[str], pos: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(p) for p in pos])
    best = F.max_by(F.struct(*rest), order).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[ColumnLike],
    bucket: Column,
    out: str,
    start: int = 0,
) -> DataFrame:
    """Dense numbering inside ``group`` without sorting a whole group in one task.

    ``bucket`` must never decrease along ``order`` and hold a bounded number of rows.  Bucket
    sizes are counted (partial aggregate), turned into offsets by a prefix sum over *buckets*,
    and the rows are ranked inside their bucket only.
    """
    g = list(group)
    tagged = df.withColumn("_b", bucket)
    sizes = tagged.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*g).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*g, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*g, "_b").orderBy(*[col(o) for o in order])
    # null-safe so that a null group is numbered too
    t, o = tagged.alias("t"), offsets.alias("o")
    cond = F.col("t._b").eqNullSafe(F.col("o._b"))
    for k in g:
        cond = cond & F.col(f"t.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = t.join(o, cond).select("t.*", "o._off")
    return joined.withColumn(
        out, (F.row_number().over(inside) - 1 + F.col("_off") + start).cast("int")
    ).drop("_b", "_off")


def key_bucket(c: ColumnLike, width: int = 65536) -> Column:
    """Order-preserving bucket of an integer key: at most ``width`` distinct keys share one."""
    return F.floor(col(c) / F.lit(width)).cast("long")


def right_of(x: ColumnLike, w: ColumnLike) -> Column:
    return col(x) + col(w)


def union_box_aggs(prefix: str = "") -> list[Column]:
    """Aggregates for the smallest box covering x/y/w/h rows."""
    return [
        F.min("x").alias(prefix + "x"),
        F.min("y").alias(prefix + "y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias(prefix + "w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias(prefix + "h"),
    ]


def pack_lines(lines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per page with its lines as an array sorted by line number.

    Bounded by the page; every line-range operator then works inside the row.
    """
    line = F.struct("i", "text", "x", "y", "w", "h", "origin", *extra)
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def in_range(lines: Column, frm: Column, to: Column) -> Column:
    return F.filter(lines, lambda l: (l["i"] >= frm) & (l["i"] <= to))


def union_of(lines: Column) -> Column:
    """Covering box of an array of line structs (null for an empty array); bind the array first."""
    x = F.array_min(F.transform(lines, lambda l: l["x"]))
    y = F.array_min(F.transform(lines, lambda l: l["y"]))
    r = F.array_max(F.transform(lines, lambda l: l["x"] + l["w"]))
    b = F.array_max(F.transform(lines, lambda l: l["y"] + l["h"]))
    return F.struct(x.alias("x"), y.alias("y"), (r - x).alias("w"), (b - y).alias("h"))


def padded(box: Column, pad: float, width: Column, height: Column) -> Column:
    """Grow a box by ``pad``, clip to the page, never a negative size."""
    x = F.greatest(F.lit(0.0), box["x"] - pad)
    y = F.greatest(F.lit(0.0), box["y"] - pad)
    r = F.least(width.cast("double"), box["x"] + box["w"] + pad)
    b = F.least(height.cast("double"), box["y"] + box["h"] + pad)
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        F.greatest(F.lit(0.0), r - x).alias("w"),
        F.greatest(F.lit(0.0), b - y).alias("h"),
    )


def joined_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda l: l["text"]), "\n")


def bind(value: Column, body) -> Column:
    """``let v = value in body(v)``: the value is computed once per row however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def median_of(values: Column) -> Column:
    """Exact median of a small array: mean of the two middle values."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        hi = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
        lo = F.try_element_at(s, F.greatest(F.floor(n / 2).cast("int"), F.lit(1)))
        return F.when(n % 2 == 1, hi).otherwise((lo + hi) / 2)

    return bind(F.array_sort(values), middle)


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    order: ColumnLike,
    value: ColumnLike,
    bucket: Column,
    out: str,
) -> DataFrame:
    """Exclusive running sum of ``value`` along ``order``, bucketed like ``number_rows``."""
    g = list(group)
    tagged = df.withColumn("_b", bucket).withColumn("_v", col(value))
    sizes = tagged.groupBy(*g, "_b").agg(F.sum("_v").alias("_n"))
    before = W.partitionBy(*g).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*g, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*g, "_b").orderBy(col(order)).rowsBetween(W.unboundedPreceding, -1)
    return (
        tagged.join(offsets, [*g, "_b"])
        .withColumn(out, F.col("_off") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_b", "_v", "_off")
    )
