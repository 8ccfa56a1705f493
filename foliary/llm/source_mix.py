"""Mixing sources to target weights by exact cuts in a random order.

Each document has a key, the md5 of its id and text. Within its source documents lie in the order of keys; the words
before each are a prefix sum, and the source's budget is cut there: whole epochs first, then what the rest of the budget
still covers of the order, the last document in part. Sources share the words of all documents by weight, at most
`most_epochs` times their own; what is above that is shared again by the others' weights.

The range sort is in parts of the key's range. Keys are uniform, so a source of n documents is cut into about sqrt(n)
parts of about sqrt(n) rows each: a source that holds a third of all rows is spread like the rest. Sums of the parts
are taken before the shuffle and added up by source, so no task sees a whole source. Sources may be many: they are
numbered by a range sort of their own, and of them only sums come to the driver. DataFrame functions only.

Defined cases: a null or empty text has no words and takes none. A null source is a source of its own, after all others.
Null ids count as empty in the key. Rows that repeat in full tie and are cut in any order, which gives the same rows;
they
share a part. Documents without any words, or an empty table, take nothing. Other columns are kept by `mixed` and
ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import common as C

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: The part of a key that places it in its range: seven hexadecimal digits.
DIGITS = 7


def _sources(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int, scratch: C.Scratch) -> DataFrame:
    """`source, number, source_size, target, parts`, a row for each source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    s = scratch.table(C.placed(sums, F.asc_nulls_last("source")), "sources")
    run = F.shiftright("place", C.PLACE_BITS).alias("run")
    runs = s.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that sorted
    runs = runs.select("run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    number = F.col("ahead") + F.col("place").bitwiseAND((1 << C.PLACE_BITS) - 1)
    s = s.select("*", run).join(runs, "run").withColumn("number", number)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    s = scratch.table(s.select("source", "number", "source_size", "docs", weight.alias("weight"), (F.col("source_size") * most_epochs).alias("limit")), "weights")
    level, above = 0.0, -1
    while True:
        over = F.col("limit") < F.lit(level) * F.col("weight")
        row = s.agg(F.count_if(over), F.sum("source_size"), F.sum(F.when(over, F.col("limit")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if row[0] == above or not row[3]:
            break
        above, level = row[0], (row[1] - row[2]) / row[3]
    target = F.least(F.lit(level) * F.col("weight"), F.col("limit").cast("double"))
    return s.select("source", "number", "source_size", target.alias("target"), F.ceil(F.sqrt("docs")).alias("parts"))


def _key() -> Column:
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.md5(whole.cast("binary"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id, size, source_size, target, taken` and the columns to `carry`: what the mix takes of each document.

    `taken` counts words, epochs included; a source's sum is its target, rounded.
    """
    scratch = C.Scratch(docs.sparkSession)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    # texts are read once: what follows is a few short columns
    carried = [F.struct(*carry).alias("carried")] if carry else []
    sizes = scratch.table(docs.select("doc_id", "source", size.alias("size"), _key().alias("key"), *carried), "sizes")
    sources = scratch.table(_sources(sizes, weights, most_epochs, scratch), "targets").withColumnRenamed("source", "of")
    place = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("double") / 16**DIGITS
    rows = sizes.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("part", F.floor(place * F.col("parts")))
    sums = rows.groupBy("number", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("number", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("start"))
    inner = Window.partitionBy("number", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, ["number", "part"])
    budget, of = F.round("target").cast("long"), F.col("source_size")
    epochs = F.when(of > 0, F.floor(budget / of)).otherwise(0)
    left = budget - epochs * of - F.col("start") - F.col("inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return at.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["carried.*"] if carry else []))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of `docs`: a document once for each epoch, a cut one with its first words."""
    held = docs.select("doc_id", "source", "text", F.struct("*").alias("all"), F.monotonically_increasing_id().alias("row"))
    held = C.Scratch(docs.sparkSession).table(held, "held")  # the ids of rows are fixed from here on
    takes = plan(held, weights, most_epochs, ("row",)).where("taken > 0").select("row", "size", "taken")
    rows = held.join(takes, "row").select("all", "size", "taken", F.explode(F.sequence(F.lit(1), F.expr("(taken + size - 1) div size"))).alias("epoch"))
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("all.text", F.lit(WORD), 0), 1, left.cast("int")), " ")
    text = F.when(left < F.col("size"), first).otherwise(F.col("all.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("all")[c].alias(c) for c in docs.columns])
