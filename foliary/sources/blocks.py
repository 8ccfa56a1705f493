"""Block-list replies (boxes on a 0-1000 grid) to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE, bind, is_blank, js_round, strip_space
from foliary.operators.geometry import group_words_into_lines
from foliary.sources.replies import extract_json, repair_doubled_keys

# Coordinate grid and how many bad boxes a page may have.
GRID = 1000
MAX_DROPPED_SHARE = 0.05
MIN_DROPPED_ALLOWANCE = 3

_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_FOUR_NUMBERS = rf"^\[\s*{_NUMBER}(?:\s*,\s*{_NUMBER}){{3}}\s*\]$"


def printed_segments(text: Column) -> Column:
    """Printed lines of a block, blank ones trimmed at both ends only."""

    def inner(parts: Column) -> Column:
        filled = F.filter(
            F.transform(parts, lambda p, k: F.when(~is_blank(p), k).otherwise(F.lit(-1))), lambda k: k >= 0
        )
        ends = F.struct(F.array_min(filled).alias("a"), F.array_max(filled).alias("b"))
        return bind(
            ends,
            lambda e: F.coalesce(
                F.slice(parts, e["a"] + 1, e["b"] - e["a"] + 1), F.array().cast("array<string>")
            ),
        )

    return bind(F.split(text, r"\r?\n"), inner)


def convert_box(box_json: Column, width: Column, height: Column, segments: Column) -> Column:
    """Raw ``[ymin,xmin,ymax,xmax]`` text to a pixel box; null when it is unusable."""
    numbers = F.when(
        F.regexp_like(box_json, F.lit(_FOUR_NUMBERS)),
        F.transform(F.split(F.translate(box_json, "[] \t\n", ""), ","), lambda v: v.try_cast("double")),
    )
    scaled = lambda c, size: js_round(F.least(F.greatest(c / GRID * size, F.lit(0.0)), size.cast("double"))).cast("double")

    def edges(v: Column) -> Column:
        at = lambda k: F.try_element_at(v, F.lit(k))
        return F.struct(
            ((at(4) > at(2)) & (at(3) > at(1))).alias("forward"),
            scaled(at(2), width).alias("l"),
            scaled(at(4), width).alias("r"),
            scaled(at(1), height).alias("t"),
            scaled(at(3), height).alias("b"),
        )

    def box(e: Column) -> Column:
        ok = e["forward"] & (e["r"] - e["l"] >= 1) & (e["b"] - e["t"] >= segments)
        return F.when(
            ok,
            F.struct(
                e["l"].alias("x"), e["t"].alias("y"), (e["r"] - e["l"]).alias("w"), (e["b"] - e["t"]).alias("h")
            ),
        )

    return bind(bind(numbers, edges), box)


def bands_for(box: Column, n: Column) -> Column:
    """N stacked bands of a box; the last one ends exactly at its bottom."""
    edge = lambda k: box["y"] + js_round(box["h"] * k / n)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(
            box["x"].alias("x"),
            edge(k).cast("double").alias("y"),
            box["w"].alias("w"),
            (F.when(k == n - 1, box["y"] + box["h"]).otherwise(edge(k + 1)) - edge(k))
            .cast("double")
            .alias("h"),
        ),
    )


REPLY = "lines array<struct<box_2d: string, text: string, text_content: string, label: string>>"


def page_blocks(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Each page's entries as an array of (segments, n, box), with counts and the refusal.

    ``replies`` carries run_id, page_index, width, height and the reply text.  A reply is one
    page, so everything up to the bands happens in its row.
    """
    w, h = F.col("width"), F.col("height")

    def split(e: Column) -> Column:
        text = F.coalesce(e["text"], e["text_content"], e["label"], F.lit(""))
        parts = printed_segments(text)
        return F.struct(parts.alias("segments"), F.size(parts).alias("n"), e["box_2d"].alias("raw"))

    def place(e: Column) -> Column:
        return F.struct(
            e["segments"].alias("segments"), e["n"].alias("n"), convert_box(e["raw"], w, h, e["n"]).alias("box")
        )

    body = F.from_json(extract_json(repair_doubled_keys(reply)), REPLY)["lines"]
    p = replies.select(*PAGE, "width", "height", F.transform(F.transform(body, split), place).alias("blocks"))
    bad = F.size(F.filter("blocks", lambda e: (e["n"] > 0) & e["box"].isNull()))
    p = p.withColumn("entries", F.size("blocks")).withColumn("dropped", bad)
    allowed = F.greatest(F.lit(float(MIN_DROPPED_ALLOWANCE)), F.col("entries") * MAX_DROPPED_SHARE)
    return p.withColumn("refused", F.col("dropped") > allowed)


def block_entries(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per entry of a page's reply: segments, box or null, position."""
    # the plain form would also filter pages on their blocks, which parses and places them again for each test
    entries = page_blocks(replies, reply).select(*PAGE, F.posexplode_outer("blocks").alias("pos", "e"))
    return entries.where("pos IS NOT NULL").select(*PAGE, "pos", "e.*")


def block_report(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Per page: entries, dropped entries, and whether the whole page is refused."""
    return page_blocks(replies, reply).select(*PAGE, "entries", "dropped", "refused")


def bands_from_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Every printed band of every usable block of the pages not refused, marked when sliced."""
    # a refused page explodes to nothing; a filter would be pushed below and parse twice
    kept = F.when(~F.col("refused"), F.col("blocks"))
    e = page_blocks(replies, reply).select(*PAGE, F.posexplode(kept).alias("pos", "e"))
    e = e.select(*PAGE, "pos", "e.*")
    e = e.where("n > 0 and box is not null")
    zipped = F.arrays_zip(F.col("segments").alias("text"), bands_for(F.col("box"), F.col("n")).alias("band"))
    b = e.select(*PAGE, "pos", "n", F.posexplode(zipped).alias("k", "z"))
    return b.select(
        *PAGE,
        (F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("k")).alias("seq"),
        strip_space("z.text").alias("text"),
        F.col("z.band.x").alias("x"),
        F.col("z.band.y").alias("y"),
        F.col("z.band.w").alias("w"),
        F.col("z.band.h").alias("h"),
        (F.col("n") > 1).alias("interpolated"),
    ).where("text <> ''")


def lines_from_blocks(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Lines of every page whose reply was not refused."""
    return group_words_into_lines(bands_from_replies(replies, reply))
