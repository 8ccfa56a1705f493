"""Recognition annotations (nested JSON) to words and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.core import BOX, PAGE, bind, is_blank
from foliary.operators.geometry import group_packed_words
from foliary.operators.quality import page_geometry
from foliary.session import kept
from foliary.sources.annotation_text import READERS, WHOLE, glued, row_type, word_type

BREAK = "property struct<detectedBreak: struct<type: string>>"
ANNOTATION = f"""fullTextAnnotation struct<pages: array<struct<blocks: array<struct<paragraphs: array<struct<words:
    array<struct<symbols: array<struct<text: string, {BREAK.replace(' ', ': ', 1)}>>,
                 {BREAK.replace(' ', ': ', 1)},
                 boundingBox: struct<vertices: array<struct<x: double, y: double>>>>>>>>>>>>"""


def ends_token(word: Column) -> Column:
    """Does a break follow?  The last symbol's break wins over the word's."""
    last = F.try_element_at(word["symbols"], F.lit(-1))["property"]["detectedBreak"]["type"]
    kind = F.coalesce(last, word["property"]["detectedBreak"]["type"])
    return F.coalesce(kind != "UNKNOWN", F.lit(False))


def box_from_vertices(vertices: Column) -> Column:
    """S3: covering box of the corners, a missing coordinate being 0; null without area."""
    xs = F.transform(vertices, lambda v: F.coalesce(v["x"], F.lit(0.0)))
    ys = F.transform(vertices, lambda v: F.coalesce(v["y"], F.lit(0.0)))
    extent = lambda v: bind(v, lambda c: F.struct(F.array_min(c).alias("least"), (F.array_max(c) - F.array_min(c)).alias("span")))

    def box(e: Column) -> Column:
        x, y = e["x"], e["y"]
        whole = F.struct(x["least"].alias("x"), y["least"].alias("y"), x["span"].alias("w"), y["span"].alias("h"))
        return F.when((x["span"] > 0) & (y["span"] > 0), whole)

    return bind(F.struct(extent(xs).alias("x"), extent(ys).alias("y")), box)


def word_text(word: Column) -> Column:
    text = F.array_join(F.transform(word["symbols"], lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return F.coalesce(text, F.lit(""))


def _blocks(column: str) -> Column:
    doc = F.from_json(F.col(column), ANNOTATION)["fullTextAnnotation"]["pages"]
    return F.flatten(F.transform(doc, lambda p: F.coalesce(p["blocks"], F.array())))


def _slow_words(blocks: Column, parts: tuple[str, ...]) -> Column:
    none = F.array().cast(T.ArrayType(row_type(word_type(parts))))
    found = {"text": word_text, "box": lambda w: box_from_vertices(w["boundingBox"]["vertices"]), "ends": ends_token}

    def of_paragraph(b: Column, p: Column, paragraph: Column) -> Column:
        read = lambda w, k: F.struct(b.alias("block_index"), p.alias("p"), k.alias("k"), *[found[c](w).alias(c) for c in parts])
        return F.coalesce(F.transform(paragraph["words"], read), none)

    def of_block(block: Column, b: Column) -> Column:
        nested = F.transform(block["paragraphs"], lambda paragraph, p: of_paragraph(b, p, paragraph))
        return F.coalesce(F.flatten(nested), none)

    return F.flatten(F.transform(blocks, of_block))


def read_annotations(annotations: DataFrame, column: str = "annotation", parts: tuple[str, ...] = WHOLE) -> DataFrame:
    """A row per annotation: its number of ``blocks`` (null without pages) and its ``words``, each a struct.

    Plain texts are parsed in batches, at a quarter of the cost; whatever is odd in them comes back null and goes through Spark's reader.
    """
    read = annotations.select(*PAGE, column, READERS[parts](column).alias("_read"))
    slow = bind(_blocks(column), lambda b: F.struct(F.when(b.isNotNull(), F.size(b)).alias("blocks"), _slow_words(b, parts).alias("words")))
    return read.select(*PAGE, F.coalesce("_read", slow).alias("_read")).select(*PAGE, "_read.blocks", "_read.words")


def annotation_words(annotations: DataFrame, column: str = "annotation", parts: tuple[str, ...] = WHOLE) -> DataFrame:
    """Every annotated word with block number, text, box (null when unusable) and break flag, or those ``parts`` of it that are read."""
    # the plain form would also filter pages on their words, which reads them once more for the test
    w = read_annotations(annotations, column, parts).select(*PAGE, F.posexplode_outer("words").alias("_at", "word"))
    return w.where("_at IS NOT NULL").select(*PAGE, *[f"word.{c}" for c in ("block_index", "p", "k", *parts)])


def _own(df: DataFrame, column: str | Column, name: str) -> DataFrame:
    """Each row's value as a column that Python can take: one that is still an expression of Python's own results it can't."""
    return df.select(*PAGE, F.explode(F.array(column)).alias(name))


def _page_tokens(annotations: DataFrame, column: str) -> DataFrame:
    """A row per page with its ``tokens``.

    Annotations are brought together only where a page has several, which its keys tell: words are many times their text.
    """
    words = _own(read_annotations(annotations, column), "words", "words")
    if not annotations.groupBy(*PAGE).count().where("count > 1").isEmpty():
        rows = words.groupBy(*PAGE).agg(F.collect_list("words").alias("_rows"))
        several = F.array_sort(F.flatten("_rows"))
        words = _own(rows, F.when(F.size("_rows") == 1, F.element_at("_rows", 1)).otherwise(several), "words")
    return _own(words.select(*PAGE, glued("words").alias("_tokens")), "_tokens", "tokens")


def words_from_annotations(annotations: DataFrame, column: str = "annotation") -> DataFrame:
    """Usable words with the unbroken ones glued, numbered in reading order per page.

    A word after a break or in another block starts a token in any case; what stands between is folded in order.  A page's
    words stay packed until they are tokens, so none is sorted or met in a window.
    """
    tokens = _page_tokens(annotations, column).select(*PAGE, F.posexplode_outer("tokens").alias("seq", "_t"))
    return tokens.where("seq IS NOT NULL").select(*PAGE, "seq", *[f"_t.{c}" for c in ("text", "block_index", *BOX)])


def annotation_report(annotations: DataFrame, column: str = "annotation") -> DataFrame:
    """Blocks and dropped words per page, counted inside the annotation's row."""
    bad = F.filter("words", lambda w: w["box"].isNull() | is_blank(w["text"]))
    read = read_annotations(annotations, column)
    counted = read.select(*PAGE, *[F.greatest(x, F.lit(0)).alias(n) for x, n in ((F.col("blocks"), "blocks"), (F.size(bad), "_d"))])
    return counted.select(*PAGE, "blocks", F.sum("_d").over(W.partitionBy(*PAGE)).alias("dropped"))


def lines_from_annotations(annotations: DataFrame, column: str = "annotation") -> DataFrame:
    """Words, then rows; every line is measured."""
    lines = _page_tokens(annotations, column).select(*PAGE, F.posexplode_outer(group_packed_words("tokens")).alias("i", "_l"))
    return lines.where("i IS NOT NULL").select(*PAGE, "i", "_l.text", *[f"_l.{c}" for c in BOX], "_l.n_words", F.lit("measured").alias("origin"))


def annotated_page_report(annotations: DataFrame, pages: DataFrame, column: str = "annotation") -> DataFrame:
    """S4's report: Q1 over the lines, with segment, block and dropped counts."""
    lines = kept(lines_from_annotations(annotations, column))
    segments = lines.groupBy(*PAGE).agg(F.sum("n_words").alias("segments"))
    return (
        page_geometry(lines, pages)
        .join(annotation_report(annotations, column), PAGE)
        .join(segments, PAGE, "left")
        .withColumn("segments", F.coalesce("segments", F.lit(0)))
        .withColumn("degraded", F.col("reasons") != "")
    )
