"""Line dedup by a template tree of fixed depth.

A line's words are parsed down a tree: words with a digit or `@` are variable fields; the first level is the number of
words, the next ones are the leading words. In a leaf, a word at a position that fewer lines than the least support carry
there is a variable field too (no template can hold it as a constant). What is left constant is the line's template. A
template that recurs in enough documents, with at least `constant` of its words constant, is boilerplate: its lines are
dropped from all documents but the first (least id) that has it. So are identical lines (same words, digits included).

How many documents are enough depends on what recurs, and grows with the number of documents, D, where chance can make it
recur (`support`, `exact_support`). The least support is `min_docs` or D^(1/4), whichever is more. A template of f
constant and v variable words needs D^((8 - f + 2 v) / 16), at least the least support. Identical lines of n words need as
much as a template of n constants below 10 words; from there on 10 documents and less with each word, from 30 words on
two, whatever D is.

Leaves are never gathered: supports are counts by (leaf, position, word), templates order-free hashes of their
constants, both summed before they are shuffled. Only hashes travel; lines of leaves that too few documents share, which
are nearly all, are left out before their words are looked at. Identical lines are counted by one hash of all words.
Keys that can recur are found first, by sums a task makes of its own rows, and go into a bitmap of fixed size; only rows
that it lets through are shuffled and counted exactly.

Defined cases: null and empty texts have no lines and stay as they are; lines of fewer than three words are never
dropped; a document whose id is null is never the first unless all are; rows with the same id and text are one document
and get the same text. An empty table gives an empty result. Other columns are kept by `without_boilerplate`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

MIN_WORDS = 3
MIN_DOCS = 10
CONSTANT = 0.7
LEADING = 2
IDENTICAL = (10, 30)  # words from which identical lines need at most 10 documents, and two

_FIELD = np.zeros(256, bool)
_FIELD[48:58] = True
_FIELD[64] = True
_VARIABLE = np.uint64(1)


def _parsed(column: pa.Array):
    """Word hashes with fields masked, and for each line with words: text, number in it, first word, word count, leaf, and
    hash of all words as they are."""
    words, off = C.word_hashes(column)
    data, byte_off = C.utf8(column)
    starts, _, _ = C.word_spans(data, byte_off)
    if not len(words):
        return words, *(np.zeros(0, np.int64),) * 4, words, words
    plain = words
    words = np.where(np.add.reduceat(_FIELD[data] & ~C._SPACE[data], starts), _VARIABLE, words)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    breaks = np.cumsum(data == 10)
    before = np.concatenate([[0], breaks])[byte_off[:-1]]
    line = breaks[starts] - before[text]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])]))
    n = np.diff(np.append(first, len(words)))
    leaf = C.mix(n.astype(np.uint64))
    for j in range(LEADING):
        leaf = C.mix((leaf + words[np.minimum(first + np.minimum(j, n - 1), len(words) - 1)]) * C._STEP)
    place = (np.arange(len(plain)) - np.repeat(first, n)).astype(np.uint64)
    whole = C.mix(np.add.reduceat(C.mix((plain + place) * C._STEP), first) + n.astype(np.uint64))
    return words, text[first], line[first], first, n, leaf, whole


def _lines(rows: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """`row, doc_id, line, leaf, n, whole` of all lines with enough words, or with a table `row, doc_id, line, leaf, words`
    of those of leaves in it."""

    def run(batches):
        for batch in batches:
            for b in C.slices(batch):
                words, text, line, first, n, leaf, whole = _parsed(b.column("text"))
                use = n >= MIN_WORDS
                if table is not None and len(use):
                    use &= C.possible(table, leaf)
                at = np.flatnonzero(use)
                take = pa.array(text[at])
                cols = [b.column("row").take(take), b.column("doc_id").take(take), pa.array(line[at]), pa.array(leaf[at].view(np.int64))]
                names = ["row", "doc_id", "line", "leaf"]
                if table is not None:
                    flat = np.concatenate([words[first[i] : first[i] + n[i]] for i in at]) if len(at) else words[:0]
                    edges = np.concatenate([[0], np.cumsum(n[at])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int64))))
                    names.append("words")
                else:
                    cols += [pa.array(n[at]), pa.array(whole[at].view(np.int64))]
                    names += ["n", "whole"]
                yield pa.record_batch(cols, names)

    kind = "row long, doc_id long, line long, leaf long" + (", words array<long>" if table is not None else ", n long, whole long")
    return rows.mapInArrow(run, kind)


def support(constants: Column, variables: Column, total: int, min_docs: int = MIN_DOCS) -> Column:
    """Documents that a template needs among `total`."""
    share = F.least(F.greatest((8 - constants + 2 * variables) / 16, F.lit(0.25)), F.lit(1.0))
    return F.greatest(F.ceil(F.pow(F.lit(float(max(total, 1))), share)), F.lit(min_docs))


def exact_support(n: Column, total: int, min_docs: int = MIN_DOCS) -> Column:
    """Documents that an identical line of `n` words needs among `total`."""
    low, high = IDENTICAL
    longer = F.greatest(F.ceil(min_docs - (min_docs - 2) * (n - low) / (high - low)), F.lit(2))
    return F.when(n < low, support(n, F.lit(0), total, min_docs)).otherwise(longer)


def _recurring(lines: DataFrame, key: list[str], needed: Column) -> DataFrame:
    """`row, line` of lines (`row, doc_id, line` and the key) whose key is in enough documents, but for the first one."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    once = lines.select(*key, "row", "doc_id").distinct()
    found = once.groupBy(*key).agg(F.count("*").alias("docs"), F.min(order)["row"].alias("keeper")).where((F.col("docs") > 1) & (F.col("docs") >= needed))
    return lines.join(found, key).where(F.col("row") != F.col("keeper")).select("row", "line")


def _let_through(lines: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The lines whose `column` may be in the one long column set of `keys`."""
    table = C.membership(keys)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(C.possible(table, b.column(column).to_numpy(zero_copy_only=False).view(np.uint64))))

    return lines.mapInArrow(run, lines.schema)


def _word_keys() -> Column:
    """One hash of leaf, position and word for each of a line's words."""
    return F.transform("words", lambda w, i: F.xxhash64("leaf", i, w))


def _some(lines: DataFrame, often: DataFrame) -> DataFrame:
    """`row, line, key` of the words of lines that may be in `often` (`key`)."""
    table = C.membership(often)

    def run(batches):
        for b in batches:
            sizes, keys = np.diff(b.column("keys").offsets.to_numpy()), b.column("keys").flatten()
            may = np.flatnonzero(C.possible(table, keys.to_numpy(zero_copy_only=False).view(np.uint64)))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes)[may])
            yield pa.record_batch([b.column("row").take(at), b.column("line").take(at), keys.take(pa.array(may))], ["row", "line", "key"])

    return lines.select("row", "line", _word_keys().alias("keys")).mapInArrow(run, "row long, line long, key long")


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """`row, lines`: for each document that has some, the numbers of its lines to drop."""
    scratch = C.Scratch(docs.sparkSession)
    rows = docs.select(C.row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = scratch.table(_lines(rows), "every-line")
    total = rows.select("row").distinct().count()
    least = max(min_docs, math.ceil(total**0.25))
    twice = every.groupBy("whole").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("whole")
    same = _let_through(every.select("row", "doc_id", "line", "whole", "n"), twice, "whole")
    same = scratch.table(_recurring(same, ["whole", "n"], exact_support(F.col("n"), total, min_docs)), "identical")
    many = every.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("leaf")
    shared = _let_through(every.select("row", "leaf"), many, "leaf").distinct()
    shared = shared.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shared = scratch.table(shared.select("leaf"), "leaves")
    lines = _lines(rows, C.membership(shared)).join(shared, "leaf").dropDuplicates(["row", "line"])
    lines = scratch.table(lines.withColumn("n", F.size("words")), "lines")
    fields = F.arrays_zip(_word_keys().alias("key"), F.col("words").alias("word"))
    placed = lines.select(F.explode(fields).alias("at")).where(F.col("at.word") != F.lit(int(_VARIABLE)))
    often = placed.groupBy(F.col("at.key").alias("key")).agg(F.count("*").alias("seen"))
    often = scratch.table(often.where(F.col("seen") >= least).select("key"), "often")
    # one plan at all sizes: past the broadcast threshold these are shuffled anyway
    marked = _some(lines, often).join(often.hint("merge"), "key")
    fixed = marked.groupBy("row", "line").agg(F.bit_xor("key").alias("template"), F.count("*").alias("fixed"))
    ids = lines.select("row", "line", "doc_id", "leaf", "n").join(fixed, ["row", "line"])
    ids = scratch.table(ids.where(F.col("fixed") >= constant * F.col("n")), "templates")
    alike = _recurring(ids, ["leaf", "template", "n", "fixed"], support(F.col("fixed"), F.col("n") - F.col("fixed"), total, min_docs))
    return scratch.table(same.union(alike).groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("lines")), "drop")


def dropped(docs: DataFrame, **how) -> DataFrame:
    """`all, text, lines`: the row of `docs`, its new text and the numbers of the lines dropped (null: none).

    Only documents that may lose a line, by a bitmap of fixed size, are shuffled to the list of lines, each text once.
    """
    drop = boilerplate(docs, **how)
    rows = C.held(docs).withColumn("some", C.flagged(C.membership(drop.select("row")), "row"))
    cut = rows.where("some").join(drop.hint("merge"), "row", "left")
    kept = F.filter(F.split("all.text", "\n", -1), lambda x, i: ~F.array_contains("lines", i.cast("long")))
    cut = cut.select("all", F.when(F.col("lines").isNull(), F.col("all.text")).otherwise(F.array_join(kept, "\n")).alias("text"), "lines")
    whole = rows.where("NOT some").select("all", F.col("all.text").alias("text"), F.lit(None).cast("array<long>").alias("lines"))
    return whole.union(cut)


def without_boilerplate(docs: DataFrame, **how) -> DataFrame:
    """The columns of `docs` with new texts (and `n_chars` where there is such a column), without the documents that
    consisted of dropped lines alone."""
    out = dropped(docs, **how).where("lines IS NULL OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = F.col("all").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("lines").isNull(), F.col("all.n_chars")).otherwise(F.length("text"))
        new = new.withField("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(new.alias("all")).select("all.*")
