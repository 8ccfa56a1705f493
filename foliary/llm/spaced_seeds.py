"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words under the 1s of a fixed mask; the words under its 0s may differ. Seeds of all documents
that can be among the benchmark's (a bitmap of fixed size says so) are joined with the benchmark's, each hit gives an
alignment of a document with an item, and the alignment is verified word by word: it counts as an overlap if some
window of `window` words, or the whole item or document where that is shorter, agrees in at least `agree` of its words.

The masks are lossless: wherever the words that differ stand, some mask hits an overlap within the bound (`missed` counts
the patterns that none hits). Windows of 15 words have masks of their own, those of 10 to 14 and of 6 to 9 others. Texts
meet in the masks of the shorter one, so long documents use the short masks only if there are short items.

Defined cases: null and empty texts and items, and those of fewer than six words, overlap with nothing. Texts are whole,
however long. Rows with the same id and text get the same result; null ids are ids. Repeated items count once. With an
empty benchmark nothing is contaminated. Other columns are kept by `clean` and ignored otherwise, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

WINDOW = 15
AGREE = 0.8

# fixed values: masks for windows from so many words to the next number
MASKS = {
    6: ("110111", "11111", "111101", "101111", "111011"),
    10: ("110111", "111000101", "101011001"),
    15: ("1111011", "11001000111", "11010100011"),
}
_NEXT = {6: 10, 10: 15, 15: np.iinfo(np.int64).max}
_LONGER = np.uint64(0xA5A5A5A55A5A5A5A)


def _least(window: int, agree: float) -> int:
    """The least whole number of words that agrees."""
    return next(n for n in range(window + 1) if n >= agree * window)


def missed(window: int, agree: float = AGREE) -> int:
    """How many ways to differ in as many of `window` words as the bound allows are hit by no mask."""
    masks = MASKS[max(c for c in MASKS if c <= window)]
    hits = [sum(1 << (at + j) for j, x in enumerate(m) if x == "1") for m in masks for at in range(window - len(m) + 1)]
    differ = (sum(1 << i for i in c) for c in combinations(range(window), window - _least(window, agree)))
    return sum(all(d & h for h in hits) for d in differ)


def _seeds(words: np.ndarray, off: np.ndarray, mask: str, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word position in it, and hash of each seed of one mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = np.full(n, which + 1, np.uint64)
    for j in (j for j, x in enumerate(mask) if x == "1"):
        h = C.mix((h + words[j : j + n]) * C._STEP + np.uint64(j + 1))
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    at = np.flatnonzero(off[text + 1] - np.arange(n) >= len(mask))
    return text[at], at - off[text[at]], h[at]


def _chosen(words: np.ndarray, off: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and offsets of some texts alone, and their numbers."""
    n = np.diff(off)
    return words[np.repeat(texts, n)], np.concatenate([[0], np.cumsum(n[texts])]), np.flatnonzero(texts)


def seeds(rows: DataFrame, table: np.ndarray | None = None, short: tuple[int, ...] = ()) -> DataFrame:
    """`row, pos, seed` of the items `row, text`; with a table those of documents that can be in it.

    In the masks of its own length a text has two kinds of seeds as a document, for items of that length and for longer
    ones, and one kind as an item. `short` names the masks that longer documents use.
    """

    def run(batches):
        for batch in batches:
            for b in C.slices(batch):
                words, off = C.word_hashes(b.column("text"))
                names, n = b.column("row").to_numpy(), np.diff(off)
                for c, masks in MASKS.items():
                    own, longer = (n >= c) & (n < _NEXT[c]), n >= _NEXT[c]
                    kinds = [(own, 0), (longer, 1)] if table is None else [(own, 0), (own, 1)] + [(longer, 0)] * (c in short)
                    for texts, kind in kinds:
                        w, edges, which = _chosen(words, off, texts)
                        for k, mask in enumerate(masks if len(which) else ()):
                            text, pos, h = _seeds(w, edges, mask, 8 * c + k)
                            h = h ^ _LONGER if kind else h
                            if table is not None:
                                hit = C.possible(table, h)
                                text, pos, h = text[hit], pos[hit], h[hit]
                            yield pa.record_batch([pa.array(names[which[text]]), pa.array(pos), pa.array(h.view(np.int64))], ["row", "pos", "seed"])

    return rows.select("row", "text").mapInArrow(run, "row long, pos long, seed long")


def _short(items: DataFrame) -> tuple[int, ...]:
    """The masks that are some item's own."""

    def run(batches):
        for b in batches:
            n = np.diff(C.word_hashes(b.column("text"))[1])
            yield pa.record_batch([pa.array([c for c in MASKS if ((n >= c) & (n < _NEXT[c])).any()], pa.int32())], ["c"])

    return tuple(sorted(r.c for r in items.select("text").mapInArrow(run, "c int").distinct().collect()))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """`row, item, matched`: verified overlaps of documents with items; matched is the best window's count.

    Windows and bounds that the masks are not lossless for are refused.
    """
    lost = [w for w in range(min(MASKS), window + 1) if missed(w, agree)]
    if lost:
        raise ValueError(f"masks miss overlaps of {lost} words that agree in {agree}")
    scratch = C.Scratch(docs.sparkSession)
    rows = docs.select(C.row_key("doc_id", "text").alias("row"), "text")
    items = benchmark.where("text IS NOT NULL").select(C.row_key("text").alias("row"), "text").dropDuplicates(["row"])
    item_seeds = scratch.table(seeds(items).withColumnsRenamed({"row": "item", "pos": "item_pos"}), "item-seeds")
    table = C.membership(item_seeds.select("seed"))
    hits = seeds(rows, table, _short(items)).join(item_seeds, "seed").select("row", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
    found = scratch.table(hits.distinct().groupBy("row", "item").agg(F.collect_list("shift").alias("shifts")), "alignments")
    sieve_table = C.membership(found.select("row"))

    def sieve(batches):
        for b in batches:
            yield b.filter(pa.array(C.possible(sieve_table, b.column("row").to_numpy().view(np.uint64))))

    def verify(batches):
        for batch in batches:
            for b in C.slices(batch):
                words, off = C.word_hashes(b.column("text"))
                theirs, their_off = C.word_hashes(b.column("item_text"))
                best = []
                for i, shifts in enumerate(b.column("shifts").to_pylist()):
                    doc, item = words[off[i] : off[i + 1]], theirs[their_off[i] : their_off[i + 1]]
                    w, top = min(window, len(item), len(doc)), 0
                    for s in shifts:
                        lo, hi = max(0, -s), min(len(item), len(doc) - s)
                        if hi - lo >= w:
                            same = np.concatenate([[0], np.cumsum(doc[lo + s : hi + s] == item[lo:hi])])
                            top = max(top, int((same[w:] - same[:-w]).max()))
                    best.append(top if w and top >= agree * w else None)
                yield pa.record_batch([b.column("row"), b.column("item"), pa.array(best, pa.int64())], ["row", "item", "matched"])

    texts = rows.mapInArrow(sieve, "row long, text string").dropDuplicates(["row"])
    full = found.join(items.select(F.col("row").alias("item"), F.col("text").alias("item_text")), "item").join(texts, "row")
    return scratch.table(full.mapInArrow(verify, "row long, item long, matched long").where("matched IS NOT NULL"), "overlaps")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of `docs`: `doc_id, contaminated, n_items, item_ids` (sorted; without null ids)."""
    ids = benchmark.select(C.row_key("text").alias("item"), F.col("item_id").cast("long").alias("item_id"))
    found = overlaps(docs, benchmark).join(ids, "item").groupBy("row").agg(
        F.countDistinct("item").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    out = docs.select("doc_id", C.row_key("doc_id", "text").alias("row")).join(found, "row", "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that overlap with no item."""
    found = overlaps(docs, benchmark).select("row").distinct()
    return C.held(docs).join(found, "row", "left_anti").select("all.*")
