"""Annotation texts in batches: arrays of whole columns, no Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.core import NO_SPACE_CLASS

BOX_TYPE = pa.struct([(c, pa.float64()) for c in ("x", "y", "w", "h")])
PLACE = [(c, pa.int32()) for c in ("block_index", "p", "k")]
#: What is read of a word; a reader asked for some of it looks for no more.
PARTS = {"text": pa.string(), "box": BOX_TYPE, "ends": pa.bool_()}


def word_type(parts: tuple[str, ...]) -> pa.DataType:
    return pa.struct(PLACE + [(c, PARTS[c]) for c in parts])


def read_type(parts: tuple[str, ...]) -> pa.DataType:
    return pa.struct([("blocks", pa.int32()), ("words", pa.list_(word_type(parts)))])


def row_type(kind: pa.DataType) -> T.DataType:
    """Spark's type for an Arrow type; a text form would need a session to be read."""
    if pa.types.is_struct(kind):
        return T.StructType([T.StructField(f.name, row_type(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return T.ArrayType(row_type(kind.value_type))
    return {pa.int32(): T.IntegerType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType()}[kind]


# What is read at a time, which bounds the memory of a task.
PIECE_BYTES = 8 << 20
PIECE_ROWS = 10_000


class NotPlain(Exception):
    """A text that only Spark's own reader may judge."""


@lru_cache
def _parsing(parts: tuple[str, ...]) -> pj.ParseOptions:
    mark = [("property", pa.struct([("detectedBreak", pa.struct([("type", pa.string())]))]))]
    corners = pa.struct([("vertices", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])
    symbol = [("text", pa.string())] * ("text" in parts) + mark * ("ends" in parts)
    word = [("symbols", pa.list_(pa.struct(symbol)))] * bool(symbol) + mark * ("ends" in parts) + [("boundingBox", corners)] * ("box" in parts)
    kind = pa.list_(pa.struct(word))
    for name in ("words", "paragraphs", "blocks"):
        kind = pa.list_(pa.struct([(name, kind)]))
    schema = pa.schema([("fullTextAnnotation", pa.struct([("pages", kind)]))])
    return pj.ParseOptions(explicit_schema=schema, newlines_in_values=False, unexpected_field_behavior="ignore")


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the members of lists of these sizes: the list, and the place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - offsets_of(sizes)[owner]


def sizes_of(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lists_of(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets_of(sizes), pa.int32()), values)


def joined(texts: pa.Array, sizes: np.ndarray, mark: str) -> pa.Array:
    return pc.binary_join(lists_of(texts, sizes), mark)


def _spans(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least = np.minimum.reduceat(values, starts)
    return least, np.maximum.reduceat(values, starts) - least


def _boxes(words: pa.Array) -> pa.Array:
    """Covering boxes of the corners, a missing coordinate being 0; null without area."""
    corners = pc.struct_field(words, ["boundingBox", "vertices"])
    sizes = sizes_of(corners)
    some = sizes > 0
    box = np.zeros((4, len(words)))
    if some.any():
        each = corners.flatten()
        starts = offsets_of(sizes)[:-1][some]
        for at, name in enumerate(("x", "y")):
            values = pc.fill_null(pc.struct_field(each, name), 0.0).to_numpy(zero_copy_only=False)
            if not np.isfinite(values).all() or (np.signbit(values) & (values == 0)).any():
                raise NotPlain
            box[at, some], box[at + 2, some] = _spans(values, starts)
    return pa.StructArray.from_arrays([pa.array(v) for v in box], fields=list(BOX_TYPE), mask=pa.array(~((box[2] > 0) & (box[3] > 0))))


def _texts(words: pa.Array) -> pa.Array:
    symbols = pc.struct_field(words, "symbols")
    return joined(pc.fill_null(pc.struct_field(symbols.flatten(), "text"), ""), sizes_of(symbols), "")


def _ends(words: pa.Array) -> pa.Array:
    """The last symbol's break wins over the word's."""
    symbols, path = pc.struct_field(words, "symbols"), ["property", "detectedBreak", "type"]
    sizes = sizes_of(symbols)
    last = pa.array(offsets_of(sizes)[1:] - 1, pa.int64(), mask=sizes == 0)
    kind = pc.coalesce(pc.struct_field(symbols.flatten(), path).take(last), pc.struct_field(words, path))
    return pc.fill_null(pc.not_equal(kind, "UNKNOWN"), False)


def _parsed(texts: pa.Array, parts: tuple[str, ...]) -> pa.Array:
    """``read_type`` of plain texts: an object each, as anything else may run into its neighbour or is not for us to read."""
    if texts.null_count or not (pc.all(pc.starts_with(texts, "{")).as_py() and pc.all(pc.ends_with(texts, "}")).as_py()):
        raise NotPlain
    body = pc.binary_join(lists_of(texts, np.array([len(texts)])), "\n")[0].as_buffer()
    reading = pj.ReadOptions(use_threads=False, block_size=len(body) + 1)
    table = pj.read_json(pa.BufferReader(body), read_options=reading, parse_options=_parsing(parts))
    if table.num_rows != len(texts):
        raise NotPlain
    pages = pc.struct_field(table.column(0).combine_chunks(), "pages")
    row, _ = places(sizes_of(pages))
    blocks = pc.struct_field(pages.flatten(), "blocks")
    of_page, _ = places(sizes_of(blocks))
    row = row[of_page]
    counts = np.bincount(row, minlength=len(texts))
    number = np.arange(len(row)) - offsets_of(counts)[row]
    paragraphs = pc.struct_field(blocks.flatten(), "paragraphs")
    of_block, p = places(sizes_of(paragraphs))
    row, number = row[of_block], number[of_block]
    lists = pc.struct_field(paragraphs.flatten(), "words")
    of_paragraph, k = places(sizes_of(lists))
    row, number, p = row[of_paragraph], number[of_paragraph], p[of_paragraph]
    words = lists.flatten()

    found = {"text": _texts, "box": _boxes, "ends": _ends}
    columns = [pa.array(v, pa.int32()) for v in (number, p, k)] + [found[c](words) for c in parts]
    per_row = lists_of(pa.StructArray.from_arrays(columns, fields=list(word_type(parts))), np.bincount(row, minlength=len(texts)))
    # a page that has no list of pages has no count either
    blocks = pa.array(counts, pa.int32(), mask=pages.is_null().to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([blocks, per_row], fields=list(read_type(parts)))


def _read(texts: pa.Array, parts: tuple[str, ...]) -> Iterator[pa.Array]:
    """Halves what doesn't read as a whole, down to the texts that are left to Spark: their rows are null."""
    try:
        yield _parsed(texts, parts)
    except (pa.ArrowInvalid, NotPlain):
        if len(texts) == 1:
            yield pa.nulls(1, read_type(parts))
        else:
            half = len(texts) // 2
            yield from _read(texts.slice(0, half), parts)
            yield from _read(texts.slice(half), parts)


def pieces(size: np.ndarray, most: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[slice]:
    """Runs of rows of bounded size, of a row at least."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows, len(size))
        yield slice(at, to)
        at = to


def _readings(batches: Iterator[pa.Array], parts: tuple[str, ...]) -> Iterator[pa.Array]:
    for texts in batches:
        for part in pieces(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
            yield from _read(texts[part], parts)


WHOLE, BOX, ENDS = tuple(PARTS), ("box",), ("ends",)


@F.arrow_udf(row_type(read_type(WHOLE)))
def _plain_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _readings(batches, WHOLE)


@F.arrow_udf(row_type(read_type(BOX)))
def _plain_boxes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _readings(batches, BOX)


@F.arrow_udf(row_type(read_type(ENDS)))
def _plain_ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _readings(batches, ENDS)


#: By the parts read: blocks and words of annotation texts; null where a text isn't one plain JSON object with the fields' own types.
READERS = {WHOLE: _plain_words, BOX: _plain_boxes, ENDS: _plain_ends}

TOKEN_TYPE = pa.struct([("text", pa.string()), ("block_index", pa.int32()), *BOX_TYPE])
# Fixed value: how many words are glued at a time.
PIECE_WORDS = 200_000


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def _opening(top: np.ndarray, bottom: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words open a token: the starts, and any that shares no height with the growing token before it.

    The second words of all runs are judged at once, then the third, and so on.
    """
    opens, begin = starts.copy(), np.flatnonzero(starts)
    length, at = np.diff(begin, append=len(starts)), 1
    high, low = top[begin], bottom[begin]
    while (more := length > at).any():
        begin, length, high, low = begin[more], length[more], high[more], low[more]
        t, b = top[begin + at], bottom[begin + at]
        joins = less(high, b) & less(t, low)
        opens[begin + at] = ~joins
        high, low = np.where(joins, np.fmin(high, t), t), np.where(joins, np.maximum(low, b), b)
        at += 1
    return opens


def _tokens(pages: pa.Array) -> pa.Array:
    row, _ = places(sizes_of(pages))
    words = pages.flatten()
    usable = pc.and_(pc.is_valid(pc.struct_field(words, "box")), pc.match_substring_regex(pc.struct_field(words, "text"), NO_SPACE_CLASS))
    usable = pc.fill_null(usable, False)
    row, words = row[usable.to_numpy(zero_copy_only=False)], words.filter(usable)
    block, ends, x, y, w, h = (
        pc.struct_field(words, c).to_numpy(zero_copy_only=False) for c in ("block_index", "ends", ["box", "x"], ["box", "y"], ["box", "w"], ["box", "h"])
    )
    starts = (np.diff(row, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0) | np.append(True, ends[:-1])[: len(row)]
    begin = np.flatnonzero(_opening(y, y + h, starts))
    if not len(begin):
        return lists_of(pa.array([], TOKEN_TYPE), np.zeros(len(pages), dtype=np.int64))
    left, top = np.fmin.reduceat(x, begin), np.fmin.reduceat(y, begin)
    box = [left, top, np.maximum.reduceat(x + w, begin) - left, np.maximum.reduceat(y + h, begin) - top]
    text = joined(pc.struct_field(words, "text"), np.diff(begin, append=len(row)), "")
    columns = [text, pa.array(np.minimum.reduceat(block, begin), pa.int32()), *map(pa.array, box)]
    return lists_of(pa.StructArray.from_arrays(columns, fields=list(TOKEN_TYPE)), np.bincount(row[begin], minlength=len(pages)))


@F.arrow_udf(row_type(pa.list_(TOKEN_TYPE)))
def glued(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pages' words in reading order to tokens: usable ones, the unbroken of one block glued while they share some height."""
    for pages in batches:
        for part in pieces(sizes_of(pages), PIECE_WORDS):
            yield _tokens(pages[part])
