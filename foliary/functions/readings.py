"""Line texts as evidence: running-head tokens, second readings, edit distance, signatures."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.core import SPACE_CLASS, ColumnLike, col


def furniture_tokens(c: ColumnLike) -> Column:
    """Distinct tokens with digit runs masked, so that numbered footers collapse together."""
    masked = F.regexp_replace(F.lower(col(c)), "[0-9]+", "#")
    kept = F.regexp_replace(masked, r"[^\p{L}\p{N}#]+", " ")
    return F.array_distinct(F.filter(F.split(kept, " "), lambda t: t != ""))


def has_a_letter(c: ColumnLike) -> Column:
    """Whether any token of the text would carry a letter; cheaper than looking at the tokens."""
    return F.regexp_like(col(c), F.lit(r"\p{L}"))


def carries_a_word(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.regexp_like(t, F.lit(r"\p{L}")))


def token_overlap(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b)).cast("double")
    widest = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / widest)


def fold_confusables(c: ColumnLike) -> Column:
    return F.translate(col(c), "lio", "110")


def comparable_tokens(c: ColumnLike) -> Column:
    """Folded tokens in reading order; empty ones dropped.

    Texts are folded whole; the costly patterns run only where a text isn't ASCII or a token holds more than it may.
    """
    folded = fold_confusables(F.lower(col(c)))
    ascii_only = F.octet_length(col(c)) == F.char_length(col(c))
    tokens = F.when(ascii_only, F.split(folded, r"\s+")).otherwise(F.split(folded, f"{SPACE_CLASS}+"))
    clean = lambda t: F.when(F.regexp_like(t, F.lit("[^a-z0-9]")), F.regexp_replace(t, "[^a-z0-9]", "")).otherwise(t)
    return F.filter(F.transform(tokens, clean), lambda t: t != "")


def normalize_reading(c: ColumnLike) -> Column:
    return F.array_join(comparable_tokens(c), " ")


def signature_tokens(c: ColumnLike) -> Column:
    return F.filter(comparable_tokens(c), lambda t: F.length(t) >= 2)


def line_signature(c: ColumnLike) -> Column:
    return F.array_join(signature_tokens(c), " ")


def nearest_end(needle: str, haystack: str) -> tuple[int, int]:
    """(distance, end) of the nearest window, least end on ties.

    A column of the edit table is two bit vectors, of rows where it rises and where it falls by one, so a character of
    the haystack costs a few operations on numbers of as many bits as the needle has characters.
    """
    at: dict[str, int] = {}
    for i, ch in enumerate(needle):
        at[ch] = at.get(ch, 0) | 1 << i
    every = (1 << len(needle)) - 1
    top = 1 << len(needle) - 1
    rises, falls = every, 0
    score = best = len(needle)
    end = 0
    for j, ch in enumerate(haystack, start=1):
        same = at.get(ch, 0)
        steady = same | falls
        diagonal = (((same & rises) + rises) ^ rises) | same
        up = falls | (~(diagonal | rises) & every)
        down = rises & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j
        up <<= 1
        rises = (down << 1 | ~(steady | up)) & every
        falls = up & steady & every
    return best, end


# Cells of an edit table, two bits each, that are held at once on the way back.
HELD_BITS = 1 << 25


def window_start(needle: str, window: str) -> int:
    """Where the nearest window that ends with ``window`` starts: the way back through its edit table.

    A step goes back in both texts if that is as cheap as any, else in the needle, else in the window.  A column is two bit
    vectors, of the rows to step back in both and in the needle from.  Of a large table the state is held every so many
    columns and the columns between are made again, so a long page's table is never held whole.
    """
    at: dict[str, int] = {}
    for i, ch in enumerate(needle):
        at[ch] = at.get(ch, 0) | 1 << i
    every = (1 << len(needle)) - 1
    width = max(1, len(window)) if len(needle) * len(window) <= HELD_BITS else isqrt(len(window)) + 1

    def columns(rises: int, falls: int, part: str) -> Iterator[tuple[int, int, int]]:
        for ch in part:
            same = at.get(ch, 0)
            steady = same | falls
            diagonal = (((same & rises) + rises) ^ rises) | same
            both = same | ~(diagonal | falls)
            up = (falls | (~(diagonal | rises) & every)) << 1
            rises = ((rises & diagonal) << 1 | ~(steady | up)) & every
            falls = up & steady & every
            yield both, rises, falls

    i, j = len(needle), len(window)
    states = [(every, 0)]
    for k, (_, rises, falls) in enumerate(columns(every, 0, window[: (j - 1) // width * width]), start=1):
        if k % width == 0:
            states.append((rises, falls))
    while i and j:
        block = (j - 1) // width
        low = block * width
        held = [(both, rises) for both, rises, _ in columns(*states[block], window[low:j])]
        while i and j > low:
            both, rises = held[j - low - 1]
            if both >> i - 1 & 1:
                i, j = i - 1, j - 1
            elif rises >> i - 1 & 1:
                i -= 1
            else:
                j -= 1
    return j


def best_window(needle: str, haystack: str, limit: int | None = None) -> tuple[int, int, int] | None:
    """(distance, start, end) of the haystack window nearest to the needle, least end on ties; None if beyond a given limit."""
    if not needle:
        return 0, 0, 0
    if not haystack:
        return (len(needle), 0, 0) if limit is None or len(needle) <= limit else None
    hit = haystack.find(needle)
    if hit >= 0:
        return 0, hit, hit + len(needle)
    if limit is not None and not shares_grams(needle, haystack, limit):
        return None
    distance, end = nearest_end(needle, haystack)
    if limit is not None and distance > limit:
        return None
    # a window is no longer than needle and distance together, so its start needs this part of the table only
    lead = max(0, end - len(needle) - distance)
    return distance, lead + window_start(needle, haystack[lead:end]), end


WINDOW_TYPE = T.StructType(
    [
        T.StructField("distance", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)


@F.pandas_udf(WINDOW_TYPE)
def best_window_udf(needle: pd.Series, haystack: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [best_window(n or "", h or "") for n, h in zip(needle, haystack)],
        columns=["distance", "start", "end"],
    )


def _exact_hit(n: Column, h: Column) -> tuple[Column, Column]:
    """Whether the needle occurs as it is, and the window struct of its first occurrence."""
    at = F.call_function("instr", h, n)
    window = F.struct(
        F.lit(0).alias("distance"),
        (at - 1).cast("int").alias("start"),
        (at - 1 + F.length(n)).cast("int").alias("end"),
    )
    return at > 0, window


def best_substring_match(needle: ColumnLike, haystack: ColumnLike) -> Column:
    """Nearest window struct.  Exact hits stay in the JVM (``instr``); only misses reach Python."""
    n, h = col(needle), col(haystack)
    hit, exact = _exact_hit(n, h)
    # nulls cost nothing in the UDF: the pair is blanked out where an exact hit exists
    found = best_window_udf(F.when(~hit, n), F.when(~hit, h))
    return F.when(hit, exact).otherwise(found)


GRAMS = (2, 3)


def shares_grams(needle: str, haystack: str, tolerance: int) -> bool:
    """``may_match`` of two texts."""
    for q in GRAMS:
        least = len(needle) - (q - 1) - tolerance * q
        if least > 0:
            held = {haystack[i : i + q] for i in range(len(haystack) - q + 1)}
            if sum(needle[i : i + q] in held for i in range(len(needle) - q + 1)) < least:
                return False
    return True


def may_match(needle: ColumnLike, haystack: ColumnLike, tolerance: Column) -> Column:
    """False only if no window of the haystack is within the tolerance.

    An edit spoils q of the needle's q-grams at most, so a window within k edits has all of them but k * q.
    """
    n, h = col(needle), col(haystack)

    def enough(q: int) -> Column:
        least = F.length(n) - (q - 1) - tolerance * q
        grams = F.transform(F.sequence(F.lit(1), F.length(n) - (q - 1)), lambda i: F.substr(n, i, F.lit(q)))
        return F.when(least <= 0, True).otherwise(F.size(F.filter(grams, lambda g: F.contains(h, g))) >= least)

    return enough(GRAMS[0]) & enough(GRAMS[1])


# Characters from which a needle's q-grams are looked up in a set of the haystack's, not searched for one by one.
LONG_NEEDLE = 64


@F.pandas_udf(WINDOW_TYPE)
def window_within_udf(pair: pd.DataFrame) -> pd.DataFrame:
    """Nearest windows of ``needle, haystack, tolerance`` within the tolerance; of the others, and of nulls, nulls."""
    rows = zip(pair["needle"], pair["haystack"], pair["tolerance"])
    found = [None if n is None else best_window(n, h, int(t)) for n, h, t in rows]
    return pd.DataFrame([w or (None,) * 3 for w in found], columns=["distance", "start", "end"], dtype="Int32")


def window_within(needle: ColumnLike, haystack: ColumnLike, tolerance: Column) -> Column:
    """Nearest window struct if it is within the tolerance, else null.

    Pairs that share too few q-grams never reach the edit table; those of short needles are told apart in the JVM.
    """
    n, h = col(needle), col(haystack)
    hit, exact = _exact_hit(n, h)
    open_ = ~hit & ((F.length(n) > LONG_NEEDLE) | may_match(n, h, tolerance))
    # one struct, so that the test is made once a pair
    pair = F.struct(n.alias("needle"), h.alias("haystack"), tolerance.cast("int").alias("tolerance"))
    found = window_within_udf(F.when(open_ & tolerance.isNotNull(), pair))
    return F.when(hit, exact).when(found["distance"].isNotNull(), found)


def folded_agree_within(value: ColumnLike, reading: ColumnLike, tolerance: Column) -> Column:
    """T11 of texts folded before, as columns of their own: the test names them many times over."""
    return window_within(value, reading, tolerance).isNotNull()


def agrees_within(value: ColumnLike, reading: ColumnLike, tolerance: Column) -> Column:
    """Some part of the folded reading is within the tolerance of the folded value."""
    return folded_agree_within(normalize_reading(value), normalize_reading(reading), tolerance)


def agrees_exactly(value: ColumnLike, reading: ColumnLike) -> Column:
    """Tolerance 0: the folded value occurs inside the folded reading."""
    return F.contains(normalize_reading(reading), normalize_reading(value))
