"""How two spellings of one value differ: the kind of difference and the differing spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.core import SPACE_CLASS, ColumnLike, col, strip_space

# The kinds, from the least to the most serious.
KINDS = ["spasi", "huruf", "tanda-baca", "angka", "nilai"]

# Fixed value: marks a reader may drop; points and commas are dropped too unless they stand between two digits.
_MARKS_NOT_NUMERIC = r"[:;!?'\"‘’“”()\[\]{}\-–—_/\\]"


def without_space(c: ColumnLike) -> Column:
    return F.regexp_replace(col(c), f"{SPACE_CLASS}+", "")


def without_punctuation(c: ColumnLike) -> Column:
    return F.regexp_replace(
        col(c), rf"{_MARKS_NOT_NUMERIC}|(?<![0-9])[.,]|[.,](?![0-9])", ""
    )


def fold_key(c: ColumnLike) -> Column:
    return F.lower(strip_space(F.regexp_replace(col(c), f"{SPACE_CLASS}+", " ")))


_PARTS = r"(?s)^([^0-9]*)([0-9](?:.*[0-9])?)([^0-9]*)$"
_CORE = r"^([0-9]+)(?:[.,]([0-9]+))?$"


def number_parts(c: ColumnLike) -> Column:
    """Text before the first digit, first to last digit, text after.  Null without a digit."""
    t = strip_space(c)
    return F.when(
        F.regexp_like(t, F.lit("[0-9]")),
        F.struct(
            F.regexp_extract(t, _PARTS, 1).alias("head"),
            F.regexp_extract(t, _PARTS, 2).alias("core"),
            F.regexp_extract(t, _PARTS, 3).alias("tail"),
        ),
    )


def core_value(core: Column) -> Column:
    """Value of a digit group; a three-digit group after a separator is ambiguous, so null."""
    whole = F.regexp_extract(core, _CORE, 1)
    part = F.regexp_extract(core, _CORE, 2)
    return F.when(
        F.regexp_like(core, F.lit(_CORE)) & (F.length(part) != 3),
        F.when(part == "", whole.try_cast("double")).otherwise(
            F.concat(whole, F.lit("."), part).try_cast("double")
        ),
    )


def same_number(a: ColumnLike, b: ColumnLike) -> Column:
    pa, pb = number_parts(a), number_parts(b)
    return F.coalesce(
        (fold_key(pa["head"]) == fold_key(pb["head"]))
        & (fold_key(pa["tail"]) == fold_key(pb["tail"]))
        & (core_value(pa["core"]) == core_value(pb["core"])),
        F.lit(False),
    )


def kind_of(a: ColumnLike, b: ColumnLike) -> Column:
    sa, sb = without_space(a), without_space(b)
    da = F.lower(without_space(without_punctuation(a)))
    db = F.lower(without_space(without_punctuation(b)))
    return (
        F.when(sa == sb, "spasi")
        .when(F.lower(sa) == F.lower(sb), "huruf")
        .when(da == db, "tanda-baca")
        .when(same_number(a, b), "angka")
        .otherwise("nilai")
    )


def _chars(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def _common_prefix(a: Column, b: Column) -> Column:
    same = F.zip_with(_chars(a), _chars(b), lambda p, q: p.eqNullSafe(q))
    first_off = F.array_position(same, F.lit(False))
    return F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")


def spans_of(a: ColumnLike, b: ColumnLike) -> Column:
    """Half-open spans left after the longest common prefix and then suffix."""
    ca, cb = col(a), col(b)
    la, lb = F.length(ca), F.length(cb)
    prefix = _common_prefix(ca, cb)
    free = F.least(la, lb) - prefix
    suffix = F.least(_common_prefix(F.reverse(ca), F.reverse(cb)), free)
    return F.struct(
        prefix.alias("a_from"),
        (la - suffix).cast("int").alias("a_to"),
        prefix.alias("b_from"),
        (lb - suffix).cast("int").alias("b_to"),
    )


def describe_difference(a: ColumnLike, b: ColumnLike) -> Column:
    s = spans_of(a, b)
    return F.struct(kind_of(a, b).alias("kind"), *[s[n].alias(n) for n in ("a_from", "a_to", "b_from", "b_to")])


def label_key(c: ColumnLike) -> Column:
    """Label fold that also trims stars, brackets and parentheses."""
    one = F.regexp_replace(F.lower(col(c)), f"{SPACE_CLASS}+", " ")
    ends = r"[ :;.,\-*()\[\]]+"
    return F.trim(F.regexp_replace(one, f"^{ends}|{ends}$", ""))


def fold_label(c: ColumnLike) -> Column:
    """Narrower label fold: only colons, points, commas, semicolons and dashes are trimmed."""
    one = F.regexp_replace(F.lower(col(c)), f"{SPACE_CLASS}+", " ")
    ends = r"[ :.,;\-]+"
    return F.trim(F.regexp_replace(one, f"^{ends}|{ends}$", ""))
