"""Keys, fingerprints, labels and report number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.core import ColumnLike, col

# Separator of a capture's ordinal and the 32-bit hash parameters.
CAPTURE_SEPARATOR = "#"
HASH_SEED = 2166136261
HASH_PRIME = 16777619
HASH_SIZE = 2**32


def slot_key_of(c: ColumnLike) -> Column:
    """Everything before the last separator."""
    return F.regexp_replace(col(c), "(?s)#[^#]*$", "")


def capture_ordinal_of(c: ColumnLike) -> Column:
    n = F.regexp_extract(col(c), "(?s)#([0-9]+)$", 1).try_cast("int")
    return F.when(n >= 1, n).otherwise(1)


def capture_key_for(slot_key: ColumnLike, ordinal: ColumnLike) -> Column:
    return F.when(col(ordinal) <= 1, col(slot_key)).otherwise(
        F.concat(col(slot_key), F.lit(CAPTURE_SEPARATOR), col(ordinal).cast("string"))
    )


def zone_fingerprint(page: ColumnLike, frm: ColumnLike, to: ColumnLike) -> Column:
    return F.concat(
        col(page).cast("string"), F.lit(":"), col(frm).cast("string"), F.lit("-"), col(to).cast("string")
    )


def continuation_checked(stamp: ColumnLike, page: ColumnLike, frm: ColumnLike, to: ColumnLike) -> Column:
    """A stamp counts only while it names the zone the capture has now."""
    return F.coalesce(col(stamp) == zone_fingerprint(page, frm, to), F.lit(False))


def fnv1a(c: ColumnLike) -> Column:
    """32-bit FNV-1a over characters, as eight hex digits."""
    codes = F.transform(F.split(col(c), ""), lambda ch: F.ascii(ch).cast("bigint"))
    folded = F.aggregate(
        F.when(col(c) == "", F.array().cast("array<bigint>")).otherwise(codes),
        F.lit(HASH_SEED).cast("bigint"),
        lambda h, ch: (h.bitwiseXOR(ch) * HASH_PRIME) % HASH_SIZE,
    )
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def to_fixed(x: ColumnLike, digits: int) -> Column:
    """Decimal text with a fixed number of digits and no grouping; of two equally near ones the one farther from zero.

    Formatting rounds the double's exact value, but ties to even. A value is a tie just when it is an odd multiple of
    2**-(digits + 1), which a product with a power of two shows exactly.
    """
    v = col(x).cast("double")
    size = F.abs(v)
    doubled = size * F.lit(float(2 ** (digits + 1)))
    up = F.ceil(size * F.lit(float(10**digits))) / F.lit(float(10**digits))
    text = F.format_number(F.when(doubled % 2 == 1, up).otherwise(size), digits)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.regexp_replace(text, ",", ""))


def compact_tokens(n: ColumnLike) -> Column:
    v = col(n)
    return (
        F.when(v >= 1_000_000, F.concat(to_fixed(v / 1_000_000, 2), F.lit("M")))
        .when(v >= 1_000, F.concat(to_fixed(v / 1_000, 1), F.lit("k")))
        .otherwise(v.cast("bigint").cast("string"))
    )


def usd_text(n: ColumnLike) -> Column:
    return F.concat(F.lit("$"), to_fixed(n, 4))


def relative(base: ColumnLike, candidate: ColumnLike) -> Column:
    """Percent change; from a zero base it is 0 when nothing changed and null otherwise."""
    b, c = col(base).cast("double"), col(candidate).cast("double")
    return F.when(b == 0, F.when(c == 0, F.lit(0.0))).otherwise(F.try_divide(c - b, b) * 100)


def signed(n: ColumnLike, digits: int = 1) -> Column:
    v = col(n)
    return (
        F.when(v.isNull(), "n/a")
        .when(v > 0, F.concat(F.lit("+"), to_fixed(v, digits)))
        .otherwise(to_fixed(v, digits))
    )


# The word for a continuation, the quote placeholder, output name parts.
CONTINUED = "lanjutan"
QUOTE_MARK = "{{quote}}"
REPORT_PREFIX = "Form_Validasi_"
UPDATED_SUFFIX = "_TERBARU"


def capture_label(label: ColumnLike, ordinal: ColumnLike) -> Column:
    o = col(ordinal)
    return (
        F.when(o <= 1, col(label))
        .when(o == 2, F.concat(col(label), F.lit(f" ({CONTINUED})")))
        .otherwise(F.concat(col(label), F.lit(f" ({CONTINUED} "), (o - 1).cast("string"), F.lit(")")))
    )


def display_label(label: ColumnLike, quote: ColumnLike) -> Column:
    """Only the first placeholder is filled."""
    at = F.locate(QUOTE_MARK, col(label))
    return F.when(at == 0, col(label)).otherwise(
        F.concat(
            F.substring(col(label), F.lit(1), at - 1),
            col(quote),
            F.substring(col(label), at + len(QUOTE_MARK), F.length(col(label))),
        )
    )


def slot_search_label(section_title: ColumnLike, slot_label: ColumnLike) -> Column:
    document = F.regexp_replace(col(section_title), rf"(?i)\s*\({CONTINUED}\)\s*$", "")
    return F.concat(document, F.lit(" / "), col(slot_label))


def deliverable_name(id_epic: ColumnLike, quote: ColumnLike, run_id: ColumnLike) -> Column:
    stem = F.concat_ws("_", F.nullif(col(id_epic), F.lit("")), F.nullif(col(quote), F.lit("")))
    return F.concat(
        F.lit(REPORT_PREFIX), F.coalesce(F.nullif(stem, F.lit("")), col(run_id)), F.lit(".docx")
    )


def updated_name(name: ColumnLike) -> Column:
    n = col(name)
    stem = F.regexp_extract(n, r"(?s)^(.+)(\.[^.]*)$", 1)
    ext = F.regexp_extract(n, r"(?s)^(.+)(\.[^.]*)$", 2)
    return F.when(stem == "", F.concat(n, F.lit(f"{UPDATED_SUFFIX}.xlsx"))).otherwise(
        F.concat(stem, F.lit(UPDATED_SUFFIX), ext)
    )
