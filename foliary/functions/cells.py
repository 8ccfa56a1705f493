"""Spreadsheet scalars: addresses, number text, date serials, number-format classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.core import ColumnLike, bind, col, strip_space

# Address pattern, sheet limits and the last date serial.
REF_PATTERN = "^([A-Z]{1,3})([0-9]{1,7})$"
COLUMN_PATTERN = "^[A-Z]{1,3}$"
MAX_COLUMN = 16384
MAX_ROW = 1048576
MAX_DATE_SERIAL = 2958465


def col_to_number(c: ColumnLike) -> Column:
    """``A`` is 1; null for anything but one to three capitals."""
    letters = F.lpad(col(c), 3, "@")  # '@' is the character before 'A', so it weighs nothing
    digit = [F.ascii(F.substring(letters, k, 1)) - 64 for k in (1, 2, 3)]
    return F.when(
        F.regexp_like(col(c), F.lit(COLUMN_PATTERN)), digit[0] * 676 + digit[1] * 26 + digit[2]
    )


def number_to_col(n: ColumnLike) -> Column:
    """Letters of a 1-based column number; null below 1 or above three letters."""
    k = col(n).cast("int")
    last = (k - 1) % 26
    rest2 = F.floor((k - 1 - last) / 26).cast("int")
    mid = (rest2 - 1) % 26
    rest3 = F.floor((rest2 - 1 - mid) / 26).cast("int")
    letter = lambda v: F.chr((v + 65).cast("long"))
    return F.when(
        k.between(1, 18278),
        F.concat(
            F.when(rest3 >= 1, letter(rest3 - 1)).otherwise(""),
            F.when(rest2 >= 1, letter(mid)).otherwise(""),
            letter(last),
        ),
    )


def is_cell_ref(c: ColumnLike) -> Column:
    row = F.regexp_extract(col(c), REF_PATTERN, 2).try_cast("int")
    return F.coalesce(F.regexp_like(col(c), F.lit(REF_PATTERN)) & (row >= 1), F.lit(False))


def parse_ref(c: ColumnLike) -> Column:
    """Struct (col, row); null for text that is no address."""
    return F.when(
        is_cell_ref(c),
        F.struct(
            col_to_number(F.regexp_extract(col(c), REF_PATTERN, 1)).alias("col"),
            F.regexp_extract(col(c), REF_PATTERN, 2).try_cast("int").alias("row"),
        ),
    )


def format_ref(column: ColumnLike, row: ColumnLike) -> Column:
    return F.when(col(row) >= 1, F.concat(number_to_col(column), col(row).cast("string")))


def plain_number(raw: ColumnLike) -> Column:
    """Number text at 15 significant digits, no exponent, no trailing zeros.

    Text that is no finite number is only trimmed.
    """

    def by_digits(v: Column) -> Column:
        digits, exp = v["digits"], v["exp"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
        inner = F.concat(
            F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.lit(15))
        )
        body = F.when(exp < 0, small).when(exp >= 14, F.rpad(digits, exp + 1, "0")).otherwise(inner)
        return F.when(exp >= 14, body).otherwise(
            F.regexp_replace(F.regexp_replace(body, "0+$", ""), "[.]$", "")
        )

    def scientific(x: Column) -> Column:
        """Fifteen digits and the exponent of a magnitude."""

        def split(sci: Column) -> Column:
            return F.struct(
                F.translate(F.substring_index(sci, "e", 1), ".", "").alias("digits"),
                F.substring_index(sci, "e", -1).try_cast("int").alias("exp"),
            )

        return bind(bind(F.format_string("%.14e", F.abs(x)), split), by_digits)

    def number(v: Column) -> Column:
        t, x = v["t"], v["x"]
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
        return (
            F.when(~finite, t)
            .when(whole, x.cast("bigint").cast("string"))
            .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), scientific(x)))
        )

    trimmed = strip_space(raw)
    return bind(bind(trimmed, lambda t: F.struct(t.alias("t"), t.try_cast("double").alias("x"))), number)


def serial_to_date(serial: ColumnLike, date1904: ColumnLike) -> Column:
    """dd/mm/yyyy text of a serial day, with the 1900 system's day that never was."""
    d = F.floor(col(serial)).cast("int")
    fmt = lambda base, n: F.date_format(F.date_add(F.lit(base).cast("date"), n), "dd/MM/yyyy")
    return (
        F.when(d.isNull() | (d > MAX_DATE_SERIAL), F.lit(None).cast("string"))
        .when(col(date1904), F.when(d >= 0, fmt("1904-01-01", d)))
        .when(d < 1, F.lit(None).cast("string"))
        .when(d == 60, F.lit("29/02/1900"))
        .when(d > 60, fmt("1899-12-30", d))
        .otherwise(fmt("1899-12-31", d))
    )


def strip_literals(code: ColumnLike) -> Column:
    """A number-format code without quoted text, escapes and brackets; elapsed time is kept."""
    token = r'"[^"]*(?:"|$)|[\\_*](?s:.)?|\[(?!(?i:h+|m+|s+)(?:\]|$))[^\]]*(?:\]|$)'
    bare = F.regexp_replace(col(code), token, "")
    return F.regexp_replace(bare, r"[\[\]]", "")


def format_class(format_id: ColumnLike, code: ColumnLike) -> Column:
    """'date', 'percent' or null.  A custom code wins over the built-in number."""
    i = col(format_id)
    bare = strip_literals(code)
    custom = F.when(F.regexp_like(bare, F.lit("(?i)[dmyhs]")), "date").when(
        F.contains(bare, F.lit("%")), "percent"
    )
    built_in = F.when(i.between(14, 22) | i.between(45, 47), "date").when(i.isin(9, 10), "percent")
    return F.when(col(code).isNotNull(), custom).otherwise(built_in)
