"""Organisation and document-type names: folding, corporate forms, acronyms, equality.

Everything is a Catalyst expression over string columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.core import ColumnLike, col, strip_space

# Corporate designators, the one two-word designator, and the stop words.
CORPORATE_WORDS = ["pt", "tbk", "persero", "cv", "ud"]
CORPORATE_PHRASE = "perusahaan perseroan"
STOP_WORDS = ["dan", "di", "ke", "dari", "yang", "of", "the", "and"]

# The domain abbreviations and what they stand for.
DOMAIN_TERMS = {
    "PKS": "Perjanjian Kerja Sama",
    "BA": "Berita Acara",
    "BAP": "Berita Acara Permintaan",
    "BAST": "Berita Acara Serah Terima",
    "SP": "Surat Penunjukan",
    "SPH": "Surat Penawaran Harga",
    "TTD": "Tanda Tangan",
    "TOP": "Term of Payment",
    "SID": "Service ID",
    "MRC": "Monthly Recurring Charge",
    "NRC": "Non Recurring Charge",
    "OTC": "One Time Charge",
    "PSB": "Pasang Baru",
    "KCP": "Kantor Cabang Pembantu",
    "LOP": "Layanan Order Pelanggan",
    "VPN": "Virtual Private Network",
    "MPLS": "Multiprotocol Label Switching",
    "AO": "Activation Order",
    "MO": "Modify Order",
    "DO": "Delete Order",
}

_FORMS = "(?:" + "|".join([*CORPORATE_WORDS, CORPORATE_PHRASE]) + ")"


def normalize(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def words(c: ColumnLike) -> Column:
    n = normalize(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def letters(c: ColumnLike) -> Column:
    return F.upper(F.regexp_replace(col(c), "[^a-zA-Z0-9]+", ""))


def strip_corporate_forms(c: ColumnLike) -> Column:
    n = normalize(c)
    head = F.regexp_replace(n, f"^(?:{_FORMS}(?: |$))+", "")
    both = F.regexp_replace(head, f"(?:(?:^| ){_FORMS})+$", "")
    return F.coalesce(F.nullif(both, F.lit("")), n)


def significant_words(c: ColumnLike) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(
        F.split(strip_corporate_forms(c), " "),
        lambda t: (t != "") & ~F.array_contains(stop, t),
    )


def acronym_of(c: ColumnLike) -> Column:
    return F.array_join(F.transform(significant_words(c), lambda t: F.upper(F.substring(t, 1, 1))), "")


def domain_expansion(c: ColumnLike) -> Column:
    table = F.create_map(*[F.lit(v) for kv in DOMAIN_TERMS.items() for v in kv])
    return F.try_element_at(table, letters(c))


def domain_equivalent(a: ColumnLike, b: ColumnLike) -> Column:
    ea, eb = domain_expansion(a), domain_expansion(b)
    left = F.regexp_replace(normalize(F.coalesce(ea, col(a))), " ", "")
    right = F.regexp_replace(normalize(F.coalesce(eb, col(b))), " ", "")
    return (ea.isNotNull() | eb.isNotNull()) & (left != "") & (left == right)


def acronym_matches(short: ColumnLike, long: ColumnLike) -> Column:
    compact = letters(short)
    sig = significant_words(long)
    return (
        F.length(compact).between(2, 8)
        & (F.size(words(short)) == 1)
        & ~F.regexp_like(col(short), F.lit("[a-z]"))
        & (F.size(sig) >= 2)
        & ~F.array_contains(sig, F.lower(compact))
        & (compact == acronym_of(long))
    )


def is_name_like(c: ColumnLike) -> Column:
    sig = significant_words(c)
    return (F.size(sig) >= 2) & F.forall(sig, lambda t: ~F.regexp_like(t, F.lit("[0-9]")))


def contains_run(haystack: ColumnLike, needle: ColumnLike) -> Column:
    """Space-joined token strings: a run of at least two tokens inside another."""
    h, n = col(haystack), col(needle)
    padded_h = F.concat(F.lit(" "), h, F.lit(" "))
    padded_n = F.concat(F.lit(" "), n, F.lit(" "))
    return F.contains(n, F.lit(" ")) & F.contains(padded_h, padded_n)


def same_entity(a: ColumnLike, b: ColumnLike) -> Column:
    """Pairwise equality of two spellings.  Not transitive: compare with one canonical value."""
    na, nb = normalize(a), normalize(b)
    sa, sb = strip_corporate_forms(a), strip_corporate_forms(b)
    return (
        (na != "")
        & (nb != "")
        & (
            (na == nb)
            | domain_equivalent(a, b)
            | acronym_matches(a, b)
            | acronym_matches(b, a)
            | (sa == sb)
            | (is_name_like(a) & is_name_like(b) & (contains_run(sa, sb) | contains_run(sb, sa)))
        )
    )


def canonical_rank(value: ColumnLike, pos: ColumnLike) -> Column:
    """Sort key whose maximum is the canonical spelling: most words, longest, earliest."""
    v = strip_space(value)
    return F.struct(
        F.size(significant_words(v)).alias("n_sig"),
        F.length(v).alias("len"),
        (-col(pos).cast("long")).alias("neg_pos"),
    )
