"""Scalar functions on invented values."""

import random
import time

from pyspark.sql import functions as F

from foliary.core import SPACE_CLASS
from foliary.functions import cells, differ, keys, names, readings


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_same_entity(spark):
    cases = [
        ("BCN", "Bank Contoh Nusantara", True),
        ("Bank", "Bank Contoh Nusantara", False),
        ("PT Bank Contoh Nusantara Tbk", "bank contoh nusantara", True),
        ("Perusahaan Perseroan (Persero) PT Contoh", "CONTOH", True),
        ("BAST", "Berita Acara Serah Terima", True),
        ("bcn", "Bank Contoh Nusantara", False),
        ("Contoh Nusantara", "Bank Contoh Nusantara Raya", True),
        ("Unit 7 Raya", "Unit 7 Raya Baru", False),
        ("", "x", False),
        ("pt", "pt", True),
    ]
    got = column(spark, cases, "a string, b string, want boolean", names.same_entity("a", "b"))
    assert got == [c[2] for c in cases]


def test_strip_matches_token_loop(spark):
    rng = random.Random(5)
    vocabulary = ["pt", "tbk", "persero", "cv", "ud", "perusahaan", "perseroan", "alpha", "beta"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(1, 7))),) for _ in range(400)]

    def loop(text):
        t, changed = text.split(), True
        while changed and t:
            changed = False
            if t[:2] == ["perusahaan", "perseroan"]:
                t, changed = t[2:], True
            if t[-2:] == ["perusahaan", "perseroan"]:
                t, changed = t[:-2], True
            if t and t[0] in vocabulary[:5]:
                t, changed = t[1:], True
            if t and t[-1] in vocabulary[:5]:
                t, changed = t[:-1], True
        return " ".join(t) or text

    got = column(spark, rows, "a string", names.strip_corporate_forms("a"))
    assert got == [loop(r[0]) for r in rows]


def test_difference_kinds_and_spans(spark):
    cases = [
        ("10 Mbps", "10  Mbps", "spasi"),
        ("ABC", "abc", "huruf"),
        ("Jl. Contoh, 5", "Jl Contoh 5", "tanda-baca"),
        ("99", "99.00", "angka"),
        ("1.000", "1,000", "nilai"),
        ("10 Mbps", "10 Gbps", "nilai"),
        ("", "x", "nilai"),
    ]
    rows = [c[:2] for c in cases]
    got = column(spark, rows, "a string, b string", differ.kind_of("a", "b"))
    assert got == [c[2] for c in cases]
    spans = column(spark, [("aXXb", "aYb"), ("aa", "aaa"), ("", "x")], "a string, b string", differ.spans_of("a", "b"))
    assert [tuple(s) for s in spans] == [(1, 3, 1, 2), (2, 2, 2, 3), (0, 0, 0, 1)]


def test_cells(spark):
    refs = [("A1",), ("XFD1048576",), ("AA0",), ("a1",), ("ABCD1",), ("AN40",)]
    assert column(spark, refs, "r string", cells.is_cell_ref("r")) == [True, True, False, False, False, True]
    nums = [(n,) for n in (1, 26, 27, 40, 702, 703, 16384)]
    letters = column(spark, nums, "n int", cells.number_to_col("n"))
    assert letters == ["A", "Z", "AA", "AN", "ZZ", "AAA", "XFD"]
    back = column(spark, [(x,) for x in letters], "c string", cells.col_to_number("c"))
    assert back == [n[0] for n in nums]
    raws = [("1.50",), (" 12 ",), ("1e-7",), ("0.1",), ("abc ",), ("-2.25",), ("1234567.125",)]
    assert column(spark, raws, "r string", cells.plain_number("r")) == ["1.5", "12", "0.0000001", "0.1", "abc", "-2.25", "1234567.125"]
    serials = [(0, False), (1, False), (59, False), (60, False), (61, False), (0, True), (2958466, False)]
    got = column(spark, serials, "s int, d boolean", cells.serial_to_date("s", "d"))
    assert got == [None, "01/01/1900", "28/02/1900", "29/02/1900", "01/03/1900", "01/01/1904", None]
    codes = [("dd/mm/yyyy", "date"), ('"d"0.0', None), ("[h]:mm", "date"), ("0%", "percent"), ("[Red]0", None), ("0\\d", None), ("_d0", None)]
    rows = [(200, c) for c, _ in codes]
    assert column(spark, rows, "i int, c string", cells.format_class("i", "c")) == [w for _, w in codes]


def test_keys(spark):
    rows = [("slot",), ("slot#2",), ("a#b#03",), ("slot#x",), ("slot#0",)]
    assert column(spark, rows, "k string", keys.slot_key_of("k")) == ["slot", "slot", "a#b", "slot", "slot"]
    assert column(spark, rows, "k string", keys.capture_ordinal_of("k")) == [1, 2, 3, 1, 1]
    assert column(spark, [("",), ("a",), ("foobar",)], "k string", keys.fnv1a("k")) == ["811c9dc5", "e40c292c", "bf9cf968"]


def brute_window(needle, hay):
    best = None
    for s in range(len(hay) + 1):
        for e in range(s, len(hay) + 1):
            row = list(range(e - s + 1))
            for i, ch in enumerate(needle, 1):
                prev, row = row, [i]
                for j in range(1, e - s + 1):
                    row.append(min(prev[j - 1] + (ch != hay[s + j - 1]), prev[j] + 1, row[j - 1] + 1))
            d = row[-1]
            if best is None or (d, e) < best:
                best = (d, e)
    return best


def test_window_of_a_long_line_needs_no_wide_table():
    """The way back costs bits, not numbers, and a table too large to hold is made again in parts."""
    rng = random.Random(8)
    page = "".join(rng.choices("abcdefgh ", k=30_000))
    crop = "".join(c if rng.random() > 0.2 else "z" for c in page[5_000:20_000])
    began = time.process_time()
    distance, start, end = readings.best_window(crop, page)
    assert time.process_time() - began < 3
    assert abs(start - 5_000) < 5 and abs(end - 20_000) < 5
    held, readings.HELD_BITS = readings.HELD_BITS, 0
    try:
        for _ in range(300):
            n, h = ("".join(rng.choices("abc", k=rng.randint(1, k))) for k in (9, 40))
            readings.HELD_BITS = 0
            parts = readings.best_window(n, h)
            readings.HELD_BITS = held
            assert parts == readings.best_window(n, h)
    finally:
        readings.HELD_BITS = held
    assert readings.best_window(crop, page, distance - 1) is None
    assert readings.best_window(crop, page, distance) == (distance, start, end)


def test_folded_tokens_of_any_script(spark):
    texts = ["OIl-10  x\u00a0y", "a\u0085b \u2003 c\u00e9", "K\u212aL \u03a3\u03a3 \u0130z", "\ta\x0bb\x1cc\n", "--", "", None, "No. 7"]
    old = lambda c: F.filter(F.transform(F.split(c, f"{SPACE_CLASS}+"), lambda t: F.regexp_replace(readings.fold_confusables(F.lower(t)), "[^a-z0-9]", "")), lambda t: t != "")
    rows = [(t,) for t in texts]
    assert column(spark, rows, "t string", readings.comparable_tokens("t")) == column(spark, rows, "t string", old(F.col("t")))


def test_window_within_of_long_needles(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        h = "".join(rng.choices("abcde ", k=rng.randint(0, 300)))
        n = "".join(c if rng.random() > 0.15 else "q" for c in h[rng.randint(0, 50) : rng.randint(60, 250)])
        rows.append((n, h, rng.choice([0, 5, 20, 60])))
    rows += [(None, "a", 1), ("a", None, 1), ("a", "b", None)]
    got = column(spark, rows, "n string, h string, t int", readings.window_within("n", "h", F.col("t")))
    for (n, h, t), w in zip(rows, got, strict=True):
        best = None if None in (n, h, t) else readings.best_window(n, h)
        assert (w and tuple(w)) == (best if best and best[0] <= t else None)


def test_best_window_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = "".join(rng.choices("abc", k=rng.randint(0, 5)))
        h = "".join(rng.choices("abc", k=rng.randint(0, 8)))
        d, start, end = readings.best_window(n, h)
        if not n or not h:
            assert d == len(n) and (start, end) == (0, 0)
            continue
        assert (d, end) == brute_window(n, h)
        assert 0 <= start <= end


def test_best_substring_match_uses_both_ways(spark):
    rows = [("abc", "xxabcxx"), ("abd", "xxabcxx"), ("", "x")]
    m = column(spark, rows, "n string, h string", readings.best_substring_match("n", "h"))
    assert [(x["distance"], x["start"], x["end"]) for x in m][:2] == [(0, 2, 5), (1, 2, 4)]


def test_reading_fold(spark):
    assert column(spark, [(" No.  OIl-10 ",)], "t string", readings.normalize_reading("t")) == ["n0 01110"]
    assert column(spark, [("Hal 12 dari 300 dari",)], "t string", readings.furniture_tokens("t")) == [["hal", "#", "dari"]]
    assert column(spark, [(0.5, 12.5)], "a double, b double", F.concat(keys.to_fixed("a", 0), F.lit("/"), keys.to_fixed("b", 0))) == ["1/13"]


def test_fixed_text_takes_the_larger_of_two_equally_near(spark):
    import decimal

    cases = [(1.25, 1), (1.35, 1), (2.125, 2), (-0.5, 0), (0.5, 0), (2.5, 0), (-2.5, 0), (1.45, 1), (1.005, 2), (0.49999999999999994, 0), (-0.04, 1), (1234567.875, 2), (-1.25, 1)]
    for v, d in cases:
        exact = decimal.Decimal(abs(v)).quantize(decimal.Decimal(1).scaleb(-d), decimal.ROUND_HALF_UP)
        assert column(spark, [(v,)], "v double", keys.to_fixed("v", d)) == [f"{'-' if v < 0 else ''}{exact}"]
    assert column(spark, [(1250,), (2_125_000,)], "v long", keys.compact_tokens("v")) == ["1.3k", "2.13M"]
