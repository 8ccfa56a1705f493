"""Operators on small fixtures, some against brute force, at several shuffle widths."""

import random

from pyspark.sql import functions as F

from foliary.core import key_bucket, number_rows, prefix_sums
from foliary.operators import captures, citations, continuation, furniture, geometry, ledger, pools, quality, reconcile, sections

LINE = "run_id string, source_id string, page_index int, i int, text string, x double, y double, w double, h double, origin string"
PAGE = "run_id string, source_id string, page_index int, page_in_doc int, width int, height int"


def contract(spark, pages=5, extra=()):
    """Pages of body lines above a running footer of three lines."""
    rows, pg = [], []
    for p in range(pages):
        texts = [f"pasal {p} {k} {'abcdefgh'[(p * 3 + k) % 8] * 5} {'xyzuvw'[(p + k) % 6] * 4}" for k in range(6 + p % 3)]
        texts += ["PIHAK PERTAMA PIHAK KEDUA", f"Halaman {p + 1} dari {pages}", "Ref: KONTRAK/CONTOH/2026", *extra]
        for i, t in enumerate(texts):
            rows.append(("r", "s", p, i, t, 100.0, 100.0 + 40 * i, 700.0, 30.0, "measured"))
        pg.append(("r", "s", p, p, 1000, 1400))
    return spark.createDataFrame(rows, LINE), spark.createDataFrame(pg, PAGE), rows, pg


def brute_furniture(rows, pages):
    import re

    def tokens(t):
        t = re.sub(r"[0-9]+", "#", t.lower())
        return frozenset(re.sub(r"[^\w#]+|_", " ", t).split())

    tails = {}
    for p in pages:
        own = sorted((r[3], r[4]) for r in rows if r[2] == p[2] and r[1] == p[1])[-6:]
        tails[p[1], p[2]] = [(i, tokens(t)) for i, t in own if any(c.isalpha() for c in t)]
    out = set()
    for (s, p), own in tails.items():
        doc = [k for k in tails if k[0] == s]
        if len(doc) < 3:
            continue
        for i, a in own:
            n = sum(1 for k in doc if k == (s, p) or any(len(a & b) / max(len(a), len(b)) >= 0.6 for _, b in tails[k]))
            if n >= 0.5 * len(doc):
                out.add(("r", s, p, i))
    return out


def test_furniture(spark, partitions):
    lines, pages, rows, pg = contract(spark)
    got = partitions(lambda: furniture.running_furniture(lines, pages))
    assert set(got) == brute_furniture(rows, pg)
    assert {(r[0], r[1], r[2], r[3]) for r in rows if r[4].startswith("Halaman")} <= set(got)


def test_furniture_random_against_brute_force(spark):
    rng = random.Random(11)
    rows, pg = [], []
    for s in ("a", "b", "c"):
        for p in range({"a": 14, "b": 4, "c": 2}[s]):
            for i in range(rng.randint(1, 8)):
                text = " ".join(rng.choices(["page", "ref", "of", "the", "10", "x", "42", "sum"], k=rng.randint(1, 4)))
                rows.append(("r", s, p, i, text, 0.0, float(i), 1.0, 1.0, None))
            pg.append(("r", s, p, p, 10, 10))
    lines, pages = spark.createDataFrame(rows, LINE), spark.createDataFrame(pg, PAGE)
    spark.catalog.clearCache()
    got = {tuple(r) for r in furniture.running_furniture(lines, pages).collect()}
    assert got == brute_furniture(rows, pg)


def test_numbering_in_buckets(spark, partitions):
    rows = [("hot", k) for k in range(500)] + [("cold", k * 7) for k in range(20)] + [(None, k) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = partitions(lambda: number_rows(df, ["g"], ["k"], key_bucket("k", 16), "n"))
    want = {}
    for g, k in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.setdefault(g, []).append(k)
    assert sorted((str(g), k, n) for g, k, n in got) == sorted((str(g), k, n) for g, ks in want.items() for n, k in enumerate(ks))
    sums = prefix_sums(df.where("g = 'hot'"), ["g"], "k", F.lit(2), key_bucket("k", 16), "s")
    assert {r["k"]: r["s"] for r in sums.collect()} == {k: 2 * k for k in range(500)}


def greedy(words, tol=0.5):
    rows = []
    for w in sorted(words, key=lambda w: w[3]):
        for r in rows:
            top, bottom = min(x[3] for x in r), max(x[3] + x[5] for x in r)
            if min(w[3] + w[5], bottom) - max(w[3], top) >= tol * w[5]:
                r.append(w)
                break
        else:
            rows.append([w])
    return {i: " ".join(x[6] for x in sorted(r, key=lambda x: x[2])) for i, r in enumerate(rows)}


def test_words_to_lines_against_greedy_loop(spark, partitions):
    rng = random.Random(2)
    schema = "run_id string, page_index int, x double, y double, w double, h double, text string, seq int"
    rows = []
    for p in range(6):
        for k in range(60):
            rows.append(("r", p, float(rng.randint(0, 900)), float(rng.randint(0, 300)), 20.0, float(rng.choice([10, 20, 60])), f"t{k}", k))
    df = spark.createDataFrame(rows, schema)
    got = partitions(lambda: geometry.group_words_into_lines(df).select("page_index", "i", "text"))
    want = [(p, i, t) for p in range(6) for i, t in greedy([r for r in rows if r[1] == p]).items()]
    assert sorted(got) == sorted(want)


def test_ranges_trim_and_errors(spark):
    lines, pages, _, _ = contract(spark, pages=3)
    far = lines.withColumn("y", F.when(F.col("i") >= 6, F.col("y") + 900).otherwise(F.col("y"))).where("page_index = 0")
    z = spark.createDataFrame(
        [("r", 0, 0, 8, "high", 1), ("r", 0, 2, 99, "high", 2), ("r", 0, 5, 3, "high", 3), ("r", 7, 0, 1, "high", 4), ("r", None, None, None, "low", 5)],
        "run_id string, page_index int, from_line int, to_line int, confidence string, k int",
    )
    got = {r["k"]: r for r in geometry.resolve_ranges(z, far, pages).collect()}
    assert (got[1]["to_line"], got[1]["confidence"]) == (5, "high")
    assert (got[2]["to_line"], got[2]["confidence"]) == (5, "low")
    assert got[3]["error"] == "reversed"
    assert got[4]["error"] == "not-a-page-offered"
    assert got[5]["outcome"] == "none"


def test_completeness_blank_rows_do_not_break(spark):
    lines = spark.createDataFrame([("r", "s", 0, 0, "a", 0.0, 10.0, 5.0, 10.0, None)], LINE)
    pages = spark.createDataFrame([("r", "s", 0, 0, 100, 100)], PAGE)
    ink = spark.createDataFrame([("r", 0, y) for y in [10, 11, 40, 41, 60, 61]], "run_id string, page_index int, y int")
    r = quality.page_completeness(lines, ink, pages).collect()[0]
    assert (r["uncovered_run"], r["ink_bottom"], r["complete"]) == (4, 61, False)


def test_attempts(spark):
    rows = [("r", 0, 1, False, None), ("r", 0, 2, True, None), ("r", 1, 1, False, None), ("r", 1, 2, False, None), ("r", 2, 1, False, None), ("r", 2, 2, False, "bad")]
    a = spark.createDataFrame(rows, "run_id string, page_index int, attempt int, complete boolean, error string")
    got = {r["page_index"]: (r["kept_attempt"], r["outcome"]) for r in quality.best_attempt(a).collect()}
    assert got == {0: (2, "complete"), 1: (2, "short"), 2: (None, "refused")}


def test_spans_and_pool(spark):
    _, pages, _, _ = contract(spark, pages=4)
    spans = spark.createDataFrame([("r", "s", "KB", 0, 1), ("r", "s", "SP", 2, 3)], "run_id string, source_id string, doc_type string, from_page int, to_page int")
    assert pools.span_issues(spans, pages).count() == 0
    typed = pools.pages_by_type(spans, pages)
    wanted = spark.createDataFrame([("r", "q", "SP")], "run_id string, pool_id string, doc_type string")
    got = {r["page_index"]: r["position"] for r in pools.RankedPools(pages, typed, wanted).rows().collect()}
    assert got == {2: 0, 3: 1, 0: 2, 1: 3}
    bad = spark.createDataFrame([("r", "s", "KB", 0, 10**9), ("r", "s", "SP", 3, 2)], spans.schema)
    assert {r["issue"] for r in pools.span_issues(bad, pages).collect()} == {"past-last-page", "reversed"}


def test_overlaps_name_the_last_partner(spark):
    lines, pages, _, _ = contract(spark, pages=5)
    e = [("r", "s", 0, "pasal 0", 0, 2, 0, 0), ("r", "s", 1, "pasal 1", 1, 1, 0, 0), ("r", "s", 2, "pasal 2", 2, 3, 0, 0), ("r", "s", 3, "pasal 4", 4, 4, 0, 0)]
    entries = spark.createDataFrame(e, "run_id string, source_id string, pos int, title string, from_page int, to_page int, title_from int, title_to int")
    got = {r["pos"]: (r["reason"], r["overlaps_with"]) for r in sections.refuse_overlaps(sections.judge_sections(entries, pages, lines)).collect()}
    assert got == {0: ("overlaps", "pasal 2"), 1: ("overlaps", "pasal 0"), 2: ("overlaps", "pasal 0"), 3: (None, None)}


def test_walk_stops_and_pending(spark):
    lines, pages, _, _ = contract(spark, pages=4)
    ctx = continuation.page_context(lines, pages)
    zones = spark.createDataFrame([("r", "k", 0, 0, 5, False), ("r", "m", 1, 0, 6, False), ("r", "n", 2, 0, 1, False)], "run_id string, key string, page_index int, from_line int, to_line int, whole_page boolean")
    replies = spark.createDataFrame(
        [("r", "k", 1, True, 0, 6, "high"), ("r", "k", 2, False, None, None, "high"), ("r", "k", 3, True, 0, 1, "high")],
        "run_id string, key string, step int, continues boolean, from_pos int, to_pos int, confidence string",
    )
    confirmed = continuation.confirm_replies(replies, zones, lines, pages)
    got = sorted((r["key"], r["step"], r["outcome"]) for r in continuation.find_continuations(zones, confirmed, ctx).collect())
    assert got == [("k", 1, "found"), ("k", 2, "model-declined"), ("m", 1, "pending"), ("n", 1, "declined")]


def test_reconcile(spark, partitions):
    rows = [
        ("r", "name", 1, "PT Bank Contoh Nusantara Tbk", "uncited", None, None, None),
        ("r", "name", 2, "Bank Contoh Nusantara", "cited", 3, 1, 1),
        ("r", "name", 3, "BCN", "cited", 4, 0, 0),
        ("r", "city", 4, "Alpha", "cited", 1, 0, 0),
        ("r", "city", 5, "Beta", "cited", 2, 0, 0),
        ("r", "pics", 6, "Ani", "cited", 1, 0, 0),
        ("r", "pics", 7, "Budi", "invalid", None, None, None),
        ("r", "none", 8, "  ", "uncited", None, None, None),
    ]
    v = spark.createDataFrame(rows, "run_id string, field_key string, seq int, value string, status string, page_index int, from_line int, to_line int")
    lists = spark.createDataFrame([("pics",)], "field_key string")
    got = {r[1]: r for r in partitions(lambda: reconcile.reconcile(v, lists))}
    assert got["name"][2:4] == ("settled", "PT Bank Contoh Nusantara Tbk")
    assert got["city"][2] == "conflict" and got["pics"][2] == "list" and got["none"][2] == "blank"
    assert got["pics"][5] == "invalid" and got["pics"][6] == 1


def test_citation_ends_versus_every_line(spark):
    lines, pages, _, _ = contract(spark, pages=1)
    holes = lines.where("i <> 2")
    c = spark.createDataFrame([("r", 0, 1, 3)], "run_id string, page_index int, from_line int, to_line int")
    assert citations.citation_outcomes(c, holes, pages).collect()[0]["status"] == "cited"
    r = citations.whole_citations(c, holes, pages).collect()[0]
    assert (r["cited"], r["reason"], r["missing_line"]) == (False, "missing-line", 2)


def test_ledger_prices(spark):
    rows = [("r", "a", "gemini-3.5-flash", 1, 1_000_000, 0, 0, 2_000_000, 0, 0.0, False), ("r", "b", "unknown", 1, 1, 0, 0, 0, 0, 0.0, False), ("r", "c", "pages", 2, 0, 0, 0, 0, 2, 0.003, True), ("r", "d", None, 0, 0, 0, 0, 0, 0, 0.0, False)]
    t = spark.createDataFrame(rows, "run_id string, stage string, model_id string, calls int, input long, output long, thoughts long, cached_input long, pages long, page_cost_usd double, batch boolean")
    got = {r["stage"]: r["c"] for r in t.withColumn("c", ledger.usd_of_tally()).collect()}
    assert abs(got["a"] - 0.15) < 1e-9 and got["b"] is None and abs(got["c"] - 0.0015) < 1e-12 and got["d"] == 0


def test_remove_source_cuts_from_the_lowest_lost_capture(spark):
    pages = spark.createDataFrame([("r", "a", 0, 0, 9, 9), ("r", "b", 1, 0, 9, 9), ("r", "a", 2, 1, 9, 9)], PAGE)
    schema = "run_id string, key string, slot_key string, ordinal int, pos int, status string, page_index int, from_line int, to_line int, origin string, checked_for string"
    rows = [
        ("r", "s", "s", 1, 0, "confirmed", 2, 0, 1, "llm", "2:0-1"),
        ("r", "s#2", "s", 2, 1, "confirmed", 1, 0, 1, "llm", None),
        ("r", "s#3", "s", 3, 2, "confirmed", 2, 0, 1, "llm", None),
        ("r", "t", "t", 1, 3, "confirmed", 1, 0, 0, "llm", "1:0-0"),
        ("r", "u", "u", 1, 4, "confirmed", 2, 0, 0, "llm", "2:0-0"),
    ]
    gone = spark.createDataFrame([("r", "b")], "run_id string, source_id string")
    got = {r["key"]: (r["status"], r["page_index"], r["checked_for"]) for r in captures.remove_sources(spark.createDataFrame(rows, schema), pages, gone).collect()}
    assert got == {"s": ("confirmed", 1, None), "t": ("pending", None, None), "u": ("confirmed", 1, "1:0-0")}


def test_many_extras_lose_nothing_and_a_limit_gives_a_refused_row(spark):
    from foliary.operators import workbook_checks as wc

    fields = spark.createDataFrame([("r", "f1", "One")], "run_id string, field_id string, label string")
    answers = spark.createDataFrame([("r", "f1", 0, "cocok", "v", 0, 0, 0)], "run_id string, field_id string, pos bigint, verdict string, value string, page_index int, from_line int, to_line int")
    extras = spark.createDataFrame([("r", i, f"Extra {i}", "v", 0, 0, 0) for i in range(41)], "run_id string, pos bigint, label string, value string, page_index int, from_line int, to_line int")
    captures = spark.createDataFrame([("r", 0)], "run_id string, page_index int")
    lines = spark.createDataFrame([("r", 0, 0, "text", 0.0, 0.0, 1.0, 1.0, "t")], "run_id string, page_index int, i int, text string, x double, y double, w double, h double, origin string")
    assert wc.fold_screens(fields, answers, extras, captures, lines).count() == 42
    capped = wc.fold_screens(fields, answers, extras, captures, lines, max_extra=40).collect()
    assert sorted(str(r.reason) for r in capped if r.field_id is None) == ["too-many-extras"] and len(capped) == 2


def test_screens_of_one_id_keep_their_own_lines(spark):
    """A line belongs to a capture, not to the id that two captures may share."""
    from foliary.operators.compare import screen_violations

    captures_ = spark.createDataFrame([("r", 3, "0"), ("r", 20, "0"), ("r", 5, "5")], "run_id string, pos int, id string")
    lines = [("r", p, i) for p, n in ((3, (7, 1)), (20, (0, 1)), (5, (0, 1))) for i in n]
    got = screen_violations(captures_, spark.createDataFrame(lines, "run_id string, pos int, i int"))
    assert sorted(map(tuple, got.collect())) == [("r", 3, "lines-not-dense"), ("r", 20, "id-used-twice")]
