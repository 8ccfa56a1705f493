"""Index structures and plans: each against brute force, and how much they shuffle."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from foliary.functions import readings
from foliary.operators import citations, compare, furniture, pools, sections, workbook_checks
from foliary.operators.numbering import range_numbers
from foliary.plans import all_queries
from foliary.sources import blocks, sinks, transcripts


def table(needle, hay):
    """(distance, start, end) from the whole edit table; diagonal before deletion before insertion."""
    above = [(0, j) for j in range(len(hay) + 1)]
    for i, a in enumerate(needle, start=1):
        row = [(i, above[0][1])]
        for j, b in enumerate(hay, start=1):
            best = (above[j - 1][0] + (a != b), above[j - 1][1])
            for cost, start in ((above[j][0] + 1, above[j][1]), (row[j - 1][0] + 1, row[j - 1][1])):
                if cost < best[0]:
                    best = (cost, start)
            row.append(best)
        above = row
    end = min(range(len(hay) + 1), key=lambda j: above[j][0])
    return above[end][0], above[end][1], end


def test_nearest_windows_and_their_bound(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    rows = [(k, word(rnd.randrange(1, 24)), word(rnd.randrange(1, 70)), rnd.randrange(0, 6)) for k in range(400)]
    rows += [(400 + k, n[: rnd.randrange(1, 9)] + n[-rnd.randrange(1, 9) :], word(9) + n + word(9), 4) for k, n in enumerate(word(30) for _ in range(60))]
    rows += [(500, "x" * 300, "y" * 20_000 + "x" * 290 + "y" * 9, 75), (501, "ab", "", 1), (502, "", "ab", 0)]
    df = spark.createDataFrame(rows, "id int, n string, h string, k int")
    exact = lambda n, h: (0, h.find(n), h.find(n) + len(n)) if n in h else None
    want = {i: exact(n, h) or table(n, h) for i, n, h, _ in rows if i not in (500, 501, 502)}
    got = {r.id: r for r in df.select("*", readings.best_substring_match("n", "h").alias("m"), readings.window_within("n", "h", F.col("k")).alias("w"), readings.may_match("n", "h", F.col("k")).alias("may")).collect()}
    assert {i: tuple(got[i].m) for i in want} == want
    near = {i: want[i] for i, _, _, k in rows if i in want and want[i][0] <= k}
    assert {i: tuple(got[i].w) for i in want if got[i].w} == near and 60 < len(near) < len(want)
    assert all(got[i].may or want[i][0] > k for i, _, _, k in rows if i in want) and not all(r.may for r in got.values())
    assert got[500].m.distance == 10 and got[500].w.end == 20_290


def test_crops_without_distances_agree(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    lines = [("r", p, i, text(6)) for p in range(8) for i in range(12)]
    crops, pairs = [], []
    for c in range(40):
        run, p, i, t = rnd.choice(lines)
        for _ in range(rnd.choice((0, 2, 9, 40))):
            at = rnd.randrange(len(t))
            t = t[:at] + rnd.choice("abxyz") + t[at + 1 :]
        crops.append((c, 0, t if c else "--"))
        pairs.append((c, "r", p))
    args = (spark.createDataFrame(pairs, "crop_id int, run_id string, page_index int"), spark.createDataFrame(crops, "crop_id int, i int, text string"), spark.createDataFrame(lines, "run_id string, page_index int, i int, text string"))
    rows = lambda df: sorted(map(tuple, df.select("crop_id", F.coalesce("cause", F.lit("")), "min_line", "max_line").collect()), key=repr)
    full = compare.required_ranges(*args)
    assert rows(full) == rows(compare.required_ranges(*args, explain=False)) and {"no-match", "empty-crop", ""} <= {r[1] for r in rows(full)}


@pytest.mark.parametrize("n_pages", [1, 50])
def test_positions_by_arithmetic(spark, n_pages):
    rnd = random.Random(n_pages)
    pages = [(r, i * 3 + 1) for r in ("a", "b") for i in range(n_pages)]
    typed = [(r, p, t) for r, p in pages for t in ("KB", "SP") if rnd.random() < 0.4] + [("a", 1, "ALL"), ("b", 10**6, "KB")]
    typed += [("b", p, "ALL") for r, p in pages if r == "b"]
    wanted = [(r, q, t) for r in ("a", "b", "none") for q, t in (("one", "KB"), ("two", "KB"), ("two", "SP"), ("all", "ALL"), ("bare", None))]
    pool = pools.RankedPools(
        spark.createDataFrame(pages, "run_id string, page_index int"), spark.createDataFrame(typed, "run_id string, page_index int, doc_type string"), spark.createDataFrame(wanted, "run_id string, pool_id string, doc_type string")
    )
    want = {}
    for run in ("a", "b"):
        for q in ("one", "two", "all", "bare"):
            types = {t for r, p, t in wanted if r == run and p == q}
            first = {p for r, p, t in typed if r == run and t in types}
            for k, p in enumerate(sorted((p for r, p in pages if r == run), key=lambda p: (p not in first, p))):
                want[run, q, k] = p
    assert {(r.run_id, r.pool_id, r.position): r.page_index for r in pool.rows().collect()} == want
    cited = [(k, r, q, p) for k, (r, q, p) in enumerate([*want, *want, ("a", "one", n_pages), ("a", "one", -1), ("a", "one", None), ("a", "other", 0), ("none", "one", 0)])]
    got = pool.remap(spark.createDataFrame(cited, "id int, run_id string, pool_id string, position int")).collect()
    assert len(got) == len(cited) and all(r.page_index == want.get((r.run_id, r.pool_id, r.position)) for r in got)


def test_cells_under_five_thousand_merges(spark):
    rnd = random.Random(6)
    taken, merges = set(), [("b", "s", 1, 200, 9999, 200), ("b", "s", 1, 300, 1, 16_000), ("b", "t", 1, 1, 1_048_576, 16_384)]
    for k in range(5000):
        r, c, h, w = 10 + k // 50 * 12, 1 + k % 50 * 3, rnd.randrange(1, 12), rnd.randrange(1, 4)
        merges.append(("b", "s", r, c, r + h - 1, c + w - 1))
        taken.add((r, c, r + h - 1, c + w - 1))
    cells = [("b", "s", k, rnd.randrange(1, 1300), rnd.randrange(1, 160)) for k in range(5000)] + [("b", "s", 6000, 77, 200), ("b", "s", 6001, 1, 200), ("b", "s", 6002, 1, 15_999), ("b", "t", 6003, 5, 5), ("b", "t", 6004, 1, 1), ("x", "s", 6005, 1, 1)]
    want = {k for _, s, k, r, c in cells if s == "s" and k < 6000 and any(a <= r <= x and b <= c <= y and (r, c) != (a, b) for a, b, x, y in taken)} | {6000, 6002, 6003}
    got = workbook_checks.covered_cells(
        spark.createDataFrame(cells, "book_id string, sheet string, pos int, row int, col int"), spark.createDataFrame(merges, "book_id string, sheet string, r1 int, c1 int, r2 int, c2 int")
    )
    assert {r.pos for r in got.collect()} == want and len(want) > 1000


def test_numbers_of_one_range_sort(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(("hot", "hot", "hot", "cold", None)), k) for k in range(3000)]
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {(r.g, r.k): r.number for r in range_numbers(spark.createDataFrame(rows, "g string, k int"), ["g"], ["k"], "number").collect()}
        for g in ("hot", "cold", None):
            assert [got[g, k] for k in sorted(k for x, k in rows if x == g)] == list(range(sum(x == g for x, _ in rows)))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_holders_are_linked(spark):
    held = [(f"r{k:02}", "d", f"n{k}", j) for k in range(30) for j in (1, 0)] + [("r00", "e", "x", 0), ("r05", None, "y", 0)]
    runs = spark.createDataFrame([(f"r{k:02}", k) for k in range(31)], "run_id string, created_at int")
    links = compare.linked_holders(spark.createDataFrame(held, "run_id string, digest string, name string, pos int"), runs)
    rows = links.collect()
    assert len(rows) == 31 and {r.run_id: r.older_run for r in rows if r.digest == "d"} == {f"r{k:02}": f"r{k - 1:02}" if k else None for k in range(30)}
    asked = spark.createDataFrame([("r29", "d"), ("r30", "d"), ("r03", "d"), ("r00", "e"), ("r05", None)], "run_id string, digest string")
    assert {(r.run_id, r.digest): r.other_run for r in compare.newest_other_holder(asked, links).collect()} == {("r29", "d"): "r28", ("r30", "d"): "r29", ("r03", "d"): "r29", ("r00", "e"): None, ("r05", None): None}


def test_heavy_tokens_are_split(spark, monkeypatch):
    """One source with most of the rows: the same furniture, whether its tokens are cut into parts or not."""
    rows = []
    for s, pages in (("hot", 60), ("small", 4)):
        for p in range(pages):
            for i, t in enumerate((f"line {p} own {p * 7 % 11}", "running foot of the contract", f"page {p} of {pages}", f"contract of party {'abc'[p % 3]}")):
                rows.append(("r", s, p, i, t))
    lines = spark.createDataFrame(rows, "run_id string, source_id string, page_index int, i int, text string")
    pages = lines.select("run_id", "source_id", "page_index").distinct()
    plain = sorted(map(tuple, furniture.running_furniture(lines, pages).collect()))
    monkeypatch.setattr(furniture, "HEAVY_TOKEN", 3)
    assert sorted(map(tuple, furniture.running_furniture(lines, pages).collect())) == plain and len(plain) > 100


def test_refused_replies_are_rows(spark):
    ok = '{"values":[{"fieldKey":"a","value":"x","pageIndex":0,"from":0,"to":1}]}'
    replies = [(0, ok), (1, "no idea"), (2, '{"values":[{"fieldKey":"a","value":"x","pageIndex":0,"from":-1,"to":1}]}'), (3, "{broken}"), (4, '{"other":1}'), (5, None)]
    df = spark.createDataFrame([("r", "p", k, t) for k, t in replies], "run_id string, pool_id string, id int, reply string")
    got = {r.id: r.reason for r in citations.refused_field_replies(df).collect()}
    assert got == {1: "no-json-object", 2: "negative-number", 3: "unreadable-json", 4: "no-values", 5: "no-json-object"}
    keys = spark.createDataFrame([("r", "a")], "run_id string, field_key string")
    assert citations.field_claims(df, keys).count() == 1
    answers = [(0, '{"fields":[{"id":"a","verdict":"cocok"},{"verdict":"cocok"},{"id":"a","verdict":"beda"}]}'), (1, '{"fields":[{"id":"a"},{"id":"b"}]}'), (2, "sorry")]
    df = spark.createDataFrame([("r", k, t) for k, t in answers], "run_id string, chunk int, reply string")
    got = {(r.chunk, r.pos): r.reason for r in workbook_checks.refused_answers(df).collect()}
    assert got == {(0, 1): "no-id", (0, 2): "answered-before", (1, 0): "answered-before", (2, None): "no-json-object"}
    assert workbook_checks.compare_answers(df).count() + len(got) == 6


def test_a_section_reply_fails_as_a_whole(spark):
    e = [("r", "s", 0, "fine", 0, 0, 0, 0), ("r", "s", 1, "x" * 81, 1, 1, 0, 0), ("r", "t", 0, "x" * 80, 0, 0, 0, 0), ("r", "u", 0, "", 0, 0, 0, 0), ("r", "v", 0, "a", -1, 0, 0, 0)] + [("r", "w", k, "a", k, k, 0, 0) for k in range(21)]
    entries = spark.createDataFrame(e, "run_id string, source_id string, pos int, title string, from_page int, to_page int, title_from int, title_to int")
    assert {r.source_id: r.fault for r in sections.reply_faults(entries).collect()} == {"s": "title-length", "u": "title-length", "v": "not-a-number", "w": "too-many-sections"}


def test_files_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    good = "  doc p1   41  1932   0.981   0.993   1.5%   24   2   1.02   7"
    log = spark.createDataFrame([("a", 2, good), ("a", 1, "Model: m1"), ("b", 1, "nothing here")], "run string, k int, value string")
    transcripts.write_transcripts(log, f"{folder}/logs", "k")
    back = transcripts.read_transcripts(spark, f"{folder}/logs").withColumn("run", F.regexp_extract("run", "run=([^/]+)/", 1))
    assert [tuple(r) for r in transcripts.parse_page_rows(back).collect()] == [("a", "doc p1", 41, 1932, 0.981, 0.993, 1.5, 24, 2, 1.02, 7)]
    assert [tuple(r) for r in transcripts.transcript_refusals(back).collect()] == [("b", 1, "no-page-rows")]

    import hashlib
    import pathlib

    files = pathlib.Path(folder, "files")
    (files / "deep").mkdir(parents=True)
    (files / "one.pdf").write_bytes(b"\x00\xff" * 10)
    (files / "deep" / "two.pdf").write_bytes(b"z" * 5000)
    name = lambda r: r.path.rsplit("/", 1)[1]
    got = {name(r): (r.length, r.reason, r.digest) for r in transcripts.read_documents(spark, str(files), most_bytes=100).collect()}
    assert got == {"one.pdf": (20, None, hashlib.sha256(b"\x00\xff" * 10).hexdigest()), "two.pdf": (5000, "too-large", None)}
    assert {name(r): r.reason for r in transcripts.read_documents(spark, str(files)).collect()} == {"one.pdf": None, "two.pdf": None}

    edits = spark.createDataFrame([("r", "s", "A1", "x"), ("r", "s", "A2", "bad"), ("q", "s", "B1", "y")], "run_id string, sheet string, ref string, value string")
    sinks.write_edits(edits, edits.where("ref = 'A2'"), f"{folder}/edits")
    assert sorted(map(tuple, spark.read.schema(edits.schema).parquet(f"{folder}/edits").select(*edits.columns).collect())) == [("q", "s", "B1", "y"), ("r", "s", "A1", "x")]
    rows = spark.createDataFrame([("r", "s", "id", "t", 0, 1, (3, 0, 2))], sinks.PROPOSALS)
    sinks.write_json(rows, f"{folder}/json")
    assert sinks.read_json(spark, f"{folder}/json", sinks.PROPOSALS).select(*rows.columns).collect() == rows.collect()


@pytest.mark.parametrize(("name", "most"), [("t9_furniture_tokens", 2), ("source_furniture_report", 30), ("v13_check_for_continuation", 40), ("p2_ranked_pool", 20), ("p3_remap_positions", 20), ("g3_group_words_into_lines", 2)])
def test_plans_shuffle_little(spark, name, most):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    plan = all_queries()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", before)
    shuffles = sum(plan.count(f"Exchange {kind}") for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition"))
    assert shuffles <= most and "ArrowEvalPython" not in plan


def _evidence(spark, rows):
    from foliary.plans.evidence import Evidence

    folder = tempfile.mkdtemp()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return Evidence(spark, folder)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_annotations_are_built_in_the_row(spark):
    """No word is a row before an annotation is read, and a page's texts go to a stated number of tasks."""
    from foliary.plans import sources
    from foliary.sources import annotations

    ev = _evidence(spark, [(1, "a b  c\n \nd e", "en", "src1", 10), (1, "a b  c\n \nd e", "en", "src1", 10), (2, None, "en", "src1", 0)])
    pages = sources.annotation_pages(ev)
    assert "Generate" not in _plan(pages) and "REPARTITION_BY_NUM" in _plan(ev.words)
    words = annotations.annotation_words(pages).where("page_index = 0").orderBy("block_index", "p", "k").collect()
    assert [(w.block_index, w.p, w.k, w.text) for w in words if w.block_index == 0] == [(0, 0, k, t) for k, t in enumerate("aabbcc")]
    report = {r.page_index: (r.blocks, r.dropped) for r in annotations.annotation_report(pages).collect()}
    assert report[0] == (3, sum(w.box is None for w in words)) and 0 < report[0][1]


def test_pairs_are_dealt_before_their_edit_tables(spark):
    from foliary.plans import text

    folder = tempfile.mkdtemp()
    parts = spark.createDataFrame([(k, f"part {k}", k % 9, "Brand#1") for k in range(40)], "p_partkey long, p_name string, p_size int, p_brand string")
    parts.coalesce(1).write.parquet(f"{folder}/part.parquet")
    for name in ("t11_agrees_within", "t11_bounded_distance", "t12_best_substring_match"):
        assert "REPARTITION_BY_NUM" in _plan(all_queries()[0][name](spark, folder)), name


def test_body_lines_of_common_words_are_no_furniture_candidates(spark, monkeypatch):
    rng = random.Random(4)
    rows, pages = [], []
    for p in range(60):
        own = "".join(chr(97 + int(c)) for c in str(p))
        text = [" ".join(rng.sample("abcdefghijkl", 4) + [w + own + "x" * i for w in ("qa", "qb", "qc", "qd")]) for i in range(5)]
        rows += [("r", "s", p, i, t) for i, t in enumerate([*text, f"Page {p} of 60"])]
        pages.append(("r", "s", p))
    lines = spark.createDataFrame(rows, "run_id string, source_id string, page_index int, i int, text string")
    written, write = [], furniture.kept
    monkeypatch.setattr(furniture, "kept", lambda df: written.append(write(df)) or written[-1])
    found = furniture.running_furniture(lines, spark.createDataFrame(pages, "run_id string, source_id string, page_index int"))
    assert sorted(map(tuple, found.collect())) == [("r", "s", p, 5) for p in range(60)]
    looked_up = [d.count() for d in written if "by_rarity" in d.columns]
    assert looked_up == [1]


def test_block_reply_is_parsed_once(spark):
    reply = '{"lines":[{"box_2d":[100,100,200,900],"text":"a\\nb"},{"box_2d":[5,5,1,1],"text":"c"}]}'
    kind = "run_id string, page_index int, width int, height int, reply string"
    replies = spark.createDataFrame([("r", 0, 1000, 1000, reply), ("r", 1, 1000, 1000, '{"lines":[]}'), ("r", 2, 1000, 1000, "none")], kind)
    entries = blocks.block_entries(replies)
    assert [(r["page_index"], r["pos"], r["n"], r["box"] and tuple(r["box"])) for r in entries.collect()] == [(0, 0, 2, (100.0, 100.0, 800.0, 100.0)), (0, 1, 1, None)]
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_tasks_grow_in_number_with_the_texts(spark, monkeypatch):
    """A task's words fit its memory several times, however few partitions are asked for."""
    from foliary.plans import evidence

    rows = [(k, "word " * 50, "en", "src1", 250) for k in range(20)]
    monkeypatch.setattr(evidence, "TASK_CHARS", 500, raising=False)
    ev = _evidence(spark, rows)
    assert ev.texts.rdd.getNumPartitions() == 10
    assert ev.words.count() == 20 * (50 + 4 + 2)
    assert _evidence(spark, [(1, None, "en", "src1", 0)]).texts.count() == 1
