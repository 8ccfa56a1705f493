"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliary.llm import class_ngrams, disclosure, language_filters, length_histogram, line_templates, packing, rule_ensemble, set_join, spaced_seeds, vector_dedup

PROSE = "the quick brown fox jumps over the lazy dog while seven small mice watch from under the old oak table near the door"
TEXTS = [PROSE, PROSE, PROSE.upper(), None, "", " \t\n ", "word", "a\nb\n\nc", "x" * 30_000, "tok " * 30_000, PROSE + " today", "été 4111 1111 1111 1111 +1 (555) 123-4567 me@host.example 10.0.0.1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, c int, words int, `all` int, spans string, label int, lines int, edits int, score int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(TEXTS)] + [(None, PROSE, "en", None, 1), (None, None, None, None, None), (0, PROSE, None, None, None)]
    return spark.createDataFrame([(*r, "r", 1, 2, 3, "s", 1, 5, 6, 7) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sets(docs, none):
    got = set_join.join_sets(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(TEXTS) + 3 and by[1].component_id == by[2].component_id == by[10].component_id == 0
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[5].kept and by[6].n_shingles == 1
    assert [r.component_id for r in got if r.doc_id is None and r.n_shingles] == [0]
    kept = set_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 11]
    assert set_join.join_sets(none).count() == 0 and set_join.one_of_each(none).count() == 0


def test_seeds(spark, docs, none):
    items = [(1, " ".join(PROSE.split()[2:19])), (2, None), (3, ""), (None, "one two three"), (1, " ".join(PROSE.split()[2:19])), (4, "the quick brown fox sprang over the lazy dog while eight small mice watch from under")]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, row string")
    got = spaced_seeds.contaminated(docs, bench).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r.contaminated} == {0, 1, 2, 10, None}
    assert {tuple(r.item_ids) for r in got if r.contaminated} == {(1, 4)}
    assert spaced_seeds.clean(docs, bench).count() == docs.count() - 6 and spaced_seeds.clean(docs, bench).columns == docs.columns
    assert spaced_seeds.clean(docs, bench.limit(0)).count() == docs.count() and spaced_seeds.contaminated(none, bench).count() == 0


def test_templates(spark, docs, none):
    # the second lines share a leaf, but only five of their nine words
    texts = [f"Page {i} of 900 printed by me\nthis line holds {chr(97 + i) * 5} {chr(98 + i) * 3} and {chr(99 + i) * 4} {chr(100 + i) * 6} alone" for i in range(12)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)] + [(200, texts[3].split("\n")[0])], "doc_id long, text string"))
    got = {r.doc_id: r.text for r in line_templates.without_boilerplate(more).collect()}
    assert got[100] == texts[0] and 200 not in got and got[3] is None and got[4] == ""
    assert all(got[100 + i] == texts[i].split("\n")[1] for i in range(1, 12))
    same = line_templates.without_boilerplate(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert line_templates.without_boilerplate(none).count() == 0


def test_packing_round_trip(docs, none):
    from foliary.llm.bpe import default_path, encoder

    whole = encoder(default_path())._whole
    got = packing.pack(docs).collect()
    for i, t in enumerate(TEXTS):
        ids = whole(t or "") + (2).to_bytes(4, "little")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        mine = mine[: len(mine) // (2 if i == 0 else 1)] if i else mine[::2]
        assert sum(r.length for r in mine) == len(ids) // 4 and all(r.length == 1024 for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in mine)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for o, n in sorted(p):
            assert o == end
            end += n
        assert end <= 1024
    few = packing.pack(docs, per_part=4).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in few) == sorted((str(r.doc_id), r.piece, r.length) for r in got)
    assert packing.pack(none).count() == 0


def test_bound_and_best_fit():
    import numpy as np

    rnd = np.random.default_rng(3)
    for size in (10, 64):
        for _ in range(20):
            lengths = rnd.integers(1, size + 1, 40)
            bins, fill = packing.best_fit(lengths, size)
            assert fill.max() <= size and np.bincount(bins, lengths).astype(int).tolist() == fill.tolist()
            assert packing.lower_bound(np.bincount(lengths, minlength=size + 1)) <= len(fill)
    assert packing.lower_bound(np.bincount([6] * 7, minlength=11)) == 7


def test_histogram(docs, none):
    from foliary.llm.bpe import default_path, encoder

    n = sorted(len(x) // 4 + 1 for x in encoder(default_path())([r.text for r in docs.collect()]))
    got = {r.context_limit: r for r in length_histogram.context_report(docs).collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert r.truncated_tokens == sum(min(x, k) for x in n) and r.docs_from == sum(x >= k for x in n) and r.docs_within == sum(x <= k for x in n)
        assert r.tokens_from == sum(x for x in n if x >= k) and r.total_tokens == sum(n)
    assert length_histogram.context_report(none).count() == 0


def test_rules(spark, docs, none):
    marks = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, None), (None, 1), (9, 0), (9, 0), (77, 1)], "doc_id long, quality int")
    model = rule_ensemble.fit(docs, marks)
    got = model.scored(docs).select("all.doc_id", "score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert rule_ensemble.accepted(docs, model, 0.0).columns == docs.columns
    constant = rule_ensemble.fit(docs, marks.where("quality = 1"))
    assert constant.scored(none).count() == 0 and rule_ensemble.fit(none, marks.limit(0)).scored(docs).first().score == 0.5


def test_languages(docs, none):
    model = language_filters.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in model.predict(docs.select("doc_id", "text", "lang_pred" if "lang_pred" in docs.columns else "lang")).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (0, "en"), (8, "en")} <= got
    assert {r.lang_pred for r in language_filters.fit(none).predict(docs.select("doc_id", "text")).collect()} == {"und"}
    assert model.predict(none.select("doc_id", "text")).count() == 0


def test_scores(docs, none):
    held = F.coalesce(F.col("doc_id") == 10, F.lit(False)).alias("held_out")
    got = class_ngrams.score(docs.select("*", held), classes=4).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert r.n_tokens == r.n_known == 1
    new = next(r for r in got if r.doc_id == 10)
    assert new.held_out and new.n_tokens - new.n_known == 1 and new.score < 0
    assert class_ngrams.score(none.select("*", held)).count() == 0
    unlearned = class_ngrams.score(docs.select("*", F.lit(True).alias("held_out"))).collect()
    assert all(r.base_score == r.score == 0 and r.train_tokens == 0 for r in unlearned)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (3, [1.0, 0.1], 1), (2, [1.0, 0.0], 2), (1, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1)]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, c string")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vector_dedup.link(v).collect())
    want = {"5": (4, 3, False), "4": (4, 3, False), "3": (4, 3, True), "None": (4, 3, False)}
    assert all(x[1:] == want.get(x[0], (0, int(x[0]) if x[0] != "None" else None, True)) for x in got) and len(got) == len(rows)
    assert vector_dedup.link(v.limit(0)).count() == 0


def test_personal_data(spark, docs, none):
    got = {r.doc_id: r for r in disclosure.report(docs).collect()}
    r = got[11]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and got[3].spans == got[4].spans == ""
    assert r.spans == "card:4:23,phone:24:41,email:42:57,ip:58:66"
    told = [(i, f"Agent Zorbaline wrote from zz@secret.example on day {'abcdef'[i] * 4}") for i in range(5)] + [(9, "wrote from day on agent " + PROSE)] * 40
    some = spark.createDataFrame(told, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in disclosure.report(some).collect()}
    assert "term:6:15" in spans[0] and "term:0:5" not in spans[0] and spans[9] == ""
    texts = {r.doc_id: r.text for r in disclosure.sanitised(some).collect()}
    assert texts[0] == "Agent  wrote from [address] on day aaaa" and texts[9] == told[-1][1]
    assert disclosure.sanitised(docs).columns == docs.columns and disclosure.report(none).count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PROSE[10:90])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert re.match("doc_id,piece", ",".join(out.columns)) and out.count() >= 0


def test_dense_groups_match_brute_force(spark):
    """Members of a group all share most shingles, few are alike; all leaves and depths give the same components."""
    import random

    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rnd.sample(range(80), rnd.randrange(1, 6)):
            words[at] = f"x{rnd.randrange(40)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for leaf, levels in ((24, 3), (4, 1)):
        got = {r.doc_id: r.component_id for r in set_join.join_sets(docs, leaf=leaf, levels=levels).collect()}
        assert got == dict(enumerate(root))
    assert 1 < len(set(root)) < 150


def test_masks_hit_every_pattern_within_the_bound():
    assert [spaced_seeds.missed(n) for n in range(6, spaced_seeds.WINDOW + 1)] == [0] * 10


def test_overlaps_match_brute_force(spark):
    """Items of 6 to 20 words with any words exchanged within the bound and beyond it, in long and short documents."""
    import random

    rnd = random.Random(4)
    items = [[f"i{n}w{k}" for k in range(n)] for n in range(6, 21)]
    docs = []
    for i in range(700):
        item = rnd.choice(items)
        words = list(item)
        for at in rnd.sample(range(len(words)), rnd.randrange(0, len(words) // 5 + 2)):
            words[at] = f"x{i}y{at}"
        around = [[f"d{i}{side}{k}" for k in range(rnd.choice((0, 0, 1, 30)))] for side in "ab"]
        docs.append(around[0] + words + around[1] if i % 3 else words[rnd.randrange(0, 8) : rnd.randrange(9, 21)])
    want = set()
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            w = min(15, len(item), len(d))
            at = [(a, b) for a in range(len(d) - w + 1) for b in range(len(item) - w + 1)] if w > 5 else []
            if any(sum(d[a + k] == item[b + k] for k in range(w)) >= 0.8 * w for a, b in at):
                want.add((i, j))
    got = spaced_seeds.contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, j) for r in got for j in r.item_ids} == want and 300 < len(want) < 700


def _told(texts, entity):
    """Term spans by the definition, for texts whose entities are whole words that `entity` matches."""
    import math

    word = lambda line: set(re.findall(r"[^\W\d_]{3,}", line.lower()))
    every = {line for t in texts for line in t.split("\n")}
    contexts, places = {}, []
    for t in texts:
        lines = t.split("\n")
        for i, line in enumerate(lines):
            near = {e.lower() for x in lines[max(0, i - 1) : i + 2] for e in re.findall(entity, x)}
            places.append((t, sum(len(x) + 1 for x in lines[:i]), line, near))
            for e in near:
                contexts.setdefault(e, set()).add(line)
    degree = {}
    for e, held in contexts.items():
        for w in {w for x in held for w in word(x)}:
            n_c, n_t, n_ct = len(held), sum(w in word(x) for x in every), sum(w in word(x) for x in held)
            if n_ct >= 2 and len(every) > n_c and math.log2(len(every) * n_ct / (n_c * n_t)) / math.log2(len(every) / n_c) >= 0.9:
                degree[e, w] = True
    out = {t: set() for t in texts}
    for t, at, line, near in places:
        taken = [m.span() for m in re.finditer(entity, line)]
        for m in re.finditer(r"[^\W\d_]{3,}", line):
            if any((e, m.group().lower()) in degree for e in near) and not any(a < m.end() and m.start() < b for a, b in taken):
                out[t].add(f"term:{at + m.start()}:{at + m.end()}")
    return out


def test_terms_match_brute_force(spark):
    import random

    rnd = random.Random(8)
    common = [a + b + c for a in ("ba", "do", "ki") for b in ("ren", "sol") for c in ("ta", "mu", "vi")]
    texts = []
    for i in range(300):
        own, lines = f"zor{chr(97 + i % 26)}{chr(97 + i // 26)}", []
        for k in range(rnd.randrange(1, 7)):
            words = [rnd.choice(common) for _ in range(6)] + [own] * (rnd.random() < 0.6) + [f"u{i % 40}@host.example"] * (k == 1)
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    want = _told(texts, r"[a-z0-9]+@host\.example")
    got = disclosure.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: {s for s in r.spans.split(",") if s.startswith("term")} for r in got} == {i: want[t] for i, t in enumerate(texts)}
    assert sum(r.n_term for r in got) > 200 and all(r.n_email == (texts[r.doc_id].count("\n") > 0) for r in got)


def test_terms_of_copied_lines_and_rare_entities(spark):
    # five lines of one entity, one of them in 2,000 copies; an entity seen once, whose neighbours share a word with it
    lines = [f"Quillon {w} writes from one@host.example" for w in ("alpha", "bravo", "delta", "gamma", "omega")]
    texts = lines + [lines[0]] * 2000 + ["the ward of Brannock\nask two@host.example for Brannock\nnothing else"] + [f"some writes from {'abcdefghij'[i % 10]}{i} alpha for the else" for i in range(3000)]
    got = disclosure.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {r.doc_id: r.spans for r in got}
    assert all(by[i].startswith("term:0:7") for i in range(2005)) and "term:12:20" in by[2005] and by[2005].endswith("term:46:54")


@pytest.mark.parametrize("between", ["\n", " "])
def test_many_addresses_in_one_text(spark, between):
    text = between.join(f"to user{i}@host.example" for i in range(6000))
    (got,) = disclosure.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z0-9]+@host\.example", text)]
    assert got.n_email == len(want) == 6000 and got.spans.startswith(",".join(want[:50])) and got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_identical_lines_and_loose_templates(spark):
    # a line of 60 words in two documents, one of 25 words in three and in four, one of 3 words in 12, and clean short
    # lines of 4 words that share the first three, in 12 of 2,000 documents
    line = lambda c, n: " ".join(f"{c}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(n))
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = [f"own {letters(i)} text\n" for i in range(2000)]
    for i in (3, 9):
        texts[i] += line("a", 60)
    for i in (20, 21, 22, 23):
        texts[i] += line("b", 25) + ("\n" + line("c", 25) if i < 23 else "") + f"\nchapter {i} of x"
    for i in range(100, 112):
        texts[i] += f"he went to {letters(i * 7)}\nsee also below"
    for i in range(300, 320):
        texts[i] += f"copyright {i} by {line('d', 8)}"
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["all"].doc_id: r.lines for r in line_templates.dropped(rows).collect() if r.lines}
    want = {9: [1], **{i: [1] for i in (21, 22, 23)}, **{i: [2] for i in range(101, 112)}, **{i: [1] for i in range(301, 320)}}
    assert got == want


def test_dense_label_matches_brute_force(spark):
    """3,000 vectors of mean cosine 0.9 in one label, with pairs at about 0.982, in small windows."""
    import numpy as np

    rnd = np.random.default_rng(6)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    v = unit(3 * unit(rnd.standard_normal((1, 64))) + unit(rnd.standard_normal((3000, 64))))
    v[:400:2] = unit(v[1:401:2] + 0.19 * unit(rnd.standard_normal((200, 64))))
    links = (v @ v.T >= 0.98).sum(axis=1) - 1
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(5000 + i, x.tolist(), 2) for i, x in enumerate(np.eye(64)[:40])]
    got = vector_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=8).collect()
    assert links.sum() >= 300 and {r.vec_id: r.n_links for r in got} == {**dict(enumerate(links.tolist())), **{5000 + i: 0 for i in range(40)}}
    assert vector_dedup.passes_for(3000, 0.9, window=8) > vector_dedup.passes_for(3000, 0.0, window=8) >= vector_dedup.PASSES


def test_each_training_word_is_placed_by_what_it_follows(spark, monkeypatch):
    """Words that only follow words outside the frequent ones get a class from that, not one for the rest."""
    placed = []

    def kept(*args, f=class_ngrams._assigned):
        placed.append(f(*args))
        return placed[-1]

    monkeypatch.setattr(class_ngrams, "_assigned", kept)
    rows = [(i, f"the a{i} b{i} c{i} the d{i}", i == 9) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = class_ngrams.score(docs, classes=3, core_words=1).collect()
    assert len(got) == 10 and all(r["score"] < 0 for r in got)
    words = [r["w"] for r in placed[0].select("w").collect()]
    assert len(words) == len(set(words)) == 4 * 9


def test_only_documents_that_may_lose_lines_are_shuffled(spark):
    footer = "all rights to these pages are kept by the house and its heirs"
    rows = [(i, f"body {i * 7919} alone {i}" + f"\n{footer}" * (i % 20 == 0)) for i in range(400)]
    out = line_templates.dropped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["all"].doc_id for r in out.collect() if r.lines) == list(range(20, 400, 20))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the other texts go past the join, which is the same however short the list is
    assert "Union" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_full_sets_are_made_for_likely_documents_only(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(300)]
    texts = [f"{t} {PROSE}" for t in texts] + [texts[0] + " " + PROSE + " today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, sets = [], set_join._sets
    monkeypatch.setattr(set_join, "_sets", lambda d, wanted: asked.append(wanted.count()) or sets(d, wanted))
    got = {r.doc_id: r.component_id for r in set_join.join_sets(docs).collect()}
    assert got == {i: i % 300 for i in range(301)}
    # all share the shingles of one line, far too few for a link
    assert asked == [2]


def test_places_in_a_chunk_are_kept_compressed(spark):
    docs = spark.createDataFrame([(i, PROSE * 40, False) for i in range(50)], "doc_id long, text string, held_out boolean")
    for r in class_ngrams.chunks(docs).collect():
        assert 4 * sum(r.n) > 10 * len(r.seq)
    got = class_ngrams.score(docs).collect()
    assert len(got) == 50 and {r.n_known for r in got} == {len((PROSE * 40).split()) + 1}
