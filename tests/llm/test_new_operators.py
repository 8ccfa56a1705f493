"""Spelling variants, conversation repair and source mixes against plain Python, with all their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from foliary.llm import common as C
from foliary.llm import dialogue_repair, source_mix, trie_variants

DOCS = "doc_id long, text string, lang string, source string, word string, n long, `all` int, place long, key string, row int, part string"


def documents(spark, rows):
    """(doc_id, source, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, "w", 1, 2, 3, "k", 4, "p") for i, s, t in rows], DOCS)


# ---------------------------------------------------------------- op11


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows, least_length=6, slips=199):
    counts = Counter()
    for i, _, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= 5}
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


@pytest.mark.parametrize("slips", [199, 7])
def test_variants_match_brute_force(spark, slips):
    rnd = random.Random(7)
    letters = "abÀéÿ"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 12))) for _ in range(60)] + ["z" * k for k in range(6, 12)] + ["abcabcabc", "xylophone", "Xylophon"]
    words = ["chainaaa"] * 10 + ["chainaab"] * 90 + ["chainabb"] * 600
    for w in base:
        n = rnd.choice((5, 6, 30, 160))
        words += [w] * n
        for _ in range(4):
            at = rnd.randrange(len(w) + 1)
            other = rnd.choice((w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]))
            words += [other] * rnd.choice((1, 5, 6, 30))
    rnd.shuffle(words)
    rows = [(i, "s", rnd.choice((" ", "-", "1")).join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20)]
    rows += [(None, "s", "zzzzzz " * 9), (1, "s", None), (2, "s", ""), (3, "s", "q" * 20_000), (3, "s", " ".join(["y" * 3000] * 6)), (3, "s", " ".join(["y" * 2999 + "w"] * 40))] + rows[:3]
    got = {r.word: tuple(r) for r in trie_variants.variants(documents(spark, rows), slips=slips).collect()}
    want = expected_variants(rows, slips=slips)
    assert got == want and sum(x[1] is not None for x in want.values()) > 20 and sum(x[2] not in x[:2] for x in want.values()) > 0


def test_variants_of_nothing(spark):
    assert trie_variants.variants(documents(spark, []).limit(0)).count() == 0
    assert trie_variants.variants(documents(spark, [(1, "s", "only a few short words")])).count() == 0


# ---------------------------------------------------------------- op12

TURNS = "conv_id long, turn long, role string, text string, key string, place long, block int, code int"


def expected_repairs(rows):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, digest), by trying all edits."""
    given = lambda x: " " if x is None else str(x)
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{given(c)}:{given(t)}".encode()) % 20
        role, text = given(role), given(text)
        place = ((t is not None, t or 0), role, text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for copy in range((1, 2)[kind == 3] if kind else 0):
            by[c].append((*place, copy, "user" if kind == 4 else role, text, t))
    return {c: expected_repair(c, sorted(r, key=lambda x: x[:4])) for c, r in by.items()}


def expected_repair(conv, rows):
    seen, faults, counts = set(), [], [0, 0, 0, 0]
    for *_, role, text, _t in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
        counts[fault] += 1
        faults.append(fault)
        seen.add((role, text))
    initials = [r[4][:1] for r in rows]
    turns = [r[6] for r in rows if r[6] is not None]
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    born = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, row, i, state, inserted=0):
            rest = best(i, state, inserted)
            if rest:
                options.append((cost + rest[0], edit + rest[1], row + rest[2]))

        if inserted < 3:
            add(5, "I", ((name[born[state]], ""),), i, born[state], inserted + 1)
        if i < len(rows):
            add(2, "D", (), i + 1, state)
            if faults[i] > 1:
                more = 5 * (faults[i] == 2)
                add(1 + more, "R", ((name[born[state]], rows[i][5]),), i + 1, born[state])
                if initials[i] in follows[state]:
                    add(more, "K", ((rows[i][4], rows[i][5]),), i + 1, follows[state][initials[i]])
        return min(options, key=lambda o: o[:2], default=None)

    for i in range(len(rows), -1, -1):  # from the end, so that the recursion stays flat
        for state in follows:
            best(i, state, 0)
    cost, audit, kept = best(0, "", 0)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return conv, gaps, *counts[:3], illegal, cost, audit, digest


def test_repairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dialogue_repair, "LEAST_BLOCK", 4)  # so that long conversations lie in many blocks
    rnd = random.Random(3)
    rows = []
    for conv in [None, *range(80)]:
        for t in range(150 if conv in (None, 7) else rnd.choice((1, 2, 4, 9))):
            turn = rnd.choice((t, t, t, t, None, rnd.randrange(9)))
            role = rnd.choice(("user", "assistant") * 3 + ("system", "tool", "Sys", None, ""))
            rows.append((conv, turn, role, rnd.choice(("Hi.", "so", "what?", " \t", None, "", "a\nb!\n", f"x {t}.", f"y {t}", "é?"))))
    rows += rows[:30] + [(90, 0, "user", "word " * 30_000), (90, 1, "assistant", "x" * 100_000 + "."), (91, 1, None, None)]
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], TURNS)
    got = {r.conv_id: tuple(r) for r in dialogue_repair.Repair(dialogue_repair.damaged(df)).summary().collect()}
    want = expected_repairs(rows)
    assert got == want and set("".join(r[7] for r in want.values())) == set("DKR") and any(not r[7] for r in want.values())


def test_repaired_rows_have_the_roles_of_a_conversation(spark):
    rows = [(c, t, role, f"text {c} {t}.") for c in range(30) for t, role in enumerate(("assistant", "system", "user", "user", "assistant", "tool", "user")[c % 5 :])]
    repair = dialogue_repair.Repair(dialogue_repair.damaged(spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], TURNS)))
    by = {}
    for r in sorted(repair.repaired().collect(), key=lambda r: (r.block, r.step)):
        by.setdefault(r.conv_id, []).append(r)
        assert r.edit != "I" or (r.text == "" and r.turn is None)
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in rows)) for rows in by.values()) and len(by) > 20


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert dialogue_repair.Repair(dialogue_repair.damaged(none)).summary().count() == 0


# ---------------------------------------------------------------- op13


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = rest / max(1, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def test_mix_keeps_budgets(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(("a", "b", "b", "b", "b", "b", "c", None, "é", "Z")), " ".join("w" * rnd.randrange(1, 5) for _ in range(rnd.randrange(0, 40)))) for i in range(900)]
    rows += [(2000 + i, f"tiny{i}", "x y") for i in range(7)] + [(3000, "empty", None), (3001, "empty", ""), (None, "c", "n u l l"), (None, None, None), (3002, "long", "tok\t" * 40_000)]
    rows += rows[:9] + [(4000, "c", "the same row")] * 60
    docs = documents(spark, rows)
    got = source_mix.plan(docs, carry=("source",)).collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = expected_targets(sizes)
    taken, seen = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        seen[r.doc_id, r.source, r.size] += 1
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
    assert seen == Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    cut = Counter(r.source for r in got if r.size and r.taken % r.size)
    assert all(n <= 1 for n in cut.values())
    again = source_mix.plan(docs.repartition(7), carry=("source",)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    mix = source_mix.mixed(docs)
    words = mix.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(source_mix.WORD))).alias("n"))
    assert mix.columns == docs.columns and {r.source: r.n for r in words.collect() if r.n} == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing(spark):
    assert source_mix.plan(documents(spark, []).limit(0)).count() == 0
    blank = source_mix.plan(documents(spark, [(1, "a", " "), (2, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_places_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = C.Scratch(spark).table(C.placed(df, F.col("v")), "placed").orderBy("place").collect()
    assert [r.v for r in rows] == list(range(1000))
