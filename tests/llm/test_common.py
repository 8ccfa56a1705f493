import random
import re

import numpy as np
import pyarrow as pa

from foliary.llm import common as C

TEXTS = ["The the  tHe", None, "", " \t a b\nc d e f ", "É é\x0bÉa", "x" * 3000, "a b c", "b a c", "a b c d e a b c d e"]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def test_words_and_shingles_match_plain_python():
    for texts in (TEXTS, TEXTS[1:], TEXTS[::-1], [None, ""], []):
        column = pa.array(texts, pa.string())
        h, off = C.word_hashes(column)
        flat = [w for t in texts for w in words(t)]
        assert [len(words(t)) for t in texts] == list(np.diff(off))
        names = {}
        for w, x in zip(flat, h, strict=True):
            assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)
        items, at = C.shingle_sets(column, 5)
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            w, s = words(t), items[a:b]
            want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
            assert len(s) == len(want)


def test_slices_keep_all_rows_in_order():
    b = pa.record_batch({"text": pa.array(["a" * 50, None, "b" * 10, "c" * 500] * 9), "i": pa.array(range(36))})
    parts = list(C.slices(b, limit=100))
    assert len(parts) > 5 and [i for p in parts for i in p.column("i").to_pylist()] == list(range(36))


def test_components_of_chains_stars_and_nothing(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(5, 5), (3, 2)]
    edges += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    e = spark.createDataFrame(edges, "a long, b long")
    many = dict(C.components(e.repartition(5), C.Scratch(spark), per_task=40).collect())
    got = dict(C.components(e, C.Scratch(spark)).collect())
    assert many == got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert C.components(spark.createDataFrame([], "a long, b long"), C.Scratch(spark)).count() == 0
