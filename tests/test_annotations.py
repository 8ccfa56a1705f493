"""Annotations read in batches, glued and grouped in the page's row: against Spark's own reader, brute force and the rows' form of G3."""

import json
import random

from pyspark.sql import functions as F

from foliary.operators import geometry
from foliary.sources import annotations

KIND = "run_id string, page_index int, annotation string"


def page(*words):
    return json.dumps({"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": list(words)}]}]}]}})


def word(text="ab", box=((1, 2), (3.5, 9)), kind=None):
    symbols = [{"text": c} for c in text[:-1]] + [{"text": text[-1:], "property": {"detectedBreak": {"type": kind}}}]
    return {"symbols": symbols, "boundingBox": {"vertices": [{"x": x, "y": y} for x, y in box]}}


def odd_texts():
    w = page(word())
    nulls = {"blocks": [None, {"paragraphs": None}, {"paragraphs": [None, {"words": None}, {"words": [None, {}, {"symbols": [None]}]}]}]}
    texts = [None, "", "{}", "null", "[]", '{"fullTextAnnotation":null}', json.dumps({"fullTextAnnotation": {"pages": [None, {"blocks": None}, nulls]}})]
    texts += [w, " " + w, w + w, w[:-3], "[" + w + "]", w.replace('"', "'"), json.dumps(json.loads(w), indent=1), '{"a": [{}', "{}]}"]
    texts += [w.replace('"x": 1', f'"x": {v}') for v in ('"1"', '"abc"', "-0.0", "-0", '"NaN"', "7, \"x\": 1", "true", "1e400")]
    texts += [w.replace('"text": "a"', f'"text": {v}') for v in ("12", '{"q":1}', "null", '"\\ud83d\\ude00 \\" \\u0000"', '"\\ud83d"')]
    return texts + [page(word(box=()), word(""), {**word(), "symbols": [], "property": {"detectedBreak": {"type": "X"}}}, word(kind="UNKNOWN"))]


def test_batches_read_what_sparks_reader_reads(spark):
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(odd_texts())], KIND)
    for parts in annotations.READERS:
        slow = annotations._slow_words(annotations._blocks("annotation"), parts)
        want = df.select("page_index", F.coalesce(slow, F.array()).alias("words"))
        got = annotations.read_annotations(df, parts=parts).select("page_index", F.coalesce("words", F.array()).alias("words"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = annotations.annotation_words(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("ArrowEvalPython") == 1
    plain = df.where(annotations.READERS[annotations.WHOLE]("annotation").isNotNull()).count()
    assert 5 <= plain < df.count()


def glued(words):
    """Tokens (text, x, y, right, bottom) of a page of one block, word by word."""
    out, ended = [], True
    for text, (x, y), (r, b), kind in words:
        if not text.strip() or r <= x or b <= y:
            continue
        if not ended and out[-1][2] < b and y < out[-1][4]:
            t, *e = out[-1]
            out[-1] = [t + text, min(e[0], x), min(e[1], y), max(e[2], r), max(e[3], b)]
        else:
            out.append([text, x, y, r, b])
        ended = kind is not None and kind != "UNKNOWN"
    return [tuple(t) for t in out]


def test_words_are_glued_and_grouped_in_the_row(spark):
    rng = random.Random(5)

    def made():
        x, y = rng.randint(0, 90), rng.choice((0, 4, 9, 15, 30, 60))
        return rng.choice(("a", "bc", " ")), (x, y), (x + rng.randint(0, 9), y + rng.choice((0, 5, 10, 14))), rng.choice(("SPACE", "UNKNOWN", None, None))

    pages = [[made() for _ in range(rng.randint(0, 25))] for _ in range(60)]
    df = spark.createDataFrame([("r", i, page(*[word(t, (a, b), k) for t, a, b, k in p])) for i, p in enumerate(pages)], KIND)
    words = annotations.words_from_annotations(df)
    got = {(r.page_index, r.seq): (r.text, r.x, r.y, r.x + r.w, r.y + r.h) for r in words.collect()}
    assert got == {(i, k): t for i, p in enumerate(pages) for k, t in enumerate(glued(p))}
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan

    columns = ["page_index", "i", "text", "x", "y", "w", "h", "n_words"]
    want = geometry.group_words_into_lines(words).select(columns)
    lines = annotations.lines_from_annotations(df)
    assert sorted(map(tuple, lines.select(columns).collect())) == sorted(map(tuple, want.collect()))
    # a page's annotations that come in several rows are one page
    twice = annotations.words_from_annotations(df.union(df).where("page_index < 9"))
    assert twice.count() > 0 and twice.select("page_index", "seq").distinct().count() == twice.count()
    assert annotations.annotation_report(df.union(df)).count() == 120
