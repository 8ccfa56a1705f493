"""Spelling variants by a relational trie frontier.

The words of the corpus form two tries, one of the words and one of the words read backwards. Their nodes are rows: a
node where words part has its outgoing edges, each with the code points up to the next such node or to a word's end. A
node has at most one edge for each letter, so its row is bounded, however many words lie below it. A state (word,
position, node, edits) stands for a part of the word that has been read on the way to a node. Level by level (a level is
the number of parting nodes above), the states of the level are joined with its nodes. Without an edit they replace,
insert or delete one code point where the word leaves an edge; with an edit they follow the edge that spells what is
left. Edges of one word below a node end there: a state that spells its end is a neighbour.

Two words at one edit share the first half of the searched word or the other half of its end, so states enter each trie
below half of the word only, where nodes have few edges. Node names are hashes: equal ones could only add neighbours,
which an exact edit distance removes.

Defined cases: null and empty texts have no words; a null id counts as empty in the hash of planted slips. Long texts and
words are whole. Rows that repeat count each time. Ties of counts take the word that is smallest by code points. An
empty table has no words. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
SLIPS = 199
#: Counts that a task keeps before it passes them on.
HELD_WORDS = 400_000


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """`word, n`: runs of letters (A-Z lower-cased) of whole texts that are long and frequent enough.

    Where `slips` divides the crc32 of `<doc_id>:<run>`, the run loses one code point; 0 plants no slips.
    """

    def count(batches):
        find = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least_length)).findall
        seen: Counter = Counter()

        def passed():
            return pa.record_batch([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in C.slices(batch):
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    start = zlib.crc32(key.encode())
                    for run, n in Counter(find(text.encode().lower().decode())).items():
                        h = zlib.crc32(run.encode(), start)
                        if slips and h % slips == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length or not run:
                                continue
                        seen[run] += n
                if len(seen) > HELD_WORDS:
                    yield passed()
                    seen.clear()
        yield passed()

    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    found = docs.select(key.alias("key"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- the two tries


def _ways(vocabulary: DataFrame, scratch: C.Scratch, least: int) -> DataFrame:
    """A row for each word, trie and parting node on the word's way.

    `s` (the word as its trie reads it), `back`, `level`, `position` (code points read above the node), `node`, `enters`
    (states of the word may begin here), and the edge that the word takes: `label`, and `child`, null at the word's end.
    """
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    trie = lambda back, s, start: vocabulary.select(F.lit(back).alias("back"), s.alias("s"), start.alias("start"))
    both = trie(False, F.col("word"), half).union(trie(True, F.reverse("word"), n - half))
    each = both.select("*", F.explode(F.sequence(F.lit(least), F.length("s"))).alias("position"))
    each = scratch.table(each.select("*", F.xxhash64("back", F.substr("s", F.lit(1), F.col("position"))).alias("node")), "prefixes")
    letter = F.substr("s", F.col("position") + 1, F.lit(1))
    parting = each.groupBy("node").agg(F.min(letter).alias("low"), F.max(letter).alias("high")).where("low < high").select("node")
    # a word has no more parting nodes than code points
    way = each.join(parting, "node").groupBy("s", "back", "start").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("way"))
    at = way.select("s", "back", "start", "way", F.posexplode("way").alias("level", "at"))
    below = F.try_element_at("way", F.col("level") + 2)
    return at.select(
        "s", "back", "level", "at.position", "at.node", (F.col("at.position") >= F.col("start")).alias("enters"),
        F.substr("s", F.col("at.position") + 1, F.coalesce(below["position"], F.length("s")) - F.col("at.position")).alias("label"), below["node"].alias("child"),
    )


def _hops(at: Column, drop: int, other: Column | None = None) -> Column:
    """Moves along edges that spell the word from position `at` on, but for the edge's first `drop` code points.

    `other`: the edge must not begin with this. An edge without a child must spell all that is left.
    """
    tail = lambda x: F.substr(x["label"], F.lit(1 + drop))
    size = lambda x: F.when(x["child"].isNull(), F.length("s") + 1).otherwise(F.length(x["label"]) - drop)

    def fits(x):
        spelled = F.substr("s", at + 1, size(x)) == tail(x)
        if drop:
            spelled = spelled & (x["label"] != "")
        return spelled if other is None else spelled & (F.substr(x["label"], F.lit(1), F.lit(1)) != other)

    move = lambda x: F.struct((at + F.length(x["label"]) - drop).alias("position"), x["child"].alias("node"), x["word"].alias("other"))
    return F.transform(F.filter("edges", fits), move)


def near(vocabulary: DataFrame, scratch: C.Scratch, least_length: int = LEAST_LENGTH) -> DataFrame:
    """`word, other`: each word with each word that differs by one inserted, deleted or replaced code point."""
    ways = scratch.table(_ways(vocabulary, scratch, least_length // 2), "ways", "level")
    # one edge for each letter: a set of some ninety at most
    edge = F.struct("label", "child", F.when(F.col("child").isNull(), F.col("s")).alias("word"))
    nodes = scratch.table(ways.groupBy("level", "node").agg(F.collect_set(edge).alias("edges")), "nodes", "level")
    deepest = nodes.agg(F.max("level")).first()[0]
    letter = F.substr("s", F.col("position") + 1, F.lit(1))
    p = F.col("position")
    inside = lambda moves: F.when(letter != "", moves).otherwise(F.slice(moves, 1, 0))
    edited = F.concat(inside(_hops(p + 1, 1, letter)), _hops(p, 1, letter), inside(_hops(p + 1, 0, letter)))
    moves = F.when(F.col("edits") == 0, edited).otherwise(_hops(p, 0))
    frontier, ended = None, []
    for level in range(0 if deepest is None else deepest + 1):
        states = ways.where((F.col("level") == level) & F.col("enters")).select("s", "back", "position", "node", F.lit(0).alias("edits"))
        if frontier is not None:
            states = states.unionByName(frontier)
        met = states.join(nodes.where(F.col("level") == level).select("node", "edges"), "node")
        after = scratch.table(met.select("s", "back", F.explode(moves).alias("to")).select("s", "back", "to.*"), f"level-{level}")
        frontier = after.where("node is not null").select("s", "back", "position", "node", F.lit(1).alias("edits"))
        ended.append(after.where("node is null"))
    word = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = vocabulary.select("word", F.col("word").alias("other")).limit(0)
    for e in ended:
        pairs = pairs.union(e.select(word("s"), word("other")))
    return pairs.distinct().where(F.levenshtein("word", "other", 1) == 1)


# ---------------------------------------------------------------- forms


def _roots(forms: DataFrame, scratch: C.Scratch) -> DataFrame:
    """`word, root`: the last of the forms that follow. Each step is many times as frequent, so a few doublings end it."""
    at = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = scratch.table(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = to.select("word", "root")
        if to.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, slips: int = SLIPS) -> DataFrame:
    """`word, form, root, n, n_near, form_n`, a row for each word.

    `form`: the most frequent near word, if it has at least `factor` times the word's occurrences; `root`: the last form
    when forms are followed, the word itself if it has none.
    """
    scratch = C.Scratch(docs.sparkSession)
    vocabulary = scratch.table(words(docs, least_length, least_count, slips), "words")
    pairs = near(vocabulary, scratch, least_length).join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    found = vocabulary.join(best, "word", "left").select("*", (-F.col("best.n")).alias("top"))
    has = F.col("top") >= F.col("n") * factor
    found = scratch.table(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, F.col("top")).alias("form_n")), "forms")
    roots = _roots(found.where("form is not null"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
