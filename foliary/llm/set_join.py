"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. In each of several trees a document follows its minwise
shingles under the branch functions of a level into child nodes, so that two documents meet in a child with a
probability equal to their Jaccard similarity for each branch. Nodes of few sets are compared exhaustively, larger
ones branch again. With two branches a level a pair at similarity 0.75 dies out in a tree with probability 0.111, so
five independent trees miss it with probability below 2e-5; in nodes that are small at once below 1e-6.

Copies are one set from the start. Groups of near copies stay together however deep one branches, so each large node
also compares its members with a pivot; a node whose members are already connected holds no further news and is
closed. After each level a member of a large node goes if too few of its shingles are in other components for any link
out of its own, which is an exact bound. A node of sets so alike that branching would leave more pairs than it has, or
that is still large at the last level, is compared in tiles, all against all, so no pair is left out for the size of a
group. Every link is confirmed on the full sets.

Full sets are made only for documents that may have a link: of the minwise shingles under all functions, 30, a pair at
similarity 0.75 has fewer than 9 in common with probability 4e-8. So in a small node a set without a partner of fitting size
and 9 common ones goes, and of large nodes one with fewer than 9 that any other set of theirs has; nodes that are small
then are compared at once.

Defined cases: a null or empty text, or one of white space only, has an empty set and is linked with nothing. A text of
fewer words than a shingle is one shingle. Null ids never name a component unless all ids of it are null. Rows that
repeat an id share its component and are all `kept`. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

WORDS = 5
PERCENT = 75
TREES = 5
BRANCHES = 2
LEVELS = 3
#: Sets in a node that is compared exhaustively.
LEAF = 24
#: Sets, and shingles, in a tile of a node that stays large; shingles of one matrix.
TILE = 512
TILE_ITEMS = 100_000
STRIP = 4096
#: Equal minwise shingles, of all functions, below which two sets are not compared.
LIKELY = 9
#: Share of equal minwise shingles from which a member of a large node is compared with its pivot early.
EARLY = 0.6

_FUNCTIONS = TREES * BRANCHES * LEVELS
_FACTORS = C.mix(np.arange(1, _FUNCTIONS + 1, dtype=np.uint64) * C._STEP) | np.uint64(1)
_LANES = C.mix(np.array([71, 72], np.uint64) * C._STEP)


def _described(items: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set its name, 128 bits, and its minwise shingles under all branch functions."""
    starts = off[:-1][np.diff(off) > 0]
    if not len(starts):
        return np.zeros(0, "S16"), np.zeros((0, _FUNCTIONS), np.int64)
    lanes = np.stack([np.add.reduceat(C.mix(items ^ lane), starts) for lane in _LANES], axis=1)
    mins = np.stack([np.minimum.reduceat(items * f, starts) for f in _FACTORS], axis=1)
    return lanes, mins.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """`row, doc_id, n, c, sig, low` for each row: size of the set, its name, its minwise shingles and 16 bits of each (null if empty)."""

    def run(batches):
        for batch in batches:
            for b in C.slices(batch):
                items, off = C.shingle_sets(b.column("text"), WORDS)
                n = np.diff(off)
                lanes, mins = _described(items, off)
                at = np.cumsum(n > 0) - 1
                names = [lanes[i].tobytes() if m else None for i, m in zip(at, n, strict=True)]
                edges = np.concatenate([[0], np.cumsum(n > 0)]) * _FUNCTIONS
                sigs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(mins.ravel()))
                short = mins.astype(np.uint16)
                low = [short[i].tobytes() if m else None for i, m in zip(at, n, strict=True)]
                yield pa.record_batch(
                    [b.column("row"), b.column("doc_id"), pa.array(n), pa.array(names, pa.binary()), sigs, pa.array(low, pa.binary())],
                    ["row", "doc_id", "n", "c", "sig", "low"],
                )

    rows = docs.select(C.row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n long, c binary, sig array<long>, low binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`c, items` for the wanted (`row`, `c`): the full set as bytes, computed from the text again."""
    table = C.membership(wanted.select("row"))

    def sieve(batches):
        for b in batches:
            yield b.filter(pa.array(C.possible(table, b.column("row").to_numpy().view(np.uint64))))

    def run(batches):
        for batch in batches:
            for b in C.slices(batch):
                items, off = C.shingle_sets(b.column("text"), WORDS)
                sets = [items[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
                yield pa.record_batch([b.column("c"), pa.array(sets, pa.binary())], ["c", "items"])

    rows = docs.select(C.row_key("doc_id", "text").alias("row"), "text").mapInArrow(sieve, "row long, text string")
    # repeated rows go where the join has dealt them; a class is of one row
    return rows.join(wanted, "row").dropDuplicates(["row"]).select("c", "text").mapInArrow(run, "c binary, items binary")


def _likely(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """`gid, c` of the members of small groups that have a partner there of fitting size and with enough minwise shingles in common."""

    def run(batches):
        for b in batches:
            off, all_ = b.column("all").offsets.to_numpy(), b.column("all").flatten()
            n = all_.field("n").to_numpy()
            low = np.frombuffer(b"".join(all_.field("low").to_pylist()), np.uint16).reshape(-1, _FUNCTIONS)
            off = off - off[0]
            keep = np.zeros(len(n), bool)
            for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                m, part = n[x:y], low[x:y]
                fits = 100 * np.minimum(m[:, None], m) >= PERCENT * np.maximum(m[:, None], m)
                fits &= (part[:, None] == part).sum(axis=2) >= LIKELY
                np.fill_diagonal(fits, False)
                keep[x:y] = fits.any(axis=1)
            at = np.flatnonzero(keep)
            gid = b.column("gid").take(pa.array(np.repeat(np.arange(len(off) - 1), np.diff(off))[at]))
            yield pa.record_batch([gid, all_.field("c").take(pa.array(at))], ["gid", "c"])

    with_low = groups.join(classes.select("c", "n", "low"), "c")
    return with_low.groupBy("gid").agg(F.collect_list(F.struct("c", "n", "low")).alias("all")).mapInArrow(run, "gid long, c binary")


def _plausible(large: DataFrame, classes: DataFrame) -> DataFrame:
    """`c` of the members of large nodes that have enough minwise shingles in common with other members, of whatever node."""
    who = classes.select("c", "sig").join(large.select("c").distinct(), "c")
    each = who.select(F.col("c"), F.xxhash64("c").alias("h"), F.posexplode("sig").alias("f", "token")).select("c", "h", F.xxhash64("f", "token").alias("key"))
    across = each.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    return each.join(across, "key").groupBy("c").agg(F.count("*").alias("shared")).where(F.col("shared") >= LIKELY).select("c")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (small + large - common)


def _compare(table: pa.Table) -> pa.Table:
    """Links between the sets of a group that its own earlier links don't already connect."""
    sets = dict(zip(table.column("c").to_pylist(), table.column("items").to_pylist(), strict=True))
    names, sets = list(sets), [np.frombuffer(x, np.uint64) for x in sets.values()]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a, b = [], []
    for i in range(len(sets)):
        for j in range(i):
            if (x := find(i)) != (y := find(j)) and _alike(sets[i], sets[j]):
                root[x] = y
                a.append(names[i])
                b.append(names[j])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _compare_tiles(table: pa.Table) -> pa.Table:
    """Links between different components in one tile (all `part` 0) or between two, as trees; sizes of intersections are a product of
    incidence matrices, built for some thousand shingles at a time."""
    part = table.column("part").to_numpy()
    names, comps = table.column("c").to_pylist(), np.unique(np.array([x.hex() for x in table.column("comp").to_pylist()]), return_inverse=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    n = np.array([len(x) for x in sets])
    one = np.flatnonzero(part == 0)
    two = np.flatnonzero(part == 1) if part.any() else one
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)[times[at] > 1]
    at = (np.cumsum(times > 1) - 1)[at[times[at] > 1]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(one), len(two)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, STRIP):
        x, y = np.searchsorted(at, [low, low + STRIP])
        m = np.zeros((len(sets), STRIP), np.float32)
        m[row[x:y], at[x:y] - low] = 1
        both += m[one] @ m[two].T
    alike = (100 + PERCENT) * both.astype(np.int64) >= PERCENT * (n[one][:, None] + n[two][None, :])
    i, j = np.nonzero(alike & (comps[one][:, None] != comps[two][None, :]))
    root = C.forest([names[k] for k in one[i]], [names[k] for k in two[j]])
    return pa.table({"a": pa.array(root.keys(), pa.binary()), "b": pa.array(root.values(), pa.binary())})


def _tiles(open_rows: DataFrame) -> DataFrame:
    """`gid, c, comp, part` with each two members (`node, comp, c, n`) of a node that aren't connected together in some group.

    A tile holds about TILE sets and TILE_ITEMS shingles, or one set. Components of more members have tiles of their
    own, which are not compared with each other.
    """
    counts = open_rows.groupBy("node", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("items"))
    home = F.when((F.col("k") >= TILE) | (F.col("items") >= TILE_ITEMS), F.col("comp"))
    counts = counts.withColumn("home", home)
    width = F.greatest(F.ceil(F.sum("k") / TILE), F.ceil(F.sum("items") / TILE_ITEMS)).cast("long")
    width = counts.groupBy("node", "home").agg(width.alias("width"))
    placed = open_rows.join(counts.select("node", "comp", "home"), ["node", "comp"])
    placed = placed.alias("p").join(width.alias("w"), (F.col("p.node") == F.col("w.node")) & F.col("p.home").eqNullSafe(F.col("w.home")))
    placed = placed.select("p.node", "p.c", "p.comp", F.xxhash64("p.home", F.expr("pmod(xxhash64(p.c), w.width)")).alias("tile"), "p.home")
    tiles = placed.select("node", "home", "tile").distinct()
    x, y = tiles.alias("x"), tiles.alias("y")
    two = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.tile") <= F.col("y.tile")))
    two = two.where(F.col("x.home").isNull() | F.col("y.home").isNull() | (F.col("x.home") != F.col("y.home")))
    two = two.select(F.col("x.node").alias("node"), F.col("x.tile").alias("one"), F.col("y.tile").alias("two"), F.xxhash64("x.node", "x.tile", "y.tile").alias("gid"))
    sides = two.select("node", "gid", F.col("one").alias("tile"), F.lit(0).alias("part"))
    sides = sides.union(two.where("one <> two").select("node", "gid", "two", F.lit(1)))
    return placed.drop("home").join(sides, ["node", "tile"]).select("gid", "c", "comp", "part")


def _hopeful(large: DataFrame, sets: DataFrame) -> DataFrame:
    """`c` of the members of large nodes that may still have a link out of their component.

    A link needs three quarters of the shingles of either end, so as many of them must be in members of other
    components. This is exact: who fails has no such link, however many sets share a node with it.
    """

    def run(batches):
        for b in batches:
            sizes = pc.binary_length(b.column("items")).to_numpy() // 8
            flat = np.frombuffer(b"".join(b.column("items").to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.record_batch([b.column("c").take(at), b.column("h").take(at), pa.array(flat)], ["c", "h", "s"])

    who = large.select("c", F.xxhash64("comp").alias("h")).distinct().join(sets, "c")
    each = who.select("c", "h", "items").mapInArrow(run, "c binary, h long, s long")
    across = each.groupBy("s").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("s")
    shared = each.join(across, "s").groupBy("c").agg(F.count("*").alias("shared"))
    sizes = sets.select("c", F.expr("octet_length(items) div 8").alias("n"))
    return shared.join(sizes, "c").where(100 * F.col("shared") >= PERCENT * F.col("n")).select("c")


def join_sets(docs: DataFrame, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """`row, doc_id, n_shingles, component_id, kept` for each row of `docs` (`doc_id`, `text`).

    `row` is `common.row_key("doc_id", "text")`. `levels` of at most LEVELS and `leaf` change cost, not results.
    """
    scratch = C.Scratch(docs.sparkSession)
    sig = scratch.table(signatures(docs), "signatures")
    full = sig.where("c IS NOT NULL")
    same = [F.first(x).alias(x) for x in ("sig", "low", "n")]
    classes = full.groupBy("c").agg(F.min("row").alias("row"), *same, F.min("doc_id").alias("least"))
    classes = scratch.table(classes, "classes")

    def branch(rows: DataFrame, level: int) -> DataFrame:
        """Children of `node, tree, comp, c, sig`, beside their `parent`; at level 0 each tree is a node of all."""
        at = level * TREES * BRANCHES
        token = lambda i: F.struct(F.lit(i).alias("f"), F.element_at("sig", i + 1).alias("token"))
        if level == 0:
            kids = rows.select("c", "comp", F.inline(F.array(*[token(i) for i in range(TREES * BRANCHES)])))
            return kids.select(F.lit(0).alias("parent"), F.xxhash64("f", "token").alias("node"), F.expr(f"int(f / {BRANCHES})").alias("tree"), "comp", "c")
        pick = F.array(*[F.array(*[token(at + t * BRANCHES + i) for i in range(BRANCHES)]) for t in range(TREES)])
        kids = rows.select("node", "tree", "comp", "c", F.inline(F.get(pick, F.col("tree"))))
        return kids.select(F.col("node").alias("parent"), F.xxhash64("node", "f", "token").alias("node"), "tree", "comp", "c")

    def verified(groups: DataFrame) -> DataFrame:
        return groups.join(sets, "c").groupBy("gid").applyInArrow(lambda t: _compare(t.select(["c", "items"])), "a binary, b binary")

    members = scratch.table(branch(classes.withColumn("comp", F.col("c")), 0), "nodes")
    who = F.xxhash64("comp")
    shape = lambda m: m.groupBy("node").agg(F.count("*").alias("size"), F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("node", "size")
    sizes = scratch.table(shape(members), "sizes")
    sets = None
    links = None
    comps = None
    rest = None
    for level in range(levels):
        sized = members.join(sizes, "node")
        small = sized.where(F.col("size") <= leaf).select("node", "c")
        large = sized.where(F.col("size") > leaf).drop("size")
        if level == 0:
            large = scratch.table(large, "met")
            large = large.join(_plausible(large, classes), "c", "left_semi")
        large = scratch.table(large.join(shape(large), "node"), f"sized{level}")
        small = small.union(large.where(F.col("size") <= leaf).select("node", "c"))
        large = scratch.table(large.where(F.col("size") > leaf).join(classes.select("c", "sig"), "c"), f"large{level}")
        grew = not large.isEmpty()
        groups = small.groupBy("node").agg(F.array_sort(F.collect_list("c")).alias("all"))
        groups = groups.groupBy("all").agg(F.min("node").alias("gid")).select("gid", F.explode("all").alias("c"))
        groups = scratch.table(_likely(groups, classes), f"groups{level}")
        if sets is None:
            wanted = groups.select("c").union(large.select("c")).distinct().join(classes.select("c", "row"), "c").select("row", "c")
            sets = scratch.table(_sets(docs, scratch.table(wanted, "wanted")), "sets")
        if grew:
            pivots = large.groupBy("node").agg(F.min_by(F.struct("c", "sig"), F.xxhash64("c")).alias("p"))
            equal = F.size(F.filter(F.zip_with("sig", "p.sig", lambda x, y: x == y), lambda x: x))
            stars = large.join(pivots, "node").where((equal >= EARLY * _FUNCTIONS) & (F.col("c") != F.col("p.c")))
            stars = stars.select(F.col("p.c").alias("pivot"), "c").distinct()
            width = stars.groupBy("pivot").agg(F.ceil(F.count("*") / leaf).cast("long").alias("width"))
            stars = stars.join(width, "pivot").select("pivot", "c", F.expr("xxhash64(pivot, pmod(xxhash64(c), width))").alias("gid"))
            heads = stars.select("gid", F.col("pivot").alias("c")).distinct().select("gid", "c")
            groups = groups.union(stars.select("gid", "c")).union(heads)
        found = scratch.table(verified(groups), f"links{level}")
        links = found if links is None else links.union(found)
        if not grew:
            comps = None
            break
        comps = C.components(links, scratch)
        large = large.drop("comp").join(comps.select(F.col("id").alias("c"), F.col("component").alias("comp")), "c", "left")
        large = large.withColumn("comp", F.coalesce("comp", "c")).drop("size")
        news = lambda m: m.join(shape(m).select("node"), "node", "left_semi")
        large = scratch.table(news(large), "connected")
        large = scratch.table(news(large.join(_hopeful(large, sets), "c", "left_semi")), "hopeful")
        if level + 1 < levels:
            members = scratch.table(branch(large, level + 1), "nodes")
            # where branching leaves more to compare than before, the node is compared as it is
            before = large.groupBy("node").agg(F.count("*").alias("size"))
            after = members.groupBy("parent", "node").agg(F.count("*").alias("size")).groupBy("parent").agg(F.sum(F.col("size") * F.col("size")).alias("work"))
            dense = before.join(after, before.node == after.parent).where(F.col("work") >= before["size"] * before["size"]).select("parent")
            dense = scratch.table(dense, "dense")
            members = members.join(dense, "parent", "left_anti")
            large = large.join(dense.withColumnRenamed("parent", "node"), "node", "left_semi")
        large = large.select("node", "c")
        rest = large if rest is None else rest.union(large)
        if level + 1 < levels:
            sizes = scratch.table(shape(members), "sizes")
            if sizes.isEmpty():
                break
    if rest is not None and not rest.isEmpty():
        comps = C.components(links, scratch) if comps is None else comps
        rest = rest.join(comps.select(F.col("id").alias("c"), F.col("component").alias("comp")), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        rest = rest.join(sets.select("c", F.expr("octet_length(items) div 8").alias("n")), "c")
        rest = scratch.table(rest.join(shape(rest).select("node"), "node", "left_semi").select("node", "comp", "c", "n"), "rest")
        tiled = _tiles(rest).join(sets, "c").groupBy("gid").applyInArrow(lambda t: _compare_tiles(t.select(["c", "comp", "items", "part"])), "a binary, b binary")
        links = links.union(scratch.table(tiled, "tiled"))
        comps = None
    comps = C.components(links, scratch) if comps is None else comps
    classes = classes.select("c", "least").join(comps.select(F.col("id").alias("c"), "component"), "c", "left")
    classes = classes.withColumn("component", F.coalesce("component", "c"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.table(classes.join(least, "component").select("c", "component_id"), "named")
    out = sig.select("row", "doc_id", "n", "c").join(named, "c", "left")
    cid = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: one of each group, and every document without words.

    Only rows that may go, or stand there more than once, by a bitmap of fixed size, are shuffled.
    """
    found = join_sets(docs).groupBy("row").agg(F.count_if("kept").alias("times"), F.max(F.col("n_shingles") > 0).alias("worded"))
    odd = C.Scratch(docs.sparkSession).table(found.where("times = 0 OR (times > 1 AND worded)").select("row", "times"), "odd")
    rows = C.held(docs).withColumn("some", C.flagged(C.membership(odd.select("row")), "row"))
    some = rows.where("some").join(odd, "row", "left")
    # a row that stands there more than once is one document of its group
    once = rows.where("NOT some").select("all").union(some.where("times IS NULL").select("all"))
    return once.union(some.where("times > 1").groupBy("row").agg(F.first("all").alias("all")).select("all")).select("all.*")
