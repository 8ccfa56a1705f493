"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector to the signs of random projections, concatenated; vectors are put in the order of label and
hash over all partitions, and each is compared with its neighbours in a bounded window, across the seams of blocks and
partitions too. Links verified in any pass are united.

What is hashed is the vector less the mean of its label's unit vectors, so that vectors which all point one way are told
apart; cosines are verified on the originals. With m the length of the mean, two vectors at the least cosine c are at about
1 - (1 - c) / (1 - m^2) after that, which gives the probability q that they share a sign. In a label of n vectors a window
holds them with probability about (window / n)^log2(1 / q), and the label gets as many passes as make a miss in all of them
less likely than `MISS` (`passes_for`), `passes` at least. The denser and larger a label, the more; others don't pay for it.

Equal vectors are one from the start. The links of a vector are counted exactly afterwards: within each component tiles
of bounded size are multiplied, every two of them once, and only counts leave a task.

Defined cases: rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite components,
link with nothing and are kept. Vectors of different lengths never link. Repeated ids are counted as vectors of their
own. Null ids name no component unless all of its ids are null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

COSINE = 0.98
PASSES = 12
MISS = 1e-7
BITS = 48
WINDOW = 64
BLOCK = 256
TILE = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; all lists must be of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _planes(which: int, length: int, bits: int) -> np.ndarray:
    return np.random.default_rng([which, length]).standard_normal((length, bits))


def passes_for(n: int, mean_square: float, cosine: float = COSINE, least: int = PASSES, window: int = WINDOW) -> int:
    """Passes for a label of `n` vectors whose mean unit vector has that squared length."""
    if n <= window:
        return least
    apart = max(-1.0, 1 - (1 - cosine) / max(1 - mean_square, 1e-9))
    share = max(0.5, 1 - np.arccos(apart) / np.pi)
    held = (window / n) ** np.log2(1 / share)
    return max(least, int(np.ceil(np.log(MISS) / np.log1p(-min(held, 1 - MISS)))))


def _keys(batch: pa.RecordBatch, bits: int):
    """For each pass the rows that take part in it, and their hashes."""
    sizes, passes = batch.column("size").to_numpy(), batch.column("passes").to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        take = pa.array(at)
        centre = batch.column("centre").take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        m, own = _matrix(batch.column("v").take(take)) - centre, passes[at]
        for p in range(int(own.max())):
            use = own > p
            yield p, at[use], (m[use] @ _planes(p, int(n), bits) > 0) @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _centres(classes: DataFrame, cosine: float, least: int, window: int) -> DataFrame:
    """`size, label, rows, centre, passes` of each label and length of vectors; no vector leaves its task, only sums."""

    def sums(batches):
        for b in batches:
            groups: dict = {}
            for i, g in enumerate(zip(b.column("size").to_pylist(), b.column("label").to_pylist(), strict=True)):
                groups.setdefault(g, []).append(i)
            for (size, _), at in groups.items():
                total = _matrix(b.column("v").take(pa.array(at))).sum(axis=0)
                label = b.column("label").take(pa.array(at[:1]))
                yield pa.record_batch([pa.array([size], pa.int32()), label, pa.array([len(at)]), pa.array([total.tolist()])], ["size", "label", "n", "total"])

    kind = f"size int, label {dict(classes.dtypes)['label']}, n long, total array<double>"
    some = classes.select("size", "label", "v").mapInArrow(sums, kind)
    each = some.select("size", "label", "n", F.posexplode("total").alias("pos", "x")).groupBy("size", "label", "pos").agg(F.sum("n").alias("rows"), F.sum("x").alias("x"))
    # rounded, so that the order of sums doesn't matter
    mean = F.round(F.col("x") / F.col("rows"), 9)
    each = each.groupBy("size", "label").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("pos", mean.alias("x"))))["x"].alias("centre"))

    def chosen(batches):
        for b in batches:
            square = [float(np.square(x).sum()) for x in b.column("centre").to_pylist()]
            n = [passes_for(r, x, cosine, least, window) for r, x in zip(b.column("rows").to_pylist(), square, strict=True)]
            yield b.append_column("passes", pa.array(n, pa.int32()))

    return each.mapInArrow(chosen, f"size int, label {dict(classes.dtypes)['label']}, rows long, centre array<double>, passes int")


def _linked(m: np.ndarray, cosine: float, other: np.ndarray | None = None) -> np.ndarray:
    return m @ (m if other is None else other).T >= cosine


def link(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, bits: int = BITS, window: int = WINDOW) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for each row of `vectors` (`vec_id`, `embedding`, `label`)."""
    scratch = C.Scratch(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("label").isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    name = F.when(usable, F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), v.cast("string")))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", name.alias("c"), v.alias("v"))
    classes = rows.where("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.table(classes.withColumn("size", F.size("v")), "classes")

    def spread(batches):
        for b in batches:
            for p, at, keys in _keys(b, bits) if b.num_rows else ():
                x = b.take(pa.array(at))
                yield pa.record_batch([pa.array(np.full(len(keys), p, np.int32)), x.column("size"), x.column("label"), pa.array(keys), x.column("c"), x.column("v")], ["pass", "size", "label", "key", "c", "v"])

    label_kind = dict(classes.dtypes)["label"]
    kind = f"pass int, size int, label {label_kind}, key long, c binary, v array<double>"
    centres = scratch.table(_centres(classes, cosine, passes, window), "centres")
    n = centres.agg(F.sum(F.col("rows") * F.col("passes")).alias("n")).first()["n"] or 0
    parts = max(2, -(-n // 20_000))
    order = ["pass", "size", "label", "key", "c"]
    centred = classes.join(centres, ["size", "label"]).select("size", "label", "c", "v", "centre", "passes")
    sorted_rows = centred.mapInArrow(spread, kind).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def placed(batches):
        """Number of each row in its partition, from the front; whether it is among the last ones."""
        held, at = None, 0
        for b in batches:
            b = pa.Table.from_batches([b])
            b = pa.concat_tables([held, b]) if held is not None else b
            out, held = b.slice(0, max(0, len(b) - window)), b.slice(max(0, len(b) - window))
            for x, last in ((out, False),):
                yield from x.append_column("i", pa.array(np.arange(at, at + len(x)))).append_column("last", pa.array(np.full(len(x), last))).combine_chunks().to_batches()
            at += len(out)
        if held is not None:
            yield from held.append_column("i", pa.array(np.arange(at, at + len(held)))).append_column("last", pa.array(np.full(len(held), True))).combine_chunks().to_batches()

    ranked = sorted_rows.mapInArrow(placed, kind + ", i long, last boolean").withColumn("p", F.spark_partition_id())
    ranked = scratch.table(ranked, "sorted")
    block = F.expr(f"i div {BLOCK}")
    homes = F.array_compact(
        F.array(
            F.struct(F.col("p"), block.alias("b")),
            F.when((F.col("i") % BLOCK < window) & (F.col("i") >= BLOCK), F.struct(F.col("p"), (block - 1).alias("b"))),
            F.when(F.col("last"), F.struct(F.col("p"), F.lit(-1).cast("long").alias("b"))),
            F.when(F.col("i") < window, F.struct((F.col("p") - 1).alias("p"), F.lit(-1).cast("long").alias("b"))),
        )
    )
    homed = ranked.select(F.explode(homes).alias("h"), "pass", "size", "label", "c", "v").select("h.p", "h.b", "pass", "size", F.col("label").cast("string").alias("label"), "c", "v")

    def neighbours(t: pa.Table) -> pa.Table:
        a, b = [], []
        names = t.column("c").to_pylist()
        groups: dict = {}
        for i, g in enumerate(zip(*(t.column(x).to_pylist() for x in ("pass", "size", "label")), strict=True)):
            groups.setdefault(g, []).append(i)
        for at in groups.values():
            if len(at) > 1:
                x, y = np.nonzero(np.triu(_linked(_matrix(t.column("v").take(pa.array(at))), cosine), 1))
                root = C.forest([names[at[i]] for i in x], [names[at[j]] for j in y])
                a += root.keys()
                b += root.values()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    comps = C.components(homed.groupBy("p", "b").applyInArrow(neighbours, "a binary, b binary"), scratch)

    # exact counts: tiles of a component against each other
    member = classes.join(comps.select(F.col("id").alias("c"), F.col("component").alias("root")), "c")
    shape = member.groupBy("root").agg(F.min("least").alias("component_id"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    member = member.join(shape, "root").withColumn("tile", F.expr("int(pmod(xxhash64(c), tiles))"))
    pairs = F.expr("transform(sequence(0, tiles - 1), o -> struct(least(o, tile) AS lo, greatest(o, tile) AS hi))")
    tiled = member.select("root", "tile", "c", "v", "times", F.explode(pairs).alias("t")).select("root", "tile", "c", "v", "times", "t.lo", "t.hi")

    def counts(t: pa.Table) -> pa.Table:
        tile, times = t.column("tile").to_numpy(), t.column("times").to_numpy()
        m, low = _matrix(t.column("v")), tile == tile.min()
        hits = np.zeros(len(tile), np.int64)
        if low.all():
            hits = _linked(m, cosine) @ times
            hits -= np.where((_linked(m, cosine).diagonal()), times, 0)
        else:
            near = _linked(m[low], cosine, m[~low])
            hits[low], hits[~low] = near @ times[~low], times[low] @ near
        return pa.table({"c": t.column("c"), "links": pa.array(hits)})

    links = tiled.groupBy("root", "lo", "hi").applyInArrow(counts, "c binary, links long").groupBy("c").agg(F.sum("links").alias("links"))
    named = member.select("c", "component_id").join(links, "c", "left")
    named = classes.select("c", "times", "least").join(named, "c", "left")
    named = scratch.table(named.select("c", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "named")
    out = rows.select("vec_id", "c").join(named, "c", "left")
    cid = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), cid.alias("component_id"), F.col("vec_id").eqNullSafe(cid).alias("kept"))
