"""Language-model scoring by Brown class bigrams.

A word's probability after another is that of its class after the other's class, times its own within its class. Classes
are found by exchange: the most frequent words move one by one to the class that raises the likelihood of the class
bigrams most, until none moves; each other word then makes the same step once, to the class that fits best what it
follows: the classes, and the words outside the frequent ones, which are one context more, so that each place of each
word counts. Counts are of all training texts. Class transitions are smoothed towards the classes' shares; words are
discounted within their class and what that frees is the class's probability of an unknown word, so that the
probabilities of all known words, the end and one unknown word add up to one after any class.

Texts are read once: chunks of whole documents are written as distinct word hashes and positions in them, so that only a
chunk's distinct words meet the vocabulary, which is never broadcast. The counts between frequent words (at most
(CORE + 2)^2) and between classes are all that comes to the driver.

Defined cases: a null or empty text is the end token alone. Texts are whole. Rows whose id is null are learned from
(their remainder is not 1). Rows that repeat count each time. With no training text all words are unknown and both scores
are 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

CLASSES = 32
#: Words that take part in the exchange until it settles.
CORE = 600
SWEEPS = 10
#: Weight of the classes' shares in a class's transitions, in tokens.
SMOOTHING = 5.0
CHUNK = 1_500_000

END = np.uint64(0)


# ---------------------------------------------------------------- chunks


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Whole documents (`doc_id, text, held_out`) as `chunk, words, seq, doc_ids, held, n`: sorted distinct hashes, places in them (compressed)."""

    def out(words, ids, held, n):
        distinct, seq = np.unique(np.concatenate(words), return_inverse=True)
        row = [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([distinct.tobytes()]), pa.array([pa.compress(seq.astype(np.int32), codec="zstd", asbytes=True)])]
        lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (held, pa.bool_()), (n, pa.int64()))]
        return pa.record_batch(row + lists, ["chunk", "words", "seq", "doc_ids", "held", "n"])

    def run(batches):
        words, ids, held, n, total = [], [], [], [], 0
        for batch in batches:
            for b in C.slices(batch):
                w, off = C.word_hashes(b.column("text"))
                words.append(np.insert(w, off[1:], END))
                ids += b.column("doc_id").to_pylist()
                held += b.column("held_out").to_pylist()
                n += (np.diff(off) + 1).tolist()
                total += len(words[-1])
                if total >= size:
                    yield out(words, ids, held, n)
                    words, ids, held, n, total = [], [], [], [], 0
        if n:
            yield out(words, ids, held, n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    return rows.mapInArrow(run, "chunk long, words binary, seq binary, doc_ids array<long>, held array<boolean>, n array<long>")


def _open(batch: pa.RecordBatch):
    """For each chunk: its id, distinct words (None if left out), places, and which tokens are of training documents."""
    named = "words" in batch.schema.names
    for i in range(batch.num_rows):
        n = np.array(batch.column("n")[i].as_py(), np.int64)
        held = np.repeat(np.array(batch.column("held")[i].as_py(), bool), n)
        seq = pa.decompress(batch.column("seq")[i].as_buffer(), decompressed_size=4 * len(held), codec="zstd")
        words = np.frombuffer(batch.column("words")[i].as_buffer(), np.uint64) if named else None
        yield batch.column("chunk")[i].as_py(), words, np.frombuffer(seq, np.int32), ~held


def _columns(names, *arrays):
    return pa.record_batch([pa.array(x) for x in arrays], names)


def _word_counts(enc: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, words, seq, train in _open(batch):
                n = np.bincount(seq[train], minlength=len(words))
                yield _columns(["w", "n"], words[n > 0].view(np.int64), n[n > 0])

    return enc.select("chunk", "words", "seq", "held", "n").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _local(core: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted core, -1 if it isn't there."""
    if not len(core):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(core, words), len(core) - 1)
    return np.where(core[at] == words, at, -1)


def _matrix(enc: DataFrame, size: int, states) -> np.ndarray:
    """Counts of states after each other in training documents; states gives each chunk's, -1 for none."""

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for state, train, before_first in states(batch):
                before = np.concatenate([[before_first], state[:-1]])
                use = train & (before >= 0) & (state >= 0)
                total += np.bincount(before[use].astype(np.int64) * size + state[use], minlength=size * size)
        at = np.flatnonzero(total)
        yield _columns(["at", "n"], at, total[at])

    rows = enc.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out.reshape(size, size)


# ---------------------------------------------------------------- classes


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word; pairs[v, w] counts w after v, its last row and column the end, a class of its own."""
    n = len(pairs) - 1
    order = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1))[:n], kind="stable")
    cls = np.empty(n + 1, np.int64)
    cls[order] = np.arange(n) % classes
    cls[n] = classes
    one = np.zeros((n + 1, classes + 1))
    one[np.arange(n + 1), cls] = 1
    after, before = pairs @ one, pairs.T @ one
    table = one.T @ after
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            old, self_ = cls[w], pairs[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[old] -= self_
            left[old] -= self_
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_
            table = np.maximum(table, 0)
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (f(table + right) - f(table)).sum(axis=1) + (f(table.T + left) - f(table.T)).sum(axis=1)
            d = table.diagonal()
            gain += f(d + right + left + self_) - f(d + right) - f(d + left) + f(d)
            gain -= f(rows + right.sum() + self_) - f(rows) + f(cols + left.sum() + self_) - f(cols)
            gain[classes] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += right
            table[:, new] += left
            table[new, new] += self_
            if new != old:
                moved += 1
                cls[w] = new
                after[:, old] -= pairs[:, w]
                after[:, new] += pairs[:, w]
                before[:, old] -= pairs[w]
                before[:, new] += pairs[w]
        if not moved:
            break
    return cls


def _assigned(enc: DataFrame, core: np.ndarray, cls: np.ndarray, table: np.ndarray) -> DataFrame:
    """`w, cls` of all other words of training texts; the last row of the table is for what follows one of them."""
    k = len(table) - 1
    gain = np.log((table + 1) / (table.sum(axis=0) + k + 1))[:, : k - 1]

    def contexts(batches):
        for batch in batches:
            for _, words, seq, train in _open(batch):
                at = _local(core, words)
                known = np.where(at >= 0, cls[at], np.where(words == END, k - 1, k))
                state = known[seq]
                before = np.concatenate([[k - 1], state[:-1]])
                use = train & (state == k)
                key, n = np.unique(seq[use].astype(np.int64) * (k + 1) + before[use], return_counts=True)
                yield _columns(["w", "ctx", "n"], words[key // (k + 1)].view(np.int64), (key % (k + 1)).astype(np.int16), n.astype(np.int32))

    def choose(batches):
        parts = [[b.column(x).to_numpy() for x in ("w", "ctx", "n")] for b in batches if b.num_rows]
        if parts:
            w, ctx, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(w, kind="stable")
            w, ctx, n = w[order], ctx[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            sums = np.stack([np.add.reduceat(n * gain[ctx, c], first) for c in range(k - 1)])
            yield _columns(["w", "cls"], w[first], sums.argmax(axis=0).astype(np.int16))

    rows = enc.select("chunk", "words", "seq", "held", "n").mapInArrow(contexts, "w long, ctx short, n int")
    return rows.repartition("w").mapInArrow(choose, "w long, cls short")


# ---------------------------------------------------------------- scores


def _coded(enc: DataFrame, vocabulary: DataFrame, tokens: int, types: int, share: np.ndarray, discount: float, unknown: int) -> DataFrame:
    """Each chunk's classes, and for each document what doesn't depend on transitions."""
    least = 0.5 * (types + 1)

    def emit(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[i].as_buffer(), np.int64)
                yield _columns(["w", "chunk", "place"], words, np.full(len(words), batch.column("chunk")[i].as_py()), np.arange(len(words), dtype=np.int32))

    def gather(t: pa.Table) -> pa.Table:
        blobs = [t.column(x).to_numpy().tobytes() for x in ("place", "n", "cls")]
        return pa.table({"chunk": t.column("chunk").slice(0, 1), **{x: pa.array([b]) for x, b in zip(("place", "count", "cls"), blobs, strict=True)}})

    def code(batches):
        for batch in batches:
            for i, (chunk, _, seq, _) in enumerate(_open(batch)):
                size = int(seq.max()) + 1  # every distinct word has a place
                c, cls = np.zeros(size, np.int64), np.full(size, unknown, np.uint8)
                if batch.column("place")[i].is_valid:
                    blob = lambda x, t, i=i, batch=batch: np.frombuffer(batch.column(x)[i].as_buffer(), t)
                    place = blob("place", np.int32)
                    c[place], cls[place] = blob("count", np.int64), blob("cls", np.int16)
                base = np.log10((c + 0.5) / (tokens + least))
                own = np.log10(np.maximum(c - discount, 1e-9) / np.maximum(share[cls], 1))
                own[(cls >= unknown - 1)] = 0
                n = np.array(batch.column("n")[i].as_py(), np.int64)
                first = np.cumsum(n) - n
                sums = [np.add.reduceat(x[seq], first).tolist() for x in ((c > 0).astype(np.int64), base, own)]
                cols = [pa.array([chunk]), pa.array([cls[seq].tobytes()]), *[pa.array([s]) for s in sums]]
                lists = [batch.column(x).slice(i, 1) for x in ("doc_ids", "held", "n")]
                yield pa.record_batch(cols + lists, ["chunk", "classes", "known", "base", "own", "doc_ids", "held", "n"])

    met = enc.select("chunk", "words").mapInArrow(emit, "w long, chunk long, place int").join(vocabulary, "w")
    packed = met.select("chunk", "place", "n", "cls").groupBy("chunk").applyInArrow(gather, "chunk long, place binary, count binary, cls binary")
    kind = "chunk long, classes binary, known array<long>, base array<double>, own array<double>, doc_ids array<long>, held array<boolean>, n array<long>"
    return enc.drop("words").join(packed, "chunk", "left").mapInArrow(code, kind)


def score(docs: DataFrame, classes: int = CLASSES, core_words: int = CORE, sweeps: int = SWEEPS) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity` of `doc_id, text, held_out`."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    enc = scratch.table(chunks(docs), "chunks")
    counts = scratch.table(_word_counts(enc), "counts")
    head = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    tokens, types, ones, twos = (int(x or 0) for x in head)
    top = counts.where(F.col("w") != 0).orderBy(F.desc("n"), "w").limit(core_words).collect()
    core = np.sort(np.array([r["w"] for r in top], np.int64).view(np.uint64))

    def core_states(batch):
        for _, words, seq, train in _open(batch):
            at = _local(core, words)
            yield np.where(words == END, len(core), np.where(at >= 0, at, len(core) + 1))[seq], train, len(core)

    slim = enc.select("chunk", "words", "seq", "held", "n")
    counted = _matrix(slim, len(core) + 2, core_states)
    pairs, after_other = counted[:-1, :-1], counted[-1, :-1]
    cls = exchange(pairs, classes, sweeps)
    one = np.eye(classes + 1)[cls]
    table = np.vstack([one.T @ pairs, after_other]) @ one
    known = spark.createDataFrame([(int(w), int(c)) for w, c in zip(core.view(np.int64), cls, strict=False)] + [(0, classes)], "w long, own short")
    found = _assigned(enc, core, cls, table)
    vocabulary = counts.join(found, "w", "left").join(F.broadcast(known), "w", "left")
    vocabulary = scratch.table(vocabulary.select("w", "n", F.coalesce("own", "cls").alias("cls")), "vocabulary")
    totals = vocabulary.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    share, kinds = np.zeros(classes + 2), np.zeros(classes + 2)
    for r in totals:
        share[r["cls"]], kinds[r["cls"]] = r["n"], r["v"]
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
    unknown = classes + 1
    coded = scratch.table(_coded(enc, vocabulary, tokens, types, share, discount, unknown), "coded")

    def class_states(batch):
        for i in range(batch.num_rows):
            n = np.array(batch.column("n")[i].as_py(), np.int64)
            train = ~np.repeat(np.array(batch.column("held")[i].as_py(), bool), n)
            yield np.frombuffer(batch.column("classes")[i].as_buffer(), np.uint8).astype(np.int64), train, classes

    follows = _matrix(coded.select("classes", "held", "n"), classes + 2, class_states)
    prior = share[: classes + 1] / max(tokens, 1)
    p = (follows[:, : classes + 1] + SMOOTHING * prior) / (follows[:, : classes + 1].sum(axis=1, keepdims=True) + SMOOTHING)
    freed = np.where(share > 0, discount * kinds / np.maximum(share, 1), 0)[: classes + 1]
    freed[classes] = 0
    logs = np.zeros((classes + 2, classes + 2))
    if tokens:
        logs[:, : classes + 1] = np.log10(np.maximum(p, 1e-300))
        logs[:, unknown] = np.log10(np.maximum(p @ freed, 1e-300))

    def final(batches):
        for batch in batches:
            for i, (state, _, start) in enumerate(class_states(batch)):
                n = np.array(batch.column("n")[i].as_py(), np.int64)
                first = np.cumsum(n) - n
                steps = logs[np.concatenate([[start], state[:-1]]), state]
                own = np.array(batch.column("own")[i].as_py())
                total = np.add.reduceat(steps, first) + (own if tokens else 0)
                doc = [batch.column(x)[i].values for x in ("doc_ids", "held", "n", "known")]
                base = batch.column("base")[i].values
                rest = [pa.array(np.full(len(n), tokens)), base, pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))]
                yield pa.record_batch(doc + rest, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return coded.select("classes", "held", "n", "known", "base", "own", "doc_ids").mapInArrow(final, kind)
