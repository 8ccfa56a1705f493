"""Best-fit packing with certified bin counts.

A document is its token ids and the end id. Documents longer than a sequence are cut into full pieces, the first of
which may be shorter. Pieces are dealt to parts of bounded size; each part is packed by best-fit decreasing and
dual-feasible functions of its lengths give a lower bound of its bins. A part whose count meets the bound is certified
and keeps its bins, all but those no more than half full; a part with a gap keeps its full bins only. What is given up
is dealt anew to fewer parts, so that parts exchange documents, and packed again, round after round, until a single
part is left or nothing is given up.

Defined cases: a null or empty text is the end id alone. Texts are whole. Rows that repeat are packed each for itself.
Null ids are kept. An empty table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import bpe
from foliary.llm import common as C

SEQUENCE = 1024
END = 2
#: Pieces of a part.
PART = 20_000
ROUNDS = 6


def pieces(docs: DataFrame, size: int = SEQUENCE, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32` of each piece of each document."""
    path = tokenizer or bpe.default_path()
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = bpe.encoder(path)
        for batch in batches:
            for b in C.slices(batch):
                out = []
                for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                    ids += last
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    out += [(doc, i, x, y - x, zlib.crc32(ids[4 * x : 4 * y])) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
                cols = zip(*out, strict=True) if out else [()] * 5
                yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray) -> int:
    """Bins that pieces need at least; counts[s] is the number of pieces of length s, up to the size of a bin.

    The largest of the sum of lengths and of two families of dual-feasible functions: lengths over C - e count as C and
    those under e as nothing; and lengths rounded down to multiples of C / k as (k + 1) x / C tells.
    """
    c = len(counts) - 1
    s = np.arange(c + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * s)
    e = np.arange(0, c // 2 + 1)
    large = number[c] - number[c - e]
    middle = total[c - e] - np.where(e > 0, total[e - 1], 0)
    best = int(-(-(c * large + middle) // c).max())
    for k in range(1, 31):
        q, rest = np.divmod((k + 1) * s, c)
        value = np.where(rest == 0, s * k, q * c)  # in units of 1 / (k c)
        best = max(best, -(-int((value * counts).sum()) // (k * c)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece by best-fit decreasing, and how full each bin is."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    free, bins, fill = 0, np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            left, b = size, len(fill)
            fill.append(0)
        fill[b] += n
        bins[i] = b
        if left > n:
            room[left - n].append(b)
            free |= 1 << (left - n)
    return bins, np.array(fill, np.int64)


def _packed(table: pa.Table, size: int, turn: int, final: bool) -> pa.Table:
    lengths = table.column("length").to_numpy()
    bins, fill = best_fit(lengths, size)
    gap = len(fill) - lower_bound(np.bincount(lengths, minlength=size + 1))
    given_up = (fill < size if gap else 2 * fill <= size) & (not final)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    offset = np.zeros(len(bins), np.int64)
    offset[order] = before - np.repeat(before[np.searchsorted(bins[order], np.arange(len(fill)))], np.bincount(bins))
    part = table.column("part").to_numpy()
    out = table.append_column("sequence_id", pa.array((np.int64(turn) << 58) + (part << 28) + bins))
    return out.append_column("offset", pa.array(offset)).append_column("open", pa.array(given_up[bins]))


def _packer(size: int, turn: int, final: bool):
    return lambda t: _packed(t, size, turn, final)


def pack(docs: DataFrame, size: int = SEQUENCE, end: int = END, tokenizer: str | None = None, per_part: int = PART) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset` of each piece."""
    scratch = C.Scratch(docs.sparkSession)
    left = scratch.table(pieces(docs, size, end, tokenizer), "pieces")
    columns = left.columns
    kind = ", ".join(f"{c} {t}" for c, t in left.dtypes) + ", part long, sequence_id long, offset long, open boolean"
    done, n, turn = None, left.count(), 0
    while True:
        parts = max(1, -(-n // per_part))
        final = turn == ROUNDS or parts == 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(parts)))
        packed = dealt.groupBy("part").applyInArrow(_packer(size, turn, final), kind)
        packed = scratch.table(packed, f"packed{turn}")
        kept = packed.where("NOT open").select(*columns, "sequence_id", "offset")
        done = kept if done is None else done.union(kept)
        if final:
            return done.withColumn("piece", F.col("piece").cast("int"))
        left = packed.where("open").select(*columns)
        n, turn = left.count(), turn + 1
