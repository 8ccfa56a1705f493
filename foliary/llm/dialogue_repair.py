"""Repair of conversations by a dynamic programme with checkpoints.

A conversation's rows have the role initials `(s?(ua)+)?` after the cheapest edits: Keep, Rerole to user or assistant,
Delete, Insert an empty user or assistant row. The grammar has four states, and a state's backward cost is the least cost
of what follows. Rows are range-sorted, so a conversation of any length lies in blocks of about as many rows as it has
blocks (the square root of the longest one's rows), spread over tasks. Backward costs are kept at the ends of blocks
only: each block's cost matrix (four states in, four out) is worked out where its rows are, and the matrices of a
conversation are multiplied from its end. Then the block recomputes the costs inside it from its checkpoint and walks
forward from each state along the tight edits, the ASCII-least first; the states in which blocks are entered follow from
the exits of those before, and the edits are those of the walk from that state. What travels is two digits a row. Only a
digest of a whole conversation must read its texts in one task, as a stream; the repair needs no such task.

Rows count as a repetition if the conversation has the role and text earlier; that is found by hashes of 128 bits.

Defined cases: a null role or text is one space, so a null text is blank; null ids of conversations are one conversation,
null turns come first. Rows of one turn lie in the order of their roles and texts as given. Texts are whole. Rows that
repeat are repetitions. A conversation without rows is kept with zeros in the summary and has no repaired rows. An empty
table has no conversations. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: Costs of the edits; a truncated row that stays adds `RAGGED`.
REROLE, DELETE, INSERT, RAGGED = 1, 2, 5, 5
#: Blocks are never shorter than this: more would cost more than they spread.
LEAST_BLOCK = 64
NEVER = 1 << 40

# states: 0 before all, 1 after a system row, 2 after a user row, 3 after an assistant row
_BORN = (2, 2, 3, 2)  # where an inserted or reroled row leads
_KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))  # by state and initial (s, u, a, other)
_END = (0, 2 * INSERT, INSERT, 0)
_ROLE = {2: "user", 3: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text, copy, dropped`: rows with planted damage by the crc32 of `conv_id:turn`, modulo 20.

    0 drops a row (it stays, marked), 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes its role user.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.struct("role", "text").alias("given"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )


def _key() -> Column:
    """The id of a conversation as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))


def placed_rows(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The rows with `key` and `place`, in the order of conversations and of rows in them; rows that tie are equal."""
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("given"), F.col("copy"), F.col("salt")]
    salted = rows.select("*", _key().alias("key"), F.monotonically_increasing_id().alias("salt"))
    return scratch.table(C.placed(salted, *order).drop("given", "copy", "salt"), "rows")


def coded(rows: DataFrame) -> DataFrame:
    """`key, place, code` of the rows that are left: 4 * fault (0 none, 1 truncated, 2 duplicate, 3 blank) + initial (0 s, 1 u, 2 a, 3 other)."""
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    plain = F.when(~F.col("text").rlike(SOLID), 3).when(F.col("text").rlike(ENDED), 0).otherwise(1)
    head = F.substring("role", 1, 1)
    initial = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(3)
    kept = rows.where(~F.col("dropped")).select("key", "place", content.alias("content"), plain.alias("plain"), initial.alias("initial"))
    first = kept.groupBy("key", "content").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(again & (F.col("plain") != 3), 2).otherwise(F.col("plain"))
    return kept.join(first, ["key", "content"], "left").select("key", "place", (fault * 4 + F.col("initial")).alias("code"))


# ---------------------------------------------------------------- the dynamic programme


def _inserts(best: list[int]) -> tuple[int, ...]:
    """Costs once rows may be inserted; a second insertion leads on, a third only back."""
    two, three = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return min(best[0], INSERT + two), min(best[1], INSERT + two), two, three


@lru_cache(1 << 14)
def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    fault, initial = code >> 2, code & 3
    out = []
    for s in range(4):
        best = DELETE + after[s]
        if fault < 2:
            best = min(best, REROLE + RAGGED * fault + after[_BORN[s]])
            if _KEEP[s][initial] is not None:
                best = min(best, RAGGED * fault + after[_KEEP[s][initial]])
        out.append(best)
    return _inserts(out)


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Backward costs before a row from those after it; their differences take few values."""
    low = min(after)
    return tuple(low + x for x in _before(code, tuple(x - low for x in after)))


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before a block to each state after its rows."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else NEVER for s in range(4))
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


def checkpoints(matrices: list[list[int]]) -> tuple[list[list[int]], int]:
    """Backward costs at the end of each block of a conversation, and its cost."""
    out, v = [], list(_END)
    for m in reversed(matrices):
        out.append(v)
        v = [min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4)]
    return out[::-1], v[0]


def inside(codes: bytes, end: list[int]) -> list[tuple[int, ...]]:
    """Backward costs before each row of a block and after its last, from its checkpoint."""
    costs = [tuple(end)]
    for code in reversed(codes):
        costs.append(before(code, costs[-1]))
    return costs[::-1]


def walk(codes: bytes, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[list[tuple[int, str, int]], int]:
    """The tight edits of a block from a state on, ASCII-least first, as (row, edit, state after it), and the exit.

    Insertions stand before a row; only the last block of a conversation has some after all of its rows.
    """
    out, i = [], 0
    while i < len(codes) or (last and costs[i][state]):
        left = costs[i][state]
        if i < len(codes) and left == DELETE + costs[i + 1][state]:
            edit = "D"
        elif left == INSERT + costs[i][_BORN[state]]:
            edit, state = "I", _BORN[state]
        else:
            more, to = RAGGED * (codes[i] >> 2), _KEEP[state][codes[i] & 3]
            edit, state = ("K", to) if to is not None and left == more + costs[i + 1][to] else ("R", _BORN[state])
        out.append((i, edit, state))
        i += edit != "I"
    return out, state


def _each(columns: str, f):
    """A function for mapInArrow: `f(row)` gives the output rows of a row."""
    names = [c.split(" ")[0] for c in columns.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[c.split(" ")[1]]) for n, c in zip(names, columns.split(", "), strict=True)])

    def run(batches):
        for b in batches:
            rows = [out for row in b.to_pylist() for out in f(row)]
            yield pa.record_batch([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(names))], schema=schema)

    return run


def _mapped(df: DataFrame, columns: str, f) -> DataFrame:
    return df.mapInArrow(_each(columns, f), columns)


_LEGAL = {(0, 1), (1, 2), (2, 1)}
_BLOCK = "key string, block long, codes array<int>, places array<long>"


def _measured(row):
    codes = bytes(row["codes"])
    faults = [c >> 2 for c in codes]
    pairs = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(codes, codes[1:], strict=False))
    yield row["key"], row["block"], row["codes"], row["places"], matrix(codes), *(faults.count(k) for k in (3, 2, 1)), pairs


def _ends(row):
    """Checkpoints of a conversation's blocks; its cost and the pairs across seams go with the first."""
    ends, cost = checkpoints([b["matrix"] for b in row["blocks"]])
    tips = [(b["head"] & 3, b["tail"] & 3) for b in row["blocks"]]
    seams = sum((a[1], b[0]) not in _LEGAL for a, b in zip(tips, tips[1:], strict=False))
    for k, (b, end) in enumerate(zip(row["blocks"], ends, strict=True)):
        yield row["key"], b["block"], end, k == len(ends) - 1, 0 if k else cost, 0 if k else seams


def _exits(row):
    codes = bytes(row["codes"])
    costs = inside(codes, row["end"])
    yield row["key"], row["block"], row["codes"], row["places"], row["end"], row["last"], [walk(codes, costs, s, row["last"])[1] for s in range(4)]


def _entries(row):
    state = 0
    for b in row["blocks"]:
        yield row["key"], b["block"], state
        state = b["exits"][state]


def _edits(row):
    codes = bytes(row["codes"])
    for step, (i, edit, state) in enumerate(walk(codes, inside(codes, row["end"]), row["entry"], row["last"])[0]):
        yield row["key"], row["block"], step, edit, None if edit == "I" else row["places"][i], _ROLE[state] if edit in "IR" else None


class Repair:
    """The steps of a repair, for conversations with or without planted damage.

    `rows`: key, conv_id, turn, role, text, dropped, place. `edits`: key, block, step, edit, place, role (the new one).
    """

    def __init__(self, conversations: DataFrame):
        self.scratch = scratch = C.Scratch(conversations.sparkSession)
        self.rows = placed_rows(conversations, scratch)
        codes = scratch.table(coded(self.rows), "codes")
        longest = codes.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        size = max(LEAST_BLOCK, math.isqrt(longest))
        # a block has `size` rows at most
        block = F.expr(f"place div {size}").alias("block")
        row = F.array_sort(F.collect_list(F.struct("place", "code")))
        blocks = codes.groupBy("key", block).agg(row.alias("r")).select("key", "block", F.col("r.code").alias("codes"), F.col("r.place").alias("places"))
        self.blocks = scratch.table(_mapped(blocks, _BLOCK + ", matrix array<long>, blank long, duplicate long, truncated long, pairs long", _measured), "blocks")
        tips = F.struct("block", "matrix", F.element_at("codes", 1).alias("head"), F.element_at("codes", -1).alias("tail"))
        whole = self.blocks.groupBy("key").agg(F.array_sort(F.collect_list(tips)).alias("blocks"))
        self.ends = scratch.table(_mapped(whole, "key string, block long, end array<long>, last boolean, cost long, seams long", _ends), "checkpoints")
        met = self.blocks.select("key", "block", "codes", "places").join(self.ends, ["key", "block"])
        exits = scratch.table(_mapped(met, _BLOCK + ", end array<long>, last boolean, exits array<int>", _exits), "exits")
        whole = exits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("blocks"))
        entries = _mapped(whole, "key string, block long, entry int", _entries)
        walked = exits.drop("exits").join(entries, ["key", "block"])
        self.edits = scratch.table(_mapped(walked, "key string, block long, step long, edit string, place long, role string", _edits), "edits")

    def repaired(self) -> DataFrame:
        """`key, block, step, conv_id, turn, role, text, edit`: the rows that stay, in the order of block and step; inserted ones have no turn."""
        ids = self.rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"))
        given = self.rows.select("place", "turn", F.col("role").alias("given"), "text")
        out = self.edits.where("edit <> 'D'").join(given, "place", "left").join(ids, "key")
        return out.select("key", "block", "step", "conv_id", "turn", F.coalesce("role", "given").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")

    def summary(self) -> DataFrame:
        """A row for each conversation, those without rows included."""
        turns = self.rows.groupBy("key", "turn").agg(F.min("conv_id").alias("conv_id"), F.min("dropped").alias("gone"))
        held = F.when(~F.col("gone"), F.col("turn"))
        whole = turns.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.coalesce(F.max(held) - F.min(held) + 1 - F.count(held), F.lit(0)).cast("long").alias("gaps"))
        counts = self.blocks.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "pairs")])
        costs = self.ends.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("seams").alias("seams"))
        parts = self.edits.groupBy("key", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("step", "edit")))["edit"], "").alias("part"))
        audits = parts.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "part")))["part"], "").alias("audit"))
        out = whole.join(counts, "key", "left").join(costs, "key", "left").join(audits, "key", "left").join(digests(self.repaired()), "key", "left")
        none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out.select(
            "conv_id", "gaps", none("blank"), none("duplicate"), none("truncated"), F.coalesce(F.col("pairs") + F.col("seams"), F.lit(0)).alias("illegal"), none("cost"),
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )


def digests(repaired: DataFrame) -> DataFrame:
    """`key, digest`: sha256 of the `role:text` lines of each conversation. Rows pass in order; none are gathered."""

    def run(batches):
        key, digest = None, None
        for b in batches:
            done: list = []
            for k, line in zip(b.column("key").to_pylist(), b.column("line").to_pylist(), strict=True):
                if k == key:
                    digest.update(b"\n")
                else:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(line.encode())
            yield pa.record_batch([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "digest"])
        if digest:
            yield pa.record_batch([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "digest"])

    lines = repaired.select("key", "block", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("key").sortWithinPartitions("key", "block", "step").select("key", "line").mapInArrow(run, "key string, digest string")
