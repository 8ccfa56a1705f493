"""Streams over several files, restarts and replayed batches."""

import pathlib
import tempfile

import pytest

from foliary.operators.ledger import stage_tallies
from foliary.streaming import arrivals as arr

DOCS = "run_id string, digest string, name string, pos bigint"
ROUNDS = "run_id string, slot_key string, round int, pos bigint, page_index int"
FILES = [
    [("r", "d1", "a", 1), ("r", "d2", "b", 3), ("r", "d2", "b2", 2), ("r", None, "n", 4)],
    [("r", "d1", "c", 0), ("r", "d3", "d", 4)],
    [("r", "d3", "e", 5), ("q", "d1", "f", 6)],
    [("r", None, "n2", 9), ("q", "d1", "g", 0)],
    [("r", "d2", "h", 1), ("q", "d4", "i", 1)],
]


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def forget_last_commit(checkpoint):
    """As if the driver had died after the last batch was written and before it was committed."""
    last = max((p for p in pathlib.Path(checkpoint, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    pathlib.Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    return int(last.name)


def one_by_one(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_documents_over_five_files_with_a_restart_and_a_replay(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    answers = {}

    def run():
        arr.append_available(arr.accept_documents(one_by_one(spark, folder, DOCS)), f"{folder}/out", f"{folder}/checkpoint")
        rows = arr.stored(spark, f"{folder}/out", arr.ANSWERS).collect()
        assert len({(r.run_id, r.name) for r in rows}) == len(rows)
        return {(r.run_id, r.name): (r.accepted, r.held_as, r.in_same_drop) for r in rows}

    for k in range(3):
        land(spark, folder, FILES[k], DOCS)
        answers = run()  # each run restarts from the state of the one before
    assert forget_last_commit(f"{folder}/checkpoint") == 2
    assert run() == answers and len(answers) == 8
    land(spark, folder, FILES[3], DOCS)
    land(spark, folder, FILES[4], DOCS)
    yes, no = (True, None, None), lambda held, same=False: (False, held, same)
    assert run() == {
        ("r", "a"): yes, ("r", "b2"): yes, ("r", "b"): no("b2", True), ("r", "n"): yes, ("r", "c"): no("a"), ("r", "d"): yes, ("r", "e"): no("d"),
        ("q", "f"): yes, ("r", "n2"): yes, ("q", "g"): no("f"), ("r", "h"): no("b2"), ("q", "i"): yes,
    }


def test_rounds_never_change_earlier_zones(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rounds = [[("r", "s", 1, 2, 8), ("r", "s", 1, 1, 7)], [("r", "s", 0, 0, 9), ("r", "t", 2, 1, 5), ("r", "t", 1, 7, 4)], [("r", "t", 0, 0, 1), ("q", "s", 2, 2, 2)]]

    def run():
        arr.append_available(arr.fill_slots(one_by_one(spark, folder, ROUNDS)), f"{folder}/out", f"{folder}/checkpoint")
        return sorted(map(tuple, arr.stored(spark, f"{folder}/out", arr.ZONES).collect()))

    for rows in rounds:
        land(spark, folder, rows, ROUNDS)
        got = run()
    assert got == [("q", "s", 2, 2, 2), ("r", "s", 1, 1, 7), ("r", "t", 1, 7, 4)]
    forget_last_commit(f"{folder}/checkpoint")
    assert run() == got


USAGE = "run_id string, ts bigint, seq bigint, stage string, model_id string, input bigint, output bigint, thoughts bigint, cached_input bigint, pages bigint, page_cost_usd double, batch boolean"


@pytest.mark.parametrize("every", [2, 3])
def test_tallies_are_merged_and_compacted(spark, every):
    folder = tempfile.mkdtemp(prefix="spark-")
    files = [[(f"r{k % 3}", 10 * k + i, i, "ocr" if i % 2 else "locate", f"m{k}", i, k, 1, 0, 1, 0.0, False) for i in range(4)] for k in range(7)]
    table = lambda: arr.ChangedRows(spark, f"{folder}/out", arr.STAGE, every=every)
    assert table().table() is None
    stream = lambda: arr.running_tallies(one_by_one(spark, folder, USAGE))
    for rows in files[:5]:
        land(spark, folder, rows, USAGE)
    arr.merge_available(stream(), table(), f"{folder}/checkpoint")
    forget_last_commit(f"{folder}/checkpoint")
    for rows in files[5:]:
        land(spark, folder, rows, USAGE)
    arr.merge_available(stream(), table(), f"{folder}/checkpoint")
    columns = [*arr.STAGE, *arr.COUNTERS, "model_id"]
    whole = spark.createDataFrame([r for f in files for r in f], USAGE)
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(table().table()) == rows(stage_tallies(whole))
    kept = [p.name for kind in ("base", "changed") for p in pathlib.Path(folder, "out", kind).iterdir()]
    assert len(kept) <= every + 1 and sum(p.startswith("upto") for p in kept) == 1
    # a batch that comes again after its base is complete changes nothing
    table().write(spark.createDataFrame([("r0", "ocr", 1, 1, 1, 1, 1, 1, "old")], "run_id string, stage string, calls long, input long, output long, thoughts long, cached_input long, pages long, model_id string"), 0)
    assert rows(table().table()) == rows(stage_tallies(whole))
