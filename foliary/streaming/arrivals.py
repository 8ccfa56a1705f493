"""Documents, rounds and usage as they arrive.

What must last is keyed state in the RocksDB state store, by digest, by slot and by stage: a micro-batch reads and
writes the keys that it brings, however many came before it. Answers are appended by Spark's file sink, whose log makes
a replayed batch count once; running tallies are changed rows by batch, merged by key and compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from foliary.operators.ledger import COUNTERS
from foliary.session import work_folder  # noqa: F401

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stored(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All rows that a stream has appended to a folder; none if it has not begun."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _started(writer, checkpoint: str):
    """Start a stream over everything that has arrived, with the keyed state store, and wait for its end."""
    spark = SparkSession.active()
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def append_available(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append a stream's rows to a folder, each batch once."""
    _started(stream.writeStream.outputMode("append").format("parquet").option("path", folder), checkpoint)


# ------------------------------------------------------------------ X1

ANSWERS = "run_id string, digest string, name string, pos bigint, accepted boolean, held_as string, in_same_drop boolean"


_ANSWER = Row("run_id", "digest", "name", "pos", "accepted", "held_as", "in_same_drop")


class _FirstHolder(StatefulProcessor):
    """Keeps the name of a digest's first holder in a run.

    Rows of a digest that is held are answered as they pass; of a new one, those of the batch are held until its first
    is known, so the size of a batch (files or bytes a trigger) bounds them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "name string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run, digest = key
        if digest is None:  # nothing is known of the content, so it repeats nothing
            for r in rows:
                yield _ANSWER(run, digest, r.name, r.pos, True, None, None)
        elif self.holder.exists():
            held = self.holder.get()[0]
            for r in rows:
                yield _ANSWER(run, digest, r.name, r.pos, False, held, False)
        else:
            mine = sorted((r.pos, r.name) for r in rows)
            held = mine[0][1]
            self.holder.update((held,))
            for k, (pos, name) in enumerate(mine):
                yield _ANSWER(run, digest, name, pos, k == 0, held if k else None, True if k else None)

    def close(self) -> None:
        pass


def accept_documents(arriving: DataFrame) -> DataFrame:
    """Every arriving document, accepted if its digest is new to the run; a refused one names the first holder.

    ``arriving``: a stream of run_id, digest, name, pos.  Within a batch the least pos comes first.
    """
    keyed = arriving.select("run_id", "digest", "name", "pos").groupBy("run_id", "digest")
    return keyed.transformWithState(_FirstHolder(), ANSWERS, "Append", "None")


# ------------------------------------------------------------------ X2

ZONES = "run_id string, slot_key string, round int, pos bigint, page_index int"


_FILLED = Row("run_id", "slot_key", "round", "pos", "page_index")


class _FirstZone(StatefulProcessor):
    """Keeps that a slot has its zone; a slot takes the first of the batch that brings any."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.zone = handle.getValueState("zone", "round int, pos bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.zone.exists():
            return
        first = min(((r.round, r.pos, r.page_index) for r in rows), key=lambda z: z[:2])
        self.zone.update(first[:2])
        yield _FILLED(*key, *first)

    def close(self) -> None:
        pass


def fill_slots(arriving: DataFrame) -> DataFrame:
    """The zone that each slot takes, once; zones that are there stay, whatever round comes later.

    ``arriving``: a stream of run_id, slot_key, round, pos, page_index.
    """
    zones = arriving.select("run_id", "slot_key", "round", F.col("pos").cast("bigint").alias("pos"), "page_index")
    return zones.groupBy("run_id", "slot_key").transformWithState(_FirstZone(), ZONES, "Append", "None")


# ------------------------------------------------------------------ X3

STAGE = ["run_id", "stage"]


def running_tallies(usage: DataFrame) -> DataFrame:
    """Streaming sums by run and stage; the state holds one row per stage."""
    return usage.groupBy(*STAGE).agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(c).alias(c) for c in COUNTERS[1:]],
        F.max_by("model_id", F.struct("ts", "seq")).alias("model_id"),
    )


class ChangedRows:
    """A keyed table fed by a stream in update mode: a folder of changed rows for each batch, merged into a base.

    After every ``every`` batches the base and the changes since it become a new base; what it replaces is removed, so the
    folder holds two rows a key and the changes of the last batches at most.  A batch that is replayed writes its folder
    anew, and a base is used only when it is complete.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], every: int = 8):
        self.spark, self.folder, self.keys, self.every = spark, folder, keys, every
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(conf)

    def _complete(self, kind: str) -> dict[int, str]:
        """Batch and folder of each complete write of a kind."""
        root = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(root):
            return {}
        found = [s.getPath() for s in self._fs.listStatus(root)]
        return {int(p.getName().split("=")[1]): p.toString() for p in found if self._fs.exists(self._path(p, "_SUCCESS"))}

    def _remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The sink of ``foreachBatch``."""
        bases = self._complete("base")
        if bases and max(bases) >= batch_id:
            return  # a replay of what the base holds
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.folder}/changed/batch={batch_id}")
        changed = self._complete("changed")
        if len([b for b in changed if b > max(bases, default=-1)]) >= self.every:
            self._merged().write.mode("overwrite").parquet(f"{self.folder}/base/upto={batch_id}")
            for b, path in changed.items():
                if b <= batch_id:
                    self._remove(path)
            for path in bases.values():
                self._remove(path)

    def _merged(self) -> DataFrame | None:
        bases, changed = self._complete("base"), self._complete("changed")
        base = max(bases, default=-1)
        paths = [bases[b] for b in bases if b == base] + [p for b, p in sorted(changed.items()) if b > base]
        if not paths:
            return None
        rows = self.spark.read.parquet(paths[0])
        rows = self.spark.read.schema(rows.schema).parquet(*paths)
        rest = [c for c in rows.columns if c not in (*self.keys, "batch")]
        last = F.max_by(F.struct("batch", *rest), "batch").alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*")

    def table(self) -> DataFrame | None:
        """The last row of each key; None before the first batch."""
        merged = self._merged()
        return None if merged is None else merged.drop("batch")


def merge_available(stream: DataFrame, sink: ChangedRows, checkpoint: str) -> None:
    """Feed a keyed table with the rows that have changed in each batch."""
    _started(stream.writeStream.outputMode("update").foreachBatch(sink.write), checkpoint)
