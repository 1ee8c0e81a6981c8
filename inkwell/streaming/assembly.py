"""Documents whose blocks arrive in any order, released whole: a keyed state a document, closed by count or by a timer.

Blocks wait in a list state under their document. The document closes when as many different blocks are there as its blocks
say it has (total), or, if that never comes, when the event-time watermark passes `idle` after its latest block. Closing
releases all blocks at once and leaves only a mark, so state holds open documents and nothing else of closed ones; the
released blocks then go through the batch operators (number_blocks, questions) of one micro-batch, which see whole documents.
A block that comes again is held once, one whose time is before the watermark is dropped by Spark; one that comes after its document has closed is released by itself, marked late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Columns that every block of a stream has: its document, place, time, and the number of blocks of its document (or null).
CARRIED = ["doc", "i", "ts", "total"]


class Release(StatefulProcessor):
    """Holds (i, body) of each block of an open document; gives (doc, i, body, closed_by) once it closes.

    idle: milliseconds of event time after the latest block.
    """

    def __init__(self, idle: int, body: StructType):
        self.idle, self.held = idle, body

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", self.held)
        self.open = handle.getValueState("open", "latest long, due long")
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows, timerValues):
        came = [(r["i"], r["body"], r["at"], r["total"]) for r in rows]
        if self.closed.exists():
            for i, body, _, _ in sorted(came, key=lambda x: x[0]):
                yield self._out(key, i, body, "late")
            return
        known = dict(self._list())
        new = {i: body for i, body, _, _ in came if i not in known}
        if new:
            self.blocks.appendList([(i, body) for i, body in new.items()])
        known |= new
        totals = [n for *_, n in came if n is not None]
        if totals and len(known) >= max(totals):
            yield from self._close(key, known, "count")
            return
        before = self.open.get() if self.open.exists() else None
        latest = max([at for _, _, at, _ in came] + ([before[0]] if before else []))
        if before and before[1]:
            self.handle.deleteTimer(before[1])
        due = max(latest + self.idle, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self.open.update((latest, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.closed.exists():
            yield from self._close(key, dict(self._list()), "timer")

    def _list(self):
        return [(r[0], r[1]) for r in self.blocks.get()] if self.blocks.exists() else []

    def _close(self, key, known, why):
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.blocks.clear()
        self.open.clear()
        self.closed.update((True,))
        for i in sorted(known):
            yield self._out(key, i, known[i], why)

    @staticmethod
    def _out(key, i, body, why):
        from pyspark.sql import Row

        return Row(doc=key[0], i=i, body=body, closed_by=why)

    def close(self) -> None:
        pass


def released(blocks: DataFrame, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The blocks of closed documents of a stream of blocks (doc, i, ts, total and any more columns), with closed_by: count,
    timer or late."""
    rest = [c for c in blocks.columns if c not in CARRIED]
    doc, i = blocks.schema["doc"].dataType, blocks.schema["i"].dataType
    body = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    packed = blocks.withWatermark("ts", late).select("doc", "i", F.unix_millis("ts").alias("at"), F.col("total").cast("long").alias("total"), body.alias("body"), "ts")
    ms = blocks.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00 UTC' + interval {idle})")).first()[0]
    out = StructType([StructField("doc", doc), StructField("i", i), StructField("body", StringType()), StructField("closed_by", StringType())])
    held = StructType([StructField("i", i), StructField("body", StringType())])
    whole = packed.groupBy("doc").transformWithState(Release(ms, held), out, "Append", "EventTime")
    fields = StructType([f for f in blocks.schema.fields if f.name in rest])
    return whole.withColumn("body", F.from_json("body", fields)).select("doc", "i", "body.*", "closed_by")


def assembled(blocks: DataFrame, assemble: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, idle: str = "10 minutes", late: str = "10 minutes", **trigger) -> StreamingQuery:
    """Starts a query that writes assemble(the released blocks) of each micro-batch to a Parquet table, a folder a batch: a batch
    that runs again after a failure replaces its own folder, so every document's rows are there once. The blocks themselves
    are kept in the same way beside it, in table-blocks.

    assemble: a batch operator over whole documents; late blocks come in batches and documents of their own, with closed_by
    late. trigger: as in writeStream.trigger, availableNow by default. State is kept in RocksDB under the checkpoint.
    """
    spark = blocks.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written before it is read, more than once perhaps: a second run of the plan would work on the same state again.
        batch.write.mode("overwrite").parquet(f"{table}-blocks/batch={batch_id}")
        assemble(spark.read.schema(batch.schema).parquet(f"{table}-blocks/batch={batch_id}")).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the setting that it starts with
    try:
        return released(blocks, idle, late).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
