"""Storage-log operators on a stream of log events.

Events wait in a state store, by (family, key), until the watermark has passed them: event-time
timers then release them, so what leaves the store is the log in its final order, slice by slice.
The store also keeps each key's flushes and hands them out once for each slice that asks for the key;
a batch therefore looks at its own events and at the history of the keys it asks for, never at the
log so far.  What it needs to know about tables is metadata: compactions, and the first and last
flush of every table between two compactions that name it.

Each micro-batch writes its own partition of every table, named by the batch id, and reads only
partitions of earlier batches: a repeated batch overwrites what it wrote before, so results survive
lost executors and restarted queries.  Events behind the watermark are dropped by the engine and
counted from its progress reports.  Watermarks and timers have a resolution of a millisecond.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from keysift.operators import bloom
from keysift.operators.bloom import FilterSet
from keysift.plans import storage_log
from keysift.session import broadcast_if_small, materialize

EVENT_SCHEMA = "kind string, t long, line_no long, cf string, `table` string, key string, inputs array<string>"
NEVER = -(1 << 62)


def stage_events(events: DataFrame, path: str, parts: int) -> None:
    """Write a log as ``parts`` successive batches of files, in time order."""
    cuts = events.approxQuantile("t", [i / parts for i in range(1, parts)], 0.001)
    edges = [float(NEVER), *cuts, float(1 << 62)]
    for low, high in zip(edges, edges[1:]):
        events.where((F.col("t") > low) & (F.col("t") <= high)).write.mode("append").parquet(path)


def event_stream(spark: SparkSession, path: str, schema: str | StructType = EVENT_SCHEMA, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(stream: DataFrame, work: str, process) -> None:
    query = (
        stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _write(df: DataFrame, work: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{work}/{name}/batch={batch}")


def _state(spark: SparkSession, work: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(f"{work}/{name}")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"

#: ``role`` is 'event' for the log itself and 'held' for an earlier flush of a key that a read of the slice asks for.
SETTLED = f"{EVENT_SCHEMA}, role string"
HIT_SCHEMA = "line_no long, t long, cf string, key string, `table` string"
COUNTER_SCHEMA = "cf string, reads long, cf_known long, found long, not_found long, cf_unknown long"
META_SCHEMA = "cf string, `table` string, t long, line_no long"
END = "end"
#: Microseconds of a moment behind every log: 9999-01-01.
FAR = 253_370_764_800_000_000


class KeyHistory(StatefulProcessor):
    """The events of one (family, key): those not yet settled by millisecond, and all settled flushes."""

    WAITING = "events array<struct<kind:string,t:bigint,line_no:bigint,cf:string,`table`:string,key:string,inputs:array<string>>>"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", self.WAITING)
        self.flushes = handle.getListState("flushes", "cf string, `table` string, key string, t long, line_no long")
        # The watermark of the slice that was last told the flushes.
        self.told = handle.getValueState("told", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[int, list[tuple]] = {}
        for r in rows:
            if r["kind"] != END:
                fresh.setdefault(r["t"] // 1000, []).append((r["kind"], r["t"], r["line_no"], r["cf"], r["table"], r["key"], r["inputs"]))
        for at, events in fresh.items():
            if self.waiting.containsKey((at,)):
                events = [tuple(e) for e in self.waiting.getValue((at,))[0]] + events
            else:
                self.handle.registerTimer(at)
            self.waiting.updateValue((at,), (events,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        if not self.waiting.containsKey((at,)):
            return
        events = [tuple(e) for e in self.waiting.getValue((at,))[0]]
        self.waiting.removeKey((at,))
        if any(e[0] == "read" for e in events) and not (self.told.exists() and self.told.get()[0] == now):
            self.told.update((now,))
            if self.flushes.exists():
                for cf, table, name, t, line_no in self.flushes.get():
                    yield Row(kind="flush", t=t, line_no=line_no, cf=cf, table=table, key=name, inputs=None, role="held")
        for kind, t, line_no, cf, table, name, inputs in events:
            if kind == "flush":
                self.flushes.appendValue((cf, table, name, t, line_no))
            yield Row(kind=kind, t=t, line_no=line_no, cf=cf, table=table, key=name, inputs=inputs, role="event")

    def close(self) -> None:
        pass


def settled_stream(events: DataFrame, delay_micros: int) -> DataFrame:
    """The events that the watermark has passed, and the earlier flushes of keys that are read (``SETTLED``).

    A compaction is a group of its own: nothing about it depends on other events here.
    """
    timed = events.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", f"{delay_micros // 1000} milliseconds")
    alone = F.concat(F.lit("\0"), "kind", F.lit(" "), F.col("line_no").cast("string"))
    keyed = timed.withColumn("_key", F.when(F.col("kind").isin("flush", "read"), F.coalesce("key", F.lit(""))).otherwise(alone))
    keyed = keyed.withColumn("_cf", F.coalesce("cf", F.lit("")))
    return keyed.groupBy("_cf", "_key").transformWithState(KeyHistory(), SETTLED, "append", "EventTime")


class LogStream:
    """A log consumed into ``work``; may be stopped and continued with more files, and ended once."""

    def __init__(self, spark: SparkSession, source: str, work: str, delay_micros: int, resolve: bool = True, files_per_batch: int = 8):
        self.spark, self.source, self.work, self.delay = spark, source, work, delay_micros
        self.resolving, self.files_per_batch = resolve, files_per_batch
        for name, schema in (("end", EVENT_SCHEMA), ("late", "late long")):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{work}/{name}")

    def _partition(self, name: str, schema: str, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.work}/{name}/batch={batch}")

    def _all(self, name: str, schema: str) -> DataFrame:
        return _state(self.spark, self.work, name, schema).drop("batch")

    def _metadata(self, compactions: DataFrame, flushes: DataFrame) -> DataFrame:
        """The first and the last flush of every table between two compactions that name it."""
        edges = storage_log.compaction_edges(compactions)
        named = edges.groupBy(F.col("input").alias("table")).agg(F.array_sort(F.collect_set("ord")).alias("_named"))
        ordered = storage_log.with_order(flushes.withColumn("kind", F.lit("flush"))).join(broadcast_if_small(named), "table", "left")
        times = F.size(F.filter(F.coalesce("_named", F.array()), lambda n: n < F.col("ord")))
        ends = ordered.groupBy("cf", "table", times.alias("_times")).agg(F.min("ord").alias("_first"), F.max("ord").alias("_last"))
        both = ends.select("cf", "table", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("o"))
        return both.select("cf", "table", F.col("o.t").alias("t"), F.col("o.line_no").alias("line_no"))

    def _take(self, batch: DataFrame, number: int) -> None:
        """Write a slice of the settled log, and what its reads find."""
        _write(batch, self.work, "settled", number)
        rows = self._partition("settled", SETTLED, number)
        events = rows.where("role = 'event'").drop("role")
        if not self.resolving:
            return
        _write(events.where("kind = 'compaction'"), self.work, "compactions", number)
        compactions = self._all("compactions", EVENT_SCHEMA)
        flushes = events.where("kind = 'flush'")
        known = self._partition("metadata", META_SCHEMA, number - 1).unionByName(flushes.select("cf", "table", "t", "line_no"))
        _write(self._metadata(compactions, known), self.work, "metadata", number)
        hits, counters = self.spark.createDataFrame([], HIT_SCHEMA), self.spark.createDataFrame([], COUNTER_SCHEMA)
        if not events.where("kind = 'read'").isEmpty():
            metadata = self._partition("metadata", META_SCHEMA, number).withColumn("kind", F.lit("flush"))
            tables = compactions.unionByName(metadata, allowMissingColumns=True)
            registry = storage_log.resolve(tables)
            # Of the keys only those asked for: their flushes before this slice come with it.
            held = rows.where("role = 'held'").drop("role")
            registry.events = held.unionByName(flushes).unionByName(compactions)
            found = materialize(storage_log.read_hits(registry, storage_log.read_rows(events)))
            hits = found.select("line_no", "t", "cf", "key", "table")
            counters = storage_log.read_counters(registry, found, ["cf"])
        _write(hits, self.work, "hits", number)
        _write(counters, self.work, "counters", number)

    def consume(self) -> None:
        """Take all files that are there; events within the delay of the latest one stay in the state store."""
        conf = self.spark.conf
        before = {name: conf.get(name, None) for name in (STATE_STORE, PROGRESS)}
        conf.set(STATE_STORE, ROCKS)
        conf.set(PROGRESS, "100000")
        try:
            log = event_stream(self.spark, self.source, files_per_batch=self.files_per_batch)
            marks = event_stream(self.spark, f"{self.work}/end")
            settled = settled_stream(log.unionByName(marks), self.delay)
            query = settled.writeStream.foreachBatch(self._take).outputMode("append").option("checkpointLocation", f"{self.work}/checkpoint")
            query = query.trigger(availableNow=True).start()
            query.awaitTermination()
            dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)
        self.spark.createDataFrame([(dropped,)], "late long").write.mode("append").parquet(f"{self.work}/late")

    def end(self) -> None:
        """The log has ended: everything is settled.  Events that come later are late."""
        self.consume()
        mark = self.spark.createDataFrame([(END, FAR, 0, "", None, "", None)], EVENT_SCHEMA)
        mark.coalesce(1).write.mode("append").parquet(f"{self.work}/end")
        self.consume()

    def accepted(self) -> DataFrame:
        """The settled log."""
        return self._all("settled", SETTLED).where("role = 'event'").drop("role")

    def hits(self) -> DataFrame:
        return self._all("hits", HIT_SCHEMA)

    def counters(self) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("reads", "cf_known", "found", "not_found", "cf_unknown")]
        return self._all("counters", COUNTER_SCHEMA).groupBy("cf").agg(*sums)

    def late(self) -> DataFrame:
        """How many events came behind the watermark."""
        return self.spark.read.schema("late long").parquet(f"{self.work}/late").agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))


def ingest(spark: SparkSession, source: str, work: str, delay_micros: int) -> LogStream:
    """Consume a log to its end; ``merge_logs`` of what was accepted is the merged order."""
    log = LogStream(spark, source, work, delay_micros, resolve=False)
    log.end()
    return log


def resolve_log(spark: SparkSession, source: str, work: str, delay_micros: int) -> LogStream:
    """Consume a log to its end and resolve all its reads."""
    log = LogStream(spark, source, work, delay_micros)
    log.end()
    return log


def stream_filters(spark: SparkSession, source: str, work: str, error_rate: float, capacity: int) -> FilterSet:
    """Filters of the flushed tables: every batch adds the words its keys set."""
    by = ["cf", "table"]
    schema = "cf string, `table` string, word long, bits long"
    _write(spark.createDataFrame([], schema), work, "words", -1)
    _write(spark.createDataFrame([], "cf string, `table` string"), work, "tables", -1)

    def sized(tables: DataFrame) -> DataFrame:
        return bloom.size_filters(tables.withColumn("capacity", F.lit(capacity).cast("bigint")), by, error_rate)

    def process(batch: DataFrame, number: int) -> None:
        keys = batch.where("kind = 'flush'").select(*by, "key")
        tables = keys.select(*by).distinct()
        _write(bloom.build_filters(keys, sized(tables), by, error_rate).words.select(*by, "word", "bits"), work, "words", number)
        _write(tables, work, "tables", number)

    _run(event_stream(spark, source), work, process)
    words = _state(spark, work, "words", schema).groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))
    tables = _state(spark, work, "tables", "cf string, `table` string").select(*by).distinct()
    return FilterSet(by, error_rate, sized(tables), words)
