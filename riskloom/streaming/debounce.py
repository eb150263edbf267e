"""Change events that settle, and named analyzers side by side.

`settled` lets an event of a path through once no later event of the path follows within the buffer time: of a burst only the last
stays.  A burst is a session whose gap is the buffer time, and of each open session the last event is held as state until the
watermark, which is in whole milliseconds, has passed its buffer time; then it is certain what follows, whatever the order in
which events came.  State is a row for each burst that isn't over, however many events it has.

`analyzers` runs one streaming query for each name, each with a checkpoint and a table of its own, so that one that fails or is
stopped leaves the others alone, and one that starts again goes on where it was.

The state of many paths belongs on disk; `store` sets the provider that keeps it there, and restores what was set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settled(events: DataFrame, buffer: float, delay: str = "0 seconds") -> DataFrame:
    """(path, event_id, change_type, hash, at) of a stream of events(event_id, path, change_type, ts, hash): at is ts in microseconds.

    buffer: seconds.  delay: how late events may come.  Events whose buffer time isn't over yet stay held.
    """
    ts = F.col("ts").cast("timestamp")
    rows = events.select("event_id", "path", "change_type", "hash", F.unix_micros(ts).alias("at"), ts.alias("ts")).withWatermark("ts", delay)
    wait = round(buffer * 1_000_000)
    # A session takes in what starts at its very end too; without a buffer a burst is the events of one time.
    burst = F.session_window("ts", f"{wait} microseconds") if wait else F.col("ts")
    last = F.max_by(F.struct("event_id", "change_type", "hash", "at"), F.struct("at", "event_id")).alias("last")
    return rows.groupBy("path", burst).agg(last).select("path", "last.*")


def settled_batch(events: DataFrame, buffer: float) -> DataFrame:
    """The same over a table, of which all events' times but the last's are over: by the event that follows."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    follows = F.lead(at).over(Window.partitionBy("path").orderBy("ts", "event_id"))
    last = events.agg(F.max(at).alias("last"))
    rows = events.withColumn("at", at).withColumn("next", follows).crossJoin(F.broadcast(last))  # one row
    wait = round(buffer * 1_000_000)
    return rows.where((F.col("next").isNull() | (F.col("next") > F.col("at") + wait)) & (F.col("at") + wait <= F.col("last"))).select("path", "event_id", "change_type", "hash", "at")


def analyzers(named: dict[str, DataFrame], folder: str, mode: str = "append") -> dict[str, DataFrame]:
    """Runs each stream to the end of what there is, all at once, and gives each name's table below folder.

    A query of a name that ran before in the folder goes on from its checkpoint.  If one fails, the others end first, and
    the error names it.
    """
    started, failed = {}, []
    for name, stream in named.items():
        writer = stream.writeStream.queryName(name).outputMode(mode).format("parquet").option("path", f"{folder}/{name}/rows").option("checkpointLocation", f"{folder}/{name}/checkpoint")
        started[name] = writer.trigger(availableNow=True).start()
    for name, query in started.items():
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001
            failed.append(f"{name}: {e}")
    if failed:
        raise RuntimeError("; ".join(failed))
    return {name: stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}/rows") for name, stream in named.items()}


def overall(tables: dict[str, DataFrame], found: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(analyzer, files, found) of each analyzer's table, and of all together as analyzer `all`; found: those of its rows that count as found."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("files")).withColumn("analyzer", F.lit(name))
        one = one.crossJoin((found(rows) if found else rows).agg(F.count("*").alias("found")))  # one row each
        out = one if out is None else out.unionByName(one)
    total = out.agg(F.sum("files").alias("files"), F.sum("found").alias("found")).withColumn("analyzer", F.lit("all"))
    return out.unionByName(total).select("analyzer", "files", "found")
