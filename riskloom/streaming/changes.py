"""File-change events: de-duplication by content, quick scans and running statistics, as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = "path string, change_type string, ts timestamp, hash string"


def changed_batch(events: DataFrame) -> DataFrame:
    """Events that tell something new: a creation always, a modification if its content differs from the last."""
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    last = F.lag("hash").over(w)
    return events.withColumn("_last", last).where((F.col("change_type") == "created") | F.col("_last").isNull() | (F.col("_last") != F.col("hash"))).drop("_last")


def _differs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a path's new events those that tell something new; only the last hash is kept as state."""
    parts = list(batches)
    rows = pd.concat(parts) if len(parts) > 1 else parts[0]
    # There are many paths with few events each, so the events are judged as plain arrays.
    order = np.lexsort((rows["event_id"].to_numpy(), rows["ts"].to_numpy()))
    own = rows["hash"].to_numpy()[order]
    last = np.concatenate(([state.get[0] if state.exists else None], own[:-1]))
    state.update((own[-1],))
    new = (rows["change_type"].to_numpy()[order] == "created") | pd.isna(last) | (~pd.isna(own) & (own != last))
    yield rows.take(order[new])


def changed_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: the last hash of each path is kept as state."""
    schema = events.schema
    return events.groupBy("path").applyInPandasWithState(_differs, schema, "hash string", "append", GroupStateTimeout.NoTimeout)


def running_statistics(results: DataFrame) -> DataFrame:
    """Count, detections and mean so far, by kind of change; for complete mode."""
    return results.groupBy("change_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("detected"), F.round(F.avg("value"), 6).alias("mean"))


def to_sinks(results: DataFrame, name: str, *hooks: Callable[[DataFrame, int], None], mode: str = "append"):
    """A named query that hands each micro-batch to every hook."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for hook in hooks:
            hook(batch, number)
        batch.unpersist()

    return results.writeStream.queryName(name).outputMode(mode).foreachBatch(each).trigger(availableNow=True)


def file_events(spark: SparkSession, folder: str, suffix: str = "*.txt") -> DataFrame:
    """A stream of the files that appear below a folder: path, ts (of its last change) and hash, a few files a batch."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = read.option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).load(folder)
    return files.select("path", F.col("modificationTime").alias("ts"), F.md5("content").alias("hash"), F.decode("content", "UTF-8").alias("code"))


def analyzed(files: DataFrame, analyze: Callable[[Column], Column]) -> DataFrame:
    """(path, result, error): what analyze makes of each file's code; a file that can't be judged is a row with an error."""
    good = F.col("code").isNotNull() & (F.trim("code") != "")
    return files.select("path", F.when(good, analyze(F.col("code"))).alias("result"), F.when(~good, F.lit("empty file")).otherwise(F.lit(None).cast("string")).alias("error"))


def recent(rows: DataFrame, order: list, most: int = 100) -> DataFrame:
    """The last rows, as a buffer shows them (a top-k)."""
    return rows.orderBy(*order).limit(most)


def run_once(stream: DataFrame, folder: str, mode: str = "append", top: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of a bounded stream run to its end, in a table in the shared folder: all batches, or, of a complete or reduced
    result, what the last batch left."""
    spark, out, last = stream.sparkSession, f"{folder}/rows", [-1]
    reduced = top is not None or mode == "complete"

    def write(batch: DataFrame, number: int) -> None:
        if top is not None:
            batch = top(batch.unionByName(spark.read.parquet(f"{out}-{last[0]}")) if last[0] >= 0 else batch)
        # A batch that is run again writes the same place again.
        batch.write.mode("overwrite").parquet(f"{out}-{number}" if reduced else f"{out}/batch={number}")
        last[0] = number

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{out}-{last[0]}") if reduced else spark.read.parquet(out).drop("batch")
