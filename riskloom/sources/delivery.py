"""Delivery of events to HTTP collectors, batch by batch, each event acknowledged once.

A batch posts the events that no earlier attempt of the batch has settled, and writes what came of each: `sent`, or `rejected`
if the collector says that the event itself is bad.  What fails otherwise (no answer, 408, 429, 5xx) is tried again after a wait that
doubles; if it still fails, the batch fails after the others are settled, and the next attempt goes on with the rest.
Each post carries the event's key, so a collector can tell a repeated one whose answer was lost; where the key is part
of the address, it replaces itself.

Posting runs in the executors' tasks.  The table of outcomes is written once for each attempt, and read by the next.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each kind of collector the path of a post (with the index and key), the header that holds the credential and what stands before it.
KINDS = {
    "splunk": ("/services/collector/event", "Authorization", "Splunk "),
    "elasticsearch": ("/{index}/_doc/{key}", "Authorization", "ApiKey "),
    "qradar": ("/api/siem/events", "SEC", ""),
    "sentinel": ("/api/logs", "Authorization", "SharedKey "),
    "generic": ("", "Authorization", "Bearer "),
}
#: The magnitude of each severity.
MAGNITUDE = {"critical": 10, "high": 8, "medium": 6, "low": 4}
AGAIN = (408, 429)
OUTCOME = "key string, outcome string, status int, attempts int"
TABLE = f"{OUTCOME}, batch long"


def body(kind: str, event: Column, severity: Column, file: Column, index: str = "main", source: str = "riskloom") -> Column:
    """The text that a collector of a kind takes for an event, a struct."""
    if kind == "splunk":
        return F.to_json(F.struct(F.lit(index).alias("index"), F.lit(source).alias("source"), event.alias("event")))
    if kind == "qradar":
        magnitude = F.coalesce(F.create_map(*[F.lit(x) for pair in MAGNITUDE.items() for x in pair])[severity], F.lit(MAGNITUDE["low"]))
        told = F.concat(F.lit("Vulnerability detected in "), F.coalesce(file, F.lit("unknown")))
        return F.to_json(F.struct(magnitude.alias("magnitude"), F.lit(f"{source} detection").alias("event_name"), told.alias("description"), event.alias("custom_properties")))
    return F.to_json(F.array(event)) if kind == "sentinel" else F.to_json(event)


def _post(url: str, key: str, text: str, headers: dict[str, str], wait: float, tries: int) -> tuple[str, int | None, int]:
    """(outcome, last status, attempts) of one event."""
    status = None
    for n in range(1, tries + 1):
        request = urllib.request.Request(url, text.encode(), {"Content-Type": "application/json", "Idempotency-Key": key, **headers}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:
                return "sent", answer.status, n
        except urllib.error.HTTPError as e:
            status = e.code
            if status < 500 and status not in AGAIN:
                return "rejected", status, n
        except OSError:
            status = None
        if n < tries:
            time.sleep(wait * 2 ** (n - 1))
    return "failed", status, tries


def deliver(events: DataFrame, number: int, endpoint: str, folder: str, kind: str = "generic", credential: str = "", index: str = "main", wait: float = 0.5, tries: int = 5) -> DataFrame:
    """Posts events(key, body), which are batch `number`, and gives the batch's outcomes; raises if some could not be settled.

    folder: of the outcomes of all batches, in the shared folder.  Keys tell events apart; of rows that repeat a key one is posted.
    """
    spark = events.sparkSession
    path, header, prefix = KINDS[kind]
    headers = {header: prefix + credential} if credential else {}

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), strict=True):
                url = endpoint + path.format(index=index, key=urllib.request.quote(key, safe=""))
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "outcome", "status", "attempts"), (key, *_post(url, key, text or "", headers, wait, tries)), strict=True))], schema=pa.schema([("key", pa.string()), ("outcome", pa.string()), ("status", pa.int32()), ("attempts", pa.int32())]))

    spark.createDataFrame([], TABLE).write.mode("append").parquet(folder)
    settled = outcomes(spark, folder).where((F.col("batch") == number) & (F.col("outcome") != "failed")).select("key").distinct()
    left = events.select("key", "body").dropDuplicates(["key"]).join(settled, "key", "left_anti")
    left.mapInArrow(posted, OUTCOME).withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(folder)
    told = outcomes(spark, folder).where(F.col("batch") == number)
    done = told.where("outcome <> 'failed'")
    failed = events.select("key").distinct().join(done.select("key").distinct(), "key", "left_anti").count()
    if failed:
        raise RuntimeError(f"batch {number}: {failed} events could not be delivered")
    return done


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(key, outcome, status, attempts, batch) of all attempts so far; a failed one is followed by another."""
    return spark.read.schema(TABLE).parquet(folder)


def to_collector(stream: DataFrame, endpoint: str, folder: str, checkpoint: str, **options):
    """A query that delivers the micro-batches of a stream of events(key, body); a batch that failed is tried again by the next start."""

    def each(batch: DataFrame, number: int) -> None:
        deliver(batch, number, endpoint, folder, **options)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
