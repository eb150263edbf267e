"""Delivery against a server that fails, loses answers and refuses some events."""

from __future__ import annotations

import collections
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from riskloom.sources import delivery


class Collector:
    """Accepts by key; every third post fails before, every seventh after it was taken; bodies with `poison` are bad."""

    def __init__(self):
        self.taken, self.seen, self.posts, self.down, self.lock = collections.Counter(), [], 0, False, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                text = self.rfile.read(int(self.headers["Content-Length"])).decode()
                with outer.lock:
                    outer.posts += 1
                    key = self.headers["Idempotency-Key"]
                    if outer.down or outer.posts % 3 == 0:
                        status = 503
                    elif "poison" in text:
                        status = 400
                    else:
                        if not outer.taken[key]:
                            outer.seen.append((self.path, self.headers.get("Authorization"), text))
                        outer.taken[key] += 1
                        status = 500 if outer.posts % 7 == 0 else 200
                self.send_response(status)
                self.end_headers()

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def collector():
    c = Collector()
    yield c
    c.server.shutdown()


def events(spark, n, first=0):
    body = F.when(F.col("id") % 10 == 9, "poison").otherwise(F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")))
    return spark.range(first, first + n, 1, 4).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("key"), body.alias("body"))


def test_each_event_arrives_once(spark, collector, tmp_path):
    batch = events(spark, 40)
    got = delivery.deliver(batch.unionAll(batch.limit(5)), 0, collector.url, f"{tmp_path}/out", kind="splunk", credential="k", wait=0.01, tries=12)
    told = {r.key: r.outcome for r in got.collect()}
    assert told == {f"e{i}": "rejected" if i % 10 == 9 else "sent" for i in range(40)}
    assert set(collector.taken) == {k for k, o in told.items() if o == "sent"} and len(collector.seen) == 36
    assert {(p, a) for p, a, _ in collector.seen} == {("/services/collector/event", "Splunk k")}
    # The same batch again posts nothing; another batch does.
    before = collector.posts
    assert delivery.deliver(batch, 0, collector.url, f"{tmp_path}/out", wait=0.01, tries=12).count() == 40
    assert collector.posts == before
    delivery.deliver(events(spark, 3, 100), 1, collector.url, f"{tmp_path}/out", wait=0.01, tries=12)
    assert {"e100", "e101", "e102"} <= set(collector.taken)


def test_a_batch_that_failed_goes_on_where_it_was(spark, collector, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    events(spark, 20).write.parquet(source)
    stream = lambda: spark.readStream.schema("key string, body string").parquet(source)
    collector.down = True
    with pytest.raises(Exception, match="could not be delivered"):
        delivery.to_collector(stream(), collector.url, folder, f"{tmp_path}/check", wait=0.01, tries=2).awaitTermination()
    assert not collector.taken
    collector.down = False
    delivery.to_collector(stream(), collector.url, folder, f"{tmp_path}/check", wait=0.01, tries=12).awaitTermination()
    assert set(collector.taken) == {f"e{i}" for i in range(20) if i % 10 != 9}
    last = {r.key: r.outcome for r in delivery.outcomes(spark, folder).where("outcome <> 'failed'").collect()}
    assert last == {f"e{i}": "rejected" if i % 10 == 9 else "sent" for i in range(20)}


def test_bodies(spark):
    row = spark.createDataFrame([("f", "high")], "file string, severity string")
    event = F.struct("file", "severity")
    got = {k: json.loads(row.select(delivery.body(k, event, F.col("severity"), F.col("file"))).first()[0]) for k in delivery.KINDS}
    e = {"file": "f", "severity": "high"}
    assert got["splunk"] == {"index": "main", "source": "riskloom", "event": e}
    assert got["elasticsearch"] == got["generic"] == e and got["sentinel"] == [e]
    assert got["qradar"] == {"magnitude": 8, "event_name": "riskloom detection", "description": "Vulnerability detected in f", "custom_properties": e}
