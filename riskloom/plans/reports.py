"""Queries of set operations between scanners, reports, change events and smaller functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.rules import SQL_SUBJECTS, subjects
from riskloom.operators import detectors
from riskloom.plans.registry import register
from riskloom.sources import delivery, shared, sinks
from riskloom.sources.files import last_of_key
from riskloom.streaming import changes, debounce

#: Scanner a reports error and purchase events of even users, scanner b error and click events of users divisible by three.
SCANNERS = """a AS (SELECT DISTINCT user_id AS file, event_type AS kind FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 2 = 0 AND value > 40),
b AS (SELECT DISTINCT user_id AS file, event_type AS kind FROM events WHERE event_type IN ('error', 'click') AND user_id % 3 = 0 AND value > 30)"""


def scanners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("file"), F.col("event_type").alias("kind"), "value")
    a = e.where(F.col("kind").isin("error", "purchase") & (F.col("file") % 2 == 0) & (F.col("value") > 40)).select("file", "kind").distinct()
    b = e.where(F.col("kind").isin("error", "click") & (F.col("file") % 3 == 0) & (F.col("value") > 30)).select("file", "kind").distinct()
    return a, b


for _name, _word, _op in (("union", "UNION", "unionAll"), ("intersect", "INTERSECT", "intersect"), ("except", "EXCEPT", "subtract")):

    def _query(spark, sf_dir, op=_op):
        a, b = scanners(spark, sf_dir)
        out = getattr(a, op)(b)
        return out.distinct() if op == "unionAll" else out

    register(f"u01_{_name}", f"WITH {SCANNERS} SELECT * FROM a {_word} SELECT * FROM b")(_query)


@register(
    "u02_jaccard_agreement",
    f"WITH {SCANNERS}, s AS (SELECT coalesce(a.file, b.file) AS file, count(a.file) AS na, count(b.file) AS nb, count(*) FILTER (a.file IS NOT NULL AND b.file IS NOT NULL) AS common, count(*) AS n FROM a FULL JOIN b ON a.file = b.file AND a.kind = b.kind GROUP BY ALL) SELECT file, na, nb, common, round(CASE WHEN n > 0 THEN common::DOUBLE / n ELSE 1 END, 9) AS jaccard FROM s",
)
def jaccard_agreement(spark, sf_dir):
    a, b = scanners(spark, sf_dir)
    j = a.withColumn("ina", F.lit(1)).join(b.withColumn("inb", F.lit(1)), ["file", "kind"], "full")
    s = j.groupBy("file").agg(F.count("ina").alias("na"), F.count("inb").alias("nb"), F.count_if(F.col("ina").isNotNull() & F.col("inb").isNotNull()).alias("common"), F.count("*").alias("n"))
    return s.select("file", "na", "nb", "common", F.round(F.when(F.col("n") > 0, F.col("common") / F.col("n")).otherwise(1.0), 9).alias("jaccard"))


@register("a29_correlation_summary", f"WITH {SCANNERS}, c AS (SELECT * FROM a INTERSECT SELECT * FROM b) SELECT (SELECT count(*) FROM a) AS own, (SELECT count(*) FROM b) AS other, (SELECT count(*) FROM c) AS common, round((SELECT count(*) FROM c) * 100.0::DOUBLE / greatest((SELECT count(*) FROM a), 1), 6) AS overlap")
def correlation_summary(spark, sf_dir):
    a, b = scanners(spark, sf_dir)
    j = a.withColumn("ina", F.lit(1)).join(b.withColumn("inb", F.lit(1)), ["file", "kind"], "full")
    s = j.agg(F.count("ina").alias("own"), F.count("inb").alias("other"), F.count_if(F.col("ina").isNotNull() & F.col("inb").isNotNull()).alias("common"))
    return s.withColumn("overlap", F.round(F.col("common") * 100.0 / F.greatest(F.col("own"), F.lit(1)), 6))


@register(
    "u05_scanner_agreement",
    "WITH f AS (SELECT user_id AS line, event_type AS kind, event_id, value / 100 AS c FROM events), g AS (SELECT line, kind, arg_min(c, event_id) AS first, count(*) AS n FROM f GROUP BY ALL) SELECT line, kind, n, round(least(1.0::DOUBLE, first + 0.15::DOUBLE * (n - 1)), 9) AS confidence FROM g",
)
def scanner_agreement(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("line"), F.col("event_type").alias("kind")).agg(F.min_by(F.col("value") / 100, "event_id").alias("first"), F.count("*").alias("n"))
    return g.select("line", "kind", "n", F.round(F.least(F.lit(1.0), F.col("first") + 0.15 * (F.col("n") - 1)), 9).alias("confidence"))


@register("a23_issue_summary", "SELECT event_type, count(*) FILTER (value < 30) AS low, count(*) FILTER (value >= 30 AND value < 70) AS medium, count(*) FILTER (value >= 70) AS high FROM events GROUP BY event_type")
def issue_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("value") < 30, "low").when(F.col("value") < 70, "medium").when(F.col("value") >= 70, "high")
    return e.groupBy("event_type").agg(*[F.count_if(kind == k).alias(k) for k in ("low", "medium", "high")])


EVENTS = "ev AS (SELECT event_id, user_id::VARCHAR AS path, CASE WHEN event_type = 'signup' THEN 'created' ELSE 'modified' END AS change_type, ts, md5(props) AS hash, value FROM events)"


def change_events(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "signup", "created").otherwise("modified").alias("change_type"), "ts", F.md5(F.col("props").cast("binary")).alias("hash"), "value")


_CHANGED = f"WITH {EVENTS}, l AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ts, event_id) AS last FROM ev) SELECT event_id, path, change_type FROM l WHERE change_type = 'created' OR last IS NULL OR last <> hash"


@register("n09_changed_content", _CHANGED)
def changed_content(spark, sf_dir):
    return changes.changed_batch(change_events(spark.read.parquet(f"{sf_dir}/events.parquet"))).select("event_id", "path", "change_type")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a bounded stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _streamed(spark: SparkSession, sf_dir: str, name: str, build, mode: str) -> DataFrame:
    """What a bounded stream of the events leaves in the shared folder."""
    return changes.run_once(build(change_events(_events_stream(spark, sf_dir))), shared.folder(spark, name), mode)


@register("t05_recent_buffer", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_buffer(spark, sf_dir):
    last = [F.desc("ts"), F.desc("event_id")]
    return changes.run_once(_events_stream(spark, sf_dir), shared.folder(spark, "recent"), top=lambda rows: changes.recent(rows, last)).select("event_id", "user_id")


_HELD = " + ".join(f"coalesce({rule.sql(SQL_SUBJECTS)}, false)::INT" for _, rule in detectors.BANK)


@register("t03_analysis_stream", f"SELECT doc_id, CASE WHEN code IS NULL OR trim(code, ' ') = '' THEN 'empty file' END AS error, CASE WHEN NOT (code IS NULL OR trim(code, ' ') = '') THEN {_HELD} END AS result FROM (SELECT doc_id, text AS code FROM documents)")
def analysis_stream(spark, sf_dir):
    """How many rules of the detector bank hold for each file of a stream."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    held = lambda c: sum((F.coalesce(rule.column(subjects(c)), F.lit(False)).cast("int") for _, rule in detectors.BANK), F.lit(0))
    judged = changes.analyzed(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("code")), held)
    return changes.run_once(judged, shared.folder(spark, "analyzed")).select(F.col("path").cast("long").alias("doc_id"), "error", "result")


@register("t01_file_events", "SELECT 'bucket=' || page_id // 100 AS name, md5(string_agg(url || chr(10), '' ORDER BY page_id)) AS hash FROM pages GROUP BY 1")
def file_event_stream(spark, sf_dir):
    """The files that a folder holds, as a stream: the addresses of every hundred pages, in a folder of their own."""
    folder = shared.folder(spark, "tree")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.floor(F.col("page_id") / 100).alias("bucket"), "page_id", "url")
    pages.repartition("bucket").sortWithinPartitions("bucket", "page_id").select("bucket", F.col("url").alias("value")).write.partitionBy("bucket").text(f"{folder}/files")
    rows = changes.run_once(changes.file_events(spark, f"{folder}/files"), f"{folder}/out")
    return rows.where(F.length("code") > 0).select(F.element_at(F.split("path", "/"), -2).alias("name"), "hash")


@register("t02_change_stream", _CHANGED)
def change_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, "changed", changes.changed_stream, "append").select("event_id", "path", "change_type")


@register("t04_running_statistics", f"WITH {EVENTS} SELECT change_type, count(*) AS n, count(*) FILTER (value > 50) AS detected, round(avg(value), 6) AS mean FROM ev GROUP BY change_type")
def running_statistics(spark, sf_dir):
    return _streamed(spark, sf_dir, "statistics", changes.running_statistics, "complete")


@register("n06_recent_results", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def recent_results(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("user_id", "event_id")


@register("n03_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current_method FROM conversations")
def forward_fill(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("current_method"))


@register("n04_trailing_mean", "WITH d AS (SELECT ts::DATE AS day, round(avg(value), 9) AS v FROM events GROUP BY day) SELECT day::VARCHAR AS day, round(avg(v) OVER (ORDER BY day ROWS 9 PRECEDING), 6) AS trailing FROM d")
def trailing_mean(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 9).alias("v"))
    w = Window.orderBy("day").rowsBetween(-9, Window.currentRow)  # one row for each day
    return d.select(F.col("day").cast("string").alias("day"), F.round(F.avg("v").over(w), 6).alias("trailing"))


FOUND = "found AS (SELECT user_id::VARCHAR AS file_id, event_type AS vuln_type, max(value) / 100 AS confidence FROM events GROUP BY ALL)"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").cast("string").alias("file_id"), F.col("event_type").alias("vuln_type")).agg((F.max("value") / 100).alias("confidence"))


@register("w03_sarif_results", f"WITH {FOUND} SELECT '{{\"ruleId\":\"' || upper(vuln_type) || '\",\"level\":\"' || CASE WHEN confidence >= 0.7 THEN 'error' ELSE 'warning' END || '\",\"message\":{{\"text\":\"' || vuln_type || ' in ' || file_id || '\"}}}}' AS result FROM found")
def sarif_results(spark, sf_dir):
    return found(spark, sf_dir).select(sinks.sarif_result().alias("result"))


@register("w02_junit_cases", f"WITH {FOUND}, f AS (SELECT file_id, count(*) FILTER (confidence >= 0.95) AS n FROM found GROUP BY file_id) SELECT CASE WHEN n > 0 THEN format('<testcase name=\"{{}}\"><failure message=\"{{}} findings\"/></testcase>', file_id, n) ELSE format('<testcase name=\"{{}}\"/>', file_id) END AS testcase FROM f")
def junit_cases(spark, sf_dir):
    f = found(spark, sf_dir).groupBy("file_id").agg(F.count_if(F.col("confidence") >= 0.95).alias("n"))
    return f.select(sinks.junit_case(F.col("n")).alias("testcase"))


@register("w08_security_events", f"WITH {FOUND}, s AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM found) SELECT *, CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 6 ELSE 4 END AS magnitude FROM s")
def security_events(spark, sf_dir):
    return sinks.event(found(spark, sf_dir))


@register("a02_pipeline_summary", f"WITH {FOUND} SELECT count(*) AS detected, count(*) FILTER (confidence >= 0.9) AS critical, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS medium, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence >= 0.9) = 0 AND count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) <= 5 AND count(*) <= 10 AS gate FROM found")
def pipeline_summary(spark, sf_dir):
    c = F.col("confidence")
    out = found(spark, sf_dir).agg(F.count("*").alias("detected"), F.count_if(c >= 0.9).alias("critical"), F.count_if((c >= 0.7) & (c < 0.9)).alias("high"), F.count_if((c >= 0.5) & (c < 0.7)).alias("medium"), F.count_if(c < 0.5).alias("low"))
    return out.withColumn("gate", (F.col("critical") == 0) & (F.col("high") <= 5) & (F.col("detected") <= 10))


@register("a01_directory_summary", "SELECT count(*) AS files, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean, bool_or(contains(text, 'secret')) AS any_hit, count(DISTINCT source) AS sources FROM documents")
def directory_summary(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"), F.bool_or(F.col("text").contains("secret")).alias("any_hit"), F.countDistinct("source").alias("sources"))


@register("s03_last_of_key", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def records_last(spark, sf_dir):
    return last_of_key(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "props"), "user_id", "event_id")


@register("q10_natural_order", "SELECT s_name, row_number() OVER (ORDER BY regexp_extract(s_name, '(\\d+)$', 1)::BIGINT, s_name) AS place FROM supplier")
def natural_order(spark, sf_dir):
    from riskloom.functions.ranking import numbered
    from riskloom.sources.files import natural_order as keys

    return numbered(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name"), *keys("s_name"), name="place")


@register("e02_source_lines", "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS blank, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def source_lines(spark, sf_dir):
    lines = F.split("text", "\n")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("blank"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"))


#: Seconds in which a user's events count as one burst.
BUFFER = 3600
_SETTLED = f"WITH {EVENTS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS next FROM ev) SELECT event_id, path, change_type FROM n WHERE (next IS NULL OR next > ts + INTERVAL {BUFFER} SECONDS) AND ts + INTERVAL {BUFFER} SECONDS <= (SELECT max(ts) FROM ev)"


@register("t07_settled_changes", _SETTLED)
def settled_changes(spark, sf_dir):
    """Of each burst of events the last, as a stream that holds events until their buffer time is over."""
    with debounce.store(spark):
        told = debounce.analyzers({"settled": debounce.settled(change_events(_events_stream(spark, sf_dir)), BUFFER)}, shared.folder(spark, "settled"))
    return told["settled"].select("event_id", "path", "change_type")


@register("t06_named_analyzers", f"WITH s AS ({_SETTLED}), c AS ({_CHANGED}), r AS (SELECT 'settled' AS analyzer, count(*) AS files, count(*) FILTER (change_type = 'created') AS found FROM s UNION ALL SELECT 'changed', count(*), count(*) FILTER (change_type = 'created') FROM c) SELECT * FROM r UNION ALL SELECT 'all', sum(files)::BIGINT, sum(found)::BIGINT FROM r")
def named_analyzers(spark, sf_dir):
    """Two analyzers of one stream, each a query of its own with its checkpoint, and what they have counted alone and together."""
    stream = lambda: change_events(_events_stream(spark, sf_dir))
    with debounce.store(spark):
        tables = debounce.analyzers({"settled": debounce.settled(stream(), BUFFER), "changed": changes.changed_stream(stream())}, shared.folder(spark, "analyzers"))
    return debounce.overall(tables, lambda rows: rows.where("change_type = 'created'"))


def _bodies(kind: str):
    f = f"(SELECT file_id, vuln_type, CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM found)"
    event = '{{"file_id":"\' || file_id || \'","vuln_type":"\' || vuln_type || \'","severity":"\' || severity || \'"}}'.replace("{{", "{").replace("}}", "}")
    texts = {
        "splunk": f"'{{\"index\":\"main\",\"source\":\"riskloom\",\"event\":{event}}}'", "sentinel": f"'[{event}]'", "generic": f"'{event}'", "elasticsearch": f"'{event}'",
        "qradar": f"'{{\"magnitude\":' || CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 6 ELSE 4 END || ',\"event_name\":\"riskloom detection\",\"description\":\"Vulnerability detected in ' || file_id || '\",\"custom_properties\":{event}}}'",
    }
    return f"SELECT file_id || ':' || vuln_type AS key, '{kind}' AS kind, {texts[kind]} AS body FROM {f}"


@register("w07_event_bodies", f"WITH {FOUND} " + " UNION ALL ".join(_bodies(k) for k in delivery.KINDS))
def event_bodies(spark, sf_dir):
    """What each kind of collector is sent for each finding, under the finding's key."""
    rows = sinks.event(found(spark, sf_dir))
    event = F.struct("file_id", "vuln_type", "severity")
    texts = [F.struct(F.lit(k).alias("kind"), delivery.body(k, event, F.col("severity"), F.col("file_id")).alias("body")) for k in delivery.KINDS]
    return rows.select(F.concat_ws(":", "file_id", "vuln_type").alias("key"), F.explode(F.array(*texts)).alias("b")).select("key", "b.*")
