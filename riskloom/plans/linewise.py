"""Queries of the line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.rules import quoted
from riskloom.operators import detectors, lines as L
from riskloom.plans.detection import _ALL, _LEAK, _LEAK_SQL, D
from riskloom.plans.registry import register
from riskloom.sources.snippets import SQL_SOURCES, sources

#: Lines that the framework rules find something in, beside the snippets.
MORE = [
    ("m1", 'model.addAttribute("n", n);\n<c:out value="x" escapeXml="false"/>\n<c:out value="x"/>\n<h:outputText escape="true"/>'),
    ("m2", '<p th:utext="${x}"></p>\n<p th:text="${x}"></p>\n${param.q}\nvelocityEngine.evaluate(c, w, "#escape", t);\nt.process(m, out);'),
    ("m3", 'String s = URLEncoder.encode(q);\nresponse.sendRedirect(s);\nHttpServletRequest req = get();\nvoid f(String userInput, int n) { }'),
    ("m4", 'db.executeQuery(q);\np.setString(1, q);\nScanner in = new Scanner(x);\njdbcTemplate.update(q);'),
]
SQL_LINES = SQL_SOURCES.replace("sources AS (", "base AS (", 1) + ", sources AS (SELECT * FROM base UNION ALL SELECT * FROM (VALUES {}) m(file_id, code))".format(
    ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in MORE)
) + """, split_up AS (SELECT file_id, string_split(code, chr(10)) AS p FROM sources), lines AS (SELECT file_id, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS text FROM split_up)"""


def all_sources(spark, sf_dir):
    return sources(spark, sf_dir).unionAll(spark.createDataFrame(MORE, "file_id string, code string"))


def all_lines(spark, sf_dir):
    return L.numbered_lines(all_sources(spark, sf_dir))


def _any(patterns, flag=""):
    return "(" + " OR ".join(f"regexp_matches(text, {quoted(flag + p)})" for p in patterns) + ")" if patterns else "false"


_SINKS = " UNION ALL ".join(
    f"SELECT file_id, line, {quoted(n)} AS sink, '{fw}' AS framework, '{v}' AS vuln_type, CASE WHEN {_any(u)} THEN false WHEN {_any(s)} THEN true {'ELSE true' if d else ''} END AS is_safe FROM lines WHERE {_any(p)}" for n, fw, v, p, s, u, d in L.SINKS
)


@register("j01_framework_sinks", f"WITH {SQL_LINES}, m AS ({_SINKS}) SELECT * REPLACE (is_safe::VARCHAR AS is_safe), CASE WHEN is_safe IS NOT NULL THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM m")
def framework_sinks(spark, sf_dir):
    return L.framework_sinks(all_lines(spark, sf_dir)).withColumn("is_safe", F.col("is_safe").cast("string"))


_SANITIZERS = " UNION ALL ".join(
    f"SELECT file_id, line, {quoted(n)} AS sanitizer, {e}::DOUBLE AS effectiveness FROM lines WHERE " + " OR ".join(f"contains(text, {quoted(w)})" for w in words) + f" OR {_any(['|'.join(p)], '(?i)')}" for n, p, words, e in L.SANITIZERS
)


@register("j02_sanitizers", f"WITH {SQL_LINES} {_SANITIZERS}")
def sanitizers(spark, sf_dir):
    return L.sanitizers(all_lines(spark, sf_dir))


_MARK = " OR ".join(f"contains(lower(text), {quoted(m)})" for m in L.SINK_MARKERS)


@register("j03_sink_lines", f"WITH {SQL_LINES} " + " UNION ALL ".join(f"SELECT file_id, line, {quoted(m)} AS marker FROM lines WHERE contains(lower(text), {quoted(m)})" for m in L.SINK_MARKERS))
def sink_lines(spark, sf_dir):
    low = F.lower("text")
    marks = F.array_compact(F.array(*[F.when(low.contains(F.lit(m)), F.lit(m)) for m in L.SINK_MARKERS]))
    return all_lines(spark, sf_dir).select("file_id", "line", F.explode(marks).alias("marker"))


@register(
    "j04_placement_risk",
    f"WITH {SQL_LINES}, g AS ({_SANITIZERS}), a AS (SELECT file_id, min(line) AS first_sink FROM lines WHERE {_MARK} GROUP BY file_id), b AS (SELECT file_id, min(line) AS first_sanitizer FROM g GROUP BY file_id) SELECT file_id, first_sink, first_sanitizer, CASE WHEN first_sink IS NULL THEN 'UNKNOWN' WHEN first_sanitizer < first_sink THEN 'LOW' ELSE 'HIGH' END AS risk FROM (SELECT DISTINCT file_id FROM lines) LEFT JOIN a USING (file_id) LEFT JOIN b USING (file_id)",
)
def placement_risk(spark, sf_dir):
    return L.placement(all_lines(spark, sf_dir))


_KINDS = " OR ".join(f"contains(kind, '{k}')" for k in L.FRAMEWORK_TYPES)
_NAMES = ", ".join(quoted(n) for n in L.PARAMETER_NAMES)


@register(
    "g02_taint_sources",
    rf"""WITH {SQL_LINES}, d AS (SELECT file_id, line, unnest(regexp_extract_all(text, '\b(\w+)\s+\w+\s*[;=]', 1)) AS kind, unnest(regexp_extract_all(text, '\b\w+\s+(\w+)\s*[;=]', 1)) AS variable FROM lines),
    q AS (SELECT file_id, line, unnest(regexp_extract_all(text, '\(([^)]+)\)', 1)) AS ps FROM lines), w AS (SELECT file_id, line, list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '') AS w FROM (SELECT file_id, line, unnest(string_split(ps, ',')) AS p FROM q))
    SELECT DISTINCT file_id, line, variable, 'framework' AS reason FROM d WHERE {_KINDS} UNION ALL SELECT DISTINCT file_id, line, w[-1] AS variable, 'heuristic' FROM w WHERE len(w) >= 2 AND w[-1] IN ({_NAMES})""",
)
def taint_sources(spark, sf_dir):
    return L.taint_sources(all_lines(spark, sf_dir))


@register(
    "g05_sink_flows",
    rf"""WITH {SQL_LINES}, d AS (SELECT file_id, unnest(regexp_extract_all(text, '\b(\w+)\s+\w+\s*[;=]', 1)) AS kind, unnest(regexp_extract_all(text, '\b\w+\s+(\w+)\s*[;=]', 1)) AS variable FROM lines), t AS (SELECT DISTINCT file_id, variable FROM d WHERE {_KINDS}),
    k AS (SELECT DISTINCT file_id, line, unnest(regexp_extract_all(text, '\w+')) AS word FROM lines WHERE contains(text, '(')) SELECT k.file_id, k.line, k.word AS variable, s.word AS sink FROM k JOIN t ON t.file_id = k.file_id AND t.variable = k.word JOIN k s ON s.file_id = k.file_id AND s.line = k.line WHERE s.word IN ('executeQuery', 'executeUpdate', 'println', 'sendRedirect', 'exec', 'eval', 'lookup', 'read', 'getSession')""",
)
def sink_flows(spark, sf_dir):
    """Tainted variables and sink names that stand as words in one line: lines are cut into words and joined on them."""
    rows = all_lines(spark, sf_dir)
    tainted = L.taint_sources(rows).where("reason = 'framework'").select("file_id", F.col("variable").alias("word")).distinct()
    words = rows.where(F.col("text").contains("(")).select("file_id", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    sinks = words.where(F.col("word").isin("executeQuery", "executeUpdate", "println", "sendRedirect", "exec", "eval", "lookup", "read", "getSession")).withColumnRenamed("word", "sink")
    return words.join(tainted, ["file_id", "word"]).join(sinks, ["file_id", "line"]).select("file_id", "line", F.col("word").alias("variable"), "sink")


_SEVERITY = "CASE vuln_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.SEVERITY.items()) + " ELSE 0 END"


@register(
    "j13_primary_by_severity",
    f"""WITH {SQL_SOURCES}, n AS ({_LEAK_SQL}), f AS ({_ALL} UNION ALL SELECT file_id, {len(D.BANK)}, '{D.LEAK}' FROM n WHERE {_LEAK}),
    s AS (SELECT f.file_id, pos, vuln_type, {_SEVERITY} + CASE WHEN vuln_type = 'null_pointer_dereference' THEN CASE WHEN contains(code, 'getProfile().get') OR contains(code, ').get') THEN 20 WHEN contains(code, '.get(') AND contains(code, '.length()') THEN 10 ELSE 0 END ELSE 0 END AS score FROM f JOIN sources USING (file_id))
    SELECT file_id, vuln_type, score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, pos) AS rn FROM s) WHERE rn = 1""",
)
def primary_by_severity(spark, sf_dir):
    src = sources(spark, sf_dir)
    return L.primary(detectors.findings(src), src)


@register(
    "n02_brace_depth",
    f"WITH {SQL_LINES} SELECT file_id, line, sum(length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', ''))) OVER (PARTITION BY file_id ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM lines",
)
def brace_depth(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.length(F.replace("text", F.lit("}"), F.lit(""))) - F.length(F.replace("text", F.lit("{"), F.lit("")))
    return all_lines(spark, sf_dir).select("file_id", "line", F.sum(step.cast("long")).over(w).alias("depth"))


@register(
    "e24_code_metrics",
    f"WITH {SQL_SOURCES} SELECT file_id, len(string_split(code, chr(10)))::BIGINT AS n_lines, len(regexp_extract_all(code, ';'))::BIGINT AS statements, 1 + len(regexp_extract_all(code, '\\b(if|for|while|case|catch)\\b'))::BIGINT AS complexity FROM sources",
)
def code_metrics(spark, sf_dir):
    count = lambda p: F.regexp_count("code", F.lit(p)).cast("long")
    return sources(spark, sf_dir).select("file_id", F.size(F.split("code", "\n")).cast("long").alias("n_lines"), count(";").alias("statements"), (1 + count(r"\b(if|for|while|case|catch)\b")).alias("complexity"))
