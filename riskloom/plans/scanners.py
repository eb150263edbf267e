"""Queries of the whole-file scans; what is found in files of code is known by hand, in documents by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.rules import quoted
from riskloom.operators import scanners as C
from riskloom.operators.lines import numbered_lines
from riskloom.plans.registry import register
from riskloom.plans.taint import LINE, expected

FILES = [
    ("c1", 'String q = "a";\nst.executeQuery("SELECT " + q + "x");\nString password = "p";\nMessageDigest.getInstance("MD5");\nRuntime.getRuntime().exec(c);\nnew File("../x");'),
    ("c2", 'String query = "SELECT a" +\n  id;\nst.executeQuery(query);\nPreparedStatement p = c;\nresponse.addHeader ("A", b);\nresponse.sendRedirect(u);'),
    ("c3", "ObjectInputStream in = s();\nin.readObject();\nClass.forName(n);\nDirContext d = e();\nd.search(f);\nDocumentBuilderFactory f = g();\nScriptEngine e;\ne.eval(x);"),
    ("c4", '<%@ page %>\n<c:out value="a"/>\n<c:out value="b" escapeXml="false"/>\n<p th:text="${a}" th:utext="${b}"/>'),
    ("c5", 'VelocityEngine v;\nv.mergeTemplate(t);\n#escape($x) ${y} ${z}\ncfg.setOutputFormat(PlainTextOutputFormat.I);\nfreemarker'),
    ("c6", 'List a; Map b; Set c; List d; List e; List f; List g; List h; List i; List j; HashMap k;\nfor (;;) while (x) { Class.forName(y); }\na = "x" + "y";'),
    ("c7", None),
]
SQL_DOCS = "docs AS (SELECT 'd' || doc_id::VARCHAR AS file_id, text AS code FROM documents), parts AS (SELECT file_id, string_split(code, chr(10)) AS p FROM docs), lines AS (SELECT file_id, unnest(range(1, len(p) + 1))::INTEGER AS line, unnest(p) AS text FROM parts)"
SURE = {**LINE, "confidence": "DOUBLE"}


def files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("code"))
    return docs.unionAll(spark.createDataFrame(FILES, "file_id string, code string"))


@register("p30_line_scan", f"""WITH {SQL_DOCS} {expected("file_id vuln_type cwe line confidence", '''
    c1 | SQL_INJECTION | CWE-89 | 2 | 0.82
    c1 | HARDCODED_PASSWORD | CWE-798 | 3 | 0.92
    c1 | WEAK_CRYPTO | CWE-327 | 4 | 0.95
    c1 | COMMAND_INJECTION | CWE-78 | 5 | 0.88
    c1 | PATH_TRAVERSAL | CWE-22 | 6 | 0.75
    c2 | HTTP_RESPONSE_SPLITTING | CWE-113 | 5 | 0.8
    c2 | URL_REDIRECT | CWE-601 | 6 | 0.78
    c3 | DESERIALIZATION | CWE-502 | 2 | 0.86
    c3 | REFLECTION_INJECTION | CWE-470 | 3 | 0.82
    c3 | EL_INJECTION | CWE-94 | 7 | 0.8
    c3 | EL_INJECTION | CWE-94 | 8 | 0.8
    c6 | REFLECTION_INJECTION | CWE-470 | 2 | 0.82
''', SURE)}
    UNION ALL SELECT file_id, 'WEAK_CRYPTO', 'CWE-327', line, 0.95 FROM lines WHERE contains(text, 'MD5') OR contains(text, 'SHA1') OR contains(text, 'DES')
    UNION ALL SELECT file_id, 'HARDCODED_PASSWORD', 'CWE-798', line, 0.92 FROM lines WHERE regexp_matches(text, '(password|secret|api_key)\\s*=\\s*(["'']).*["'']')""")  # fmt: skip
def line_scan(spark, sf_dir):
    return C.line_findings(numbered_lines(files(spark, sf_dir)))


@register("p31_semantic_scan", expected("file_id vuln_type cwe line confidence", """
    c1 | WEAK_CRYPTO | CWE-327 | 4 | 0.95
    c1 | COMMAND_INJECTION | CWE-78 | 5 | 0.88
    c2 | SQL_INJECTION | CWE-89 | 1 | 0.86
    c2 | SQL_INJECTION | CWE-89 | 0 | 0.85
    c2 | URL_REDIRECT | CWE-601 | 6 | 0.78
    c3 | LDAP_INJECTION | CWE-90 | 5 | 0.82
    c3 | REFLECTION_INJECTION | CWE-470 | 3 | 0.82
    c3 | DESERIALIZATION | CWE-502 | 2 | 0.86
    c3 | EL_INJECTION | CWE-94 | 8 | 0.8
    c6 | REFLECTION_INJECTION | CWE-470 | 2 | 0.82
""", SURE))  # fmt: skip
def semantic_scan(spark, sf_dir):
    return C.file_findings(files(spark, sf_dir))


@register("j06_template_engines", expected("file_id engine mode safe unsafe score", """
    c4 | JSP | enabled | 1 | 1 | 0.745
    c4 | Thymeleaf | enabled | 1 | 1 | 0.745
    c5 | FreeMarker | disabled | 0 | 2 | 0.21
    c5 | Velocity | disabled | 1 | 2 | 0.31
""", {"safe": "INTEGER", "unsafe": "INTEGER", "score": "DOUBLE"}))  # fmt: skip
def template_engines(spark, sf_dir):
    return C.template_engines(files(spark, sf_dir)).withColumn("score", F.round("score", 9))


@register("p29_precision_diagnosis", f"""WITH {SQL_DOCS}, n AS (SELECT file_id, len(regexp_extract_all(code, '".*"\\s*\\+')) AS a, len(regexp_extract_all(code, '\\b(?:List|Map|Set|ArrayList|HashMap)\\b')) AS b, len(regexp_extract_all(code, '\\b(?:for|while)\\b')) AS l FROM docs)
    {expected("file_id string_concat collection_ops reflection_calls loops advice", f'''
    c1 | 1 | 0 | 0 | 0 | {C.ADVICE[3]}
    c2 | 1 | 0 | 0 | 0 | {C.ADVICE[3]}
    c3 | 0 | 0 | 1 | 0 | {C.ADVICE[2]}
    c4 | 0 | 0 | 0 | 0 | {C.ADVICE[3]}
    c5 | 0 | 0 | 0 | 0 | {C.ADVICE[3]}
    c6 | 1 | 11 | 1 | 2 | {C.ADVICE[1]} {C.ADVICE[2]}
    c7 | - | - | - | - | {C.ADVICE[3]}
''', dict.fromkeys(("string_concat", "collection_ops", "reflection_calls", "loops"), "BIGINT"))}
    UNION ALL SELECT file_id, a, b, CASE WHEN a IS NOT NULL THEN 0 END, l, CASE WHEN a > 5 AND b > 10 THEN '{C.ADVICE[0]} {C.ADVICE[1]}' WHEN a > 5 THEN '{C.ADVICE[0]}' WHEN b > 10 THEN '{C.ADVICE[1]}' ELSE '{C.ADVICE[3]}' END FROM n""")  # fmt: skip
def precision_diagnosis(spark, sf_dir):
    out = C.precision_diagnosis(files(spark, sf_dir))
    return out.select("file_id", *[F.col(c).cast("long").alias(c) for c in ("string_concat", "collection_ops", "reflection_calls", "loops")], "advice")


_MARKS = ", ".join(f"({quoted(k)}, {quoted(w)})" for k, ws in C.MARKERS.items() for w in ws)


@register("j07_evidence_markers", f"""WITH {SQL_DOCS}, m(marks, word) AS (VALUES {_MARKS}) {expected("file_id marks hits", '''
    c1 | weak_crypto | 1
    c1 | sink:sql_injection | 1
    c1 | sink:command_injection | 1
    c1 | sink:path_traversal | 1
    c2 | sanitizer | 1
    c2 | guard:sql_injection | 1
    c2 | sink:sql_injection | 1
    c2 | sink:http_response_splitting | 1
    c3 | sink:deserialization | 2
    c3 | sink:reflection_injection | 1
    c3 | sink:ldap_injection | 2
    c3 | sink:xxe | 2
    c6 | sink:reflection_injection | 1
''', {"hits": "BIGINT"})} UNION ALL SELECT file_id, marks, count(*) FROM docs JOIN m ON contains(lower(code), word) GROUP BY file_id, marks""")  # fmt: skip
def evidence_markers(spark, sf_dir):
    return C.marker_counts(files(spark, sf_dir)).withColumn("hits", F.col("hits").cast("long"))
