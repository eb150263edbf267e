"""Rules over source lines: framework sinks, sanitizers, their placement, taint sources and label maps.

A rule table is unrolled into one array expression over a line, behind one combined test, so lines
that match nothing cost one regular expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Framework sinks: name, framework, vulnerability, patterns, safe, unsafe, safe by default.
# A safe pattern that only restates the default is left out: what is safe by default stays so.
SINKS = [
    ("Model.addAttribute", "spring_mvc", "xss", [r"\.addAttribute\s*\("], [], [], False),
    ("ModelAndView.addObject", "spring_mvc", "xss", [r"ModelAndView\s*\(", r"\.addObject\s*\("], [], [], False),
    ("RedirectView.setUrl", "spring_mvc", "http_response_splitting", [r"RedirectView\s*\(", r"\.setUrl\s*\("], [], [], False),
    ("JdbcTemplate.queryForObject", "spring_mvc", "sql_injection", [r"jdbcTemplate\.queryForObject\s*\(", r"jdbcTemplate\.update\s*\(", r"jdbcTemplate\.batchUpdate\s*\("], [], [], False),
    ("SecurityContextHolder.getContext", "spring_security", "xss", [r"SecurityContextHolder\.getContext\s*\("], [], [], False),
    ("JSP c:out", "jsp", "xss", [r"<c:out\b"], [r'escapeXml\s*=\s*"?true"?'], [r'escapeXml\s*=\s*"?false"?'], True),
    ("JSP EL output", "jsp", "xss", [r"\$\{param\.", r"\$\{requestScope\."], [], [], False),
    ("ELProcessor.eval", "jsp", "el_injection", [r"ELProcessor\s*\(", r"\.eval\s*\(", r"ExpressionFactory\.createValueExpression\s*\(", r"ExpressionFactory\.createMethodExpression\s*\("], [], [], False),
    ("JSF h:outputText", "jsf", "xss", [r"<h:outputText\b"], [r'escape\s*=\s*"?true"?'], [r'escape\s*=\s*"?false"?'], True),
    ("Thymeleaf th:text/th:utext", "thymeleaf", "xss", [r"th:text\s*=", r"th:utext\s*="], [r"th:text\s*="], [r"th:utext\s*="], True),
    ("FreeMarker Template.process", "freemarker", "xss", [r"\.process\s*\(", r"getTemplate\s*\("], [], [], False),
    ("VelocityEngine.evaluate/mergeTemplate", "velocity", "xss", [r"Velocity\.evaluate\s*\(", r"mergeTemplate\s*\(", r"velocityEngine\.evaluate\s*\("], [r"#escape\b", r"EscapeTool"], [], False),
]
# Fixed values. Sanitizers: name, patterns (case ignored), keywords (case kept), effectiveness.
SANITIZERS = [
    ("HTML Entity Escaping", [r"stringescapeutils\.escapehtml4\s*\(", r"stringescapeutils\.escapehtml5\s*\(", r"htmlutils\.htmlescape\s*\(", r"encode\.forhtml\s*\(", r"encode\.forhtmlattribute\s*\(", r"esapi\.encoder\(\)\.encodeforhtml"], ["escapeHtml4", "escapeHtml5", "htmlEscape", "Encode.forHtml", "Encode.forHtmlAttribute"], 0.92),
    ("HTML Sanitization (Allowlist)", [r"jsoup\.clean\s*\(", r"policyfactory\.sanitize\s*\("], ["Jsoup.clean", "PolicyFactory.sanitize"], 0.94),
    ("URL Encoding", [r"urlencoder\.encode\s*\(", r"encode\.foruri\s*\(", r"encode\.foruricomponent\s*\("], ["URLEncoder.encode", "Encode.forUri", "Encode.forUriComponent"], 0.88),
    ("SQL Parameterization", [r"\.setstring\s*\(", r"\.setint\s*\(", r"\.setlong\s*\(", r"\.setobject\s*\(", r"\.setboolean\s*\(", r"\.setdouble\s*\(", r"\.setfloat\s*\(", r"\.setshort\s*\(", r"\.setbigdecimal\s*\(", r"\.settimestamp\s*\(", r"\.setparameter\s*\(", r"namedparameterjdbctemplate"], ["setString", "setInt", "setLong", "setObject", "setBoolean", "setDouble", "setFloat", "setShort", "setBigDecimal", "setTimestamp", "setParameter"], 0.95),
    ("Path Normalization", [r"getcanonicalpath\s*\(", r"getcanonicalfile\s*\(", r"torealpath\s*\(", r"\.normalize\s*\("], ["getCanonicalPath", "getCanonicalFile", "toRealPath", "normalize"], 0.93),
    ("LDAP Escaping", [r"ldapencoder\.encodefilter\s*\(", r"rdn\.escapevalue\s*\(", r"escapeldapsearchfilter\s*\("], ["LdapEncoder.encodeFilter", "Rdn.escapeValue", "escapeLdapSearchFilter"], 0.88),
    ("XXE Hardening", [r"xmlconstants\.feature_secure_processing", r"disallow-doctype-decl", r"external-general-entities", r"external-parameter-entities", r"setxincludeaware\s*\(\s*false", r"setexpandentityreferences\s*\(\s*false"], ["FEATURE_SECURE_PROCESSING", "disallow-doctype-decl"], 0.90),
    ("Command Argument List", [r"new\s+processbuilder\s*\(", r"\.command\s*\(", r"list\.of\s*\(", r"arrays\.aslist\s*\("], ["ProcessBuilder", ".command(", "List.of", "Arrays.asList"], 0.82),
    ("Input Validation", [r"\.matches\s*\(", r"\.startswith\s*\(", r"\.endswith\s*\(", r"\.contains\s*\("], ["matches(", "startsWith", "endsWith", "contains("], 0.70),
]
# What marks a line with a sink, in lower case.
SINK_MARKERS = ("executequery", "executeupdate", "println", "sendredirect", "getruntime().exec", "lookup(", "search(")
# Types whose variables are tainted, and names that tell a parameter from outside; taint reads them too.
FRAMEWORK_TYPES = ("HttpServletRequest", "ServletRequest", "HttpSession", "HttpServletResponse", "ObjectInputStream", "BufferedReader", "Scanner", "InputStream", "Reader", "MultipartFile", "Cookie", "Principal", "Authentication", "WebRequest")
PARAMETER_NAMES = (
    "username", "password", "userInput", "input", "data", "action", "cmd", "command", "query", "search", "id", "userId", "user", "email", "name", "path", "file", "filename", "url", "uri",
    "request", "response", "param", "parameter", "value", "val", "content", "message", "text", "error", "exception", "className", "class", "method", "methodName", "field", "fieldName", "key",
    "token", "session", "cookie", "redirect", "forward", "include", "xpath", "sql", "ldap", "serialized", "object", "bean", "entity",
)
# How severe each kind of finding is.
SEVERITY = {
    "null_pointer_dereference": 100, "buffer_overflow": 95, "integer_overflow": 92, "sql_injection": 90, "command_injection": 90, "deserialization": 85, "xxe": 85, "ssrf": 84, "el_injection": 83,
    "http_response_splitting": 82, "reflection_injection": 80, "session_fixation": 78, "resource_leak": 76, "ldap_injection": 75, "xpath_injection": 74, "race_condition": 72, "xss": 70,
    "path_traversal": 70, "weak_crypto": 60, "insecure_randomness": 55, "hardcoded_credentials": 50, "trust_boundary_violation": 45, "csrf": 40, "log_injection": 30,
}


def numbered_lines(sources: DataFrame, code: str = "code") -> DataFrame:
    """(file_id, line, text): lines from 1; a last newline gives an empty last line."""
    return sources.select("file_id", F.posexplode(F.split(code, "\n")).alias("pos", "text")).select("file_id", (F.col("pos") + 1).alias("line"), "text")


def _any(text: Column, patterns: list[str], flag: str = "") -> Column:
    return reduce(Column.__or__, (text.rlike(flag + p) for p in patterns), F.lit(False))


def framework_sinks(lines: DataFrame) -> DataFrame:
    """(file_id, line, sink, vuln_type, is_safe, confidence): is_safe is null where nothing tells."""
    t = F.col("text")
    found = []
    for name, framework, vuln, patterns, safe, unsafe, default in SINKS:
        told = F.when(_any(t, unsafe), False).when(_any(t, safe), True).otherwise(F.lit(True) if default else F.lit(None).cast("boolean"))
        row = F.struct(F.lit(name).alias("sink"), F.lit(framework).alias("framework"), F.lit(vuln).alias("vuln_type"), told.alias("is_safe"))
        found.append(F.when(_any(t, patterns), row))
    some = "|".join(p for s in SINKS for p in s[3])
    out = lines.where(t.rlike(some)).select("file_id", "line", F.explode(F.array_compact(F.array(*found))).alias("m")).select("file_id", "line", "m.*")
    return out.withColumn("confidence", F.when(F.col("is_safe").isNotNull(), 0.75).otherwise(0.65))


def sanitizers(lines: DataFrame) -> DataFrame:
    """(file_id, line, sanitizer, effectiveness)."""
    t = F.col("text")
    hits = []
    for name, patterns, words, effect in SANITIZERS:
        hit = reduce(Column.__or__, (t.contains(F.lit(w)) for w in words)) | _any(t, ["|".join(patterns)], "(?i)")
        hits.append(F.when(hit, F.struct(F.lit(name).alias("sanitizer"), F.lit(effect).alias("effectiveness"))))
    return lines.select("file_id", "line", F.explode(F.array_compact(F.array(*hits))).alias("m")).select("file_id", "line", "m.*")


def placement(lines: DataFrame) -> DataFrame:
    """(file_id, first_sink, first_sanitizer, risk): LOW if a sanitizer stands before the first sink."""
    low = F.lower("text")
    sink = reduce(Column.__or__, (low.contains(F.lit(m)) for m in SINK_MARKERS))
    first = lines.where(sink).groupBy("file_id").agg(F.min("line").alias("first_sink"))
    guard = sanitizers(lines).groupBy("file_id").agg(F.min("line").alias("first_sanitizer"))
    out = lines.select("file_id").distinct().join(first, "file_id", "left").join(guard, "file_id", "left")
    return out.withColumn("risk", F.when(F.col("first_sink").isNull(), "UNKNOWN").when(F.col("first_sanitizer") < F.col("first_sink"), "LOW").otherwise("HIGH"))


def taint_sources(lines: DataFrame) -> DataFrame:
    """(file_id, line, variable, reason): declared framework types, and parameters with a telling name."""
    declared = F.regexp_extract_all("text", F.lit(r"\b(\w+)\s+\w+\s*[;=]"), F.lit(1))
    names = F.regexp_extract_all("text", F.lit(r"\b\w+\s+(\w+)\s*[;=]"), F.lit(1))
    pairs = lines.select("file_id", "line", F.explode(F.arrays_zip(declared.alias("kind"), names.alias("variable"))).alias("p"))
    first = pairs.where(reduce(Column.__or__, (F.col("p.kind").contains(k) for k in FRAMEWORK_TYPES))).select("file_id", "line", F.col("p.variable").alias("variable"), F.lit("framework").alias("reason"))
    inner = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda s: F.split(s, ",")))
    words = lines.select("file_id", "line", F.explode(inner).alias("p")).select("file_id", "line", F.filter(F.split("p", r"\s+"), lambda x: x != "").alias("w"))
    second = words.where(F.size("w") >= 2).select("file_id", "line", F.element_at("w", -1).alias("variable"), F.lit("heuristic").alias("reason")).where(F.col("variable").isin(*PARAMETER_NAMES))
    return first.unionAll(second).distinct()


def primary(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, vuln_type): of each file the severest finding, the first in the bank's order on ties."""
    score = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("vuln_type"))
    code = F.col("code")
    boost = F.when(code.contains("getProfile().get") | code.contains(").get"), 20).when(code.contains(".get(") & code.contains(".length()"), 10).otherwise(0)
    rows = findings.join(sources.select("file_id", boost.alias("boost")), "file_id")
    full = score + F.when(F.col("vuln_type") == "null_pointer_dereference", F.col("boost")).otherwise(0)
    return rows.groupBy("file_id").agg(F.max_by("vuln_type", F.struct(full, -F.col("pos"))).alias("vuln_type"), F.max(full).alias("score"))
