"""Queries of taint within files: the documents, and files of code whose facts are known by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import taint as T
from riskloom.plans.registry import register

FILES = [
    ("t1", """public class A {
    public void find(String username, Statement st, int n) {
        String q = "SELECT " + username;
        String r = q;
        st.executeQuery(r);
    }
}"""),
    ("t2", """class B {
    public String show(HttpServletRequest req, String title) {
        Cookie c = req.getCookie();
        String v = c.getValue();
        this.name = v;
        holder.put("k", v);
        String s = holder.put;
        String e = enc.encodeForHTML(v);
        String u = title.trim();
        out.println(e + u);
        return v;
    }
}"""),
    ("t3", """public class C {
    private native int check(String token);
    public void login(String user, int n) {
        boolean ok;
        if (user != null) {
            ok = true;
            audit(n);
        } else if (false) {
            ok = false;
        }
        int r = check(user);
        helper(user, n);
    }
    void helper(String a, int b)
    {
        log(a);
    }
}"""),
    ("t4", """void g(String username) {
switch (n) {
}
if (false) {
}
if (username.isEmpty()) {
x = 1;
}
}"""),
    ("t5", None),
    ("t6", ""),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("code"))
    return docs.unionAll(spark.createDataFrame(FILES, "file_id string, code string"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.facts(files(spark, sf_dir))


def expected(columns: str, rows: str, kinds: dict[str, str] | None = None) -> str:
    """SQL of rows written by hand, a row on each line with | between the values; - is null.  Documents are prose, which has no facts."""
    names, kinds = columns.split(), kinds or {}
    told = [[v.strip() for v in line.split("|")] for line in rows.strip().splitlines()]
    values = ", ".join("(" + ", ".join("NULL" if v == "-" else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in told)
    return f"SELECT {', '.join(f'{n}::{kinds.get(n, "VARCHAR")} AS {n}' for n in names)} FROM (VALUES {values}) v({', '.join(names)})"


LINE = {"line": "INTEGER"}


@register(
    "g01_method_index",
    "SELECT * FROM (VALUES ('t1', 'find', 2, 6), ('t2', 'show', 2, 12), ('t3', 'login', 3, 13), ('t4', 'g', 1, 9)) v(file_id, method, first_line, last_line)",
)
def method_index(spark, sf_dir):
    lines = facts(spark, sf_dir).where("fact = 'method'")
    return lines.groupBy("file_id", F.col("target").alias("method")).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))


@register("g02_taint_sources_by_tier", expected("file_id line source target", """
    t1 | 2 | Heuristic:username | username
    t2 | 2 | Conservative:String | title
    t2 | 3 | Framework:Cookie | c
    t3 | 2 | Heuristic:token | token
    t3 | 3 | Heuristic:user | user
    t4 | 1 | Heuristic:username | username
""", LINE))  # fmt: skip
def taint_sources(spark, sf_dir):
    return facts(spark, sf_dir).where("fact = 'source'").select("file_id", "line", "source", "target")


@register("g03_taint_propagation", expected("file_id kind line source target detail", """
    t1 | concat | 3 | username | q | concat
    t1 | concat | 3 | username | q | inline_concat
    t1 | assign | 4 | q | r | direct
    t2 | method_result | 4 | c | v | c.getValue()
    t2 | assign | 5 | v | name | direct
    t2 | arg | 8 | v | e | v in encodeForHTML()
    t2 | method_result | 9 | title | u | title.trim()
""", LINE))  # fmt: skip
def propagation(spark, sf_dir):
    kept = facts(spark, sf_dir).where(F.col("fact").isin("assign", "concat", "method_result", "arg"))
    return kept.select("file_id", F.col("fact").alias("kind"), "line", "source", "target", "detail")


@register("g04_tainted_fields", expected("file_id line field", """
    t2 | 5 | this.name
    t2 | 6 | holder.put
""", LINE))  # fmt: skip
def tainted_fields(spark, sf_dir):
    return facts(spark, sf_dir).where("fact = 'field'").select("file_id", "line", F.col("target").alias("field"))


@register("g05_sink_flows_in_files", expected("file_id line source sink vuln_type method sanitized", """
    t1 | 5 | r | Sink:executeQuery | SQL_INJECTION | find | false
    t2 | 6 | v | Sink:put | TRUST_BOUNDARY_VIOLATION | show | false
    t2 | 10 | e | Sink:println | XSS | show | true
    t2 | 10 | u | Sink:println | XSS | show | false
""", LINE))  # fmt: skip
def sink_flows(spark, sf_dir):
    e = T.edges(facts(spark, sf_dir)).where("kind = 'sink'")
    return e.select("file_id", "line", "source", F.col("target").alias("sink"), F.col("detail").alias("vuln_type"), "method", F.col("is_sanitized").cast("string").alias("sanitized"))


@register("g06_flow_projection", expected("file_id source target sanitized n", """
    t1 | Heuristic:username | username | false | 1
    t1 | username | q | false | 2
    t1 | q | r | false | 1
    t1 | r | Sink:executeQuery | false | 1
    t2 | Conservative:String | title | false | 1
    t2 | Framework:Cookie | c | false | 1
    t2 | c | v | false | 1
    t2 | v | name | false | 1
    t2 | v | e | true | 1
    t2 | title | u | false | 1
    t2 | v | Sink:put | false | 1
    t2 | e | Sink:println | true | 1
    t2 | u | Sink:println | false | 1
    t3 | Heuristic:token | token | false | 1
    t3 | Heuristic:user | user | false | 1
    t4 | Heuristic:username | username | false | 1
""", {"n": "BIGINT"}))  # fmt: skip
def flow_projection(spark, sf_dir):
    e = T.edges(facts(spark, sf_dir))
    return e.groupBy("file_id", "source", "target", F.col("is_sanitized").cast("string").alias("sanitized")).agg(F.count("*").alias("n"))


@register("g14_graph_nodes", expected("file_id name n_lines role kinds", """
    t1 | Heuristic:username | 1 | source |
    t1 | username | 2 | tainted |
    t1 | q | 2 | tainted |
    t1 | r | 2 | tainted | SQL_INJECTION
    t1 | Sink:executeQuery | 1 | sink | SQL_INJECTION
    t2 | Conservative:String | 1 | source |
    t2 | title | 2 | tainted |
    t2 | Framework:Cookie | 1 | source |
    t2 | c | 2 | tainted |
    t2 | v | 4 | tainted | TRUST_BOUNDARY_VIOLATION
    t2 | name | 1 | tainted |
    t2 | e | 2 | tainted | XSS
    t2 | u | 2 | tainted | XSS
    t2 | Sink:put | 1 | sink | TRUST_BOUNDARY_VIOLATION
    t2 | Sink:println | 1 | sink | XSS
    t3 | Heuristic:token | 1 | source |
    t3 | token | 1 | tainted |
    t3 | Heuristic:user | 1 | source |
    t3 | user | 1 | tainted |
    t4 | Heuristic:username | 1 | source |
    t4 | username | 1 | tainted |
""", {"n_lines": "BIGINT"}))  # fmt: skip
def graph_nodes(spark, sf_dir):
    n = T.nodes(facts(spark, sf_dir))
    return n.select("file_id", "name", "n_lines", F.when(F.col("is_sink"), "sink").when(F.col("is_source"), "source").otherwise("tainted").alias("role"), "kinds")


@register("g15_flows_by_sink", expected("vuln_type n_flows n_sources n_files", """
    SQL_INJECTION | 1 | 1 | 1
    TRUST_BOUNDARY_VIOLATION | 1 | 1 | 1
    XSS | 2 | 2 | 1
""", {"n_flows": "BIGINT", "n_sources": "BIGINT", "n_files": "BIGINT"}))  # fmt: skip
def flows_by_sink(spark, sf_dir):
    kept = facts(spark, sf_dir).where("fact = 'sink'")
    return kept.groupBy(F.col("detail").alias("vuln_type")).agg(F.count("*").alias("n_flows"), F.count_distinct("file_id", "source").alias("n_sources"), F.count_distinct("file_id").alias("n_files"))


@register("g20_implicit_flows", expected("file_id control target", """
    t3 | user | ok
    t3 | user | _control_op_L7
    t3 | user | _control_op_L8
    t4 | username | x
"""))  # fmt: skip
def implicit_flows(spark, sf_dir):
    return facts(spark, sf_dir).where("fact = 'implicit'").select("file_id", F.col("source").alias("control"), "target")


@register("g21_calling_contexts", expected("file_id callee caller", """
    t1 | find | find
    t1 | executeQuery | find
    t2 | show | show
    t2 | getCookie | show
    t2 | getValue | show
    t2 | put | show
    t2 | encodeForHTML | show
    t2 | trim | show
    t2 | println | show
    t3 | login | login
    t3 | audit | login
    t4 | g | g
"""))  # fmt: skip
def calling_contexts(spark, sf_dir):
    return facts(spark, sf_dir).where("fact = 'context'").select("file_id", F.col("target").alias("callee"), F.col("source").alias("caller"))


@register("g22_path_feasibility", expected("file_id line branch known", """
    t3 | 5 | if | always_true
    t4 | 2 | switch | -
    t4 | 4 | if | always_false
    t4 | 6 | if | tainted_variable_in_condition
""", LINE))  # fmt: skip
def path_feasibility(spark, sf_dir):
    return facts(spark, sf_dir).where("fact = 'branch'").select("file_id", "line", F.col("target").alias("branch"), F.col("detail").alias("known"))


@register("g23_native_transfers", expected("file_id line source target direction", """
    t3 | 2 | token | check | java_to_native
    t3 | 11 | check | r | native_to_java
""", LINE))  # fmt: skip
def native_transfers(spark, sf_dir):
    return facts(spark, sf_dir).where("fact = 'native'").select("file_id", "line", "source", "target", F.col("detail").alias("direction"))


@register("g24_tainted_calls", expected("file_id line caller callee arguments", """
    t1 | 2 | find | find | username
    t1 | 5 | find | executeQuery | r
    t2 | 2 | show | show | title
    t2 | 6 | show | put | v
    t2 | 8 | show | encodeForHTML | v
    t2 | 10 | show | println | e,u
    t3 | 3 | login | login | user
    t4 | 1 | g | g | username
""", LINE))  # fmt: skip
def tainted_calls(spark, sf_dir):
    return facts(spark, sf_dir).where("fact = 'call'").select("file_id", "line", F.col("source").alias("caller"), F.col("target").alias("callee"), F.col("detail").alias("arguments"))


_COUNTS = "n_tainted n_sanitized n_fields n_flows n_implicit n_branches n_native n_methods n_open_methods n_alias_pairs"


@register("g25_result_assembly", expected(f"file_id {_COUNTS}", """
    t1 | 3 | 0 | 0 | 5 | 0 | 0 | 0 | 1 | 1 | 3
    t2 | 6 | 1 | 2 | 9 | 0 | 0 | 0 | 1 | 1 | 15
    t3 | 2 | 0 | 0 | 2 | 3 | 1 | 2 | 2 | 1 | 1
    t4 | 1 | 0 | 0 | 1 | 1 | 3 | 0 | 1 | 1 | 0
""", dict.fromkeys(_COUNTS.split(), "BIGINT")))  # fmt: skip
def result_assembly(spark, sf_dir):
    return T.assembled(facts(spark, sf_dir))
