"""Rules and analysis results in YAML, and what the rules find in files of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import flow, rule_flows, syntax
from riskloom.plans import code
from riskloom.plans.registry import register
from riskloom.plans.taint import expected
from riskloom.sources import yamlfiles

RULES = '''---
# what comes in, where it does harm, and how it spreads
sources:
  - kind: call
    method: "<javax.servlet.ServletRequest: java.lang.String getParameter(java.lang.String)>"
    index: result
  - {kind: call, method: "<java.io.Reader: java.lang.String readLine()>", index: result}
sinks:
  - method: "<java.sql.Statement: java.sql.ResultSet executeQuery(java.lang.String)>"
    index: 0
  - method: "<java.io.File: void <init>(java.lang.String)>"
    index: 0
  - method: '<a.Query: void run()>'   # the object itself
    index: base
transfers:
- method: "<java.lang.StringBuilder: java.lang.StringBuilder append(java.lang.String)>"
  from: 0
  to: base
- method: "<java.lang.StringBuilder: java.lang.String toString()>"
  from: base
  to: result
- method: "<java.lang.String: java.lang.String trim()>"
  from: base
  to: result
sanitizers:
  - kind: param
    method: "<org.Encode: java.lang.String clean(java.lang.String)>"
    index: 0
'''
CODE = [
    ("r1", """class A {
    void direct(HttpServletRequest q, Statement st) {
        String id = q.getParameter("id");
        String sql = "SELECT " + id.trim();
        st.executeQuery(sql);
    }
    void built(BufferedReader in, Statement st) {
        StringBuilder b = new StringBuilder();
        b.append("x");
        b.append(in.readLine());
        st.executeQuery(b.toString());
    }
    void cleaned(HttpServletRequest q, Statement st) {
        String id = Encode.clean(q.getParameter("id"));
        st.executeQuery(id);
        new File(id);
    }
    void replaced(HttpServletRequest q, Statement st) {
        String id = q.getParameter("id");
        id = "fixed";
        st.executeQuery(id);
    }
}"""),
    ("r2", """class B {
    void some(HttpServletRequest q, int n) {
        String p = null;
        if (n > 0) {
            p = q.getParameter("p");
        }
        File f = new File("/base/" + p);
        String lost = mangle(q.getParameter("p"));
        new File(lost);
        Query r = (Query) q.getParameter("r");
        r.run();
        new File(q.getParameter("a"), "b");
    }
}"""),
]


def rules(spark: SparkSession) -> DataFrame:
    return yamlfiles.taint_rules(yamlfiles.values(spark.createDataFrame([("rules", RULES)], "file_id string, code string")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.files(spark, sf_dir).where("file_id not like 'c%'").unionAll(spark.createDataFrame(CODE, "file_id string, code string"))


@register("s15_rule_flows", expected("file_id source source_line sink sink_line", """
    r1 | getParameter | 3 | executeQuery | 5
    r1 | readLine | 10 | executeQuery | 11
    r2 | getParameter | 5 | File.<init> | 7
    r2 | getParameter | 10 | run | 11
""", {"source_line": "INTEGER", "sink_line": "INTEGER"}))  # fmt: skip
def rule_flows_(spark, sf_dir):
    """Flows by the rules of a file, over the documents, all pages' scripts and files of code."""
    given = files(spark, sf_dir)
    return rule_flows.flows(syntax.cut(syntax.tree(given)), syntax.cut(flow.flow(given)), rules(spark))


#: A rule file for each supplier: a source, a sink for every unit of its nation's number, and a sanitizer.
_METHOD = "'<p.S' || s_suppkey || ': void '"


@register("s15_rule_tables", f"""SELECT 'f' || s_suppkey AS file_id, 'sources' AS section, 0 AS entry, 'call' AS kind, 'p.S' || s_suppkey AS class, 'get' AS method, 0 AS arity, 'result' AS "index" FROM supplier
    UNION ALL SELECT 'f' || s_suppkey, 'sinks', i::INT, NULL, 'p.S' || s_suppkey, 'put' || i, 2, '1' FROM supplier, range(0, 30) r(i) WHERE i < s_nationkey
    UNION ALL SELECT 'f' || s_suppkey, 'sanitizers', 0, 'param', 'p.S' || s_suppkey, 'clean', 1, '0' FROM supplier""")  # fmt: skip
def rule_tables(spark, sf_dir):
    """Rule files made of the suppliers, read as a table of rules."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("k", F.col("s_suppkey").cast("string"))
    method = lambda rest: F.concat(F.lit('"<p.S'), F.col("k"), F.lit(": void "), rest, F.lit('>"'))
    sinks = F.transform(F.sequence(F.lit(0), F.col("s_nationkey") - 1), lambda i: F.concat(F.lit("\n- method: "), method(F.concat(F.lit("put"), i.cast("string"), F.lit("(int,int)"))), F.lit("\n  index: 1")))
    text = F.concat(F.lit("sources:\n  - kind: call\n    method: "), method(F.lit("get()")), F.lit("\n    index: result\nsinks:"), F.when(F.col("s_nationkey") > 0, F.array_join(sinks, "")).otherwise(" []"), F.lit("\nsanitizers:\n  - kind: 'param'  # one\n    index: 0\n    method: "), method(F.lit("clean(int)")), F.lit("\n"))
    return yamlfiles.taint_rules(yamlfiles.values(s.select(F.concat(F.lit("f"), "k").alias("file_id"), text.alias("code")))).drop("from", "to")


@register("s14_points_to_statistics", "SELECT 'u' || o_custkey AS file_id, count(*) FILTER (o_orderstatus <> 'P') AS pointers, count(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'P') AS sites FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus <> 'P') > 0")
def points_to_statistics(spark, sf_dir):
    """An analysis result for each customer: an entry for each order, of which the pending ones point nowhere."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    site = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("- allocation: "), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("- obj: {alloc: "), F.col("o_orderpriority"), F.lit(", line: 3}")))
    entry = F.concat(F.lit("\n  - pointer: o"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "\n    pointsTo: []").otherwise(F.concat(F.lit("\n    pointsTo:\n      "), site)))
    text = o.select("o_custkey", entry.alias("e")).groupBy("o_custkey").agg(F.concat(F.lit("result:\n  pointsTo:"), F.array_join(F.transform(F.collect_list("e"), lambda x: F.replace(x, F.lit("\n"), F.lit("\n  "))), ""), F.lit("\n")).alias("code"))
    return yamlfiles.points_to_statistics(yamlfiles.values(text.select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("file_id"), "code")))
