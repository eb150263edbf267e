"""Queries of the records of other tools.  Where a text form is parsed, its lines stand beside the documents' lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rules import quoted
from riskloom.operators import records as R
from riskloom.operators.evidence import GATES, gate_table
from riskloom.operators.lines import numbered_lines, sanitizers
from riskloom.plans.linewise import _SANITIZERS, SQL_LINES, all_lines
from riskloom.plans.registry import register
from riskloom.plans.scanners import SQL_DOCS
from riskloom.plans.taint import LINE, expected


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files of other tools, beside the documents.
TEXTS = [
    ("results.csv", "# test name, category, real vulnerability, cwe\nT1, SQLi ,TRUE,89\n\nT2,xss,false,79\nshort,row\n  # c,d,e,f"),
    ("profile.txt", "Results\n1. parse - 1.5s (30%)\n 2. points to set - 3.25s (65.5%)\nnoise 3. x"),
    ("points.txt", "'<A: void f()>':\n  - var: \"x\"\n    - \"o1\"\n    - \"o2\"\n  - var: y\n<B: int g(int)>:\n    - \"o9\"\n  - var: x\n    - \"o3\""),
    ("fix.patch", "--- a/F.java\n+++ b/F.java\n@@ -1 +1 @@\n-old\n+new\n+more\n same"),
    ("M.java", "public class M {\n  public M(int a) { }\n  public static void main(String[] a) { }\n  public static int f(final String a, int b) { return 0; } public void run() { }\n  private int g(int x) { return x; }\n}"),
]


def texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("code"))
    return numbered_lines(docs.unionAll(spark.createDataFrame(TEXTS, "file_id string, code string")))


def of(lines: DataFrame, name: str) -> DataFrame:
    """The lines of one file."""
    return lines.where(F.col("file_id") == name)


@register("s05_expected_results", expected("test category vulnerable cwe", """
    T1 | sqli | true | 89
    T2 | xss | false | 79
"""))  # fmt: skip
def expected_results(spark, sf_dir):
    return R.expected_results(of(texts(spark, sf_dir), "results.csv")).select("test", "category", F.col("vulnerable").cast("string").alias("vulnerable"), "cwe")


@register("s18_profiler_lines", expected("file_id place name seconds percent", """
    profile.txt | 1 | parse | 1.5 | 30
    profile.txt | 2 | points to set | 3.25 | 65.5
""", {"place": "INTEGER", "seconds": "DOUBLE", "percent": "DOUBLE"}))  # fmt: skip
def profiler_lines(spark, sf_dir):
    return R.profile(texts(spark, sf_dir))


@register("s17_points_to_sets", expected("file_id method variable objects", """
    points.txt | <A: void f()> | x | o1,o2
    points.txt | <A: void f()> | y |
    points.txt | <B: int g(int)> | x | o3
"""))  # fmt: skip
def points_to_sets(spark, sf_dir):
    return R.points_to(texts(spark, sf_dir)).withColumn("objects", F.array_join("objects", ","))


@register("x02_patch_lines", f"""WITH {SQL_DOCS} SELECT 'fix.patch' AS file_id, 2::BIGINT AS added, 1::BIGINT AS removed, 3::BIGINT AS changed
    UNION ALL SELECT file_id, a, r, a + r FROM (SELECT file_id, sum((text LIKE '+%' AND text NOT LIKE '+++%')::INT)::BIGINT AS a, sum((text LIKE '-%' AND text NOT LIKE '---%')::INT)::BIGINT AS r FROM lines GROUP BY file_id) WHERE a + r > 0""")  # fmt: skip
def patch_lines(spark, sf_dir):
    return R.diff_lines(texts(spark, sf_dir)).where("changed > 0")


@register("x14_public_methods", expected("file_id line name is_static types", """
    M.java | 4 | f | true | String,int
    M.java | 4 | run | false |
""", LINE))  # fmt: skip
def public_methods(spark, sf_dir):
    return R.public_methods(texts(spark, sf_dir)).withColumn("is_static", F.col("is_static").cast("string"))


URLS = ["https://h/r/commit/0a1b2c3d4e", "https://h/r/compare/aaaaaaa..BBBBBBB/", "https://h/r/commit/xyz1234", "abc12", "", None]


@register("j11_commit_hash", f"""WITH u AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f"({quoted(u)})" if u is not None else '(NULL)' for u in URLS)}) v(url))
    SELECT url, nullif(regexp_extract(rtrim(trim(url), '/'), '(?:^|/|[.][.])([0-9a-fA-F]{{7,40}})$', 1), '') AS commit_hash FROM u""")  # fmt: skip
def commit_hash(spark, sf_dir):
    urls = _table(spark, sf_dir, "pages").select("url").unionAll(spark.createDataFrame([(u,) for u in URLS], "url string"))
    return urls.select("url", R.commit_hash(F.col("url")).alias("commit_hash"))


@register("p33_file_eligibility", """SELECT page_id, regexp_matches(lower(f), '[.](java|py|js|ts|cpp|c|cs)$') AND NOT regexp_matches(f, '(^|/)[.][^/]') AND NOT regexp_matches('/' || f || '/', '/(node_modules|__pycache__|build|target|dist)/') AS eligible
    FROM (SELECT page_id, replace(url, 'http://', '') || CASE page_id % 5 WHEN 0 THEN '.java' WHEN 1 THEN '/.git/x.py' WHEN 2 THEN '/build/y.JS' WHEN 3 THEN '/A.Java' ELSE '.txt' END AS f FROM pages)""")  # fmt: skip
def file_eligibility(spark, sf_dir):
    endings = F.element_at(F.array(*map(F.lit, (".java", "/.git/x.py", "/build/y.JS", "/A.Java", ".txt"))), (1 + F.col("page_id") % 5).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", R.eligible(F.concat(F.replace("url", F.lit("http://"), F.lit("")), endings)).alias("eligible"))


SQL_LIKE = [("p1", 'checkPermission(u); deleteUser(u); updateAll(v);'), ("p2", 'hasRole(r); delete(x); "SELECT a FROM t WHERE b=" + c')]


@register("p27_security_properties", f"""WITH {SQL_DOCS}, c AS (SELECT * FROM docs UNION ALL SELECT * FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in SQL_LIKE)}) v(file_id, code))
    SELECT file_id, len(regexp_extract_all(code, '(?i)(?:checkPermission|hasRole|isAuthorized|authenticate)\\s*\\(')) < len(regexp_extract_all(code, '(?i)(?:delete|update|transfer|admin)\\w*\\s*\\(')) AS unguarded,
    regexp_matches(code, '(?i)"\\s*(select|insert|update|delete)\\b[^"]*"\\s*\\+') AS concatenated FROM c""")  # fmt: skip
def security_properties(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("code")).unionAll(spark.createDataFrame(SQL_LIKE, "file_id string, code string"))
    unguarded, concatenated = R.security_properties(F.col("code"))
    return docs.select("file_id", unguarded.alias("unguarded"), concatenated.alias("concatenated"))


@register("s06_labelled_tree", """SELECT path, label, type FROM (SELECT 'CWE' || (ARRAY[89, 79, 22, 1])[1 + (c_custkey % 4)::INT] || '/T' || c_custkey || (ARRAY['_bad.java', '_good_BAD.java', '_goodG2B.java', '_bad_base.java', '.java'])[1 + (c_custkey % 5)::INT] AS path,
    CASE WHEN c_custkey % 5 < 2 THEN 1 WHEN c_custkey % 5 = 2 THEN 0 END AS label, CASE c_custkey % 4 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' WHEN 2 THEN 'path_traversal' END AS type FROM customer) WHERE label IS NOT NULL AND type IS NOT NULL""")  # fmt: skip
def labelled_tree(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (1 + i).cast("int"))
    path = F.concat(F.lit("CWE"), pick(("89", "79", "22", "1"), k % 4), F.lit("/T"), k.cast("string"), pick(("_bad.java", "_good_BAD.java", "_goodG2B.java", "_bad_base.java", ".java"), k % 5))
    types = spark.createDataFrame([("89", "sql_injection"), ("79", "xss"), ("22", "path_traversal")], "cwe string, type string")
    return R.labelled(_table(spark, sf_dir, "customer").select(path.alias("path")), "path", types)


@register("s08_graph_summary", "SELECT o_custkey AS file, count(*) AS calls, count(DISTINCT o_orderpriority) AS methods, CASE WHEN bool_or(o_orderstatus = 'P') THEN count(*) FILTER (o_orderstatus = 'P') ELSE count(*) + 2 * count(DISTINCT o_orderpriority) END AS edges FROM orders GROUP BY o_custkey")
def graph_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "file")
    return R.graph_summary(rows, "file", calls=F.count("*"), methods=F.count_distinct("o_orderpriority"), edges=F.count_if(F.col("o_orderstatus") == "P"))


@register("s10_first_metric", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN max(value) FILTER (event_type = 'signup') WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN max(value) FILTER (event_type = 'purchase') ELSE count(*)::DOUBLE END AS edges FROM events GROUP BY user_id")
def first_metric(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("signup", "purchase")], F.collect_list("event_id").alias("list"))
    return rows.select("user_id", R.precedence(F.col("signup"), F.col("purchase"), F.size("list").cast("double")).alias("edges"))


@register("s11_prediction_source", """SELECT subgroup, toxic AS label, prediction, count(*) AS n FROM (SELECT l.toxic, CASE WHEN d.doc_id % 3 = 0 THEN 1 WHEN l.quality >= 0.5 THEN 1 ELSE 0 END AS prediction,
    CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars >= 2000 THEN 'large' WHEN n_chars >= 500 THEN 'medium' ELSE 'small' END AS subgroup FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL) GROUP BY ALL""")  # fmt: skip
def prediction_source(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    told = rows.select(F.col("toxic").alias("label"), F.col("quality").alias("confidence"), F.when(F.col("doc_id") % 3 == 0, 1).alias("prediction"), (F.col("n_chars") / 10).alias("nodes"))
    return R.prediction_rows(told).groupBy("subgroup", F.col("label").cast("long").alias("label"), "prediction").agg(F.count("*").alias("n"))


@register("s16_heap_rows", "SELECT class, count(*) AS rows, sum(n)::BIGINT AS instances FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS class, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (p_retailprice * 100)::BIGINT // 100 END AS n FROM part) GROUP BY class")
def heap_rows(spark, sf_dir):
    whole = F.format_number(F.floor(F.col("p_retailprice")).cast("long"), 0)  # with commas
    p = _table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("class_name"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "bad").otherwise(whole).alias("count_text"))
    return R.heap_rows(p, ["class_name", "name"], ["count_text"]).groupBy("class").agg(F.count("*").alias("rows"), F.sum("n").alias("instances"))


@register("s22_effectiveness_pairs", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'sql' ELSE 'xss' END AS sink, p_brand || CASE WHEN p_partkey % 3 = 1 THEN '::x' ELSE '' END AS sanitizer, (p_size / 100)::DOUBLE AS effectiveness FROM part WHERE p_partkey % 5 > 1")
def effectiveness_pairs(spark, sf_dir):
    k = F.col("p_partkey")
    key = F.concat(F.when(k % 2 == 0, "sql").otherwise("xss"), F.when(k % 5 == 0, ":").otherwise("::"), "p_brand", F.when(k % 3 == 1, F.when(k % 5 == 0, "").otherwise("::x")).otherwise(""))
    return R.effectiveness(_table(spark, sf_dir, "part").select(key.alias("key"), F.when(k % 5 == 1, "no").otherwise((F.col("p_size") / 100).cast("string")).alias("value")))


@register("j05_sanitizer_suitability", f"""WITH {SQL_LINES}, g AS ({_SANITIZERS}), n AS (SELECT DISTINCT file_id, sanitizer FROM g), k AS (SELECT file_id, sink, bool_or(CASE sink WHEN 'sql_injection' THEN sanitizer = 'SQL Parameterization' ELSE sanitizer IN ('HTML Entity Escaping', 'HTML Sanitization (Allowlist)') END) AS req,
    bool_or(sanitizer = 'Input Validation') AS acc, bool_or(CASE sink WHEN 'sql_injection' THEN sanitizer IN ('HTML Entity Escaping', 'URL Encoding') ELSE sanitizer IN ('SQL Parameterization', 'Path Normalization') END) AS bad FROM n, (VALUES ('sql_injection'), ('xss')) s(sink) GROUP BY file_id, sink)
    SELECT file_id, sink, round(greatest(0, CASE WHEN req THEN 0.95 WHEN acc THEN 0.6 ELSE 0 END - CASE WHEN bad THEN 0.3 ELSE 0 END), 9)::DOUBLE AS suitability FROM k""")  # fmt: skip
def sanitizer_suitability(spark, sf_dir):
    found = sanitizers(all_lines(spark, sf_dir)).groupBy("file_id").agg(F.collect_set("sanitizer").alias("sanitizers"))
    asked = found.select(F.explode(F.array(F.lit("sql_injection"), F.lit("xss"))).alias("sink"), "file_id", "sanitizers").withColumn("id", F.struct("file_id", "sink"))
    rules = spark.createDataFrame(R.SUITABLE, "sink string, kind string, names array<string>")
    return R.suitability(asked, rules).select("id.file_id", "id.sink", F.round("suitability", 9).alias("suitability"))


@register("j08_method_pairs", "SELECT a.conv_id, a.turn AS sink, (SELECT min(u.turn) FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user') AS source FROM conversations a WHERE a.role = 'assistant' AND EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user')")
def method_pairs(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return R.method_pairs(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", "turn")


#: Fixed: categories of a benchmark and what they are findings of.
CATEGORIES = {"error": "sql_injection", "view": "xss", "purchase": "path_traversal"}


@register("j09_category_mapping", "SELECT CASE event_type WHEN 'error' THEN 'sql_injection' WHEN 'view' THEN 'xss' ELSE 'path_traversal' END AS vuln_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view', 'purchase') GROUP BY 1")
def category_mapping(spark, sf_dir):
    kinds = F.broadcast(spark.createDataFrame(list(CATEGORIES.items()), "event_type string, vuln_type string"))  # a row for each category
    return _table(spark, sf_dir, "events").join(kinds, "event_type").groupBy("vuln_type").agg(F.count("*").alias("n"))


@register("j10_precedence_mapping", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'sql_injection' WHEN c_nationkey = 1 THEN 'xss' WHEN c_nationkey = 2 THEN 'xxe' WHEN right(c_name, 1) = '7' THEN 'csrf' END AS vuln_type FROM customer")
def precedence_mapping(spark, sf_dir):
    weaknesses = F.broadcast(spark.createDataFrame([(1, "xss"), (2, "xxe")], "c_nationkey int, by_weakness string"))  # a row for each weakness
    c = _table(spark, sf_dir, "customer").join(weaknesses, "c_nationkey", "left")
    override, by_name = F.when(F.col("c_mktsegment") == "BUILDING", "sql_injection"), F.when(F.col("c_name").endswith("7"), "csrf")
    return c.select("c_custkey", R.precedence(override, F.col("by_weakness"), by_name).alias("vuln_type"))


@register("j12_existence_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existence_join(spark, sf_dir):
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@register("j15_dynamic_static", """WITH d AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS kind FROM lineitem), s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'AR' WHEN s_suppkey % 3 = 1 THEN 'N' ELSE 'ANR' END AS o FROM supplier WHERE s_acctbal > 0)
    SELECT count(*) AS n, count(*) FILTER (s.k IS NULL) AS missing, count(*) FILTER (NOT contains(o, kind)) AS wrong, round(1 - (count(*) FILTER (s.k IS NULL OR NOT contains(o, kind))) / count(*)::DOUBLE, 9) AS rate FROM d LEFT JOIN s ON d.k = s.k""")  # fmt: skip
def dynamic_static(spark, sf_dir):
    dynamic = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("kind")).distinct()
    objects = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("A"), F.lit("R"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("N"))).otherwise(F.array(F.lit("ANR")))
    return R.soundness(dynamic, _table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key"), objects.alias("objects"))).withColumn("rate", F.round("rate", 9))


@register("j16_blended_config", "SELECT n_name AS variable, string_agg(DISTINCT s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR) AS traced FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name")
def blended_config(spark, sf_dir):
    traced = _table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("s_suppkey").cast("string"))), ",").alias("traced"))
    n = _table(spark, sf_dir, "nation")
    return n.join(traced, n.n_nationkey == traced.s_nationkey, "left").select(F.col("n_name").alias("variable"), "traced")


@register("a18_cluster_metrics", """WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM p GROUP BY label, i),
    d AS (SELECT label, avg(d) AS d FROM (SELECT p.label, vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM p JOIN c ON p.label = c.label AND p.i = c.i GROUP BY p.label, vec_id) GROUP BY label),
    e AS (SELECT sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label)
    SELECT (SELECT round(avg(d), 6) FROM d) AS intra, (SELECT count(*) FROM d) AS n_classes, (SELECT round(avg(d), 6) FROM e) AS inter""")  # fmt: skip
def cluster_metrics(spark, sf_dir):
    points = _table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return R.centroid_metrics(points, "label", "v").withColumns({c: F.round(c, 6) for c in ("intra", "inter")})


@register("a22_map_average", "SELECT k AS key, round(avg(v) + 1e-10, 8) AS mean, count(v) AS n FROM (SELECT 'value' AS k, CASE WHEN value > 50 THEN value END AS v FROM events UNION ALL SELECT event_type, event_id::DOUBLE FROM events) GROUP BY k")
def map_average(spark, sf_dir):
    maps = _table(spark, sf_dir, "events").select(F.create_map(F.lit("value"), F.when(F.col("value") > 50, F.col("value")), F.col("event_type"), F.col("event_id").cast("double")).alias("m"))
    return maps.select(F.explode("m").alias("key", "v")).groupBy("key").agg(F.round(F.avg("v") + 1e-10, 8).alias("mean"), F.count("v").alias("n"))


@register("a25_heap_opportunities", "SELECT bool_or(strings > 1000) AS interning, bool_or(lists > 0) AS collections FROM (SELECT count(*) FILTER (p_type = 'ECONOMY') AS strings, count(*) FILTER (p_type = 'PROMO') AS lists FROM part)")
def heap_opportunities(spark, sf_dir):
    kind = F.col("p_type")
    return _table(spark, sf_dir, "part").agg((F.count_if(kind == "ECONOMY") > 1000).alias("interning"), (F.count_if(kind == "PROMO") > 0).alias("collections"))


@register("a26_process_metrics", "SELECT user_id, round(sum(value) / count(*) + 1e-10, 8) AS mean, max(value) AS most, count(*) AS samples FROM events GROUP BY user_id")
def process_metrics(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value") + 1e-10, 8).alias("mean"), F.max("value").alias("most"), F.count("*").alias("samples"))


@register("a28_epoch_training", """WITH b AS (SELECT l_linenumber AS epoch, l_suppkey % 16 AS batch, avg(l_discount) AS loss, count(*) FILTER (l_tax > 0.035) AS good, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT epoch, round(avg(loss) + 1e-10, 8) AS loss, round(sum(good)::DOUBLE / sum(n), 9) AS accuracy FROM b GROUP BY epoch""")  # fmt: skip
def epoch_training(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    batches = rows.groupBy(F.col("l_linenumber").alias("epoch"), (F.col("l_suppkey") % 16).alias("batch")).agg(F.avg("l_discount").alias("loss"), F.count_if(F.col("l_tax") > 0.035).alias("good"), F.count("*").alias("n"))
    return batches.groupBy("epoch").agg(F.round(F.avg("loss") + 1e-10, 8).alias("loss"), F.round(F.sum("good") / F.sum("n"), 9).alias("accuracy"))


@register("a30_cross_dataset", "SELECT 'events' AS dataset, count(*) AS n, round(avg(value), 6) AS metric FROM events UNION ALL SELECT 'lineitem', count(*), round(avg(l_discount), 6) FROM lineitem")
def cross_dataset(spark, sf_dir):
    picked = [_table(spark, sf_dir, t).agg(F.lit(t).alias("dataset"), F.count("*").alias("n"), F.round(F.avg(c), 6).alias("metric")) for t, c in (("events", "value"), ("lineitem", "l_discount"))]
    return reduce(DataFrame.unionByName, picked).select("dataset", "n", "metric")


@register("q06_batch_statistics", "SELECT max(n) AS largest, min(n) AS smallest, count(*) AS classes, greatest(1, (max(n) + 3) // 4) AS batches FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def batch_statistics(spark, sf_dir):
    n = _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count("*").alias("classes"), F.greatest(F.lit(1), F.ceil(F.max("n") / 4)).cast("long").alias("batches"))


@register("q08_severity_order", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events WHERE value >= 75 QUALIFY place <= 100")
def severity_order(spark, sf_dir):
    return R.most_severe(_table(spark, sf_dir, "events"), "value", "event_id", 75, 100).withColumn("place", F.col("place").cast("long"))


@register("q09_patch_ranking", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 25, p_retailprice, p_partkey)::BIGINT AS place FROM part QUALIFY place <= 3")
def patch_ranking(spark, sf_dir):
    return R.ranked(_table(spark, sf_dir, "part"), "p_brand", F.col("p_size") > 25, "p_retailprice", "p_partkey", 3).withColumn("place", F.col("place").cast("long"))


@register("u03_merge_confidence", "SELECT event_id, round(0.6 * value / 100 + 0.4 * (event_id % 10) / 10, 9)::DOUBLE AS merged, round(least(1, value / 100 + least(0.1, (event_id % 10) / 50)), 9)::DOUBLE AS supplemented FROM events")
def merge_confidence(spark, sf_dir):
    both = R.merged(F.col("value") / 100, (F.col("event_id") % 10) / 10)
    return _table(spark, sf_dir, "events").select("event_id", *[F.round(c, 9).alias(n) for c, n in zip(both, ("merged", "supplemented"), strict=True)])


@register("u04_compare_sides", "SELECT user_id, CASE WHEN bool_and(event_type = 'error') THEN 'only_a' WHEN bool_and(event_type = 'click') THEN 'only_b' ELSE 'both' END AS side FROM events WHERE value > 60 AND event_type IN ('error', 'click') GROUP BY user_id")
def compare_sides(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("value > 60")
    return R.sides(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "user_id")


@register("u06_findings_mapping", "SELECT coalesce(v, 'unmapped') AS vuln_type, count(*) AS issues, count(DISTINCT user_id) AS files, round(sum(value) / (SELECT count(*) FROM events) + 1e-10, 8) AS share FROM (SELECT user_id, value, CASE event_type WHEN 'error' THEN 'sql_injection' WHEN 'view' THEN 'xss' WHEN 'purchase' THEN 'path_traversal' END AS v FROM events) GROUP BY 1")
def findings_mapping(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    kinds = F.broadcast(spark.createDataFrame(list(CATEGORIES.items()), "event_type string, vuln_type string"))  # a row for each category
    all_ = e.agg(F.count("*").alias("total"))
    rows = e.join(kinds, "event_type", "left").groupBy(F.coalesce("vuln_type", F.lit("unmapped")).alias("vuln_type")).agg(F.count("*").alias("issues"), F.count_distinct("user_id").alias("files"), F.sum("value").alias("s"))
    return rows.crossJoin(F.broadcast(all_)).select("vuln_type", "issues", "files", F.round(F.col("s") / F.col("total") + 1e-10, 8).alias("share"))  # one row


@register("u07_universe", "SELECT count(*) AS variables FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)")
def universe(spark, sf_dir):
    names = [_table(spark, sf_dir, t).select(F.col(c).alias("v")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return reduce(DataFrame.unionAll, names).agg(F.count_distinct("v").alias("variables"))


@register("g17_alias_query", """WITH r AS (SELECT s_suppkey AS name, s_nationkey AS root, s_acctbal > 5000 AS allocated FROM supplier), p AS (SELECT DISTINCT l_suppkey AS a, l_orderkey % 20 AS b FROM lineitem)
    SELECT a, b, CASE WHEN a = b THEN 'must' WHEN coalesce(x.allocated AND y.allocated, false) THEN 'must_not' WHEN x.root = y.root THEN 'may' ELSE 'unknown' END AS alias FROM p LEFT JOIN r x ON x.name = a LEFT JOIN r y ON y.name = b""")  # fmt: skip
def alias_query(spark, sf_dir):
    roots = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("root"), (F.col("s_acctbal") > 5000).alias("allocated"))
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_orderkey") % 20).alias("b")).distinct()
    return R.alias_of(pairs, roots).select("a", "b", "alias")


@register("g18_alias_refinement", "SELECT s_nationkey, count(*) AS variables, (count(*) * (count(*) - 1)) // 2 AS pairs FROM supplier GROUP BY s_nationkey")
def alias_refinement(spark, sf_dir):
    return R.alias_pairs(_table(spark, sf_dir, "supplier"), "s_nationkey")


@register("g19_alias_statistics", "SELECT count(DISTINCT l_suppkey) AS variables, count(DISTINCT l_partkey) AS sites, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS accesses FROM lineitem")
def alias_statistics(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey").alias("variables"), F.count_distinct("l_partkey").alias("sites"), F.count_distinct("l_suppkey", "l_partkey").alias("accesses"))


@register("g32_graph_features", """SELECT p_partkey AS id, i AS place, round((ARRAY[p_size / 12, (p_partkey % 12) / 12, p_partkey / 1000, (p_partkey % 100) / 100, (p_partkey % 2)::DOUBLE, (p_partkey % 3 = 0)::INT::DOUBLE, length(p_type) / 200, 1])[i + 1], 9)::DOUBLE AS feature
    FROM part, range(8) r(i)""")  # fmt: skip
def graph_features(spark, sf_dir):
    k = F.col("p_partkey")
    nodes = _table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_size").alias("kind"), (k % 12).alias("category"), k.alias("line"), (k % 100).alias("place"), (k % 2 == 1).alias("is_source"), (k % 3 == 0).alias("is_sink"), F.col("p_type").alias("code"), F.col("p_name").alias("name"))
    cells = R.node_features(nodes).where("size(features) = 128 and not exists(slice(features, 9, 120), x -> x <> 0)").select("id", F.posexplode(F.slice("features", 1, 8)).alias("place", "feature"))
    return cells.select("id", F.col("place").cast("long").alias("place"), F.round("feature", 9).alias("feature"))


@register("x08_type_inference", f"""WITH {SQL_DOCS} SELECT file_id, CASE WHEN regexp_matches(lower(code), 'executequery|preparestatement|select\\s.*\\sfrom\\s') THEN 'sql_injection' WHEN contains(lower(code), 'runtime.') OR contains(lower(code), 'processbuilder') THEN 'command_injection'
    WHEN contains(lower(code), 'getwriter') OR contains(lower(code), 'innerhtml') THEN 'xss' WHEN contains(lower(code), 'new file(') OR contains(lower(code), '../') THEN 'path_traversal' WHEN length(code) > 1000 AND length(code) % 40 > 20 THEN 'sql_injection' WHEN length(code) > 800 THEN 'command_injection' WHEN length(code) > 600 THEN 'path_traversal' ELSE 'unknown' END AS kind FROM docs""")  # fmt: skip
def type_inference(spark, sf_dir):
    n = F.length("text")
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), R.kind_of_code(F.col("text"), n / 10, n % 40).alias("kind"))


@register("x17_scanner_counts", "SELECT event_type AS method, count(*) AS n, sum((value > 50)::INT)::BIGINT AS confirmed FROM events GROUP BY event_type UNION ALL SELECT 'ensemble', count(*), count(*) FILTER (value > 50) FROM events")
def scanner_counts(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    counted = [F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("confirmed")]
    return e.groupBy(F.col("event_type").alias("method")).agg(*counted).unionAll(e.agg(F.lit("ensemble").alias("method"), *counted).select("method", "n", "confirmed"))


@register("x18_graph_index", "SELECT n_nationkey, n_name, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey < 10), 9999)::BIGINT AS prefix FROM nation")
def graph_index(spark, sf_dir):
    index = _table(spark, sf_dir, "supplier").where("s_suppkey < 10").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("prefix"))
    return R.indexed(_table(spark, sf_dir, "nation"), index, "n_nationkey", "n_name").withColumn("prefix", F.col("prefix").cast("long"))


@register("w09_diagnostics", "SELECT event_id, event_type AS vuln_type, CASE WHEN value < 70 THEN 'information' WHEN value < 90 THEN 'warning' ELSE 'error' END AS level FROM events WHERE value >= 50")
def diagnostics(spark, sf_dir):
    findings = _table(spark, sf_dir, "events").select("event_id", F.array("event_type").alias("types"), "value").where("value >= 50")
    level = F.when(F.col("value") >= 90, "error").when(F.col("value") >= 70, "warning").otherwise("information")
    return findings.select("event_id", F.explode("types").alias("vuln_type"), level.alias("level"))


#: Name stems, whether they tell of a vulnerability, and the number of its kind.
NAMES = [("VUL1_SQLInjection_Basic", 1, 0), ("SAFE_Example", 0, 23), ("VUL19_TrustBoundaryViolation", 1, 10), ("a_GoodB2G", 0, 23), ("UseAfterFree_XSS", 1, 2), ("weak_crypto_1", 1, 13), ("Unknown", 1, 0), ("IsSafe_XXE", 0, 23)]


@register("j14_label_from_name", f"SELECT p_partkey, vulnerable, kind FROM part JOIN (VALUES {', '.join(f'({i}, {b}, {k})' for i, (_, b, k) in enumerate(NAMES))}) v(i, vulnerable, kind) ON i = p_partkey % {len(NAMES)}")
def label_from_name(spark, sf_dir):
    stem = F.element_at(F.array(*[F.lit(n) for n, _, _ in NAMES]), (1 + F.col("p_partkey") % len(NAMES)).cast("int"))
    binary, kind = R.label_of_name(stem)
    return _table(spark, sf_dir, "part").select("p_partkey", binary.alias("vulnerable"), kind.alias("kind"))


@register("p34_model_threshold", "SELECT event_id FROM events WHERE event_id % 3 <> 1 OR value >= 60")
def model_threshold(spark, sf_dir):
    """A finding of the model alone needs a confidence of the threshold; what the rules found stays."""
    e = _table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(F.lit("rules"), F.lit("model"), F.lit("both")), (1 + F.col("event_id") % 3).cast("int")).alias("origin"), (F.col("value") / 100).alias("confidence"))
    return R.above_threshold(e, 0.6).select("event_id")


_GATES = ", ".join(f"('{g[0]}', {g[1]}::DOUBLE)" for g in GATES)
_OWN = "SELECT CASE event_type WHEN 'error' THEN 'SQL_QUERY' WHEN 'view' THEN 'XXE' ELSE upper(event_type) END AS sink, round(avg(value) / 100, 9) AS direct_at FROM events GROUP BY event_type"


@register("e07_gate_registry", f"WITH own AS ({_OWN}), built AS (SELECT * FROM (VALUES {_GATES}) v(sink, direct_at)) SELECT * FROM own UNION ALL SELECT * FROM built WHERE sink NOT IN (SELECT sink FROM own)")
def gate_registry(spark, sf_dir):
    """Gates of a configuration, here one for each kind of event, before those built in: of one sink the first registration holds."""
    kind = F.col("event_type")
    sink = F.when(kind == "error", "SQL_QUERY").when(kind == "view", "XXE").otherwise(F.upper(kind))
    own = _table(spark, sf_dir, "events").groupBy(sink.alias("sink")).agg(F.round(F.avg("value") / 100, 9).alias("direct_at"))
    return R.first_registered("sink", own, gate_table(spark).select("sink", "direct_at"))


@register("e25_file_metrics", f"""WITH {SQL_DOCS}, t AS (SELECT * FROM lines UNION ALL SELECT file_id, unnest(range(1, len(p) + 1)), unnest(p) FROM (SELECT file_id, string_split(code, chr(10)) AS p FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in TEXTS)}) v(file_id, code)))
    SELECT file_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '^\\s*(//|/[*]|[*])')) AS comments, sum(len(regexp_extract_all(text, '\\bclass\\s+\\w+')))::BIGINT AS classes, count(*) FILTER (regexp_matches(text, '^\\s*import\\s')) AS imports FROM t GROUP BY file_id""")  # fmt: skip
def file_metrics(spark, sf_dir):
    return R.file_metrics(texts(spark, sf_dir))
