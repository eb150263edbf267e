"""Queries of syntax trees, control flow, alias facts and program graphs.

Their files are the documents, the scripts of all pages, each as the body of a function, and files of code whose rows are known by
hand.  Documents are prose without a statement and have no nodes; all pages have a script of two statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import alias as A
from riskloom.operators import flow as C
from riskloom.operators import program_graph as P
from riskloom.operators import syntax as S
from riskloom.operators import taint as T
from riskloom.plans.registry import register
from riskloom.plans.taint import expected
from riskloom.sources import files as readers
from riskloom.sources import shared

CODE = [
    ("c1", r"""public class Calls {
    // st.executeQuery("x" + y);
    /* Runtime.getRuntime().exec(c); */
    void f(String id, Statement st, HttpServletResponse res) throws Exception {
        String note = "Runtime.getRuntime().exec(" + id;
        st.executeQuery(
            "SELECT " + id);
        log(audit(
            Runtime
                .getRuntime().exec(id)));
        res.getWriter()
            .println(id);
        st.execute(id);
        int n = id.length() + 1;
        new FileReader(new File("../etc/" + id));
        new Box("../x");
        run(() -> new ProcessBuilder(id).start());
    }
}"""),
    ("c2", """class Flow {
    int count(int[] a, int n) {
        int s = 0;
        for (int i = 0; i < n; i++) {
            if (a[i] < 0) continue;
            s += a[i];
            while (s > 9) {
                s -= 9;
            }
        }
        switch (s) {
            case 1: s = 2;
            case 2: break;
            default: return 0;
        }
        return s;
    }
    void read(Reader r) {
        try {
            use(r);
        } catch (IOException e) {
            throw e;
        } finally {
            r.close();
        }
        do { n--; } while (n > 0);
    }
}"""),
    ("c3", """package shop.alias;
public class Alias {
    static class Foo { int x; Foo next; }
    public void m(HttpServletRequest request, String name) {
        Foo f = new Foo();
        Foo g = (Foo) f;
        Foo h = name == null ? g : new Foo();
        f.next = h;
        Foo k = g.next;
        f.x = 1;
        int y = f.x;
        List<String> l = new ArrayList<>();
        Cookie cookie = new Cookie("a");
        Cookie other = new Cookie("b");
        other = cookie;
        String user = String.valueOf(name);
        // Foo z = new Foo();
    }
}"""),
    ("c4", None),
    ("c5", ""),
]
LINE = {"line": "INTEGER"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("code"))
    script = F.regexp_extract("html", "(?s)<script[^>]*>(.*?)</script>", 1)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_id"), F.concat(F.lit("void page() {\n"), script, F.lit("\n}")).alias("code"))
    return docs.unionAll(pages).unionAll(spark.createDataFrame(CODE, "file_id string, code string"))


def with_pages(columns: str, rows: str, page: str, kinds: dict[str, str] | None = None) -> str:
    """SQL of rows written by hand, and of a row for each page; page: its values after the file's id."""
    return f"{expected(columns, rows, kinds)} UNION ALL SELECT 'p' || page_id, {page} FROM pages"


@register("p32_tree_scan", with_pages("file_id nodes findings", """
    c1 | 60 | 6 SQL_INJECTION, 8 COMMAND_INJECTION, 8 COMMAND_INJECTION, 9 COMMAND_INJECTION, 11 XSS, 15 PATH_TRAVERSAL, 15 PATH_TRAVERSAL, 17 COMMAND_INJECTION, 17 COMMAND_INJECTION
    c2 | 82 |
    c3 | 55 |
""", "7, ''", {"nodes": "BIGINT"}))  # fmt: skip
def tree_scan(spark, sf_dir):
    """Every file that has a syntax tree, with what the tree rules find in it by line."""
    # Rules read the nodes several times, and files are parsed once.
    nodes = S.cut(S.tree(files(spark, sf_dir)))
    found = S.tree_findings(nodes).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "vuln_type"))), lambda x: F.concat_ws(" ", x["line"], x["vuln_type"])), ", ").alias("findings"))
    return nodes.groupBy("file_id").agg(F.count("*").alias("nodes")).join(found, "file_id", "left").fillna("", ["findings"])


@register("p32_findings", expected("file_id line vuln_type cwe confidence n", """
    c1 | 6 | SQL_INJECTION | CWE-89 | 0.86 | 1
    c1 | 8 | COMMAND_INJECTION | CWE-78 | 0.88 | 2
    c1 | 9 | COMMAND_INJECTION | CWE-78 | 0.88 | 1
    c1 | 11 | XSS | CWE-79 | 0.8 | 1
    c1 | 15 | PATH_TRAVERSAL | CWE-22 | 0.75 | 2
    c1 | 17 | COMMAND_INJECTION | CWE-78 | 0.88 | 2
""", LINE | {"confidence": "DOUBLE", "n": "BIGINT"}))  # fmt: skip
def tree_rules(spark, sf_dir):
    return S.tree_findings(S.cut(S.tree(files(spark, sf_dir)))).groupBy("file_id", "line", "vuln_type", "cwe", "confidence").agg(F.count("*").alias("n"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cut(C.flow(files(spark, sf_dir)))


@register("g27_basic_blocks", with_pages("file_id name block steps line is_exit", """
    c1 | f | 0 | 9 | 5 | true
    c2 | count | 0 | 2 | 3 | false
    c2 | count | 1 | 1 | 4 | false
    c2 | count | 2 | 1 | 5 | false
    c2 | count | 3 | 1 | 4 | false
    c2 | count | 4 | 1 | 5 | false
    c2 | count | 5 | 1 | 6 | false
    c2 | count | 6 | 1 | 7 | false
    c2 | count | 7 | 1 | 8 | false
    c2 | count | 8 | 0 | - | false
    c2 | count | 9 | 1 | 11 | false
    c2 | count | 10 | 1 | 12 | false
    c2 | count | 11 | 1 | 13 | false
    c2 | count | 12 | 1 | 14 | true
    c2 | count | 13 | 1 | 16 | true
    c2 | read | 0 | 0 | - | false
    c2 | read | 1 | 1 | 20 | false
    c2 | read | 2 | 2 | 21 | true
    c2 | read | 3 | 1 | 24 | false
    c2 | read | 4 | 1 | 26 | false
    c2 | read | 5 | 1 | 26 | false
    c2 | read | 6 | 0 | - | true
    c3 | m | 0 | 12 | 5 | true
""", "'page', 0, 2, 2, 'true'", LINE | {"block": "INTEGER", "steps": "INTEGER"}))  # fmt: skip
def basic_blocks(spark, sf_dir):
    return C.blocks(flow(spark, sf_dir)).select("file_id", "name", "block", "steps", "line", F.col("is_exit").cast("string").alias("is_exit"))


@register("g27_flow_edges", expected("file_id name kind edges", """
    c2 | count | sequential | 0-1 5-6 8-3 10-11
    c2 | count | fall-through | 1-2 2-4 6-7
    c2 | count | branch | 1-9 2-5 3-1 4-3 6-8 7-6 11-13
    c2 | count | switch | 9-10 9-11
    c2 | count | switch-default | 9-12
    c2 | read | sequential | 0-1 1-3 3-4 4-5
    c2 | read | exception | 1-2
    c2 | read | branch | 5-4
    c2 | read | fall-through | 5-6
"""))  # fmt: skip
def flow_edges(spark, sf_dir):
    pairs = F.transform(F.array_sort(F.collect_set(F.struct("source", "target"))), lambda p: F.concat_ws("-", p.source, p.target))
    return C.edges(flow(spark, sf_dir)).groupBy("file_id", "name", "kind").agg(F.concat_ws(" ", pairs).alias("edges"))


@register("g27_immediate_dominators", with_pages("file_id method idoms", """
    c1 | f | 0<-
    c2 | count | 0<- 1<0 2<1 3<2 4<2 5<2 6<5 7<6 8<6 9<1 10<9 11<9 12<9 13<11
    c2 | read | 0<- 1<0 2<1 3<1 4<3 5<4 6<5
    c3 | m | 0<-
""", "'page', '0<-'"))  # fmt: skip
def immediate_dominators(spark, sf_dir):
    found = flow(spark, sf_dir)
    names = C.blocks(found).select("file_id", "method", "name").distinct()
    reached = S.cut(C.dominators(C.blocks(found), C.edges(found)))
    idom = reached.select(*C.METHOD, "block").distinct().join(C.immediate(reached), [*C.METHOD, "block"], "left").join(names, C.METHOD)
    pairs = F.transform(F.array_sort(F.collect_set(F.struct("block", "idom"))), lambda p: F.concat_ws("<", p.block, F.coalesce(p.idom.cast("string"), F.lit("-"))))
    return idom.groupBy("file_id", F.col("name").alias("method")).agg(F.concat_ws(" ", pairs).alias("idoms"))


@register("g27_loops", expected("file_id method head blocks", """
    c2 | count | 1 | 1 2 3 4 5 6 7 8
    c2 | count | 6 | 6 7
    c2 | read | 4 | 4 5
""", {"head": "INTEGER"}))  # fmt: skip
def natural_loops(spark, sf_dir):
    found = flow(spark, sf_dir)
    names = C.blocks(found).select("file_id", "method", "name").distinct()
    told = C.loops(C.edges(found), C.dominators(C.blocks(found), C.edges(found))).join(names, ["file_id", "method"])
    return told.groupBy("file_id", F.col("name").alias("method"), "head").agg(F.concat_ws(" ", F.array_sort(F.collect_set("block"))).alias("blocks"))


def alias_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cut(A.facts(files(spark, sf_dir)))


def tainted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.facts(files(spark, sf_dir)).where("fact = 'tainted'").select("file_id", F.col("target").alias("name"))


@register("g17_points_to", expected("file_id variable sites", """
    c3 | f | Foo@5
    c3 | g | Foo@5
    c3 | h | Foo@5,Foo@7
    c3 | #Foo@5.next | Foo@5,Foo@7
    c3 | k | Foo@5,Foo@7
    c3 | l | ArrayList<>@12
    c3 | cookie | Cookie@13
    c3 | other | Cookie@13,Cookie@14
    c3 | user | String.valueOf@16
"""))  # fmt: skip
def points_to(spark, sf_dir):
    return A.points_to(alias_facts(spark, sf_dir)).groupBy("file_id", "variable").agg(F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites"))


@register("g17_alias_answers", expected("file_id a b alias confidence", """
    c3 | f | f.next | may | 0.7
    c3 | f | f.x | may | 0.7
    c3 | g | g.next | unknown | 0.3
    c3 | f | h | unknown | 0.3
    c3 | h | f | unknown | 0.3
    c3 | cookie | other | must_not | 1
    c3 | f | g | unknown | 0.3
    c3 | g | h | unknown | 0.3
    c3 | f | f | must | 1
""", {"confidence": "DOUBLE"}))  # fmt: skip
def alias_answers(spark, sf_dir):
    found = alias_facts(spark, sf_dir)
    # Asked are bases and their fields, both ends of copies, and what is stored beside where.
    fields = A.fields(found).select("file_id", F.col("base").alias("a"), F.col("name").alias("b"))
    moved = found.where("fact in ('copy', 'store')").select("file_id", F.col("source").alias("a"), F.col("target").alias("b"))
    back = moved.where("b = 'f'").select("file_id", F.lit("f").alias("a"), F.col("a").alias("b"))
    pairs = fields.unionByName(moved).unionByName(back).unionByName(fields.where("a = 'f'").select("file_id", "a", F.col("a").alias("b"))).distinct()
    return A.answers(found, pairs)


@register("g18_refinement_in_files", expected("file_id variables pairs must_not", """
    c1 | 3 | 3 | 0
    c3 | 4 | 6 | 1
""", dict.fromkeys(("variables", "pairs", "must_not"), "BIGINT")))  # fmt: skip
def refinement_in_files(spark, sf_dir):
    return A.refined(alias_facts(spark, sf_dir), tainted(spark, sf_dir))


@register("g19_statistics_in_files", expected("file_id variables sites accesses", """
    c1 | 3 | 0 | 0
    c3 | 9 | 4 | 3
""", dict.fromkeys(("variables", "sites", "accesses"), "BIGINT")))  # fmt: skip
def statistics_in_files(spark, sf_dir):
    return A.statistics(alias_facts(spark, sf_dir), tainted(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = files(spark, sf_dir)
    return P.edges(S.cut(S.tree(given)), S.cut(C.flow(given)))


@register("s12_edge_families", with_pages("file_id ast cfg dfg cdg call", """
    c1 | 59 | 8 | 11 | 0 | 0
    c2 | 81 | 23 | 30 | 87 | 0
    c3 | 54 | 11 | 10 | 0 | 0
""", "6, 1, 0, 0, 0", dict.fromkeys("ast cfg dfg cdg call".split(), "BIGINT")))  # fmt: skip
def edge_families(spark, sf_dir):
    """How many edges of each family each file's program graph has."""
    counts = [F.count_if(F.col("edge_type") == f).alias(f.lower()) for f in P.FAMILIES]
    return graph_edges(spark, sf_dir).groupBy("file_id").agg(*counts)


@register("s12_data_flow", expected("file_id flows", """
    c1 | 4>5 4>6 4>7 4>10 4>11 4>12 4>13 4>14 4>15 4>17
    c2 | 2>4 2>5 2>6 3>6 3>11 3>16 4>4 4>5 4>6 6>6 6>7 6>8 6>11 6>16 8>6 8>7 8>8 8>11 8>16 12>16 18>20 18>24 21>22 26>26
    c3 | 4>7 4>16 5>6 5>8 5>10 5>11 6>7 6>9 7>8 13>15
"""))  # fmt: skip
def data_flow(spark, sf_dir):
    """Definitions and the uses that they reach, by line."""
    given = files(spark, sf_dir)
    nodes = S.cut(S.tree(given))
    line = nodes.select("file_id", F.col("node").alias("target"), F.col("line").alias("t"))
    out = P.data_flow(nodes, S.cut(C.flow(given))).join(line, ["file_id", "target"]).join(line.select("file_id", F.col("target").alias("source"), F.col("t").alias("s")), ["file_id", "source"])
    pairs = F.transform(F.array_sort(F.collect_set(F.struct("s", "t"))), lambda p: F.concat_ws(">", p.s, p.t))
    return out.groupBy("file_id").agg(F.concat_ws(" ", pairs).alias("flows"))


@register("s12_graph_files", "SELECT 7::BIGINT AS n_nodes, 1::BIGINT AS n_methods, 1::BIGINT AS n_calls, 7::BIGINT AS n_edges, count(*) AS graphs FROM pages UNION ALL SELECT * FROM (VALUES (60, 1, 11, 78, 1), (82, 2, 2, 221, 1), (55, 1, 1, 75, 1)) v")
def graph_files(spark, sf_dir):
    """The program graphs written as JSON lines and read back by the reader of program graphs."""
    given = files(spark, sf_dir)
    nodes = S.cut(S.tree(given))
    graphs = P.graphs(nodes, S.cut(P.edges(nodes, S.cut(C.flow(given))))).drop("file_id")
    read = shared.round_trip(graphs, "graphs", lambda w, p: w.json(p), lambda s, p: readers.program_graphs(s, p, lines=True))
    told = readers.graph_summary(read).select(*[F.col(c).cast("long").alias(c) for c in ("n_nodes", "n_methods", "n_calls", "n_edges")])
    return told.groupBy(*told.columns).agg(F.count("*").alias("graphs"))
