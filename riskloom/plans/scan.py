"""The scan from files to judged findings over the documents, all pages' scripts and files of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.rules import SQL_SUBJECTS
from riskloom.operators import detectors, scan
from riskloom.plans import code
from riskloom.plans.registry import register
from riskloom.plans.taint import expected
from riskloom.sources import sinks

FILES = [
    ("v1", """public class Open {
    public void find(HttpServletRequest request, Statement st) {
        String id = request.getParameter("id");
        String q = "SELECT a FROM t WHERE k = " + id + " AND x = " + id;
        st.executeQuery(q);
    }
}"""),
    ("v2", """public class Bound {
    public void find(HttpServletRequest request, Connection c) {
        String id = request.getParameter("id");
        PreparedStatement p = c.prepareStatement("SELECT a FROM t WHERE k = ?");
        p.setString(1, id);
        p.executeQuery();
    }
}"""),
    ("v3", """public class Hash {
    byte[] of(byte[] b) throws Exception {
        return MessageDigest.getInstance("MD5").digest(b);
    }
}"""),
    ("v4", """public class Quiet {
    int twice(int n) {
        return n + n;
    }
}"""),
    ("v5", """public class Shell {
    public void run(String command) throws Exception {
        Runtime.getRuntime().exec("sh -c " + command);
    }
}"""),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.files(spark, sf_dir).where("file_id not like 'c%'").unionAll(spark.createDataFrame(FILES, "file_id string, code string"))


#: Of the documents only words of weak ciphers are findings: (0.7 / (1 + exp(-0.65)) + 0.3 * (0.5 + 0.2 + 0.08)).
_DOCUMENTS = f"SELECT 'd' || doc_id AS file_id, 'weak_crypto' AS vuln_type, NULL::DOUBLE AS gate, true AS passed, 'kept' AS verdict, 0.693907::DOUBLE AS confidence, 'warning' AS level FROM (SELECT doc_id, text AS code FROM documents) WHERE {dict(detectors.BANK)['weak_crypto'].sql(SQL_SUBJECTS)}"
_COLUMNS = "file_id vuln_type gate passed verdict confidence level"


@register("scan_findings", _DOCUMENTS + " UNION ALL " + expected(_COLUMNS, """
    v1 | sql_injection | 1 | true | kept | 0.815388 | error
    v1 | csrf | - | true | kept | 0.815388 | error
    v2 | csrf | - | true | kept | 0.804546 | error
    v3 | weak_crypto | - | true | kept | 0.786955 | error
    v5 | command_injection | 1 | true | kept | 0.786955 | error
""", {"gate": "DOUBLE", "confidence": "DOUBLE", "passed": "BOOLEAN"}))  # fmt: skip
def scan_findings(spark, sf_dir):
    return scan.scan(files(spark, sf_dir)).drop("how")


@register("scan_files", "SELECT 'd' || doc_id AS file_id, 0 AS findings, '' AS kinds FROM (SELECT doc_id, text AS code FROM documents) WHERE NOT coalesce(" + dict(detectors.BANK)["weak_crypto"].sql(SQL_SUBJECTS) + ", false)"
    + " UNION ALL SELECT 'd' || doc_id, 1, 'weak_crypto' FROM (SELECT doc_id, text AS code FROM documents) WHERE " + dict(detectors.BANK)["weak_crypto"].sql(SQL_SUBJECTS)
    + " UNION ALL SELECT 'p' || page_id, 0, '' FROM pages UNION ALL SELECT * FROM (VALUES ('v1', 2, 'csrf,sql_injection'), ('v2', 1, 'csrf'), ('v3', 1, 'weak_crypto'), ('v4', 0, ''), ('v5', 1, 'command_injection')) v")
def scan_files(spark, sf_dir):
    """Every scanned file with the number and kinds of its findings that passed."""
    rows = files(spark, sf_dir)
    told = scan.scan(rows).where("passed").groupBy("file_id").agg(F.count("*").cast("int").alias("findings"), F.array_join(F.array_sort(F.collect_set("vuln_type")), ",").alias("kinds"))
    return rows.select("file_id").join(told, "file_id", "left").fillna(0, ["findings"]).fillna("", ["kinds"])


@register("scan_sarif", "SELECT result FROM (VALUES ('{\"ruleId\":\"SQL_INJECTION\",\"level\":\"error\",\"message\":{\"text\":\"sql_injection in v1\"}}'), ('{\"ruleId\":\"CSRF\",\"level\":\"error\",\"message\":{\"text\":\"csrf in v1\"}}'), ('{\"ruleId\":\"CSRF\",\"level\":\"error\",\"message\":{\"text\":\"csrf in v2\"}}'), ('{\"ruleId\":\"WEAK_CRYPTO\",\"level\":\"error\",\"message\":{\"text\":\"weak_crypto in v3\"}}'), ('{\"ruleId\":\"COMMAND_INJECTION\",\"level\":\"error\",\"message\":{\"text\":\"command_injection in v5\"}}')) v(result)"
    + " UNION ALL SELECT '{\"ruleId\":\"WEAK_CRYPTO\",\"level\":\"warning\",\"message\":{\"text\":\"weak_crypto in ' || file_id || '\"}}' FROM (" + _DOCUMENTS + ")")
def scan_sarif(spark, sf_dir):
    return scan.scan(files(spark, sf_dir)).where("passed").select(sinks.sarif_result().alias("result"))
