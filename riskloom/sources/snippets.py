"""Literal code snippets, so that detectors have something to find beside prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.rules import quoted

SNIPPETS: list[tuple[str, str]] = [
    ("s01", 'Statement s = c.createStatement();\ns.executeQuery("SELECT a FROM t WHERE id=" + id);'),
    ("s02", 'PreparedStatement p = c.prepareStatement("SELECT a FROM t WHERE id=?");\np.setString(1, id);'),
    ("s03", 'Runtime.getRuntime().exec("ls " + dir);'),
    ("s04", 'new ProcessBuilder(cmd).start(); st.executeUpdate("DELETE");'),
    ("s05", 'File f = new File(base + name);\nnew FileInputStream(f);'),
    ("s06", 'ZipInputStream z = open();\nZipEntry entry = z.getNextEntry();\nFile out = new File(dir, entry.getName());'),
    ("s07", 'response.getWriter().println("<html>" + name);'),
    ("s08", 'ctx.search("ou=x", "(uid=" + uid + ")");'),
    ("s09", "InitialContext ic = new InitialContext();\nic.lookup(name);"),
    ("s10", 'ExpressionFactory f = make();\nf.createValueExpression(ctx, "${" + userExpr + "}", String.class);'),
    ("s11", "DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();\nf.newDocumentBuilder().parse(in);"),
    ("s12", 'DocumentBuilderFactory f = x();\nf.setFeature("secure", true);\nf.newDocumentBuilder().parse(in);'),
    ("s13", "URL u = new URL(target);\nu.openConnection();"),
    ("s14", 'URL u = new URL("http://fixed");\nu.openStream();'),
    ("s15", 'XPath xp = XPathFactory.newInstance().newXPath();\nxp.evaluate("//user[@n=" + n + "]", doc);'),
    ("s16", 'ScriptEngine e = m.getEngineByName("js");\ne.eval(script);'),
    ("s17", 'MessageDigest.getInstance("MD5");'),
    ("s18", 'MessageDigest.getInstance("SHA-256");'),
    ("s19", "ObjectInputStream in = s();\nin.readObject();"),
    ("s20", 'String password = "hunter2";'),
    ("s21", "Class.forName(className).newInstance();"),
    ("s22", "Class c = Class.forName(CONST);\nc.getMethod(methodName);"),
    ("s23", "Random r = new Random();\nint x = r.nextInt();"),
    ("s24", "System.arraycopy(a, 0, b, 0, n);"),
    ("s25", 'session.setAttribute("role", request.getParameter("role"));'),
    ("s26", "public class CsrfHandler {\n  void doPost(HttpServletRequest r) { transfer(); }\n}"),
    ("s27", "void doPost(HttpServletRequest r) { verifyToken(r); transfer(); }"),
    ("s28", "private int count;\nvoid inc() { count++; }"),
    ("s29", "private int count;\nReentrantLock lock;\nvoid inc() { count++; }"),
    ("s30", 'logger.info("login " + username);'),
    ("s31", 'logger.info("login " + sanitize(username));'),
    ("s32", "String n = map.get(k);\nn.length();"),
    ("s33", "String n = map.get(k);\nif (n != null) n.length();"),
    ("s34", "String m = user.getProfile().getEmail();"),
    ("s35", "int total = price * quantity;"),
    ("s36", "int total = Math.multiplyExact(price, quantity * 1);"),
    ("s37", 'response.sendRedirect(request.getParameter("u"));'),
    ("s38", 'response.setHeader("X", URLEncoder.encode(request.getParameter("u")));'),
    ("s39", "void login(HttpServletRequest r) {\n  HttpSession s = r.getSession();\n  authenticate();\n}"),
    ("s40", "void login() {\n  HttpSession s = r.getSession(true);\n  r.changeSessionId();\n}"),
    ("s41", "FileInputStream in = new FileInputStream(p);\nin.read();"),
    ("s42", "FileInputStream in = new FileInputStream(p);\ntry { in.read(); } finally { in.close(); }"),
    ("s43", "try (FileReader r = new FileReader(p)) { r.read(); }"),
    ("s44", 'Connection c = DriverManager.getConnection(url);\nStatement st = new Statement(c);\ntry { } finally { st.close(); }'),
    ("s45", "int größe = 1;\r\nString x = a;\r\n"),
    ("s46", ""),
    ("s47", 'eval(code); subprocess.run(x); el.innerHTML = y; q = "SELECT a " + b + c; api_key = "k1"'),
    ("s48", "if (x) {\n  y = request.getParameter(\"a\");\n  z = y;\n  db.executeQuery(z);\n}\n"),
]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, code): the documents and the snippets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("code"))
    return docs.unionAll(spark.createDataFrame(SNIPPETS, "file_id string, code string"))


SQL_SOURCES = "sources AS (SELECT 'd' || doc_id::VARCHAR AS file_id, text AS code FROM documents UNION ALL SELECT * FROM (VALUES {}) v(file_id, code))".format(
    ", ".join(f"({quoted(i)}, {quoted(c)})" for i, c in SNIPPETS)
)
