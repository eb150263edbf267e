"""Records of other tools as tables: their text forms parsed, mapped, joined and summed.

Parsers take lines(file_id, line, text) or a column, so that a whole tree of files is one table and no file is
read by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Of each sink, sanitizers that it needs, that it takes, and that don't help it.
SUITABLE = [
    ("sql_injection", "required", ["SQL Parameterization"]),
    ("sql_injection", "acceptable", ["Input Validation"]),
    ("sql_injection", "ineffective", ["HTML Entity Escaping", "URL Encoding"]),
    ("xss", "required", ["HTML Entity Escaping", "HTML Sanitization (Allowlist)"]),
    ("xss", "acceptable", ["Input Validation"]),
    ("xss", "ineffective", ["SQL Parameterization", "Path Normalization"]),
    ("command_injection", "required", ["Input Validation", "Command Argument List"]),
    ("command_injection", "ineffective", ["SQL Parameterization"]),
    ("path_traversal", "required", ["Path Normalization", "Input Validation"]),
    ("ldap_injection", "required", ["LDAP Escaping", "Input Validation"]),
    ("xxe", "required", ["XXE Hardening"]),
    ("xxe", "acceptable", ["Input Validation"]),
    ("http_response_splitting", "required", ["URL Encoding", "Input Validation"]),
]
# Extensions of source files, and folders that are left out.
EXTENSIONS = ("java", "py", "js", "ts", "cpp", "c", "cs")
SKIPPED = ("node_modules", "__pycache__", ".git", "build", "target", "dist", ".vscode")

# Kinds of findings in the order in which names are searched for them; a kind's place is its number.
TYPES = (
    "SQL_INJECTION", "COMMAND_INJECTION", "XSS", "PATH_TRAVERSAL", "XXE", "SSRF", "DESERIALIZATION", "LDAP_INJECTION", "LOG_INJECTION", "XPATH_INJECTION", "TRUST_BOUNDARY_VIOLATION", "REFLECTION_INJECTION",
    "RACE_CONDITION", "WEAK_CRYPTO", "HARDCODED_CREDENTIALS", "INSECURE_RANDOM", "NULL_DEREFERENCE", "RESOURCE_LEAK", "BUFFER_OVERFLOW", "INTEGER_OVERFLOW", "USE_AFTER_FREE", "DOUBLE_FREE", "MEMORY_LEAK", "SAFE",
)


def label_of_name(stem: Column) -> tuple[Column, Column]:
    """(vulnerable, number of the kind) of a file's name without ending: names of safe files first, then the first kind in the name,
    with or without its underscores; the first kind if none is."""
    safe = stem.startswith("SAFE") | stem.contains("Safe") | F.lower(stem).contains("good")
    found = F.coalesce(*[F.when(F.upper(stem).contains(t) | F.upper(stem).contains(t.replace("_", "")), i) for i, t in enumerate(TYPES)], F.lit(0))
    return (~safe).cast("int"), F.when(safe, TYPES.index("SAFE")).otherwise(found)


def suitability(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, suitability) of found(id, sink, sanitizers) under rules(sink, kind, names): .95 with a required one, .60 with an
    acceptable one, .30 off for one that doesn't help, never below 0."""
    hit = F.arrays_overlap("sanitizers", "names")
    told = found.join(F.broadcast(rules), "sink", "left")  # a few rows for each sink
    best = F.max(F.when(hit, F.when(F.col("kind") == "required", 0.95).when(F.col("kind") == "acceptable", 0.60)))
    off = F.max(F.when(hit & (F.col("kind") == "ineffective"), 0.30))
    return told.groupBy("id").agg(F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0)) - F.coalesce(off, F.lit(0.0))).alias("suitability"))


def method_pairs(sources: DataFrame, sinks: DataFrame, method: str, at: str) -> DataFrame:
    """(method, sink, source): every sink of a method that has a source, with the method's first source."""
    first = sources.groupBy(method).agg(F.min(at).alias("source"))
    return sinks.select(method, F.col(at).alias("sink")).join(first, method)


def precedence(*steps: Column) -> Column:
    """The first step that knows."""
    return F.coalesce(*steps)


def commit_hash(url: Column) -> Column:
    """The hash at a URL's end: of a range the right side; null unless it is 7 to 40 hex digits."""
    tail = F.element_at(F.split(F.element_at(F.split(F.rtrim(F.trim(url), F.lit("/")), "/"), -1), r"\.\."), -1)
    return F.when(tail.rlike("^[0-9a-fA-F]{7,40}$"), tail)


def soundness(dynamic: DataFrame, static: DataFrame) -> DataFrame:
    """n, missing, wrong and rate: of dynamic(key, kind), how many static(key, objects) doesn't have, or has without an
    object that names the kind.  The rate of nothing is 1."""
    both = dynamic.join(static.withColumnsRenamed({"key": "k"}), F.col("key") == F.col("k"), "left")
    missing = F.col("k").isNull()
    wrong = ~missing & ~F.exists("objects", lambda o: F.contains(o, F.col("kind")))
    out = both.agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"), F.count_if(wrong).alias("wrong"))
    return out.withColumn("rate", F.when(F.col("n") == 0, 1.0).otherwise(1 - (F.col("missing") + F.col("wrong")) / F.col("n")))


def public_methods(lines: DataFrame) -> DataFrame:
    """(file_id, line, name, is_static, types): every public method declared; constructors and main are none."""
    declared = F.regexp_extract_all("text", F.lit(r"\bpublic\s+((?:static\s+)?[\w<>\[\],.]+\s+\w+\s*\([^)]*\))"), F.lit(1))
    one = lines.where(F.col("text").contains("public")).select("file_id", "line", F.explode(declared).alias("d"))
    parameters = F.filter(F.transform(F.split(F.regexp_extract("d", r"\(([^)]*)\)", 1), ","), lambda p: F.trim(p)), lambda p: p != "")
    types = F.transform(parameters, lambda p: F.regexp_replace(p, r"^final\s+|\s+\w+$", ""))
    out = one.select("file_id", "line", F.regexp_extract("d", r"(\w+)\s*\(", 1).alias("name"), F.col("d").startswith("static").alias("is_static"), F.array_join(types, ",").alias("types"))
    return out.where("name <> 'main'")


def heap_rows(rows: DataFrame, names: list[str], counts: list[str]) -> DataFrame:
    """(class, n): the first name given and the first count given; thousands have commas, what is no number is 0."""
    number = F.coalesce(*[F.regexp_replace(c, ",", "") for c in counts])
    return rows.select(F.coalesce(*names).alias("class"), F.coalesce(number.try_cast("long"), F.lit(0)).alias("n"))


def points_to(lines: DataFrame) -> DataFrame:
    """(file_id, method, variable, objects) of text where a line '<method>': opens a method, - var: v a variable of it and - "o" adds an object.

    A variable told again starts anew, and so does one after a new method line.
    """
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, names = r"^\s*'?(<[^>]+>)'?:\s*$", r'^\s*-\s+var:\s+"?([^"]+)"?'
    marks = lines.where(F.col("text").rlike(rf"{opens}|^\s*-\s"))
    method = F.last(F.when(F.col("text").rlike(opens), F.struct(F.regexp_extract("text", opens, 1).alias("name"), "line")), ignorenulls=True).over(w)
    variable = F.last(F.when(F.col("text").rlike(names), F.struct(F.trim(F.regexp_extract("text", names, 1)).alias("name"), "line")), ignorenulls=True).over(w)
    told = marks.select("file_id", method.alias("m"), variable.alias("v"), F.when(~F.col("text").rlike(names), F.nullif(F.regexp_extract("text", r'^\s*-\s+"(.+)"$', 1), F.lit(""))).alias("o"))
    told = told.where("v.line > m.line").groupBy("file_id", F.col("m.name").alias("method"), F.col("v.name").alias("variable"), F.col("v.line").alias("line")).agg(F.collect_set("o").alias("o"))
    return told.groupBy("file_id", "method", "variable").agg(F.array_sort(F.max_by("o", "line")).alias("objects"))


def profile(lines: DataFrame) -> DataFrame:
    """(file_id, place, name, seconds, percent) of lines `N. name - Xs (Y%)`."""
    pattern = r"^\s*(\d+)\.\s+(.*?)\s+-\s+([0-9.]+)s\s+\(([0-9.]+)%\)"
    at = lambda i: F.regexp_extract("text", pattern, i)
    return lines.where(F.col("text").rlike(pattern)).select("file_id", at(1).cast("int").alias("place"), at(2).alias("name"), at(3).try_cast("double").alias("seconds"), at(4).try_cast("double").alias("percent"))


def expected_results(lines: DataFrame) -> DataFrame:
    """(file_id, test, category, vulnerable, cwe) of comma-separated lines; blank lines, # lines and those of fewer columns aren't rows."""
    cells = F.transform(F.split("text", ","), lambda c: F.trim(c))
    rows = lines.where(~F.trim("text").startswith("#") & (F.trim("text") != "")).select("file_id", cells.alias("c")).where(F.size("c") >= 4)
    return rows.select("file_id", F.col("c")[0].alias("test"), F.lower(F.col("c")[1]).alias("category"), (F.lower(F.col("c")[2]) == "true").alias("vulnerable"), F.col("c")[3].alias("cwe"))


def effectiveness(pairs: DataFrame) -> DataFrame:
    """(sink, sanitizer, effectiveness) of pairs(key, value): the key is cut once at ::, bad keys and values aren't rows."""
    two = F.split("key", "::", 2)
    out = pairs.where(F.col("key").contains("::")).select(two[0].alias("sink"), two[1].alias("sanitizer"), F.col("value").try_cast("double").alias("effectiveness"))
    return out.where("effectiveness is not null")


def labelled(paths: DataFrame, path: str, types: DataFrame) -> DataFrame:
    """(path, label, type): bad wins over good, base files are none, and the path's CWE must be one of types(cwe, type)."""
    name = F.element_at(F.split(path, "/"), -1)
    label = F.when(F.lower(name).contains("_bad"), 1).when(F.lower(name).contains("_good"), 0)
    told = paths.select(F.col(path).alias("path"), label.alias("label"), F.regexp_extract(path, r"CWE(\d+)", 1).alias("cwe")).where(label.isNotNull() & ~name.endswith("_base.java"))
    return told.join(F.broadcast(types), "cwe").select("path", "label", "type")  # a row for each kind of finding


def graph_summary(rows: DataFrame, key: str, **metrics: Column) -> DataFrame:
    """rows by key: the metrics' sums; if a graph has no edges, calls + 2 * methods stand for them."""
    out = rows.groupBy(key).agg(*[m.alias(n) for n, m in metrics.items()])
    return out.withColumn("edges", F.when(F.col("edges") == 0, F.col("calls") + 2 * F.col("methods")).otherwise(F.col("edges")))


def prediction_rows(rows: DataFrame) -> DataFrame:
    """(label, prediction, subgroup) of rows(label, confidence, prediction, nodes): unlabelled rows are none."""
    size = F.when(F.col("nodes") < 50, "small").when(F.col("nodes") < 200, "medium").when(F.col("nodes").isNotNull(), "large").otherwise("unknown")
    told = rows.select(F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("prediction", (F.col("confidence") >= 0.5).cast("int")).alias("prediction"), size.alias("subgroup"))
    return told.where("label >= 0")


def eligible(path: Column) -> Column:
    """Whether a path is a source file outside hidden and skipped folders."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & (p != ".") & (p != ".."))
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED]))
    return F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)).isin(*EXTENSIONS) & ~hidden & ~skipped


def security_properties(code: Column) -> tuple[Column, Column]:
    """(fewer checks of access than sensitive operations, text joined in a query)."""
    count = lambda p: F.regexp_count(code, F.lit(p))
    unguarded = count(r"(?i)(checkPermission|hasRole|isAuthorized|authenticate)\s*\(") < count(r"(?i)(delete|update|transfer|admin)\w*\s*\(")
    return unguarded, code.rlike(r'(?i)"\s*(select|insert|update|delete)\b[^"]*"\s*\+')


def centroid_metrics(points: DataFrame, key: str, vector: str) -> DataFrame:
    """intra (mean over classes of the mean distance to the centre), inter (mean distance of two centres), n_classes.

    The centres are a row for each class; of classes, not of points, all pairs are formed.
    """
    cells = points.select(key, F.monotonically_increasing_id().alias("_p"), F.posexplode(vector).alias("i", "x"))
    centre = cells.groupBy(key, "i").agg(F.avg("x").alias("c"))
    centre = centre.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s.c).alias("centre"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    own = points.select(key, vector).join(F.broadcast(centre), key).groupBy(key).agg(F.avg(apart(F.col(vector), F.col("centre"))).alias("d"))
    a, b = centre.select(F.col(key).alias("ka"), F.col("centre").alias("ca")), centre.select(F.col(key).alias("kb"), F.col("centre").alias("cb"))
    inter = a.join(b, F.col("ka") < F.col("kb")).agg(F.avg(apart(F.col("ca"), F.col("cb"))).alias("inter"))
    return own.agg(F.avg("d").alias("intra"), F.count("*").alias("n_classes")).crossJoin(inter)  # one row each


def ranked(rows: DataFrame, group: str, feasible: Column, cost: str, id_: str, top: int) -> DataFrame:
    """(id_, place): of each group the first `top` by feasibility, then cost."""
    w = Window.partitionBy(group).orderBy(F.when(feasible, 0).otherwise(1), cost, id_)
    return rows.select(id_, F.row_number().over(w).alias("place")).where(F.col("place") <= top)


def most_severe(rows: DataFrame, score: str, id_: str, least: float, top: int) -> DataFrame:
    """(id_, place): the `top` rows of at least `least`, by score (a report's top-k: only these rows are numbered)."""
    first = rows.where(F.col(score) >= least).orderBy(F.desc(score), id_).limit(top).agg(F.collect_list(F.struct(score, id_)).alias("all"))
    listed = F.array_sort(F.col("all"), lambda a, b: F.when(a[score] > b[score], -1).when(a[score] < b[score], 1).otherwise(F.when(a[id_] < b[id_], -1).otherwise(1)))
    return first.select(F.posexplode(listed).alias("p", "r")).select(F.col(f"r.{id_}").alias(id_), (F.col("p") + 1).alias("place"))


def sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): only_a, only_b or both."""
    both = a.select(F.col(key), F.lit(1).alias("in_a")).distinct().join(b.select(F.col(key), F.lit(1).alias("in_b")).distinct(), key, "full")
    return both.select(key, F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both").alias("side"))


def merged(own: Column, other: Column) -> tuple[Column, Column]:
    """(merged, supplemented) confidence of a finding by two scanners."""
    return 0.6 * own + 0.4 * other, F.least(F.lit(1.0), own + F.least(F.lit(0.1), 0.2 * other))


def alias_pairs(variables: DataFrame, group: str) -> DataFrame:
    """(group, variables, pairs): how many pairs of variables a refinement judges; counted, not formed."""
    n = F.count("*")
    return variables.groupBy(group).agg(n.alias("variables"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def alias_of(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, alias, confidence) of pairs(a, b), with roots(name, root, allocated): must if they are one, must_not if both are
    allocated apart, may if they go back to one root, else unknown."""
    one = [roots.select(F.col("name").alias(n), F.col("root").alias(f"r{n}"), F.col("allocated").alias(f"l{n}")) for n in ("a", "b")]
    both = pairs.join(one[0], "a", "left").join(one[1], "b", "left")
    same, apart, kin = F.col("a") == F.col("b"), F.coalesce(F.col("la") & F.col("lb"), F.lit(False)), F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))
    alias = F.when(same, "must").when(apart, "must_not").when(kin, "may").otherwise("unknown")
    return both.select("a", "b", alias.alias("alias"), F.when(same | apart, 1.0).when(kin, 0.7).otherwise(0.3).alias("confidence"))


def node_features(nodes: DataFrame) -> DataFrame:
    """nodes(id, kind, category, line, place, is_source, is_sink, code, name) with ten features, padded to 128."""
    flag = lambda c: F.col(c).cast("double")
    own = F.array(
        F.col("kind") / 12, F.col("category") / 12, F.col("line") / 1000, F.col("place") / 100, flag("is_source"), flag("is_sink"), F.length("code") / 200,
        (F.col("name") != "").cast("double"), F.lit(0.0), F.lit(0.0),
    )
    return nodes.select("id", F.concat(own, F.array_repeat(F.lit(0.0), 118)).alias("features"))


def diff_lines(lines: DataFrame) -> DataFrame:
    """(file_id, added, removed, changed) of a patch's lines; the +++ and --- lines of a file's head aren't any."""
    plus = F.col("text").startswith("+") & ~F.col("text").startswith("+++")
    minus = F.col("text").startswith("-") & ~F.col("text").startswith("---")
    out = lines.groupBy("file_id").agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("removed"))
    return out.withColumn("changed", F.col("added") + F.col("removed"))


def kind_of_code(code: Column, nodes: Column, edges: Column) -> Column:
    """What a file is taken for: by the first telling word, else by the size of its graph."""
    has = lambda *words: F.lower(code).rlike("|".join(words))
    return (
        F.when(has("executequery", "preparestatement", r"select\s.*\sfrom\s"), "sql_injection").when(has(r"runtime\.", "processbuilder"), "command_injection")
        .when(has("getwriter", "innerhtml"), "xss").when(has(r"new file\(", r"\.\./"), "path_traversal")
        .when((nodes > 100) & (edges > 20), "sql_injection").when(nodes > 80, "command_injection").when(nodes > 60, "path_traversal").otherwise("unknown")
    )


def indexed(labels: DataFrame, index: DataFrame, key: str, label: str) -> DataFrame:
    """labels with the index's prefix, 9999 where it has none: the order of a report's list is (prefix, label)."""
    return labels.join(index, key, "left").select(key, label, F.coalesce("prefix", F.lit(9999)).alias("prefix"))


def above_threshold(findings: DataFrame, least: float) -> DataFrame:
    """findings(origin, confidence) without those of the model alone below `least`."""
    return findings.where((F.col("origin") != "model") | (F.col("confidence") >= least))


def first_registered(key: str, *tables: DataFrame) -> DataFrame:
    """The rows of the tables; of one key the row of the first table that has it."""
    marked = [t.withColumn("_place", F.lit(i)) for i, t in enumerate(tables)]
    rows = marked[0]
    for t in marked[1:]:
        rows = rows.unionByName(t)
    columns = tables[0].columns
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), "_place").alias("row")).select("row.*")


def file_metrics(lines: DataFrame) -> DataFrame:
    """(file_id, n_lines, comments, classes, imports) of lines(file_id, line, text)."""
    text = F.col("text")
    return lines.groupBy("file_id").agg(
        F.count("*").alias("n_lines"), F.count_if(text.rlike(r"^\s*(//|/\*|\*)")).alias("comments"), F.sum(F.regexp_count(text, F.lit(r"\bclass\s+\w+"))).alias("classes"), F.count_if(text.rlike(r"^\s*import\s")).alias("imports")
    )
