"""Queries of what surrounds secrets, of the whole graph, its budgets, and of the report's parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborscan.functions import exprs
from harborscan.operators import correlation, report, secret_context, secret_rules
from harborscan.plans import scan_queries
from harborscan.plans.scan_queries import _BITS, _CONFIG_HITS, _OPEN_SQL, _SEV_RANK, ASSESSED_SQL, FINDINGS_SQL, _sid
from harborscan.sources import corpora
from harborscan.sources.corpora import CODE_LINES_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_LIST = lambda names: "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _pick(names, k):
    return F.get(F.array(*map(F.lit, names)), k.cast("int"))


_TEST_PATHS = ["tests/a.py", "src/a.py", "pkg/test_b.py", "web/c.spec.ts", "web/Test/d.js"]
_VALUES = ["fake_token_value_aB", "fake-token-value", "not_a_real_password_here", "do-not-echo", "example_one", "Aa9_example_Zz81xQ", "test_9x"]


@query(f"""WITH v AS (SELECT o_orderkey, {_LIST(_TEST_PATHS)}[1 + o_orderkey % 5] AS path, {_LIST(_VALUES)}[1 + (o_orderkey // 5) % 7] AS value FROM orders),
t AS (SELECT *, regexp_matches(lower(path), '^tests/|/test/|/test_|[.]spec[.]ts$') AS in_test FROM v)
SELECT o_orderkey, in_test AND lower(value) = value AND NOT regexp_matches(value, '[0-9]') AND (regexp_full_match(value, '(fake|example|test)[_-][a-z_-]+') OR regexp_full_match(value, 'not[_-]a[_-].*|do[_-]not[_-]echo')) AS made_up,
  in_test AND (regexp_matches(value, '(^|[^A-Za-z0-9])(fake|example|test)($|[^A-Za-z0-9])') OR regexp_full_match(value, 'not[_-]a[_-].*|do[_-]not[_-]echo')) AS made_up_js FROM t""")
def secret_test_suppression(spark, sf_dir):
    o = corpora.table(spark, sf_dir, "orders")
    path, value = _pick(_TEST_PATHS, F.col("o_orderkey") % 5), _pick(_VALUES, F.floor(F.col("o_orderkey") / 5) % 7)
    inside = secret_context.in_tests(path)
    return o.select("o_orderkey", secret_context.made_up(value, inside).alias("made_up"), secret_context.made_up(value, inside, True).alias("made_up_js"))


def _js_lines(spark, sf_dir):
    """path, line, text, proven: a script for each customer of orders, in which secrets are given in several ways."""
    o = corpora.table(spark, sf_dir, "orders")
    v = F.concat(F.lit("Aa9_"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16))
    q = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    k = F.col("o_orderkey") % 9
    text = (
        F.when(k == 0, q("const password = '", v, "';")).when(k == 1, q("password: process.env.PW || '", v, "',")).when(k == 2, q("password = process.env['", v, "'];")).when(k == 3, q("token = fetchToken(", v, ");"))
        .when(k == 4, q("apiKey =")).when(k == 5, q("password = `${host}", v, "`;")).when(k == 6, q("password = make('", v, "');")).when(k == 7, q("// password = '", v, "'")).otherwise(q("environment.password = environment.", "PW;"))
    )
    line = F.row_number().over(correlation.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.concat(F.lit("web/c"), F.col("o_custkey").cast("string"), F.lit(".ts")).alias("path"), line.cast("long").alias("line"), text.alias("text"), F.array(F.lit("environment")).alias("proven"))


_JS_SQL = f"""js0 AS (SELECT 'web/c' || o_custkey || '.ts' AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey % 9 AS k, 'Aa9_' || substr(md5(o_orderkey::VARCHAR), 1, 16) AS value FROM orders),
js AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY path ORDER BY line) = 4, false) AS lent FROM js0)"""


@query(f"""WITH {_JS_SQL}, h AS (SELECT path, line, 'password' AS label, value, CASE k WHEN 0 THEN 18 WHEN 1 THEN 29 WHEN 5 THEN 19 WHEN 7 THEN 15 END AS start FROM js WHERE k IN (0, 7) OR (k IN (1, 5) AND NOT lent))
SELECT path, line, label, start::BIGINT AS start, length(value) AS value_length, CASE WHEN {_BITS} >= 3.2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM h""")
def secret_js_assignments(spark, sf_dir):
    hits = secret_context.js_assignments(_js_lines(spark, sf_dir)).where("label = 'password'")
    return hits.select("path", "line", "label", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"), "confidence")


_SOURCES = ["function run(environment: NodeJS.ProcessEnv, b) {}", "function a(x: Partial<NodeJS.ProcessEnv>) {} function b(env : NodeJS.ProcessEnv) {}", "const f = (e: NodeJS.ProcessEnv) => 1", "function $q(n: number) {}"]


@query(f"SELECT o_orderkey, {_LIST(['environment', 'x,env', '', ''])}[1 + o_orderkey % 4] AS names FROM orders")
def secret_js_environment(spark, sf_dir):
    o = corpora.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.array_join(secret_context.environment_parameters(_pick(_SOURCES, F.col("o_orderkey") % 4)), ",").alias("names"))


_PY = ["import secrets", "token = secrets.token_urlsafe(32)", "x = 1", "secrets = other()", "from a import secrets", "key: str = secrets.token_hex()", "print(secrets.token_hex(4))"]


@query(f"""WITH l AS (SELECT 'py/' || o_custkey || '.py' AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, CASE WHEN o_orderkey % 31 = 0 THEN 3 WHEN o_orderkey % 37 = 0 THEN 4 ELSE [0, 1, 2, 5, 6][1 + o_orderkey % 5] END AS k FROM orders),
f AS (SELECT path, min(line) FILTER (WHERE k = 0) AS since, bool_or(k IN (3, 4)) AS bound FROM l GROUP BY path)
SELECT l.path, l.line FROM l JOIN f USING (path) WHERE k IN (1, 5) AND NOT bound AND line > since""")
def secret_trusted_generator(spark, sf_dir):
    o, k = corpora.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.when(k % 31 == 0, 3).when(k % 37 == 0, 4).otherwise(F.get(F.array(*map(F.lit, (0, 1, 2, 5, 6))), (k % 5).cast("int")))
    line = F.row_number().over(correlation.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.select(F.concat(F.lit("py/"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"), line.cast("long").alias("line"), _pick(_PY, at).alias("text"))
    return secret_context.generator_lines(rows)


@query(f"""WITH {_OPEN_SQL}, {_CONFIG_HITS}, r AS (SELECT *, row_number() OVER (ORDER BY lower(path), path, line, start, rule_id) AS place FROM ch)
SELECT path, line, rule_id, start::BIGINT AS start, place, CASE WHEN place <= 60 THEN 'EMITTED' ELSE 'ABORTED' END AS state FROM r""")
def secret_global_cap(spark, sf_dir):
    hits = scan_queries._config_hits(spark, sf_dir)
    return secret_context.global_cap(hits, 60).select("path", "line", "rule_id", F.col("start").cast("long").alias("start"), "place", "state")


@query(r"""SELECT c_custkey, regexp_replace(replace(replace('x/' || c_name || '/token_' || md5(c_name) || '/' || c_mktsegment || '.txt', c_name, '[REDACTED]'), c_mktsegment, '[REDACTED]'), '(?i)(password|token|secret|api[_-]?key|credential)([=_:-])[^/\\]{4,}', '\1\2[REDACTED]', 'g') AS path FROM customer""")
def secret_path_masking(spark, sf_dir):
    c = corpora.table(spark, sf_dir, "customer")
    path = F.concat(F.lit("x/"), "c_name", F.lit("/token_"), F.md5("c_name"), F.lit("/"), "c_mktsegment", F.lit(".txt"))
    return c.select("c_custkey", secret_context.masked_path(path, F.array("c_name", F.lit(""), "c_mktsegment")).alias("path"))


_MARK_SQL = exprs.fingerprint_sql("'secret-finding-v1'", "'SECRET.JWT'", "path", "'4'", "'8'", "'jwt'", "label")


@query(f"""WITH x AS (SELECT c_custkey, 'p/' || (c_custkey // 3) AS path, c_mktsegment AS d, row_number() OVER (PARTITION BY c_custkey // 3 ORDER BY c_mktsegment, c_custkey) AS n FROM customer),
y AS (SELECT *, CASE WHEN n > 1 THEN 'jwt|' || d || '|' || (n - 2) ELSE 'jwt' END AS label FROM x) SELECT c_custkey, {_MARK_SQL} AS fingerprint, n > 1 AS collided FROM y""")
def secret_fingerprint_collisions(spark, sf_dir):
    c = corpora.table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.concat(F.lit("p/"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("path"), F.lit("SECRET.JWT").alias("rule_id"), F.lit(4).alias("line"), F.lit(7).alias("start"), F.lit("jwt").alias("label"), F.col("c_mktsegment").alias("d"), F.col("c_custkey").alias("ordinal"))
    return secret_context.distinct_marks(rows, F.col("d")).select("c_custkey", "fingerprint", "collided")


@query(f"""WITH {_OPEN_SQL}, {_CONFIG_HITS} SELECT path, line, rule_id, (start + 1)::BIGINT AS start_column, (start + value_length + 1)::BIGINT AS end_column, 'CWE-798' AS cwe,
  CASE WHEN rule_id = 'SECRET.PRIVATE_KEY.PEM' THEN '[REDACTED PRIVATE KEY]' WHEN rule_id = 'SECRET.CONNECTION_STRING' THEN '[REDACTED PASSWORD]' ELSE '[REDACTED CREDENTIAL]' END AS preview FROM ch""")
def secret_descriptions(spark, sf_dir):
    return secret_context.described(scan_queries._config_hits(spark, sf_dir)).select("path", "line", "rule_id", "start_column", "end_column", "cwe", "preview")


@query("""SELECT doc_id AS path, 1::BIGINT AS line, CASE WHEN doc_id % 7 = 0 THEN 'INCOMPLETE' WHEN (length(lower(text)) - length(replace(lower(text), 'token', ''))) / 5 + doc_id % 5 * 300 > 1000 THEN 'LIMIT' ELSE 'COMPLETE' END AS state
FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(10), ' '), 'secret', 'x') AS text FROM documents WHERE NOT regexp_matches(lower(text), 'passw|api[_-]?key|client|auth|private|connection|access'))""")
def secret_long_lines(spark, sf_dir):
    d = corpora.table(spark, sf_dir, "documents").where(~F.lower("text").rlike("passw|api[_-]?key|client|auth|private|connection|access"))
    flat = F.replace(F.translate(F.coalesce("text", F.lit("")), "\n", " "), F.lit("secret"), F.lit("x"))
    text = F.concat(flat, F.repeat(F.lit(" token"), (F.col("doc_id") % 5 * 300).cast("int")), F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit(" "), 5000)).otherwise(""))
    return secret_context.long_line_state(d.select(F.col("doc_id").alias("path"), F.lit(1).cast("long").alias("line"), text.alias("text")))


# The whole graph, on findings that carry packages, advisories, imports, sources and sinks.


def rich_findings(spark, sf_dir):
    """Findings of the shell files with what other scanners would add, by line."""
    f, n = scan_queries.all_findings(spark, sf_dir), F.col("line")
    user = F.regexp_extract("path", "u[0-9]+", 0)  # each file has packages of its own
    return f.withColumns({
        "category": F.when(n % 4 == 0, F.lit("sast")).when(n % 9 == 2, F.lit("import_reference")).otherwise(F.col("category")), "source_line": F.when(n % 2 == 0, F.floor(n / 3).cast("string")), "sink_kind": F.when(n % 8 == 0, F.lit("command")),
        "package": F.when(n % 5 == 1, F.concat(F.lit("Pkg"), F.floor(n / 25).cast("string"), user)), "ecosystem": F.when(n % 5 == 1, F.lit("PyPI")), "version": F.when(n % 10 == 1, F.lit("1.0")),
        "advisory_id": F.when(n % 15 == 1, F.concat(F.lit("GHSA-"), F.floor(n / 50).cast("string"))), "import_name": F.when(n % 9 == 2, F.concat(F.lit("pkg"), F.floor(n / 25).cast("string"), user)),
    })


_RICH_SQL = f"""{FINDINGS_SQL}, rich AS (SELECT * REPLACE (CASE WHEN line % 4 = 0 THEN 'sast' WHEN line % 9 = 2 THEN 'import_reference' ELSE category END AS category),
  CASE WHEN line % 2 = 0 THEN (line // 3)::VARCHAR END AS source_line, CASE WHEN line % 8 = 0 THEN 'command' END AS sink_kind, CASE WHEN line % 5 = 1 THEN 'Pkg' || (line // 25) || regexp_extract(path, 'u[0-9]+') END AS package, CASE WHEN line % 5 = 1 THEN 'PyPI' END AS ecosystem,
  CASE WHEN line % 10 = 1 THEN '1.0' END AS version, CASE WHEN line % 15 = 1 THEN 'GHSA-' || (line // 50) END AS advisory_id, CASE WHEN line % 9 = 2 THEN 'pkg' || (line // 25) || regexp_extract(path, 'u[0-9]+') END AS import_name FROM findings),
ent AS (SELECT fingerprint, confidence, 'f:' || fingerprint AS own, 'file:' || {_sid("'file-v1'", "path")} AS file, 'function:' || {_sid("'function-v1'", "path", "function_id")} AS func,
  CASE WHEN package IS NOT NULL THEN 'dependency:' || {_sid("'dependency-v1'", "ecosystem", "lower(package)", "coalesce(version, '')")} END AS dep, CASE WHEN package IS NOT NULL AND advisory_id IS NOT NULL THEN 'vulnerability:' || {_sid("'vulnerability-v1'", "advisory_id")} END AS vuln,
  CASE WHEN category = 'sast' AND source_category IS NOT NULL AND source_line IS NOT NULL THEN 'source:' || {_sid("'source-v1'", "path", "source_category", "source_line")} END AS src_node,
  CASE WHEN category = 'sast' AND sink_kind IS NOT NULL THEN 'sink:' || {_sid("'sink-v1'", "path", "line::VARCHAR", "sink_kind")} END AS sink_node FROM rich)"""
_NODES_SQL = """nd AS (SELECT own AS node_id, 'FINDING' AS kind FROM ent UNION SELECT file, 'FILE' FROM ent UNION SELECT func, 'FUNCTION' FROM ent UNION SELECT dep, 'DEPENDENCY' FROM ent WHERE dep IS NOT NULL
  UNION SELECT vuln, 'VULNERABILITY' FROM ent WHERE vuln IS NOT NULL UNION SELECT src_node, 'SOURCE' FROM ent WHERE src_node IS NOT NULL UNION SELECT sink_node, 'SINK' FROM ent WHERE sink_node IS NOT NULL)"""
_EDGES_SQL = f"""ed0 AS (SELECT 'SAME_FILE' AS edge_type, own AS src, file AS dst, 'CORRELATION.ENTITY.FILE' AS rule, 'HIGH' AS confidence FROM ent UNION ALL SELECT 'SAME_FUNCTION', own, func, 'CORRELATION.ENTITY.FUNCTION', 'HIGH' FROM ent
  UNION ALL SELECT 'SAME_DEPENDENCY', own, dep, 'CORRELATION.ENTITY.DEPENDENCY', 'HIGH' FROM ent WHERE dep IS NOT NULL UNION ALL SELECT 'SAME_VULNERABILITY', own, vuln, 'CORRELATION.ENTITY.VULNERABILITY', 'HIGH' FROM ent WHERE vuln IS NOT NULL
  UNION ALL SELECT 'SAME_SOURCE', src_node, own, 'CORRELATION.ENTITY.SOURCE', confidence FROM ent WHERE src_node IS NOT NULL UNION ALL SELECT 'SAME_SINK', own, sink_node, 'CORRELATION.ENTITY.SINK', confidence FROM ent WHERE sink_node IS NOT NULL
  UNION ALL SELECT 'SOURCE_TO_SINK', src_node, sink_node, 'CORRELATION.SAST.TRACE', confidence FROM ent WHERE src_node IS NOT NULL AND sink_node IS NOT NULL),
ed AS (SELECT DISTINCT {_sid("'edge-v1'", "edge_type", "src", "dst", "rule")} AS edge_id, edge_type, src, dst, rule FROM ed0)"""


@query(f"WITH {_RICH_SQL}, {_NODES_SQL} SELECT * FROM nd")
def graph_nodes_all_kinds(spark, sf_dir):
    return correlation.entity_nodes(scan_queries.stored(rich_findings(spark, sf_dir), "findings"))


@query(f"WITH {_RICH_SQL}, {_EDGES_SQL} SELECT edge_id, edge_type, src, dst, rule FROM ed")
def graph_edges_all_kinds(spark, sf_dir):
    f = scan_queries.stored(rich_findings(spark, sf_dir), "findings")
    return correlation.anchored_entity_edges(f).select("edge_id", "edge_type", "src", "dst", "rule")


_USE_SQL = """use0 AS (SELECT DISTINCT least('f:' || a.fingerprint, 'f:' || b.fingerprint) AS src, greatest('f:' || a.fingerprint, 'f:' || b.fingerprint) AS dst FROM rich a JOIN rich b ON lower(a.package) = lower(b.import_name) WHERE a.package IS NOT NULL AND b.import_name IS NOT NULL)"""


@query(f"""WITH {_RICH_SQL}, {_USE_SQL} SELECT {_sid("'edge-v1'", "'POSSIBLE_DEPENDENCY_USE'", "src", "dst", "'CORRELATION.DEPENDENCY.PROJECT_REFERENCE'")} AS edge_id, src, dst, 'MEDIUM' AS confidence FROM use0""")
def edges_dependency_use(spark, sf_dir):
    return correlation.dependency_use(scan_queries.stored(rich_findings(spark, sf_dir), "findings")).select("edge_id", "src", "dst", "confidence")


@query(f"""WITH {_RICH_SQL}, {_USE_SQL}, used AS (SELECT src AS node FROM use0 UNION SELECT dst FROM use0)
SELECT fingerprint, CASE WHEN 'f:' || fingerprint IN (SELECT node FROM used) THEN 'REFERENCED' ELSE 'PRESENT' END AS relevance FROM rich WHERE package IS NOT NULL""")
def dependency_relevance(spark, sf_dir):
    f = scan_queries.stored(rich_findings(spark, sf_dir), "findings")
    return correlation.dependency_relevance(f, correlation.dependency_use(f))


def _downloads(spark, sf_dir):
    f, raised = scan_queries.all_findings(spark, sf_dir), F.col("line") % 6 == 0
    return f.withColumn("rule_id", F.when(raised & (F.col("rule_id") == "BEHAVIOR.PROCESS_EXEC"), F.lit("BEHAVIOR.DOWNLOAD_EXECUTE")).when(F.col("rule_id") == "BEHAVIOR.RECURSIVE_DELETE", F.lit("BEHAVIOR.CREDENTIAL_ACCESS")).otherwise(F.col("rule_id")))


@query(f"""WITH {FINDINGS_SQL}, fx AS (SELECT * REPLACE (CASE WHEN line % 6 = 0 AND rule_id = 'BEHAVIOR.PROCESS_EXEC' THEN 'BEHAVIOR.DOWNLOAD_EXECUTE' WHEN rule_id = 'BEHAVIOR.RECURSIVE_DELETE' THEN 'BEHAVIOR.CREDENTIAL_ACCESS' ELSE rule_id END AS rule_id) FROM findings),
p1 AS (SELECT {_sid("'path-v1'", "'f:' || fingerprint")} AS path_id, 'DOWNLOAD_EXECUTE' AS title, 'f:' || fingerprint AS members, severity, 'MEDIUM' AS confidence FROM fx WHERE rule_id = 'BEHAVIOR.DOWNLOAD_EXECUTE'),
g AS (SELECT path, function_id, arg_min({{'fp': fingerprint, 'line': line}}, (line, fingerprint)) FILTER (WHERE rule_id = 'BEHAVIOR.NETWORK_REQUEST') AS n, arg_min({{'fp': fingerprint, 'line': line}}, (line, fingerprint)) FILTER (WHERE rule_id = 'BEHAVIOR.CREDENTIAL_ACCESS') AS c,
  arg_min({{'fp': fingerprint, 'line': line}}, (line, fingerprint)) FILTER (WHERE rule_id = 'BEHAVIOR.PROCESS_EXEC') AS e FROM fx GROUP BY ALL),
t AS (SELECT 'f:' || n.fp AS a, 'f:' || c.fp AS b, 'f:' || e.fp AS d FROM g WHERE n IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL AND greatest(n.line, c.line, e.line) - least(n.line, c.line, e.line) <= 5)
SELECT * FROM p1 UNION ALL SELECT {_sid("'path-v1'", "'CORRELATION.BEHAVIOR.CREDENTIAL_CLUSTER'", "a", "b", "d")}, 'CREDENTIAL', a || ',' || b || ',' || d, 'MEDIUM', 'LOW' FROM t""")
def attack_paths_download_credential(spark, sf_dir):
    return correlation.attack_paths(_downloads(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {_RICH_SQL}, {_NODES_SQL}, {_EDGES_SQL}, c AS (SELECT (SELECT count(*) FROM findings) AS f, (SELECT count(*) FROM nd) AS n, (SELECT count(*) FROM ed) AS e, (SELECT count(*) FROM findings WHERE rule_id = 'BEHAVIOR.SHELL_EXEC') AS p, (SELECT max(k) FROM (SELECT count(*) AS k FROM findings GROUP BY path, line)) AS b)
SELECT 'CORRELATION_FINDING_LIMIT' AS code, f AS n, 900::BIGINT AS allowed, f > 900 AS over FROM c UNION ALL SELECT 'CORRELATION_NODE_LIMIT', n, 20000, n > 20000 FROM c UNION ALL SELECT 'CORRELATION_EDGE_LIMIT', e, 30000, e > 30000 FROM c
UNION ALL SELECT 'CORRELATION_PATH_LIMIT', p, 100, p > 100 FROM c UNION ALL SELECT 'CORRELATION_BUCKET_LIMIT', b, 1, b > 1 FROM c""")
def correlation_budgets(spark, sf_dir):
    f = scan_queries.stored(rich_findings(spark, sf_dir), "findings")
    return correlation.budget_state(f, correlation.entity_nodes(f), correlation.entity_edges(f), f.where("rule_id = 'BEHAVIOR.SHELL_EXEC'"), {"max_findings": 900, "max_paths": 100, "bucket": 1})


@query(f"WITH {FINDINGS_SQL} SELECT CASE WHEN (SELECT count(*) FROM findings) > 5000 THEN 'ABORTED' ELSE 'PARTIAL' END AS state")
def correlation_completeness(spark, sf_dir):
    f = scan_queries.all_findings(spark, sf_dir)
    budgets = correlation.budget_state(f, f.limit(0).select(F.lit("").alias("node_id")), f.limit(0), f.limit(0), {"max_findings": 5000})
    return correlation.completeness(budgets, report.coverage(spark, [("secrets", "COMPLETE"), ("behavior", "PARTIAL")]), F.lit(0), F.lit(0))


def _spoilt(spark, sf_dir):
    n, f = F.col("line"), scan_queries.all_findings(spark, sf_dir)
    return f.withColumn("ordinal", F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 6, "0"), "rule_id", F.lpad(F.col("col").cast("string"), 6, "0"))).withColumns({
        "path": F.when(n % 7 == 0, F.concat(F.lit("/"), "path")).when(n % 11 == 0, F.concat(F.lit("token=abcdef/"), "path")).otherwise(F.col("path")), "rule_id": F.when(n % 13 == 0, F.lit("bad rule")).otherwise(F.col("rule_id")),
        "confidence": F.when(n % 17 == 0, F.lit("SURE")).otherwise(F.col("confidence")),
    })


@query(f"""WITH {FINDINGS_SQL}, x AS (SELECT *, path || ':' || lpad(line::VARCHAR, 6, '0') || ':' || rule_id || ':' || lpad(col::VARCHAR, 6, '0') AS ordinal FROM findings),
r AS (SELECT ordinal, fingerprint, path, line, CASE WHEN line % 13 = 0 THEN 'unavailable' ELSE rule_id END AS rule, CASE WHEN line % 7 = 0 THEN 'INVALID_LOCATION' WHEN line % 11 = 0 THEN 'UNREDACTED_OR_UNSAFE_PATH' WHEN line % 17 = 0 THEN 'INVALID_SEVERITY_OR_CONFIDENCE' WHEN line % 13 = 0 THEN 'INVALID_RULE_SCANNER_OR_CATEGORY' END AS reason FROM x),
b AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS k FROM r WHERE reason IS NOT NULL)
SELECT 'CORRELATION_INVALID_FINDING' AS code, 1::BIGINT AS count, CASE WHEN line % 7 = 0 THEN NULL WHEN line % 11 = 0 THEN 'token=[REDACTED]/' || path ELSE path END AS path,
  'Correlation input rejected (scanner pipeline); finding=' || fingerprint || '; rule=' || rule || '; line=' || line || '; reason=' || reason AS message FROM b WHERE k <= 100
UNION ALL SELECT 'CORRELATION_INVALID_FINDING', count(*) - 100, NULL, 'reason=DETAILS_OMITTED; attribution limit=100' FROM b HAVING count(*) > 100""")
def invalid_attribution(spark, sf_dir):
    return correlation.invalid_details(scan_queries.stored(_spoilt(spark, sf_dir), "findings"))


def _faulty(spark, sf_dir):
    """Findings with evidence, packages and advisories, each with one fault by its line."""
    n, lit = F.col("line"), F.lit
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    f = scan_queries.all_findings(spark, sf_dir)
    return f.withColumns({
        "evidence": F.when(n % 10 == 1, F.array(pair(lit("k"), lit(None).cast("string")))).when(n % 10 == 2, F.transform(F.sequence(lit(1), lit(65)), lambda i: pair(lit("k"), i.cast("string")))).otherwise(F.array(pair(lit("k"), lit("v")))),
        "package": F.when(n % 10 == 3, lit("bad name")).otherwise(lit("pkg")), "ecosystem": lit("PyPI"), "version": F.when(n % 10 == 4, lit("1 0")).otherwise(lit("1.0")), "advisory_id": F.when(n % 10 == 5, lit("bad id")),
        "fingerprint": F.when(n % 10 == 6, lit("zz")).when(n % 10 == 9, lit(None)).otherwise(F.col("fingerprint")), "line": F.when(n % 10 == 7, lit(0)).otherwise(n), "col": F.when(n % 10 == 8, lit(2_000_000)).otherwise(F.col("col")),
    })


@query(f"""WITH {FINDINGS_SQL} SELECT ['ADMITTED', 'INVALID_STRUCTURED_EVIDENCE', 'INVALID_STRUCTURED_EVIDENCE', 'INVALID_DEPENDENCY_COORDINATE', 'INVALID_DEPENDENCY_COORDINATE', 'INVALID_VULNERABILITY_REFERENCE', 'INVALID_FINGERPRINT', 'INVALID_LOCATION', 'INVALID_LOCATION', 'INVALID_IDENTITY_OR_LOCATION_TYPE'][1 + line % 10] AS reason, count(*) AS n FROM findings GROUP BY ALL""")
def finding_validation_all(spark, sf_dir):
    x = scan_queries.stored(_faulty(spark, sf_dir), "findings")
    return x.select(F.coalesce(correlation.invalid_reason(x), F.lit("ADMITTED")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# The report's parts.


@query(f"WITH {ASSESSED_SQL} SELECT fingerprint, rule_id, path, (SELECT count(*) FROM assessed) AS n_total, greatest((SELECT count(*) FROM assessed) - 300, 0) AS n_omitted FROM assessed ORDER BY fingerprint, rule_id, path LIMIT 300")
def report_findings_shown(spark, sf_dir):
    return report.shown(scan_queries.assessed(spark, sf_dir).select("fingerprint", "rule_id", "path"), ["fingerprint", "rule_id", "path"], 300)


@query(f"""WITH {ASSESSED_SQL}, c AS (SELECT 'findings' AS part, (SELECT count(*) FROM findings) AS n, 1000 AS cap UNION ALL SELECT 'risk_assessments', (SELECT count(*) FROM assessed), 1000 UNION ALL SELECT 'attack_paths', (SELECT count(*) FROM findings WHERE rule_id = 'BEHAVIOR.SHELL_EXEC'), 100)
SELECT part, n AS n_total, least(n, cap)::BIGINT AS n_shown, n > cap AS truncated FROM c""")
def report_truncation(spark, sf_dir):
    f = scan_queries.stored(scan_queries.all_findings(spark, sf_dir), "findings")
    return report.truncation({"findings": f, "risk_assessments": scan_queries.assessed(spark, sf_dir, f), "attack_paths": f.where("rule_id = 'BEHAVIOR.SHELL_EXEC'")})


@query(f"""WITH {FINDINGS_SQL}, t AS (SELECT *, 'about ' || rule_id || CASE WHEN line % 50 = 7 AND rule_id = 'BEHAVIOR.SHELL_EXEC' THEN '!' ELSE '' END AS title, 'https://rules/' || rule_id AS help_uri FROM findings)
SELECT rule_id, arg_min(title, fingerprint) AS title, arg_min(help_uri, fingerprint) AS help_uri, count(DISTINCT title) > 1 AS conflict FROM t GROUP BY rule_id""")
def rule_catalogue(spark, sf_dir):
    odd = (F.col("line") % 50 == 7) & (F.col("rule_id") == "BEHAVIOR.SHELL_EXEC")
    f = scan_queries.all_findings(spark, sf_dir).withColumns({"title": F.concat(F.lit("about "), "rule_id", F.when(odd, "!").otherwise("")), "help_uri": F.concat(F.lit("https://rules/"), "rule_id")})
    return report.catalogue(f)


_NOTES_SQL = """notes AS (SELECT ['secrets', 'sast.python', 'behavior.static'][1 + event_id % 3] AS source, CASE WHEN event_type = 'error' THEN 'LINE_TOO_LONG' ELSE 'MATCH_LIMIT' END AS code, 'svc/u' || (user_id % 20) AS path, 'note ' || event_type AS message FROM events)"""


@query(f"""WITH {_NOTES_SQL}, d AS (SELECT source, code, CASE WHEN source <> 'secrets' THEN path END AS place, min({{'path': path, 'message': message}}) AS m, count(*) AS count FROM notes GROUP BY ALL)
SELECT source, code, m.path AS path, m.message AS message, count FROM d""")
def report_diagnostics(spark, sf_dir):
    e = corpora.table(spark, sf_dir, "events")
    notes = e.select(_pick(["secrets", "sast.python", "behavior.static"], F.col("event_id") % 3).alias("source"), F.when(F.col("event_type") == "error", "LINE_TOO_LONG").otherwise("MATCH_LIMIT").alias("code"), F.concat(F.lit("svc/u"), (F.col("user_id") % 20).cast("string")).alias("path"), F.concat(F.lit("note "), "event_type").alias("message"))
    return report.diagnostics(notes)


@query("""WITH f AS (SELECT ['secrets', 'behavior.static', 'sast.python'][1 + o_orderkey % 3] AS scanner_id, o_orderkey AS size_bytes, CASE WHEN o_orderkey % 10 = 0 THEN 'SKIPPED' WHEN o_orderkey % 33 = 0 THEN 'LIMIT' ELSE 'SCANNED' END AS state FROM orders),
h AS (SELECT ['secrets', 'behavior.static'][1 + event_id % 2] AS scanner_id, ['EMITTED', 'SUPPRESSED', 'DUPLICATE', 'LIMIT'][1 + user_id % 4] AS fate FROM events),
a AS (SELECT scanner_id, count(*) AS considered, count(*) FILTER (WHERE state = 'SCANNED') AS scanned, count(*) FILTER (WHERE state <> 'SCANNED') AS skipped, coalesce(sum(size_bytes) FILTER (WHERE state = 'SCANNED'), 0)::BIGINT AS bytes, count(*) FILTER (WHERE state = 'LIMIT') AS file_limits FROM f GROUP BY scanner_id),
b AS (SELECT scanner_id, count(*) AS candidates, count(*) FILTER (WHERE fate = 'EMITTED') AS emitted, count(*) FILTER (WHERE fate = 'SUPPRESSED') AS suppressed, count(*) FILTER (WHERE fate = 'DUPLICATE') AS duplicates, count(*) FILTER (WHERE fate = 'LIMIT') AS hit_limits FROM h GROUP BY scanner_id)
SELECT scanner_id, considered, scanned, skipped, bytes, coalesce(candidates, 0) AS candidates, coalesce(emitted, 0) AS emitted, coalesce(suppressed, 0) AS suppressed, coalesce(duplicates, 0) AS duplicates, file_limits + coalesce(hit_limits, 0) AS limits_hit,
  CASE WHEN file_limits + coalesce(hit_limits, 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM a LEFT JOIN b USING (scanner_id)""")
def scanner_summaries(spark, sf_dir):
    o, e = corpora.table(spark, sf_dir, "orders"), corpora.table(spark, sf_dir, "events")
    files = o.select(_pick(["secrets", "behavior.static", "sast.python"], F.col("o_orderkey") % 3).alias("scanner_id"), F.col("o_orderkey").alias("size_bytes"), F.when(F.col("o_orderkey") % 10 == 0, "SKIPPED").when(F.col("o_orderkey") % 33 == 0, "LIMIT").otherwise("SCANNED").alias("state"))
    hits = e.select(_pick(["secrets", "behavior.static"], F.col("event_id") % 2).alias("scanner_id"), _pick(["EMITTED", "SUPPRESSED", "DUPLICATE", "LIMIT"], F.col("user_id") % 4).alias("fate"))
    return report.scanner_summaries(files, hits)


_URIS = ["https://a.example/p", "http://b/x?y=1", "ftp://c/", "https://u:p@d/", "https://e/#f", "HTTPS://F.example", "https:///x", "https://g/token=abcdef"]


@query(f"SELECT page_id, {_LIST(['https://a.example/p', '', '', '', '', 'HTTPS://F.example', '', 'https://g/token=[REDACTED]'])}[1 + page_id % 8] AS uri, {_LIST(['https://[HOST]', 'http://[HOST]?[1 REDACTED QUERY FIELDS]', 'ftp://[HOST]', 'https://[USER]:[REDACTED]@[HOST]', 'https://[HOST]', 'https://[HOST]', '[REDACTED URL]', 'https://[HOST]'])}[1 + page_id % 8] AS shape FROM pages")
def uri_safety(spark, sf_dir):
    p, u = corpora.table(spark, sf_dir, "pages"), _pick(_URIS, F.col("page_id") % 8)
    return p.select("page_id", F.coalesce(report.safe_uri(u), F.lit("")).alias("uri"), report.url_shape(u).alias("shape"))


@query(f"""WITH {ASSESSED_SQL}, m AS (SELECT DISTINCT substr(src, 3) AS fingerprint, substr(dst, 3) AS primary_fp FROM support), mm AS (SELECT fingerprint, max(primary_fp) AS owner FROM m GROUP BY fingerprint)
SELECT f.fingerprint, f.severity, CASE WHEN mm.owner IS NULL THEN 'primary' ELSE 'supporting' END AS role, a.priority, CASE WHEN f.line % 5 = 0 THEN 'LIKELY' END AS verdict,
  CASE WHEN coalesce(mm.owner, f.fingerprint) IN (SELECT fingerprint FROM findings WHERE line % 2 = 0) THEN substr(sha256('remediation-v1:' || coalesce(mm.owner, f.fingerprint)), 1, 24) END AS proposal_id, f.path, f.line FROM findings f LEFT JOIN mm USING (fingerprint) LEFT JOIN assessed a USING (fingerprint)""")
def report_view(spark, sf_dir):
    f = scan_queries.stored(scan_queries.all_findings(spark, sf_dir), "findings")
    support = scan_queries.stored(correlation.supports(f), "support")
    members = support.select(F.substring("src", 3, 64).alias("fingerprint"), F.substring("dst", 3, 64).alias("primary"), F.lit("supporting").alias("role")).distinct()
    priorities = scan_queries.assessed(spark, sf_dir, f, support).select("fingerprint", "priority")
    reviews = f.where("line % 5 = 0").select("fingerprint", F.lit("LIKELY").alias("verdict"))
    proposals = f.where("line % 2 = 0").select("fingerprint", F.substring(F.sha2(F.concat(F.lit("remediation-v1:"), "fingerprint"), 256), 1, 24).alias("proposal_id"))
    return report.report_view(f, members, priorities, reviews, proposals).select("fingerprint", "severity", "role", "priority", "verdict", "proposal_id", "path", "line")


@query(f"""WITH {ASSESSED_SQL}, s AS (SELECT s AS severity, count(a.severity) AS n FROM (SELECT unnest(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS s) LEFT JOIN assessed a ON a.severity = s GROUP BY s), p AS (SELECT priority, count(*) AS n FROM assessed GROUP BY priority),
v AS (SELECT '{{"fingerprint":"' || fingerprint || '","rule_id":"' || rule_id || '","path":"' || path || '","line":' || line || ',"severity":"' || severity || '","confidence":"' || confidence || '","priority":"' || priority || '"}}' AS j, row_number() OVER (ORDER BY fingerprint, rule_id, path) AS k, fingerprint FROM assessed)
SELECT '{{"coverage":{{"overall":"PARTIAL"}},"findings":[' || (SELECT string_agg(j, ',' ORDER BY k) FROM v WHERE k <= 100) || '],"report_truncated":' || ((SELECT count(*) FROM assessed) > 100)::VARCHAR || ',"schema_version":"1.1","summary":{{"counts":{{"risk_priority":[' || (SELECT string_agg('{{"priority":"' || priority || '","n":' || n || '}}', ',' ORDER BY priority) FROM p)
  || '],"rendered_findings":' || (SELECT least(count(*), 100) FROM assessed) || ',"severity":[' || (SELECT string_agg('{{"severity":"' || severity || '","n":' || n || '}}', ',' ORDER BY severity) FROM s) || '],"total_findings":' || (SELECT count(*) FROM assessed) || '}}}}}}' AS json""")
def report_document(spark, sf_dir):
    return report.report_document(scan_queries.assessed(spark, sf_dir), spark.createDataFrame([("PARTIAL",)], "overall string"), 100)


@query(f"""WITH {ASSESSED_SQL} SELECT fingerprint FROM assessed WHERE severity IN ('MEDIUM', 'HIGH') AND priority = 'medium' AND contains(lower(concat_ws(' ', rule_id, path)), 'exec')""")
def finding_filter(spark, sf_dir):
    return report.matching(scan_queries.assessed(spark, sf_dir), severity=["MEDIUM", "HIGH"], priority=["medium"], text="EXEC").select("fingerprint")
