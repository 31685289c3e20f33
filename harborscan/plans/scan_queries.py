"""Queries of discovery, secrets, behaviour, correlation, report and gate over the derived corpora, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborscan.functions import exprs
from harborscan.functions.scratch import stored
from harborscan.operators import admission, behavior_rules, correlation, discovery, report, secret_rules
from harborscan.sources import corpora
from harborscan.sources.corpora import ARTIFACTS_SQL, CODE_LINES_SQL, CONFIG_LINES_SQL, SCRIPT_LINES_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _case(pairs, column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"


@query(f"""WITH {ARTIFACTS_SQL},
a AS (SELECT path, coalesce(strlen(text), 0) AS size_bytes, len(string_split(path, '/')) AS depth, regexp_extract(lower(path), '\\.([^./]+)$', 1) AS suffix FROM artifacts)
SELECT *, CASE suffix WHEN 'html' THEN 'html' WHEN 'md' THEN 'markdown' END AS language, CASE WHEN suffix IN ('txt', 'md') THEN 'DOCUMENTATION' ELSE 'UNKNOWN' END AS kind FROM a""")
def artifact_inventory(spark, sf_dir):
    return discovery.inventory(corpora.artifacts(spark, sf_dir))


_SCOPE_NAMES = [(n, s) for s, names in discovery.SCOPE.items() for n in names] + [("src", None), ("lib", None)]


@query(f"""WITH p AS (SELECT p_partkey, [{', '.join(f"'{n}'" for n, _ in _SCOPE_NAMES)}][1 + p_partkey % {len(_SCOPE_NAMES)}] AS folder FROM part),
q AS (SELECT CASE WHEN p_partkey % 29 = 0 THEN 'app/coverage.xml' WHEN p_partkey % 31 = 0 THEN 'app/x' || p_partkey || '.tsbuildinfo' WHEN p_partkey % 37 = 0 THEN 'keep/build/a' || p_partkey || '.py' ELSE 'app/' || folder || '/m' || p_partkey || '.py' END AS path FROM p)
SELECT path, CASE WHEN starts_with(path, 'keep/') THEN NULL WHEN path LIKE 'app/%/%' THEN {_case([(n, 'EXCLUDED_DEFAULT_' + discovery.SCOPE_REASON[s]) for n, s in _SCOPE_NAMES if s], "string_split(path, '/')[2]")}
  ELSE 'EXCLUDED_DEFAULT_GENERATED' END AS reason FROM q""")
def scope_exclusions(spark, sf_dir):
    p, n = corpora.table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    k = F.col("p_partkey")
    folder = F.get(F.array(*(F.lit(x) for x, _ in _SCOPE_NAMES)), (k % len(_SCOPE_NAMES)).cast("int"))
    path = F.when(k % 29 == 0, F.lit("app/coverage.xml")).when(k % 31 == 0, F.concat(F.lit("app/x"), n, F.lit(".tsbuildinfo"))).when(k % 37 == 0, F.concat(F.lit("keep/build/a"), n, F.lit(".py"))).otherwise(F.concat(F.lit("app/"), folder, F.lit("/m"), n, F.lit(".py")))
    return p.select(path.alias("path")).select("path", discovery.scope_of(F.col("path"), include=["keep/"]).alias("reason"))


@query(f"""WITH {ARTIFACTS_SQL}, a AS (SELECT path, coalesce(strlen(text), 0) AS size_bytes FROM artifacts),
r AS (SELECT *, sum(CASE WHEN size_bytes <= 50000 THEN size_bytes ELSE 0 END) OVER (ORDER BY lower(path), path)::BIGINT AS running_bytes FROM a)
SELECT *, CASE WHEN size_bytes > 50000 THEN 'SKIPPED_SIZE' WHEN running_bytes > 1000000 THEN 'ABORTED_BUDGET' ELSE 'ADMITTED' END AS state FROM r""")
def artifact_budget_admission(spark, sf_dir):
    files = corpora.artifacts(spark, sf_dir).select("path", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"))
    return discovery.admitted(files, 50_000, 1_000_000)


_LINES = """l AS (SELECT path, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line, len(string_split(coalesce(text, ''), chr(10))) AS n FROM artifacts),
lines AS (SELECT path, line, text, strlen(text) + CASE WHEN line < n THEN 1 ELSE 0 END AS n_bytes FROM l WHERE NOT (line = n AND text = ''))"""


@query(f"""WITH {ARTIFACTS_SQL}, {_LINES}
SELECT a.path, count(l.path) AS n_lines, coalesce(max(n_bytes), 0) AS max_line_bytes, count(*) FILTER (WHERE n_bytes > 16384) AS long_lines
FROM artifacts a LEFT JOIN lines l ON a.path = l.path GROUP BY a.path""")
def line_explosion_profile(spark, sf_dir):
    return discovery.line_profile(corpora.artifacts(spark, sf_dir))


@query(f"""WITH {CODE_LINES_SQL}, {CONFIG_LINES_SQL}, w AS (SELECT DISTINCT text FROM code_lines UNION SELECT text FROM config_lines),
c AS (SELECT text, unnest(string_split(text, '')) AS ch FROM w WHERE text <> ''), f AS (SELECT text, ch, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT text, sum(n) AS total FROM f GROUP BY text)
SELECT text, round(sum(-(n / total) * log2(n / total)), 6) AS bits FROM f JOIN t USING (text) GROUP BY text""")
def shannon_entropy_lines(spark, sf_dir):
    rows = corpora.code_lines(spark, sf_dir).select("text").unionAll(corpora.config_lines(spark, sf_dir).select("text")).distinct()
    return rows.select("text", exprs.entropy(F.col("text")).alias("bits"))


_BITS = "(SELECT round(sum(-(n / length(value)) * log2(n / length(value))), 6) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(value, '')) AS ch) GROUP BY ch))"
_CONTEXT = r"(?i)(^|[^\p{L}\p{N}_])(api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|password|passwd|secret|token|bearer)($|[^\p{L}\p{N}_])"
_HASHES = r"(?i)(^|[^\p{L}\p{N}_])(sha\d*|checksum|digest|integrity|commit|etag|hash)($|[^\p{L}\p{N}_])"


@query(f"""WITH {ARTIFACTS_SQL}, {_LINES},
c AS (SELECT path, line, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_-]+') AS m, string_split_regex(text, '[\\p{{L}}\\p{{N}}_-]+') AS g FROM lines WHERE n_bytes <= 16385 AND regexp_matches(text, '{_CONTEXT}') AND NOT regexp_matches(text, '{_HASHES}')),
s AS (SELECT path, line, text, unnest(m) AS value, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))) AS start FROM c),
e AS (SELECT * FROM s WHERE regexp_full_match(value, '[A-Za-z0-9_-]{{20,128}}') AND regexp_matches(substr(text, greatest(start - 40, 0)::BIGINT + 1, (start - greatest(start - 40, 0))::BIGINT), '{_CONTEXT}'))
SELECT path, line, start::BIGINT AS start, length(value) AS value_length FROM e WHERE {_BITS} >= 3.5""")
def secret_entropy_context(spark, sf_dir):
    files = corpora.artifacts(spark, sf_dir).withColumn("file_bytes", F.octet_length("text"))
    hits = secret_rules.detect(discovery.lines(files, "file_bytes"), [secret_rules.entropy_candidates])
    return hits.select("path", "line", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"))


@query(f"""WITH {CODE_LINES_SQL}, a AS (SELECT path, line, regexp_extract(text, '^password = ''([^'']*)''$', 1) AS value FROM code_lines WHERE text LIKE 'password = %')
SELECT path, line, 'password' AS label, 12::BIGINT AS start, length(value) AS value_length, 'MEDIUM' AS severity,
       CASE WHEN length(value) >= 16 AND {_BITS} >= 3.2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM a""")
def secret_assignment_candidates(spark, sf_dir):
    hits = secret_rules.detect(corpora.code_lines(spark, sf_dir), [secret_rules.assignment_candidates])
    return hits.select("path", "line", "label", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"), "severity", "confidence")


_OPEN_SQL = f"""{CONFIG_LINES_SQL}, ko AS (SELECT path, line, text, CASE WHEN text LIKE '%BEGIN RSA%' THEN 'B' WHEN text LIKE '%END RSA%' THEN 'E' END AS mark FROM config_lines),
ki AS (SELECT path, line, text, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'B', false) AS inside FROM ko),
open_lines AS (SELECT path, line, text FROM ki WHERE NOT inside)"""
_STARTS = "unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)))"


def _matches(source: str, rules: list[tuple[str, str]], keep: str = "") -> str:
    """SQL for path, line, rule_id, start and value of all matches of each rule."""
    parts = [f"SELECT path, line, '{rule}' AS rule_id, {order} AS rule_order, text, unnest(m) AS value, {_STARTS} AS start FROM (SELECT path, line, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM {source} WHERE regexp_matches(text, '{p}') {keep})" for order, (rule, p) in enumerate(rules)]
    return " UNION ALL ".join(parts)


@query(f"""WITH {_OPEN_SQL}, m AS ({_matches("open_lines", [(r, p) for r, _, p, _, _ in secret_rules.PROVIDERS])})
SELECT path, line, rule_id, start::BIGINT AS start, length(value) AS value_length FROM m""")
def secret_provider_tokens(spark, sf_dir):
    hits = secret_rules.detect(corpora.config_lines(spark, sf_dir), [secret_rules.provider_candidates])
    return hits.select("path", "line", "rule_id", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"))


@query(f"""WITH {_OPEN_SQL} SELECT path, line, 'postgres' AS label, 18::BIGINT AS start, 12::BIGINT AS value_length FROM open_lines WHERE text LIKE 'db postgres://%'""")
def secret_connection_strings(spark, sf_dir):
    hits = secret_rules.detect(corpora.config_lines(spark, sf_dir), [secret_rules.connection_candidates])
    return hits.select("path", "line", "label", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"))


@query(f"""WITH {_OPEN_SQL} SELECT path, line, 4::BIGINT AS start, length(text) - 4 AS value_length FROM open_lines
WHERE starts_with(text, 'jwt ') AND json_type(decode(from_base64(rpad(string_split(substr(text, 5), '.')[1], 24, '=')))) = 'OBJECT'""")
def secret_jwt(spark, sf_dir):
    hits = secret_rules.detect(corpora.config_lines(spark, sf_dir), [secret_rules.jwt_candidates])
    return hits.select("path", "line", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"))


@query(f"""WITH {CONFIG_LINES_SQL}, k AS (SELECT path, line, CASE WHEN text LIKE '%BEGIN RSA%' THEN 'B' WHEN text LIKE '%END RSA%' THEN 'E' END AS mark FROM config_lines)
SELECT path, line, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'B', false) AS inside_key FROM k""")
def secret_pem_blocks(spark, sf_dir):
    return secret_rules.outside_key_blocks(corpora.config_lines(spark, sf_dir)).select("path", "line", "inside_key")


def _config_hits(spark, sf_dir):
    return secret_rules.detect(corpora.config_lines(spark, sf_dir))


_CONFIG_HITS = f"""cm AS ({_matches("open_lines", [(r, p) for r, _, p, _, _ in secret_rules.PROVIDERS])}),
ch AS (SELECT path, line, rule_id, start, length(value) AS value_length FROM cm
  UNION ALL SELECT path, line, 'SECRET.CONNECTION_STRING', 18, 12 FROM open_lines WHERE text LIKE 'db postgres://%'
  UNION ALL SELECT path, line, 'SECRET.JWT', 4, length(text) - 4 FROM open_lines WHERE starts_with(text, 'jwt ')
  UNION ALL SELECT path, line, 'SECRET.PRIVATE_KEY.PEM', 0, 31 FROM open_lines WHERE text LIKE '-----BEGIN%'
  UNION ALL SELECT path, line, 'SECRET.GENERIC.ASSIGNMENT', 24, 36 FROM open_lines WHERE starts_with(text, 'aws_secret_access_key'))"""


@query(f"""WITH {_OPEN_SQL}, {_CONFIG_HITS} SELECT path, line, rule_id, start::BIGINT AS start, value_length::BIGINT AS value_length FROM ch""")
def secret_overlap_dedupe(spark, sf_dir):
    return _config_hits(spark, sf_dir).select("path", "line", "rule_id", F.col("start").cast("long").alias("start"), F.col("value_length").cast("long").alias("value_length"))


@query(f"""WITH {_OPEN_SQL}, {_CONFIG_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY line, start) AS n FROM ch),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, start, rule_id) AS k FROM r WHERE n <= 5)
SELECT path, line, rule_id, start::BIGINT AS start FROM f WHERE k <= 20""")
def secret_caps(spark, sf_dir):
    return secret_rules.capped(_config_hits(spark, sf_dir), per_rule=5, per_file=20).select("path", "line", "rule_id", F.col("start").cast("long").alias("start"))


@query(f"""WITH {_OPEN_SQL}, i AS (SELECT path, line FROM open_lines WHERE starts_with(text, 'id: AKIA')), s AS (SELECT path, line FROM open_lines WHERE starts_with(text, 'aws_secret'))
SELECT path, line, 'aws_access_key_id' AS label, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.path = i.path AND abs(s.line - i.line) <= 5) THEN 'HIGH' ELSE 'LOW' END AS severity,
  CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.path = i.path AND abs(s.line - i.line) <= 5) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM i
UNION ALL SELECT path, line, 'aws_secret_access_key', 'HIGH', 'HIGH' FROM s""")
def secret_aws_proximity(spark, sf_dir):
    return secret_rules.near_pairs(_config_hits(spark, sf_dir)).where("label LIKE 'aws%'").select("path", "line", "label", "severity", "confidence")


def _secret_findings(spark, sf_dir):
    return secret_rules.findings(secret_rules.detect(corpora.code_lines(spark, sf_dir)))


_SECRETS_SQL = f"""sf AS (SELECT {exprs.fingerprint_sql("'secret-finding-v1'", "'SECRET.GENERIC.ASSIGNMENT'", "path", "line::VARCHAR", "'13'", "'password'", "'password'")} AS fingerprint,
  'secrets' AS scanner_id, 'secret' AS category, 'SECRET.GENERIC.ASSIGNMENT' AS rule_id, path, line, 13::BIGINT AS col, 'MEDIUM' AS severity,
  CASE WHEN length(value) >= 16 AND {_BITS} >= 3.2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM (SELECT path, line, regexp_extract(text, '^password = ''([^'']*)''$', 1) AS value FROM code_lines WHERE text LIKE 'password = %'))"""


@query(f"WITH {CODE_LINES_SQL}, {_SECRETS_SQL} SELECT * FROM sf")
def secret_findings(spark, sf_dir):
    return _secret_findings(spark, sf_dir).drop("label", "value_length")


@query(rf"""WITH {CONFIG_LINES_SQL}, p AS (SELECT 'x/' || replace(text, '/', '_') || '/y' AS path FROM config_lines)
SELECT path, regexp_replace({'regexp_replace(' * 6}path{''.join(f", '{t}', '[REDACTED]', 'g')" for t in exprs.TOKEN_SHAPES)}, '{exprs.PATH_ASSIGNMENT.replace('{4,}', '{4,}')}', '\1\2[REDACTED]', 'g') AS safe FROM p""")
def path_redaction(spark, sf_dir):
    rows = corpora.config_lines(spark, sf_dir).select(F.concat(F.lit("x/"), F.translate("text", "/", "_"), F.lit("/y")).alias("path"))
    return rows.select("path", exprs.redact_path(F.col("path")).alias("safe"))


def _text_sql(column: str) -> str:
    q = lambda p: p.replace("'", "''")
    out = f"regexp_replace({column}, '{q(exprs.TEXT_URL)}', '[REDACTED URL]', 'g')"
    out = f"regexp_replace({out}, '{q(exprs.TEXT_AUTH)}', '\\1[REDACTED]', 'g')"
    out = f"regexp_replace({out}, '{q(exprs.TEXT_BEARER)}', 'Bearer [REDACTED]', 'g')"
    out = f"regexp_replace({out}, '{'|'.join(exprs.TOKEN_SHAPES)}', '[REDACTED TOKEN]', 'g')"
    return f"regexp_replace({out}, '{q(exprs.TEXT_ASSIGNMENT)}', '\\1=[REDACTED]', 'g')"


@query(f"WITH {CONFIG_LINES_SQL} SELECT path, line, {_text_sql('text')} AS safe FROM config_lines")
def text_redaction(spark, sf_dir):
    return corpora.config_lines(spark, sf_dir).select("path", "line", exprs.redact_text(F.col("text")).alias("safe"))


@query(f"SELECT doc_id, {exprs.fingerprint_sql(chr(39) + 'v1' + chr(39), 'lang', 'source', "coalesce(text, '')")} AS mark FROM documents")
def finding_fingerprint(spark, sf_dir):
    d = corpora.table(spark, sf_dir, "documents")
    return d.select("doc_id", exprs.fingerprint("v1", F.col("lang"), F.col("source"), F.coalesce("text", F.lit(""))).alias("mark"))


def _shell_hits(spark, sf_dir):
    return behavior_rules.hits(corpora.code_lines(spark, sf_dir).withColumn("language", F.lit("shell")))


def _rules_sql(language: str) -> list[tuple[str, str]]:
    return [("BEHAVIOR." + r, "(?i)" + p.replace("(?<!\\w)", "").replace("'", "''")) for r, p in behavior_rules.RULES[language]]


_SHELL_SQL = f"""bm AS ({_matches("code_lines", _rules_sql("shell"))}), bh AS (SELECT path, line, (start + 1)::BIGINT AS col, rule_id, rule_order, CASE WHEN contains(text, '"') OR contains(text, '''') THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM bm)"""


@query(f"WITH {CODE_LINES_SQL}, {_SHELL_SQL} SELECT path, line, col, rule_id, confidence FROM bh")
def behavior_shell_rules(spark, sf_dir):
    return _shell_hits(spark, sf_dir).drop("rule_order")


_KEEP = "AND NOT (starts_with(text, '#') OR starts_with(text, '//') OR starts_with(text, 'REM '))"
_SCRIPT_SQL = " UNION ALL ".join(_matches(f"(SELECT * FROM script_lines WHERE language = '{g}')", _rules_sql(g), _KEEP) for g in ("powershell", "batch", "javascript"))


@query(f"""WITH {SCRIPT_LINES_SQL}, m AS ({_SCRIPT_SQL})
SELECT path, line, (start + 1)::BIGINT AS col, rule_id, CASE WHEN contains(text, '"') OR contains(text, '''') THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM m""")
def behavior_script_rules(spark, sf_dir):
    return behavior_rules.hits(corpora.script_lines(spark, sf_dir)).drop("rule_order")


@query(f"""WITH {SCRIPT_LINES_SQL}, d AS (SELECT path, min(line) AS since, regexp_extract(text, '-OutFile (\\S+)', 1) AS target FROM script_lines WHERE text LIKE 'Invoke-WebRequest%' GROUP BY ALL),
r AS (SELECT path, line, regexp_extract(text, 'Start-Process (\\S+)', 1) AS target FROM script_lines WHERE text LIKE 'Start-Process%')
SELECT path, line, target FROM r JOIN d USING (path, target) WHERE since <= line""")
def behavior_download_execute(spark, sf_dir):
    return behavior_rules.download_execute(corpora.script_lines(spark, sf_dir))


@query(f"""WITH {SCRIPT_LINES_SQL}, d AS (SELECT path, min(line) AS since, regexp_extract(text, '-OutFile (\\S+)', 1) AS target FROM script_lines WHERE text LIKE 'Invoke-WebRequest%' GROUP BY ALL),
r AS (SELECT DISTINCT s.path, s.line FROM script_lines s JOIN d ON s.path = d.path AND regexp_extract(s.text, 'Start-Process (\\S+)', 1) = d.target WHERE s.text LIKE 'Start-Process%' AND since <= line)
SELECT {exprs.fingerprint_sql("'static-finding-v1'", "'BEHAVIOR.DOWNLOAD_EXECUTE'", "path", "line::VARCHAR", "'1'", "'text'")} AS fingerprint, path, line, 'MEDIUM' AS severity, 'MEDIUM' AS confidence FROM r""")
def behavior_download_findings(spark, sf_dir):
    found = behavior_rules.findings(behavior_rules.download_hits(corpora.script_lines(spark, sf_dir)))
    return found.select("fingerprint", "path", "line", "severity", "confidence")


@query(f"""WITH {CODE_LINES_SQL}, {_SHELL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, rule_order, col) AS k FROM bh)
SELECT path, rule_id, line, col, confidence FROM n WHERE k <= 30""")
def behavior_dedupe_caps(spark, sf_dir):
    return behavior_rules.deduplicated(behavior_rules.capped(_shell_hits(spark, sf_dir), per_file=30))


# Correlation: findings of the derived shell files; functions are blocks of ten lines, sources follow the line.


def all_findings(spark, sf_dir):
    found = _secret_findings(spark, sf_dir).unionByName(behavior_rules.findings(_shell_hits(spark, sf_dir)))
    return found.withColumns({"function_id": F.concat(F.lit("f"), F.floor(F.col("line") / 10).cast("string")), "source_category": F.when(F.col("line") % 3 == 0, F.lit("HTTP_INPUT"))}).drop("label", "value_length")


def made_findings(spark, sf_dir):
    """The same, made once and stored, for plans that read them several times."""
    return stored(all_findings(spark, sf_dir), "findings")


_SEVERITY_SQL = _case([("BEHAVIOR." + r, s) for r, s in behavior_rules.SEVERITY.items()], "rule_id")
FINDINGS_SQL = f"""{CODE_LINES_SQL}, {_SECRETS_SQL}, {_SHELL_SQL},
fs AS (SELECT * FROM sf UNION ALL SELECT {exprs.fingerprint_sql("'static-finding-v1'", "rule_id", "path", "line::VARCHAR", "col::VARCHAR", "'text'")}, 'behavior.static', 'behavior', rule_id, path, line, col, {_SEVERITY_SQL}, confidence FROM bh),
findings AS (SELECT *, 'f' || (line // 10) AS function_id, CASE WHEN line % 3 = 0 THEN 'HTTP_INPUT' END AS source_category FROM fs)"""


@query(f"""WITH {FINDINGS_SQL}, x AS (SELECT * REPLACE (CASE WHEN line % 7 = 0 THEN '/' || path WHEN line % 11 = 0 THEN NULL ELSE path END AS path, CASE WHEN line % 13 = 0 THEN upper(fingerprint) || 'X' ELSE fingerprint END AS fingerprint, CASE WHEN line % 17 = 0 THEN 'NONE' ELSE severity END AS severity) FROM findings)
SELECT coalesce(CASE WHEN path IS NULL THEN 'INVALID_IDENTITY_OR_LOCATION_TYPE' WHEN NOT regexp_full_match(fingerprint, '[0-9a-f]{{64}}') THEN 'INVALID_FINGERPRINT' WHEN path IS NULL OR starts_with(path, '/') THEN 'INVALID_LOCATION' WHEN severity = 'NONE' THEN 'INVALID_SEVERITY_OR_CONFIDENCE' END, 'ADMITTED') AS reason, count(*) AS n FROM x GROUP BY ALL""")
def finding_validation(spark, sf_dir):
    x = all_findings(spark, sf_dir).withColumns({
        "path": F.when(F.col("line") % 7 == 0, F.concat(F.lit("/"), "path")).when(F.col("line") % 11 == 0, F.lit(None)).otherwise(F.col("path")),
        "fingerprint": F.when(F.col("line") % 13 == 0, F.concat(F.upper("fingerprint"), F.lit("X"))).otherwise(F.col("fingerprint")),
        "severity": F.when(F.col("line") % 17 == 0, F.lit("NONE")).otherwise(F.col("severity")),
    })
    return x.select(F.coalesce(correlation.invalid_reason(x), F.lit("ADMITTED")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {FINDINGS_SQL}, x AS (SELECT * FROM findings UNION ALL SELECT * FROM findings WHERE line % 2 = 0 UNION ALL SELECT * REPLACE (line + 1 AS line) FROM findings WHERE line % 5 = 0)
SELECT fingerprint, min(line) AS line, count(DISTINCT line) - 1 AS n_collisions, count(*) - count(DISTINCT line) AS n_duplicates FROM x GROUP BY fingerprint""")
def finding_ingest_dedupe(spark, sf_dir):
    f = made_findings(spark, sf_dir)
    x = f.unionByName(f.where("line % 2 = 0")).unionByName(f.where("line % 5 = 0").withColumn("line", F.col("line") + 1))
    return correlation.ingested(x).select("fingerprint", "line", "n_collisions", "n_duplicates")


def _sid(*fields: str) -> str:
    return f"substr({exprs.fingerprint_sql(*fields)}, 1, 24)"


@query(f"""WITH {FINDINGS_SQL} SELECT DISTINCT 'f:' || fingerprint AS node_id, 'FINDING' AS kind FROM findings
UNION SELECT 'file:' || {_sid("'file-v1'", "path")}, 'FILE' FROM findings UNION SELECT 'function:' || {_sid("'function-v1'", "path", "function_id")}, 'FUNCTION' FROM findings""")
def graph_nodes(spark, sf_dir):
    return correlation.entity_nodes(made_findings(spark, sf_dir))


@query(f"""WITH {FINDINGS_SQL}, e AS (SELECT 'SAME_FILE' AS edge_type, 'f:' || fingerprint AS src, 'file:' || {_sid("'file-v1'", "path")} AS dst, 'CORRELATION.ENTITY.FILE' AS rule FROM findings
UNION ALL SELECT 'SAME_FUNCTION', 'f:' || fingerprint, 'function:' || {_sid("'function-v1'", "path", "function_id")}, 'CORRELATION.ENTITY.FUNCTION' FROM findings)
SELECT DISTINCT {_sid("'edge-v1'", "edge_type", "src", "dst", "rule")} AS edge_id, edge_type, src, dst, 'HIGH' AS confidence, rule FROM e""")
def graph_edges_entity(spark, sf_dir):
    return correlation.entity_edges(made_findings(spark, sf_dir))


_ADDED_SQL = f"""added AS (SELECT fingerprint, 0 AS step, 'f:' || fingerprint AS id, 'FINDING' AS kind, NULL AS src FROM findings
  UNION ALL SELECT fingerprint, 1, 'file:' || {_sid("'file-v1'", "path")}, 'FILE', NULL FROM findings
  UNION ALL SELECT fingerprint, 2, {_sid("'edge-v1'", "'SAME_FILE'", "'f:' || fingerprint", "'file:' || " + _sid("'file-v1'", "path"), "'CORRELATION.ENTITY.FILE'")}, 'SAME_FILE', fingerprint FROM findings
  UNION ALL SELECT fingerprint, 3, 'function:' || {_sid("'function-v1'", "path", "function_id")}, 'FUNCTION', NULL FROM findings
  UNION ALL SELECT fingerprint, 4, {_sid("'edge-v1'", "'SAME_FUNCTION'", "'f:' || fingerprint", "'function:' || " + _sid("'function-v1'", "path", "function_id"), "'CORRELATION.ENTITY.FUNCTION'")}, 'SAME_FUNCTION', fingerprint FROM findings),
placed AS (SELECT id, kind, src IS NOT NULL AS edge, fingerprint, step, row_number() OVER (PARTITION BY src IS NOT NULL ORDER BY fingerprint, step) AS place FROM (SELECT id, any_value(kind) AS kind, any_value(src) AS src, min(fingerprint) AS fingerprint, arg_min(step, (fingerprint, step)) AS step FROM added GROUP BY id))"""


@query(f"""WITH {FINDINGS_SQL}, {_ADDED_SQL}, stop AS (SELECT arg_min(fingerprint, place) AS fp, arg_min(step, place) AS st FROM placed WHERE NOT edge AND place = 301)
SELECT p.id, p.kind, p.place, stop.fp IS NOT NULL AS ended FROM placed p, stop WHERE (NOT edge AND place <= 300) OR (edge AND (stop.fp IS NULL OR (p.fingerprint, p.step) < (stop.fp, stop.st)))""")
def graph_node_budget(spark, sf_dir):
    """Nodes and entity edges of a graph of at most 300 nodes: what findings add first, in the order of fingerprints."""
    f = made_findings(spark, sf_dir)
    g = admission.graph(f, max_nodes=300, max_edges=10**9, max_findings=10**9)
    edges = g.edges.where("rule LIKE 'CORRELATION.ENTITY%'").select(F.col("edge_id").alias("id"), F.col("edge_type").alias("kind"), "place")
    ended = admission.state(g.states).select((F.col("state") == "ABORTED").alias("ended"))
    return g.nodes.select(F.col("node_id").alias("id"), "kind", F.col("place").cast("long").alias("place")).unionByName(edges).join(F.broadcast(ended))  # one row


@query(f"""WITH {FINDINGS_SQL}, {_ADDED_SQL}, stop AS (SELECT arg_min(fingerprint, place) AS fp FROM placed WHERE edge AND place = 121)
SELECT p.id, p.kind, p.place, stop.fp IS NOT NULL AS ended FROM placed p, stop WHERE (edge AND place <= 120) OR (NOT edge AND (stop.fp IS NULL OR p.fingerprint <= stop.fp))""")
def graph_edge_budget(spark, sf_dir):
    """The same of at most 120 edges: the finding that adds one more still adds its nodes, no later one does."""
    f = made_findings(spark, sf_dir)
    g = admission.graph(f, max_nodes=10**9, max_edges=120, max_findings=10**9)
    ended = g.states.where("code = 'CORRELATION_EDGE_LIMIT'").select("ended")
    edges = g.edges.select(F.col("edge_id").alias("id"), F.col("edge_type").alias("kind"), "place")
    return g.nodes.select(F.col("node_id").alias("id"), "kind", F.col("place").cast("long").alias("place")).unionByName(edges).join(F.broadcast(ended))


_COMMANDS = ", ".join(f"'{c}'" for c in correlation.COMMAND)
_LOWER = "CASE WHEN 'LOW' IN (a.confidence, b.confidence) THEN 'LOW' WHEN 'MEDIUM' IN (a.confidence, b.confidence) THEN 'MEDIUM' ELSE 'HIGH' END"
_SUPPORT_SQL = f"""support AS (SELECT {_sid("'edge-v1'", "'SUPPORTS'", "src", "dst", "'CORRELATION.BEHAVIOR.SAME_SINK_SPECIFIC'")} AS edge_id, 'SUPPORTS' AS edge_type, src, dst, confidence, 'CORRELATION.BEHAVIOR.SAME_SINK_SPECIFIC' AS rule
  FROM (SELECT DISTINCT 'f:' || a.fingerprint AS src, 'f:' || b.fingerprint AS dst, {_LOWER} AS confidence FROM findings a JOIN findings b USING (path, line, col)
        WHERE a.rule_id = 'BEHAVIOR.PROCESS_EXEC' AND b.rule_id IN ({_COMMANDS}) AND b.rule_id <> a.rule_id))"""


@query(f"WITH {FINDINGS_SQL}, {_SUPPORT_SQL} SELECT * FROM support")
def edges_supports(spark, sf_dir):
    return correlation.supports(made_findings(spark, sf_dir))


@query(f"""WITH {FINDINGS_SQL}, o AS (SELECT DISTINCT 'f:' || a.fingerprint AS src, 'f:' || b.fingerprint AS dst, {_LOWER} AS confidence FROM findings a JOIN findings b USING (path, line)
  WHERE a.rule_id IN ({_COMMANDS}) AND b.rule_id IN ({_COMMANDS}) AND a.rule_id <> b.rule_id AND a.fingerprint < b.fingerprint)
SELECT {_sid("'edge-v1'", "'OVERLAPS'", "src", "dst", "'CORRELATION.BEHAVIOR.OVERLAP'")} AS edge_id, 'OVERLAPS' AS edge_type, src, dst, confidence, 'CORRELATION.BEHAVIOR.OVERLAP' AS rule FROM o""")
def edges_overlaps(spark, sf_dir):
    return correlation.overlaps(made_findings(spark, sf_dir))


_RELATED_SQL = f"""rel AS (SELECT DISTINCT least('f:' || a.fingerprint, 'f:' || b.fingerprint) AS src, greatest('f:' || a.fingerprint, 'f:' || b.fingerprint) AS dst, CASE WHEN a.function_id = b.function_id THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM findings a JOIN findings b USING (path) WHERE a.scanner_id = 'secrets' AND b.rule_id = 'BEHAVIOR.NETWORK_REQUEST' AND (abs(a.line - b.line) <= 5 OR a.function_id = b.function_id))"""


@query(f"""WITH {FINDINGS_SQL}, {_RELATED_SQL} SELECT {_sid("'edge-v1'", "'RELATED_BEHAVIOR'", "src", "dst", "'CORRELATION.SECRET.NETWORK_CONTEXT'")} AS edge_id, 'RELATED_BEHAVIOR' AS edge_type, src, dst, confidence, 'CORRELATION.SECRET.NETWORK_CONTEXT' AS rule FROM rel""")
def edges_secret_network(spark, sf_dir):
    return correlation.secret_network(made_findings(spark, sf_dir))


@query(f"""WITH {FINDINGS_SQL}, q AS (SELECT DISTINCT 'f:' || a.fingerprint AS src, 'f:' || b.fingerprint AS dst FROM findings a JOIN findings b USING (path, function_id)
  WHERE a.rule_id = 'BEHAVIOR.NETWORK_REQUEST' AND b.rule_id = 'BEHAVIOR.PROCESS_EXEC' AND a.line < b.line AND b.line - a.line <= 5)
SELECT {_sid("'edge-v1'", "'POSSIBLE_SEQUENCE'", "src", "dst", "'CORRELATION.BEHAVIOR.LOCAL_SEQUENCE'")} AS edge_id, 'POSSIBLE_SEQUENCE' AS edge_type, src, dst, 'LOW' AS confidence, 'CORRELATION.BEHAVIOR.LOCAL_SEQUENCE' AS rule FROM q""")
def edges_sequence(spark, sf_dir):
    return correlation.sequences(made_findings(spark, sf_dir))


def _clusters(spark, sf_dir):
    """Recursive deletions stand for persistence here: the shell rules have no signal of that kind."""
    return made_findings(spark, sf_dir).withColumn("rule_id", F.when(F.col("rule_id") == "BEHAVIOR.RECURSIVE_DELETE", F.lit("BEHAVIOR.SCHEDULED_TASK")).otherwise(F.col("rule_id")))


@query(f"""WITH {FINDINGS_SQL}, g AS (SELECT path, function_id,
    arg_min({{'fp': fingerprint, 'line': line, 'sev': severity}}, (line, fingerprint)) FILTER (WHERE rule_id = 'BEHAVIOR.NETWORK_REQUEST') AS n,
    arg_min({{'fp': fingerprint, 'line': line, 'sev': severity}}, (line, fingerprint)) FILTER (WHERE rule_id = 'BEHAVIOR.RECURSIVE_DELETE') AS c,
    arg_min({{'fp': fingerprint, 'line': line, 'sev': severity}}, (line, fingerprint)) FILTER (WHERE rule_id = 'BEHAVIOR.PROCESS_EXEC') AS e FROM findings GROUP BY ALL),
t AS (SELECT 'f:' || n.fp AS a, 'f:' || c.fp AS b, 'f:' || e.fp AS d FROM g WHERE n IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL AND greatest(n.line, c.line, e.line) - least(n.line, c.line, e.line) <= 5)
SELECT {_sid("'path-v1'", "'CORRELATION.BEHAVIOR.PERSISTENCE_CLUSTER'", "a", "b", "d")} AS path_id, 'PERSISTENCE' AS title, a || ',' || b || ',' || d AS members, 'MEDIUM' AS severity, 'LOW' AS confidence FROM t""")
def attack_paths(spark, sf_dir):
    return correlation.attack_paths(_clusters(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {FINDINGS_SQL}, {_SUPPORT_SQL} SELECT {_sid("'group-v1'", "f.fingerprint")} AS group_id, f.fingerprint AS "primary", coalesce(string_agg(DISTINCT substr(s.src, 3), ',' ORDER BY substr(s.src, 3)), '') AS supporters
FROM findings f LEFT JOIN support s ON s.dst = 'f:' || f.fingerprint WHERE NOT EXISTS (SELECT 1 FROM support x WHERE x.src = 'f:' || f.fingerprint) GROUP BY f.fingerprint""")
def finding_groups(spark, sf_dir):
    f = made_findings(spark, sf_dir)
    return correlation.groups(f, correlation.supports(f)).withColumn("supporters", F.array_join("supporters", ","))


def assessed(spark, sf_dir, found=None, support=None):
    """Assessments of all findings, which are made once and stored: three joins read them. So are the edges of support,
    which two joins read."""
    f = found or made_findings(spark, sf_dir)
    return correlation.assessments(f, support or stored(correlation.supports(f), "support"), correlation.secret_network(f))


ASSESSED_SQL = f"""{FINDINGS_SQL}, {_SUPPORT_SQL}, {_RELATED_SQL},
sup AS (SELECT dst, count(DISTINCT src) AS n, min(CASE f.confidence WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS weakest FROM (SELECT DISTINCT src, dst FROM support) s JOIN findings f ON s.src = 'f:' || f.fingerprint GROUP BY dst),
near AS (SELECT src AS node FROM rel UNION SELECT dst FROM rel),
assessed AS (SELECT {_sid("'assessment-v1'", _sid("'group-v1'", "f.fingerprint"))} AS assessment_id, f.fingerprint, scanner_id, rule_id, path, line, severity,
  ['LOW', 'MEDIUM', 'HIGH'][1 + least(CASE f.confidence WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, coalesce(sup.weakest, 9))] AS confidence, 'WEAK' AS evidence,
  CASE WHEN sup.n IS NULL THEN 'WEAK' ELSE 'STRONG' END AS correlation,
  CASE WHEN source_category = 'HTTP_INPUT' THEN 'EXTERNAL_INPUT' WHEN near.node IS NOT NULL THEN 'NETWORK_CONTEXT' ELSE 'UNKNOWN' END AS exposure, lower(severity) AS priority, coalesce(sup.n, 0) AS n_supporters
  FROM findings f LEFT JOIN sup ON sup.dst = 'f:' || f.fingerprint LEFT JOIN near ON near.node = 'f:' || f.fingerprint
  WHERE NOT EXISTS (SELECT 1 FROM support x WHERE x.src = 'f:' || f.fingerprint))"""


@query(f"WITH {ASSESSED_SQL} SELECT * FROM assessed")
def risk_assessments(spark, sf_dir):
    return assessed(spark, sf_dir)


@query(f"""WITH {FINDINGS_SQL} SELECT s AS severity, count(f.severity) AS n FROM (SELECT unnest(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS s) LEFT JOIN findings f ON f.severity = s GROUP BY s""")
def report_severity_counts(spark, sf_dir):
    return report.severity_counts(report.deduplicated(all_findings(spark, sf_dir)))


@query(f"""WITH {FINDINGS_SQL}, x AS (SELECT * FROM findings UNION ALL SELECT * FROM findings WHERE line % 2 = 0 UNION ALL SELECT * REPLACE ('HIGH' AS severity) FROM findings WHERE line % 9 = 0)
SELECT fingerprint, severity, count(*) OVER (PARTITION BY fingerprint) AS n_same_fingerprint FROM (SELECT DISTINCT fingerprint, severity FROM x)""")
def report_dedupe(spark, sf_dir):
    f = made_findings(spark, sf_dir)
    x = f.unionByName(f.where("line % 2 = 0")).unionByName(f.where("line % 9 = 0").withColumn("severity", F.lit("HIGH")))
    return report.deduplicated(x).select("fingerprint", "severity", "n_same_fingerprint")


@query(f"WITH {FINDINGS_SQL} SELECT severity, category, count(*) AS n, grouping_id(severity, category)::BIGINT AS level FROM findings GROUP BY CUBE (severity, category)")
def severity_cube(spark, sf_dir):
    return report.counts(all_findings(spark, sf_dir))


def _coverage(spark, sf_dir):
    """State of each component: long lines or files leave their scanner partial."""
    profile = discovery.line_profile(corpora.artifacts(spark, sf_dir)).agg(F.sum("long_lines").alias("n"))
    secrets = profile.select(F.lit("secrets").alias("component"), F.when(F.col("n") > 0, "PARTIAL").otherwise("COMPLETE").alias("state"))
    rest = report.coverage(spark, [("discovery", "COMPLETE"), ("sast", "DISABLED"), ("behavior", "COMPLETE"), ("dependencies", "COMPLETE"), ("correlation", "COMPLETE")])
    return secrets.unionByName(rest)


_COVERAGE_SQL = f"""{ARTIFACTS_SQL}, {_LINES}, cov AS (SELECT 'secrets' AS component, CASE WHEN count(*) FILTER (WHERE n_bytes > 16384) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM lines
  UNION ALL SELECT * FROM (VALUES ('discovery', 'COMPLETE'), ('sast', 'DISABLED'), ('behavior', 'COMPLETE'), ('dependencies', 'COMPLETE'), ('correlation', 'COMPLETE')))"""


@query(f"WITH {_COVERAGE_SQL} SELECT CASE WHEN bool_or(state = 'PARTIAL') THEN 'PARTIAL' ELSE 'COMPLETE' END AS overall, coalesce(string_agg(component || '_' || state, ',' ORDER BY component) FILTER (WHERE state = 'PARTIAL'), '') AS reasons FROM cov")
def coverage_rollup(spark, sf_dir):
    return report.overall(_coverage(spark, sf_dir))


@query(f"WITH {_COVERAGE_SQL} SELECT 'SOURCE' AS layer, CASE WHEN bool_or(state = 'PARTIAL') THEN 'PARTIAL' ELSE 'DISABLED' END AS state FROM cov WHERE component IN ('secrets', 'discovery', 'sast', 'behavior') UNION ALL SELECT 'DEPENDENCY', 'COMPLETE' UNION ALL SELECT 'CORRELATION', 'COMPLETE'")
def coverage_layers(spark, sf_dir):
    return report.layers(_coverage(spark, sf_dir))


_SEV_RANK = "list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], {})"


@query(f"WITH {ASSESSED_SQL} SELECT fingerprint, priority, severity, confidence, path, line, (SELECT count(*) FROM assessed) AS n_total FROM assessed ORDER BY {_SEV_RANK.format('upper(priority)')} DESC, {_SEV_RANK.format('severity')} DESC, list_position(['LOW', 'MEDIUM', 'HIGH'], confidence) DESC, path, line, fingerprint LIMIT 20")
def report_topk(spark, sf_dir):
    return report.top(assessed(spark, sf_dir)).select("fingerprint", "priority", "severity", "confidence", "path", "line", "n_total")


@query(f"""WITH {ASSESSED_SQL} SELECT fingerprint, '{{"confidence":"' || confidence || '","evidence":"' || evidence || '","exposure":"' || exposure || '","fingerprint":"' || fingerprint || '","line":' || line || ',"path":"' || path || '","priority":"' || priority || '","rule_id":"' || rule_id || '","severity":"' || severity || '"}}' AS json FROM assessed""")
def report_json(spark, sf_dir):
    return report.report_json(assessed(spark, sf_dir))


@query(f"""WITH {ASSESSED_SQL} SELECT fingerprint, '{{"level":"' || CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END || '","locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || line || '}}}}}}],"message":{{"text":"' || rule_id || '"}},"partialFingerprints":{{"primary":"' || fingerprint || '"}},"ruleId":"' || rule_id || '"}}' AS json FROM assessed""")
def report_sarif(spark, sf_dir):
    return report.sarif(assessed(spark, sf_dir))


_GATE_SQL = f"""{ASSESSED_SQL}, {_COVERAGE_SQL}, g AS (SELECT count(*) FILTER (WHERE scanner_id = 'secrets' AND severity IN ('HIGH', 'CRITICAL')) AS n_blockers, count(*) FILTER (WHERE NOT (scanner_id = 'secrets' AND severity IN ('HIGH', 'CRITICAL'))) AS n_warnings FROM assessed),
o AS (SELECT CASE WHEN bool_or(state = 'PARTIAL') THEN 'PARTIAL' ELSE 'COMPLETE' END AS coverage FROM cov)"""


@query(f"""WITH {_GATE_SQL} SELECT CASE WHEN n_blockers > 0 OR coverage = 'PARTIAL' THEN 'BLOCK' WHEN n_warnings > 0 THEN 'WARN' ELSE 'PASS' END AS status, n_blockers, n_warnings, coverage,
  concat_ws(',', CASE WHEN n_blockers > 0 THEN 'BLOCKING_PRIMARY_FINDINGS' END, CASE WHEN coverage = 'PARTIAL' THEN 'COVERAGE_PARTIAL' END, CASE WHEN n_warnings > 0 THEN 'NON_BLOCKING_PRIMARY_FINDINGS' END) AS reasons FROM g, o""")
def gate_decision(spark, sf_dir):
    return report.gate(assessed(spark, sf_dir), report.overall(_coverage(spark, sf_dir)))


@query(f"""WITH {ASSESSED_SQL}, r AS (SELECT * REPLACE (CASE WHEN line % 10 = 0 THEN 'HIGH' ELSE severity END AS severity, CASE WHEN line % 10 = 0 THEN 'high' ELSE priority END AS priority) FROM assessed),
s AS (SELECT CASE WHEN severity = 'CRITICAL' THEN 0 ELSE 1 END::BIGINT AS rank, 'finding' AS kind, fingerprint AS subject FROM r WHERE severity IN ('CRITICAL', 'HIGH')
  UNION SELECT 2, 'risk_assessment', assessment_id FROM r WHERE priority IN ('critical', 'high')
  UNION SELECT 3, 'finding_group', {_sid("'group-v1'", "fingerprint")} FROM r WHERE priority IN ('critical', 'high') AND n_supporters > 0)
SELECT *, (SELECT count(*) FROM s) AS n_total FROM s ORDER BY rank, kind, subject LIMIT 200""")
def review_subjects(spark, sf_dir):
    f = made_findings(spark, sf_dir)
    late = F.col("line") % 10 == 0
    raised = assessed(spark, sf_dir, f).withColumns({"severity": F.when(late, F.lit("HIGH")).otherwise(F.col("severity")), "priority": F.when(late, F.lit("high")).otherwise(F.col("priority"))})
    return report.review_subjects(raised, correlation.attack_paths(f), correlation.groups(f, correlation.supports(f)), k=200)


@query(f"""WITH {ASSESSED_SQL}, t AS (SELECT * FROM assessed ORDER BY {_SEV_RANK.format('severity')} DESC, path, line, fingerprint LIMIT 50)
SELECT substr(sha256('remediation-v1:' || fingerprint), 1, 24) AS proposal_id, fingerprint, rule_id, {_case(report.GUIDANCE.items(), 'scanner_id')} AS guidance, greatest((SELECT count(*) FROM assessed) - 50, 0) AS n_omitted FROM t""")
def remediation_plan(spark, sf_dir):
    return report.remediation_plan(assessed(spark, sf_dir))
