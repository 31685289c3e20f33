"""Queries of whole scans over a project's files, with SQL from what the files were made of, and of scanners called from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborscan.functions.exprs import fingerprint_sql
from harborscan.operators import registry, scan
from harborscan.plans.scan_queries import _BITS
from harborscan.sources.corpora import CONFIG_LINES_SQL, PROJECT_SQL, config_lines, project_files

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_EXCLUDE = ["docs/1*.md"]
_STRONG = f"CASE WHEN {_BITS} >= 3.2 THEN 'MEDIUM' ELSE 'LOW' END"
_SCANNED = f"""{PROJECT_SQL}, listed AS (SELECT *, CASE WHEN k = 6 THEN 'EXCLUDED_DEFAULT_VENDOR' WHEN path LIKE 'docs/1%.md' THEN 'EXCLUDED_USER_POLICY' END AS reason FROM project_files),
read_ AS (SELECT * FROM listed WHERE reason IS NULL AND k <> 5),
hits AS (SELECT path, path AS shown, 2 AS line, 13 AS col, 'SECRET.GENERIC.ASSIGNMENT' AS rule_id, 'password' AS label, 'MEDIUM' AS severity, {_STRONG} AS confidence, 20 AS value_length FROM read_ WHERE k = 0
  UNION ALL SELECT path, path, 1, 13, 'SECRET.GENERIC.ASSIGNMENT', 'password', 'MEDIUM', 'LOW', 10 FROM read_ WHERE k = 1 AND g % 2 = 1
  UNION ALL SELECT path, path, 2, 19, 'SECRET.GENERIC.ASSIGNMENT', 'password', 'MEDIUM', {_STRONG}, 20 FROM read_ WHERE k = 2
  UNION ALL SELECT path, path, 3, 11, 'SECRET.GENERIC.ASSIGNMENT', 'api_key', 'MEDIUM', 'MEDIUM', 21 FROM read_ WHERE k = 3 AND g % 2 = 1
  UNION ALL SELECT path, 'deploy/' || (g // 2) || '/[REDACTED].sh', 1, 11, 'SECRET.GITHUB.TOKEN', 'github', 'HIGH', 'HIGH', 40 FROM read_ WHERE k = 4
  UNION ALL SELECT path, path, 2, 1, 'SECRET.PRIVATE_KEY.PEM', 'private_key', 'HIGH', 'HIGH', 31 FROM read_ WHERE k = 7),
marks AS (SELECT *, {fingerprint_sql("'secret-finding-v1'", "rule_id", "shown", "line::VARCHAR", "col::VARCHAR", "label", "label")} AS mark, substr(sha256(path), 1, 16) AS by_ FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY by_) AS place FROM marks),
secrets AS (SELECT CASE WHEN place = 1 THEN mark ELSE {fingerprint_sql("'secret-finding-v1'", "rule_id", "shown", "line::VARCHAR", "col::VARCHAR", "label", "label || '|' || by_ || '|' || (place - 2)")} END AS fingerprint, rule_id, shown AS path, line::BIGINT AS line, col::BIGINT AS col, severity, confidence, value_length::BIGINT AS value_length, place > 1 AS collided FROM placed),
acts AS (SELECT 'BEHAVIOR.NETWORK_REQUEST' AS rule_id, 'deploy/' || (g // 2) || '/[REDACTED].sh' AS path, 2::BIGINT AS line, 1::BIGINT AS col FROM read_ WHERE k = 4 UNION ALL SELECT 'BEHAVIOR.ENVIRONMENT_READ', path, 1, 18 FROM read_ WHERE k = 2),
found AS (SELECT * FROM secrets UNION ALL SELECT {fingerprint_sql("'static-finding-v1'", "rule_id", "path", "line::VARCHAR", "col::VARCHAR", "'text'")}, rule_id, path, line, col, 'INFO', 'MEDIUM', 0, false FROM acts)"""


def _scan(spark, sf_dir):
    return scan.scan(project_files(spark, sf_dir), exclude=_EXCLUDE, total=10**9)


@query(f"WITH {_SCANNED} SELECT * FROM found")
def scan_findings(spark, sf_dir):
    """Files to findings, all steps wired: suppressed test values and generated keys, JavaScript literals, masked names."""
    return _scan(spark, sf_dir).findings.drop("scanner_id", "category")


@query(f"""WITH {_SCANNED} SELECT 'secrets' AS component, 'SECRET_FINGERPRINT_COLLISION' AS code, path FROM placed WHERE place > 1
UNION ALL SELECT 'secrets', 'SECRET_PRIVATE_KEY_UNTERMINATED', path FROM read_ WHERE k = 7 AND g % 2 = 1""")
def scan_notes(spark, sf_dir):
    return _scan(spark, sf_dir).notes


@query(f"""WITH {_SCANNED}, parts AS (SELECT path, reason, string_split(path, '/') AS p FROM listed), ancestors AS (SELECT array_to_string(p[1:i], '/') AS folder, reason FROM (SELECT p, reason, unnest(range(1, len(p))) AS i FROM parts)),
folders AS (SELECT folder, bool_and(reason IS NOT NULL) AS out_ FROM ancestors GROUP BY folder),
strong AS (SELECT count(*) FILTER (WHERE {_BITS} >= 3.5) AS n FROM read_ WHERE k IN (0, 2))
SELECT count(*) AS entries_seen, count(*) FILTER (WHERE reason IS NULL) AS files_discovered, count(*) FILTER (WHERE reason IS NULL) AS files_inspected, (sum(size_bytes) FILTER (WHERE reason IS NULL))::BIGINT AS bytes_inspected,
  count(reason) AS files_excluded, count(*) FILTER (WHERE k = 6) AS default_exclusions, count(*) FILTER (WHERE reason = 'EXCLUDED_USER_POLICY') AS user_exclusions,
  (SELECT count(*) FROM folders WHERE NOT out_) AS directories_visited, (SELECT count(*) FROM folders WHERE out_) AS directories_excluded,
  count(*) FILTER (WHERE reason IS NULL) AS considered, count(*) FILTER (WHERE reason IS NULL AND k <> 5) AS applicable, count(*) FILTER (WHERE reason IS NULL AND k <> 5) AS scanned, (sum(size_bytes) FILTER (WHERE reason IS NULL AND k <> 5))::BIGINT AS bytes, 0::BIGINT AS long_lines,
  (SELECT count(*) FROM hits) + (SELECT n FROM strong) AS candidates, count(*) FILTER (WHERE k IN (1, 3) AND g % 2 = 0) AS suppressed, (SELECT n FROM strong) AS duplicates, (SELECT count(*) FROM hits) AS emitted, 0::BIGINT AS limits_hit,
  CASE WHEN (SELECT count(*) FROM placed WHERE place > 1) + count(*) FILTER (WHERE reason IS NULL AND k = 7 AND g % 2 = 1) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM listed""")
def scan_counters(spark, sf_dir):
    """Counters that the scan's own passes observed."""
    done = _scan(spark, sf_dir)
    return done.traversal.join(F.broadcast(done.secrets))  # one row each


@query(f"""WITH {_SCANNED}, g AS (SELECT count(*) FILTER (WHERE starts_with(rule_id, 'SECRET') AND severity = 'HIGH') AS n_blockers, count(*) FILTER (WHERE NOT (starts_with(rule_id, 'SECRET') AND severity = 'HIGH')) AS n_warnings FROM found),
c AS (SELECT CASE WHEN (SELECT count(*) FROM placed WHERE place > 1) + (SELECT count(*) FROM read_ WHERE k = 7 AND g % 2 = 1) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS coverage)
SELECT CASE WHEN n_blockers > 0 OR coverage = 'PARTIAL' THEN 'BLOCK' WHEN n_warnings > 0 THEN 'WARN' ELSE 'PASS' END AS status, n_blockers, n_warnings, coverage,
  concat_ws(',', CASE WHEN n_blockers > 0 THEN 'BLOCKING_PRIMARY_FINDINGS' END, CASE WHEN coverage = 'PARTIAL' THEN 'COVERAGE_PARTIAL' END, CASE WHEN n_warnings > 0 THEN 'NON_BLOCKING_PRIMARY_FINDINGS' END) AS reasons FROM g, c""")
def scan_decision(spark, sf_dir):
    return scan.decision(_scan(spark, sf_dir))


class KeyBlocks(registry.LineScanner):
    """Private key blocks of a file: the lines of each that ends, at its end, and of one that doesn't, at the file's."""

    columns = "state string, n_lines long"

    def __init__(self):
        self.n = 0

    def line(self, text):
        if self.n:
            self.n += 1
            if "-----END RSA PRIVATE KEY-----" in text:
                yield ("CLOSED", self.n)
                self.n = 0
        elif "-----BEGIN RSA PRIVATE KEY-----" in text:
            self.n = 1

    def end(self):
        if self.n:
            yield ("OPEN", self.n)


@query(f"""WITH {CONFIG_LINES_SQL}, k AS (SELECT path, line, CASE WHEN text LIKE '%BEGIN RSA%' THEN 'B' WHEN text LIKE '%END RSA%' THEN 'E' END AS mark FROM config_lines),
m AS (SELECT *, lag(mark) OVER w AS before FROM k WHERE mark IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY line)),
b AS (SELECT *, max(CASE WHEN mark = 'B' AND coalesce(before, 'E') = 'E' THEN line END) OVER (PARTITION BY path ORDER BY line) AS since FROM m),
ends AS (SELECT path, max(line) AS line FROM k GROUP BY path), last AS (SELECT path, arg_max(mark, line) AS mark, arg_max(since, line) AS since FROM b GROUP BY path)
SELECT path, line, 'CLOSED' AS state, line - since + 1 AS n_lines FROM b WHERE mark = 'E' AND before = 'B' UNION ALL SELECT path, ends.line, 'OPEN', ends.line - since + 1 FROM ends JOIN last USING (path) WHERE mark = 'B'""")
def scanner_table_function(spark, sf_dir):
    """A scanner of one's own, called from SQL over a table of lines."""
    registry.table_function(spark, "key_blocks", KeyBlocks)
    return spark.sql("SELECT * FROM key_blocks(TABLE({lines}))", lines=config_lines(spark, sf_dir))
