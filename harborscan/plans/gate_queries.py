"""Queries of the gate: reports derived from customers, sound ones and ones with each kind of fault, judged row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborscan.functions.scratch import dealt
from harborscan.operators import gate
from harborscan.sources import corpora

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: What a customer's report is like, by its key: (name, what it makes of the gate).
CASES = [
    "clean", "partial", "sast_high", "sast_unsure", "behavior", "secret", "no_data", "truncated", "aborted", "budget", "advisory_cap", "supporting", "diagnostics", "priority",
    "old_schema", "bad_requests", "doubled_mark", "bad_category", "contradiction", "bad_advisories", "stray_group", "unsafe_path", "doubled_key", "miscounted", "bad_code", "text_count", "failed",
]


def reports(spark, sf_dir):
    """report_id, json: one report for each customer; a few dependency findings besides that of its case."""
    c = dealt(corpora.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", rows=5_000)
    n = (F.col("c_nationkey") % 3).cast("int")
    case = F.get(F.array(*map(F.lit, CASES)), (F.col("c_custkey") % len(CASES)).cast("int"))
    is_ = lambda *names: case.isin(*names)
    mark = lambda i: F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), i.cast("string")), 256)

    def finding(i, scanner, category, severity, confidence, role, priority, path):
        m = mark(i)
        return F.struct(
            F.substring(m, 1, 16).alias("id"), m.alias("fingerprint"), F.lit("RULE.X").alias("rule_id"), scanner.alias("scanner_id"), category.alias("category"), F.lit("t").alias("title"), F.lit("d").alias("description"),
            severity.alias("severity"), confidence.alias("confidence"), role.alias("role"), priority.alias("risk_priority"), F.struct(path.alias("path"), F.lit(3).alias("start_line")).alias("location"),
        )

    lit = F.lit
    extra = F.transform(F.sequence(lit(1), n + 1), lambda i: finding(i, lit("dependencies"), lit("dependency"), lit("MEDIUM"), lit("MEDIUM"), lit("primary"), lit("medium"), lit("a/uv.lock")))
    extra = F.slice(extra, lit(1), n)
    scanner = F.when(is_("behavior"), "behavior.static").when(is_("sast_high", "sast_unsure", "priority"), "sast.python").otherwise("secrets")
    category = F.when(is_("bad_category"), "behavior").when(is_("behavior"), "behavior").when(is_("sast_high", "sast_unsure", "priority"), "vulnerability").otherwise("secret")
    severity = F.when(is_("sast_high", "sast_unsure", "secret", "supporting", "behavior"), "HIGH").otherwise("LOW")
    own = finding(lit(0), scanner, category, severity, F.when(is_("sast_unsure", "priority"), "MEDIUM").otherwise("HIGH"), F.when(is_("supporting"), "supporting").otherwise("primary"), F.when(is_("priority"), "critical"), F.when(is_("unsafe_path"), "../x").otherwise("a/b.py"))
    has_own = ~is_("clean", "partial", "no_data", "aborted", "budget", "advisory_cap", "diagnostics", "failed")
    findings = F.concat(F.when(has_own, F.array(own)).otherwise(F.filter(F.array(own), lambda x: lit(False))), extra)
    findings = F.when(is_("doubled_mark"), F.concat(findings, F.array(own))).otherwise(findings)
    groups = F.filter(F.array(F.struct(lit("g").alias("id"), F.when(is_("stray_group"), mark(lit(99))).otherwise(mark(lit(1))).alias("primary"), F.array(F.struct(mark(lit(0)).alias("fingerprint"), lit("supporting").alias("role"))).alias("members"))), lambda x: is_("stray_group") | (is_("supporting") & (n > 0)))
    noted = F.filter(F.array(F.struct(F.when(is_("bad_code"), "lower").otherwise("SLOW_FILE").alias("code"), lit("secrets").alias("source"), lit("m").alias("message"), lit(None).cast("string").alias("path"))), lambda x: is_("diagnostics", "bad_code"))
    overall = F.when(is_("partial", "advisory_cap"), "PARTIAL").when(is_("aborted"), "ABORTED").when(is_("failed"), "FAILED").otherwise("COMPLETE")
    state = F.when(is_("contradiction"), "PARTIAL").otherwise(overall)
    size = F.size(findings)
    cut = is_("advisory_cap").cast("int")
    body = F.struct(
        F.when(is_("old_schema"), "1.0").otherwise("1.1").alias("schema_version"), F.struct(lit(gate.TOOL).alias("name"), lit("1").alias("version")).alias("tool"), F.struct(lit("s").alias("scan_id"), lit("t").alias("target"), lit("deep").alias("profile"), lit(True).alias("offline")).alias("scan"),
        F.struct(overall.alias("overall"), F.array(F.struct(lit("secrets").alias("component"), state.alias("status"))).alias("components")).alias("coverage"),
        F.struct(
            F.struct((size + is_("truncated").cast("int") * 4).alias("total_findings"), (size + is_("miscounted").cast("int")).alias("rendered_findings")).alias("counts"),
            F.struct(
                F.when(is_("no_data"), 3).otherwise(0).alias("no_data"), lit(0).alias("matches"), lit(1).alias("exact_versions"), lit(2).alias("batch_requests_used"), lit(10).alias("batch_requests_limit"), lit(3).alias("detail_requests_used"), lit(50).alias("detail_requests_limit"),
                F.when(is_("bad_requests"), 6).otherwise(5).alias("total_requests_used"), lit(60).alias("total_requests_limit"), lit(0).alias("deduplicated_advisories"), is_("budget").alias("provider_budget_reached"),
                F.when(is_("bad_advisories"), 9).otherwise(4 + cut).alias("advisories_seen"), lit(4).alias("advisories_accepted"), cut.alias("advisories_truncated"), lit(100).alias("advisory_limit"), is_("advisory_cap").alias("advisory_limit_reached"),
            ).alias("dependency"),
        ).alias("summary"),
        noted.alias("diagnostics"), findings.alias("findings"), groups.alias("finding_groups"), F.array().cast("array<string>").alias("risk_assessments"), F.array().cast("array<string>").alias("ai_reviews"), F.array().cast("array<string>").alias("remediation_proposals"), is_("truncated").alias("report_truncated"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    text = F.when(is_("doubled_key"), F.regexp_replace(text, "^.", '{"tool":1,')).when(is_("text_count"), F.replace(text, F.lit('"no_data":0'), F.lit('"no_data":"0"'))).otherwise(text)
    return c.select(F.col("c_custkey").alias("report_id"), text.alias("json"))


_CASES_SQL = f"""k AS (SELECT c_custkey AS report_id, c_nationkey % 3 AS n, [{', '.join(f"'{x}'" for x in CASES)}][1 + c_custkey % {len(CASES)}] AS kind FROM customer),
e AS (SELECT *, CASE kind WHEN 'bad_requests' THEN 'REQUESTS' WHEN 'doubled_mark' THEN 'IDENTITY' WHEN 'bad_category' THEN 'CATEGORY' WHEN 'contradiction' THEN 'COVERAGE_CONTRADICTION' WHEN 'bad_advisories' THEN 'ADVISORIES'
  WHEN 'stray_group' THEN 'GROUPS,ROLES' WHEN 'unsafe_path' THEN 'PATHS' WHEN 'doubled_key' THEN 'JSON' WHEN 'miscounted' THEN 'COUNTS' WHEN 'bad_code' THEN 'DIAGNOSTICS' WHEN 'text_count' THEN 'DEPENDENCY' ELSE '' END AS violations FROM k),
v AS (SELECT *, CASE WHEN kind = 'old_schema' THEN 'GATE_UNSUPPORTED_SCHEMA' WHEN violations <> '' THEN 'GATE_INVALID_REPORT' END AS error FROM e)"""


@query(f"WITH {_CASES_SQL} SELECT report_id, violations, error FROM v")
def gate_validation(spark, sf_dir):
    return gate.validated(reports(spark, sf_dir)).select("report_id", F.array_join("violations", ",").alias("violations"), "error")


_DECIDED_SQL = f"""{_CASES_SQL}, b AS (SELECT *, CASE WHEN kind IN ('sast_high', 'secret', 'priority') THEN 1 ELSE 0 END AS blockers, n + CASE WHEN kind IN ('sast_unsure', 'behavior', 'truncated') THEN 1 ELSE 0 END AS warnings FROM v)"""


def _decision_sql(partial: str, no_data: str) -> str:
    return f"""WITH {_DECIDED_SQL}, s AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN blockers > 0 OR kind IN ('truncated', 'aborted', 'failed', 'budget', 'advisory_cap'{partial}{no_data}) THEN 'BLOCK'
  WHEN warnings > 0 OR kind IN ('diagnostics', 'partial', 'no_data') THEN 'WARN' ELSE 'PASS' END END AS status FROM b)
SELECT report_id, error, status, CASE WHEN error IS NULL THEN blockers END::BIGINT AS n_blockers, CASE WHEN error IS NULL THEN warnings END::BIGINT AS n_warnings,
  CASE WHEN error IS NULL THEN concat_ws(',', CASE WHEN blockers > 0 THEN 'BLOCKING_PRIMARY_FINDINGS' END, CASE WHEN kind IN ('partial', 'advisory_cap') THEN 'COVERAGE_PARTIAL' END, CASE WHEN kind = 'advisory_cap' THEN 'DEPENDENCY_ADVISORY_LIMIT_REACHED' END,
    CASE WHEN kind = 'no_data' THEN 'DEPENDENCY_NO_DATA' END, CASE WHEN kind = 'budget' THEN 'DEPENDENCY_PROVIDER_BUDGET_REACHED' END, CASE WHEN warnings > 0 THEN 'NON_BLOCKING_PRIMARY_FINDINGS' END, CASE WHEN kind = 'truncated' THEN 'REPORT_TRUNCATED' END,
    CASE WHEN kind = 'aborted' THEN 'SCAN_ABORTED' END, CASE WHEN kind = 'diagnostics' THEN 'SCAN_DIAGNOSTICS' END, CASE WHEN kind = 'failed' THEN 'SCAN_FAILED' END) END AS reasons,
  CASE WHEN error IS NULL THEN CASE WHEN kind = 'diagnostics' THEN 'SLOW_FILE' ELSE '' END END AS diagnostics, CASE status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 10 WHEN 'BLOCK' THEN 20 ELSE 2 END::BIGINT AS exit_code FROM s"""


@query(_decision_sql(", 'partial'", ""))
def gate_policy(spark, sf_dir):
    return gate.decided(reports(spark, sf_dir))


@query(_decision_sql("", ", 'no_data'"))
def gate_policy_lenient(spark, sf_dir):
    return gate.decided(reports(spark, sf_dir), gate.Policy(partial_blocks=False, no_data_blocks=True))


@query(f"""WITH {_CASES_SQL}, o AS (SELECT *, CASE WHEN kind IN ('sast_high', 'sast_unsure', 'secret', 'behavior') THEN 1 ELSE 0 END AS n_over FROM v)
SELECT report_id, CASE WHEN error IS NULL THEN n_over END::BIGINT AS n_over, CASE WHEN error IS NOT NULL THEN 3 WHEN n_over > 0 THEN 10 ELSE 0 END::BIGINT AS exit_code FROM o""")
def gate_threshold(spark, sf_dir):
    return gate.over_threshold(reports(spark, sf_dir), "high")
