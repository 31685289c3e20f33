"""Steps whose work grew faster than it had to: what they read, keep or join."""

import base64

from pyspark.sql import functions as F

from harborscan.functions import exprs
from harborscan.operators import correlation, long_lines, report, secret_rules
from harborscan.plans import scan_queries

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_hold_the_context_in_characters(spark):
    rows = long_lines.windows(spark.createDataFrame([("p", 1, "a" * 60_000), ("p", 2, "é" * 60_000)], "path string, line long, text string"), 1 << 12).collect()
    assert rows and all(len(r.text) <= r.lead + r.own + long_lines.RIGHT for r in rows)


def test_windows_see_values_beyond_blanks_and_long_tokens(spark):
    """Matches that begin in one chunk and end far beyond it, with and without runs of blanks."""
    value = "Aa9_0123456789abcdef"
    part = "eyJhbGciOiJIUzI1NiJ9"
    long = base64.urlsafe_b64encode(b'{"a":"' + b"y" * 741 + b'"}').decode().rstrip("=")
    texts = [f"{'x ' * k}password{' ' * n}={' ' * m}'{value}' {part}.{long}.{'s' * 1000} sha{'1' * 150} ghp_{'a1' * 18} postgres://{'u' * 128}:{'p' * 200}@h" for k in (0, 24, 31) for n, m in ((0, 0), (200, 300), (4000, 4000))]
    texts += [t.replace("sha", "shy") for t in texts]
    df = spark.createDataFrame([("p", n, t) for n, t in enumerate(texts)], "path string, line long, text string")
    want = sorted(tuple(r) for r in secret_rules.detect(df, max_bytes=1 << 30).collect())
    assert want and sorted(tuple(r) for r in long_lines.scan(df, 1000).collect()) == want


def test_entity_edges_meet_no_nodes(spark):
    rows = [("a" * 64, "secrets", "secret", "R", "p", 1, 1, "LOW", "LOW", "f1"), ("b" * 64, "secrets", "secret", "R", None, 1, 1, "LOW", "LOW", None)]
    f = spark.createDataFrame(rows, "fingerprint string, scanner_id string, category string, rule_id string, path string, line long, col long, severity string, confidence string, function_id string")
    got = correlation.anchored_entity_edges(f)
    want = correlation.anchored(correlation.entity_edges(f), correlation.entity_nodes(f))
    assert "LeftSemi" not in plan(got) and sorted(got.select("edge_id", "src", "dst").collect()) == sorted(want.select("edge_id", "src", "dst").collect())


def test_report_document_reads_stored_assessments(spark):
    assessed = scan_queries.assessed(spark, SMALL)
    assert "RelationV2" not in plan(assessed) and "LeftAnti" not in plan(report.report_document(assessed, spark.createDataFrame([("PARTIAL",)], "overall string"), 5))


def test_support_is_worked_out_once(spark):
    assert "SAME_SINK_SPECIFIC" not in plan(scan_queries.assessed(spark, SMALL))


def test_redacted_paths(spark):
    paths = ["svc/u1.sh", "a/ghp_" + "a1" * 18, "x/AKIA" + "A" * 16, "API-KEY=abcdef", "api_key-zzzz/q", "my_Token:abcd", "token=abc", "sk_live_" + "a" * 24, "xoxb-" + "1" * 20, "AIza" + "b" * 35, None, ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    step = F.col("p")
    for shape in exprs.TOKEN_SHAPES:
        step = F.regexp_replace(step, shape, "[REDACTED]")
    assert [r[0] for r in df.select(exprs.redact_path(F.col("p"))).collect()] == [r[0] for r in df.select(F.regexp_replace(step, exprs.PATH_ASSIGNMENT, "$1$2[REDACTED]")).collect()]
