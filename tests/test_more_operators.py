"""Golden inputs of discovery, contexts, gate, packages, patches, plug-ins and running totals."""

import json

import pytest
from pyspark.sql import functions as F

from harborscan.functions import exprs
from harborscan.operators import correlation, dependencies, discovery, gate, manifests, registry, remediation, report, secret_context, secret_rules


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def each(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_patterns(spark):
    paths = column(spark, ["build/a.md", "build", "a/build/x.py", "src/b.py", "src/[x].py", "docs/a/b.txt"])
    p = F.col("v")
    assert each(paths, discovery.glob_matches("build/", p)) == [True, False, True, False, False, False]
    assert each(paths, discovery.glob_matches("docs/a/", p)) == [False] * 5 + [True]
    assert each(paths, discovery.glob_matches("*.py", p)) == [False, False, True, True, True, False]
    assert each(paths, discovery.glob_matches("src/[!x].py", p)) == [False, False, False, True, False, False]
    assert each(paths, discovery.glob_matches("./s*c", p)) == [False, False, False, True, True, False]
    for bad in ("/x", "a/../b", "c:x", "", "a\0"):
        with pytest.raises(ValueError):
            discovery.checked_pattern(bad)


def test_default_scope_keeps_case_and_folders(spark):
    paths = column(spark, ["Build/a", "build/a", "coverage.xml/a", "x.tsbuildinfo", "a/node_modules/b", "src/a"])
    assert each(paths, discovery.scope_of(F.col("v"))) == [None, "EXCLUDED_DEFAULT_BUILD", None, "EXCLUDED_DEFAULT_GENERATED", "EXCLUDED_DEFAULT_VENDOR", None]
    assert each(paths, discovery.may_hold_included(F.lit("build"), ["build/keep/"])) == [True] * 6


def test_ignore_rules():
    assert discovery.ignore_rules("# x\n\n*.log\n!keep.log\n") == [(False, "*.log"), (True, "keep.log")]
    assert discovery.ignore_rules(None) == []
    for bad in ("a[b]\n", "!\n", "/abs\n", "x\n" * 1025, "y" * 70_000):
        with pytest.raises(ValueError):
            discovery.ignore_rules(bad)


def test_sniff(spark):
    rows = column(spark, [b"MZ\x90", b"", b"abc\xc3", b"abc\xff", "é\n".encode("utf-16-le"), b"\xff\xfea\x00", b"\x01\x02abc", b"a\x00" + b"\x01" * 10, None, b"x" * 20], "binary")
    got = each(rows, discovery.sniff(F.col("v"), longest=10))
    kinds = [(r.content_kind, r.encoding) for r in got]
    assert kinds[0] == ("BINARY", None) and kinds[1] == kinds[8] == ("TEXT", "utf-8") and kinds[2] == ("TEXT", "utf-8") and kinds[3] == ("UNKNOWN", None)
    assert kinds[5] == ("TEXT", "utf-16-le") and kinds[6] == ("BINARY", None) and kinds[7] == ("BINARY", None) and got[9].long_line and got[9].first_line is None


def test_running_total_is_global(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    got = exprs.running_total(rows, ["k", "id"], F.lit(1), "n").orderBy("k", "id").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_key_blocks(spark):
    text = ["a", "-----BEGIN RSA PRIVATE KEY-----", "password = 'Aa9_xK2mQ8vL5tR1'", "-----BEGIN PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "password = 'Aa9_xK2mQ8vL5tR1'", "-----BEGIN PRIVATE KEY-----", "x"]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(text, 1)] + [("q", 1, "password = 'Aa9_xK2mQ8vL5tR1'")], "path string, line long, text string")
    assert [(r.begin, r.end) for r in secret_rules.key_blocks(lines).orderBy("begin").collect()] == [(2, 5), (7, None)]
    assert sorted((r.path, r.line, r.rule_id[-10:]) for r in secret_rules.detect(lines).collect()) == [("p", 2, "E_KEY.PEM"[-10:] if False else "TE_KEY.PEM"), ("p", 6, "ASSIGNMENT"), ("p", 7, "TE_KEY.PEM"), ("q", 1, "ASSIGNMENT")]
    assert [r.line for r in secret_rules.outside_key_blocks(lines).where("inside_key").orderBy("line").collect()] == [3, 4, 5, 8]
    assert [r.path for r in secret_rules.unterminated(lines).collect()] == ["p"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("'a'", ["a"]), ("f('a', \"b\")", ["a", "b"]), (r"'a\'b'", [r"a\'b"]), ("x // 'c'", []), ("/* 'c' */ 'd'", ["d"]), ("`a${b}c`", ["a", "c"]), ("`${'in' + `x${'deep'}`}`", ["in", "x", "deep"]), ("'open", []), ("`open", []), ("''", [])],
)
def test_js_literals(text, want):
    assert [text[a:b] for a, b in secret_context.js_literals(text)] == want


def test_generator_proof(spark):
    def lines(path, text):
        return [(path, i, t) for i, t in enumerate(text.split("\n"), 1)]

    files = {"ok": "import secrets\ntoken = secrets.token_urlsafe(32)", "late": "token = secrets.token_hex()\nimport secrets", "bound": "import secrets\nsecrets = x\ntoken = secrets.token_hex()", "patched": "import secrets\nsecrets.token_hex = f\ntoken = secrets.token_hex()", "arg": "import secrets\ndef f(secrets): pass\ntoken = secrets.token_hex()", "other": "from a import secrets\ntoken = secrets.token_hex()"}
    df = spark.createDataFrame([r for p, t in files.items() for r in lines(p, t)], "path string, line long, text string")
    assert [(r.path, r.line) for r in secret_context.generator_lines(df).collect()] == [("ok", 2)]


def report_text(**changed):
    body = {
        "schema_version": "1.1", "tool": {"name": gate.TOOL, "version": "1"}, "scan": {"scan_id": "s", "target": "t", "profile": "deep", "offline": True},
        "coverage": {"overall": "COMPLETE", "components": [{"component": "secrets", "status": "COMPLETE"}]}, "summary": {"counts": {"total_findings": 0, "rendered_findings": 0}, "dependency": {"no_data": 0, "matches": 0, "exact_versions": 0}},
        "diagnostics": [], "findings": [], "finding_groups": [], "risk_assessments": [], "ai_reviews": [], "remediation_proposals": [], "report_truncated": False,
    }
    return json.dumps(body | changed)


def test_gate_reports(spark):
    texts = [report_text(), report_text(coverage={"overall": "PARTIAL", "components": [{"component": "x", "status": "PARTIAL"}]}), report_text(report_truncated=1), report_text(schema_version="2"), "{", None, "[]", report_text(findings=None)]
    df = column(spark, texts).select(F.col("i").alias("report_id"), F.col("v").alias("json"))
    got = {r.report_id: (r.status, r.error, r.exit_code) for r in gate.decided(df).collect()}
    assert got[0] == ("PASS", None, 0) and got[1] == ("BLOCK", None, 20) and got[3] == (None, "GATE_UNSUPPORTED_SCHEMA", 2)
    assert all(got[k] == (None, "GATE_INVALID_REPORT", 2) for k in (2, 4, 5, 6, 7))
    with pytest.raises(ValueError):
        gate.Policy(block_severity="SOME")


def test_budgets_and_buckets(spark):
    rows = [(f"{i:064x}", "behavior.static", "behavior", r, "a", 1, 1, "MEDIUM", "HIGH") for i, r in enumerate(["BEHAVIOR.PROCESS_EXEC", "BEHAVIOR.SHELL_EXEC"] * 20)]
    f = spark.createDataFrame(rows, "fingerprint string, scanner_id string, category string, rule_id string, path string, line long, col long, severity string, confidence string")
    assert correlation.overlaps(f).count() == 0 and correlation.overlaps(f.limit(4)).count() == 4
    state = {r.code: r.over for r in correlation.budget_state(f, f, f, f, {"max_nodes": 39}).collect()}
    assert state == {"CORRELATION_FINDING_LIMIT": False, "CORRELATION_NODE_LIMIT": True, "CORRELATION_EDGE_LIMIT": False, "CORRELATION_PATH_LIMIT": False, "CORRELATION_BUCKET_LIMIT": True}


def test_lock_sources():
    npm = '{"lockfileVersion":3,"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"1.0.0"},"node_modules/b":{"version":"2.0.0"},"node_modules/b/node_modules/a":{"version":"0.1.0"}}}'
    assert [(r[2], r[6]) for r in manifests.parse("package-lock.json", npm)] == [("a", "DIRECT"), ("b", "UNKNOWN"), ("a", "TRANSITIVE")]
    assert manifests.parse("package-lock.json", '{"lockfileVersion":9}')[0][-1] == "UNSUPPORTED_FORMAT"
    uv = '[[package]]\nname = "x"\nversion = "1"\nsource = { git = "https://h/r" }\n'
    assert manifests.parse("uv.lock", uv) == [("uv.lock", "PyPI", "x", "git+", "UNKNOWN", False, "UNKNOWN", "OK")]
    assert manifests.parse("uv.lock", "[[package]]\nname = 1")[0][-1] == "PARSE_ERROR"


def test_include_targets(spark):
    rows = column(spark, ["x.txt", "../x.txt", "../../x.txt", "a/../../x.txt", "/x", "C:x", " y.txt ", "a\\b.txt", ".."])
    assert each(rows, manifests.include_target(F.lit("req/r.txt"), F.col("v"))) == ["req/x.txt", "x.txt", None, "x.txt", None, None, "req/y.txt", "req/a/b.txt", None]


def test_provider_budgets():
    assert dependencies.provider_budget(120, 10) == {"batch_requests_used": 3, "batch_requests_limit": 10, "detail_requests_used": 10, "detail_requests_limit": 50, "total_requests_used": 13, "total_requests_limit": 60, "provider_budget_reached": False}
    assert dependencies.provider_budget(600, 70)["provider_budget_reached"]


def test_patches(spark):
    rows = spark.createDataFrame([("a.py", "x\ny\n", "x\nz\n"), ("a.py", None, "q\n"), ("a.py", "same", "same")], "path string, before string, after string")
    got = rows.select(remediation.changes("path", "before", "after").alias("c")).select("c.*", remediation.rejection(F.col("c")).alias("fault")).collect()
    assert got[0].diff == "--- a/a.py\n+++ b/a.py\n@@ -2 +2 @@\n-y\n+z\n" and got[0].fault is None and got[1].added == "q" and got[2].fault == "PATCH_TOO_LARGE"


def test_plug_ins(spark):
    files = spark.createDataFrame([("a.sh",), ("b.md",)], "path string")
    row = {c: F.lit("x") for c in registry.FINDING if c != "path"}
    found = registry.run_scanners([registry.Scanner("one", lambda: F.col("path").endswith(".sh"), lambda f: f.withColumns(row))], files)
    assert [r.path for r in found.collect()] == ["a.sh"]
    with pytest.raises(ValueError):
        registry.run_scanners([registry.Scanner("bad", lambda: F.lit(True), lambda f: f)], files)


def test_settings():
    assert registry.settings("[secrets]\nmax_findings_total = 5\n")["secrets"]["max_findings_total"] == 5 and registry.settings("")["correlation"]["proximity_lines"] == 5
    for bad in ("[other]\n", "[secrets]\nmore = 1\n", "[secrets]\nmax_findings_total = 0\n", "[secrets]\nmax_findings_total = true\n", "secrets = 1\n"):
        with pytest.raises(ValueError):
            registry.settings(bad)


def test_shown_tells_what_it_leaves_out(spark):
    rows = report.shown(spark.range(30), ["id"], 20).collect()
    assert len(rows) == 20 and {(r.n_total, r.n_omitted) for r in rows} == {(30, 10)}
    assert report.shown(spark.range(0), ["id"], 20).count() == 0


def test_urls(spark):
    rows = column(spark, ["https://a.b/c", "https://u:p@a/c?x=1&y=", "nonsense", None, "x" * 5000])
    assert each(rows, report.url_shape(F.col("v"))) == ["https://[HOST]", "https://[USER]:[REDACTED]@[HOST]?[2 REDACTED QUERY FIELDS]", "[REDACTED URL]", "[REDACTED URL]", "[REDACTED URL]"]
    long = "see https://h/" + "a" * 1500 + "SECRETTAIL end"
    assert each(column(spark, [long]), exprs.redact_text(F.col("v"))) == ["see [REDACTED URL] end"]
