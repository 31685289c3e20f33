"""The wired scan on small sets of files: caps with states, encodings, scope, key blocks, and empty input."""

import pytest
from pyspark.sql import functions as F

from harborscan.operators import discovery, scan, secret_rules

FILES = "path string, content binary"


def run(spark, files, **kw):
    return scan.scan(spark.createDataFrame([(p, None if t is None else t if isinstance(t, bytes) else t.encode()) for p, t in files], FILES), **kw)


def test_caps_tell_what_they_cut(spark):
    token = lambda i: f"ghp_{i:036d}"
    many = "\n".join(f"a = {token(i)}" for i in range(6))
    done = run(spark, [("a.ini", many), ("b.ini", f"x {token(91)}\ny {token(92)}\npassword = 'Zz9_x1-y2'"), ("c.ini", f"z {token(99)}"), ("d.ini", "nothing")], per_rule=3, per_file=2, total=3)
    rows = sorted((r.path, r.line) for r in done.findings.collect())
    assert rows == [("a.ini", 1), ("a.ini", 2), ("b.ini", 1)]
    notes = {(r.code, r.path) for r in done.notes.collect()}
    assert notes == {("SECRET_MATCH_LIMIT_REACHED", "a.ini"), ("SECRET_MATCH_LIMIT_REACHED", "b.ini"), ("SECRET_TOTAL_LIMIT_REACHED", "b.ini"), ("SECRET_TOTAL_LIMIT_REACHED", "c.ini")}
    one = done.secrets.first()
    assert (one.emitted, one.candidates, one.state) == (3, 10, "ABORTED") and one.considered == 4
    assert {r.component: r.state for r in done.states.collect()}["secrets"] == "ABORTED"
    assert scan.decision(done).first().status == "BLOCK"


def test_encodings_scope_and_context(spark):
    value = "Aa9_k3m5p7r9t1v3"
    files = [
        ("u16.ini", ("﻿password = '" + value + "'\n").encode("utf-16-le")), ("bom.ini", b"\xef\xbb\xbfpassword = '" + value.encode() + b"'"), ("bad.ini", b"ok\n" * 4000 + b"password = '\xff" + value.encode() + b"'"),
        ("none.ini", None), ("empty.ini", ""), ("tests/test_a.py", "password = 'fake-login'"), ("a.py", "import secrets\n\nkey = 1\napi_key = secrets.token_hex(32)"), ("b.py", "api_key = secrets.token_hex(32)"),
        ("c.js", f"const password =\n  '{value}';\nconst token = process.env.TOKEN;"), ("build/x.ini", f"password = '{value}'"), ("long.ini", f"password = '{value}' # " + "x" * 20000), ("x.exe", b"MZ" + value.encode()),
        ("key.ini", f"-----BEGIN PRIVATE KEY-----\npassword = '{value}'"),
    ]
    done = run(spark, files)
    got = {(r.path, r.line, r.rule_id.split(".", 1)[1]) for r in done.findings.where("scanner_id = 'secrets'").collect()}
    assert got == {("u16.ini", 1, "GENERIC.ASSIGNMENT"), ("bom.ini", 1, "GENERIC.ASSIGNMENT"), ("b.py", 1, "GENERIC.ASSIGNMENT"), ("c.js", 2, "GENERIC.ASSIGNMENT"), ("key.ini", 1, "PRIVATE_KEY.PEM")}
    notes = {(r.code, r.path) for r in done.notes.where("component = 'secrets'").collect()}
    assert notes == {("SECRET_DECODE_FAILED", "bad.ini"), ("SECRET_DECODE_FAILED", "none.ini"), ("SECRET_LINE_TOO_LONG", "long.ini"), ("SECRET_PRIVATE_KEY_UNTERMINATED", "key.ini")}
    seen = done.traversal.first()
    assert (seen.entries_seen, seen.files_excluded, seen.directories_visited, seen.directories_excluded) == (13, 1, 1, 1)
    assert done.secrets.first().suppressed == 2
    assert not any(value in str(r) for r in done.findings.collect())


@pytest.mark.parametrize("files", [[], [("a.bin", b"\x00\x01\x02\x03")]])
def test_nothing_to_find(spark, files):
    done = run(spark, files)
    assert done.findings.count() == 0 and done.notes.count() == 0 and done.secrets.first().state == "COMPLETE"
    assert scan.decision(done).first().status == "PASS"


def test_files_are_read_once(spark):
    """No step after the first pass goes back to the files, and no order of all hits is made where none is beyond the total."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def content(path):
        seen.add(1)
        return f"const password = 'Aa9_k3m5p7r9t1v3';\nfetch('{path}')".encode()

    paths = spark.createDataFrame([("a/x.js",), ("b/y.js",)], "path string")
    done = scan.scan(paths.select("path", content("path").alias("content")))
    assert done.findings.count() == 4 and scan.decision(done).first().n_warnings == 4 and seen.value == 2


def test_files_of_several_parts(spark, monkeypatch):
    """Blocks and caps are carried from part to part of a file, as within one."""
    value = "Aa9_k3m5p7r9t1v3"
    text = "\n".join(["password = '" + value + "'", "-----BEGIN PRIVATE KEY-----", "x", f"token = '{value}'", "-----END PRIVATE KEY-----", *(f"a = ghp_{k:036d}" for k in range(4)), f"password = '{value}'"])
    files = [("a.ini", text), ("b.ini", f"x ghp_{9:036d}"), ("deploy/ghp_" + "a1" * 18 + ".sh", "curl x\neval $(y)\nwget z"), ("deploy/ghp_" + "b1" * 18 + ".sh", f"x ghp_{9:036d}\ncurl x")]
    made = []
    for part in (1 << 16, 2):
        monkeypatch.setattr(secret_rules, "PART_LINES", part)
        done = run(spark, files, per_rule=2, per_file=4, behavior_per_file=2)
        made.append([sorted(map(tuple, df.collect())) for df in (done.findings, done.notes, done.secrets, done.states)])
    assert made[0] == made[1] and len(made[0][0]) == 9 and {n[1] for n in made[0][1]} == {"SECRET_MATCH_LIMIT_REACHED", "BEHAVIOR_MATCH_LIMIT_REACHED"}


def test_plain_text_is_told_without_python(spark):
    rows = [None, b"", b"a\xc3\xa9\n", b"MZ text", b"%PDF-1", b"\xef\xbb\xbfx", b"a\x00b", b"\x01" + b"a" * 10, b"\x01" + b"a" * 100, b"\xff\xfea\x00", b"a\xff", b"a\x0b", b"a" * 9000, b"a" * 8191 + b"\xc3\xa9", b"a" * 9000 + b"\xff", b"\xed\xa0\x80", b"\x7fELFx"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c binary")
    both = df.select("k", scan._told(F.col("c")).alias("s"), discovery.sniff(F.col("c")).alias("t")).collect()
    assert [(r.k, *r.s) for r in both] == [(r.k, r.t.content_kind, r.t.encoding) for r in both]


def test_a_gate_spares_what_does_not_change_it(spark):
    """Neighbours of network calls change no priority, so the decision does not join them; assessments tell them all the same."""
    from harborscan.operators import correlation, report

    row = ("a" * 64, "secrets", "secret", "R", "p", 1, 1, "HIGH", "LOW")
    other = ("b" * 64, "behavior.static", "behavior", "BEHAVIOR.NETWORK_REQUEST", "p", 2, 1, "INFO", "LOW")
    found = spark.createDataFrame([row, other], "fingerprint string, scanner_id string, category string, rule_id string, path string, line long, col long, severity string, confidence string")
    assessed = correlation.assessments(found, correlation.supports(found), correlation.secret_network(found))
    assert {r.exposure for r in assessed.collect()} == {"NETWORK_CONTEXT"}
    gate = report.gate(assessed, spark.createDataFrame([("COMPLETE",)], "overall string"))
    assert "s_line" not in gate._jdf.queryExecution().optimizedPlan().toString() and gate.first().n_blockers == 1
