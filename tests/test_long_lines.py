"""Windows over long lines, key blocks swept in parts, and files that grow."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from harborscan.functions import exprs
from harborscan.operators import long_lines, secret_rules
from harborscan.streaming import streams


def piece(rng):
    h = hashlib.md5(str(rng.random()).encode()).hexdigest()
    rare = lambda text, share, other: text if rng.random() < share else other
    return rng.choice([
        f"ghp_{h}{h[:4]}", f"password='Aa9_{h[:16]}'", f"token={h}", f"token=password=secret=Aa9_{h}", "é漢𝄞", "word " * rng.randint(1, 20), f"xoxb-{h[:20]}-xoxb-{h[:24]}", f"db postgres://app:{h[:12]}@db/x",
        rare("-----BEGIN RSA PRIVATE KEY-----", 0.1, "x"), rare("-----END RSA PRIVATE KEY-----", 0.1, "y"), f"secret {h}-{h}", "password = " + " " * rng.randint(0, 50) + f"Zz9/{h}", rare("example", 0.1, "z"), rare("sha256", 0.03, "q"), "token: <your_token>",
    ])


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(1)
    rows = [(f"f{p}", n, rng.choice([" ", ",", ";"]).join(piece(rng) for _ in range(rng.randint(0, 60)))) for p in range(3) for n in range(12)]
    return spark.createDataFrame(rows, "path string, line long, text string")


@pytest.mark.parametrize("size", [64, 1000])
def test_windows_find_what_whole_lines_hold(spark, lines, size):
    want = sorted(tuple(r) for r in secret_rules.detect(lines, max_bytes=1 << 30).collect())
    assert want and sorted(tuple(r) for r in long_lines.scan(lines, size).collect()) == want


def test_windows_cut_between_characters(spark):
    text = "é漢𝄞a" * 300
    rows = long_lines.windows(spark.createDataFrame([("p", 1, text), ("q", 1, ""), ("r", 1, None)], "path string, line long, text string"), 7).orderBy("chunk").collect()
    assert "".join(r.text[r.lead : r.lead + r.own] for r in rows) == text and {r.path for r in rows} == {"p"} and len(rows) == -(-len(text.encode()) // 7)


def test_blanks_that_run_on_are_told(spark):
    texts = ["password" + " " * 4096 + "= Aa9_0123456789abcdef", "password = " + " " * 4095 + "Aa9_0123456789abcdef", "x" + " " * 9000, "password =" + " " * 4095 + "Aa9_0123456789abcdef"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "path string, line long, text string")
    for size in (512, 1 << 17):
        found = long_lines.found_in(long_lines.windows(df, size))
        assert [r.state for r in long_lines.states(found).orderBy("line").collect()] == ["INCOMPLETE", "INCOMPLETE", "COMPLETE", "COMPLETE"]
    assert [(r.line, r.start) for r in long_lines.scan(df, 512).where("rule_id = 'SECRET.GENERIC.ASSIGNMENT'").collect()] == [(3, 4105)]


def test_possible_spans_overlap(spark):
    df = spark.createDataFrame([("aaa bab",), ("aab",), ("",), (None,), ("b",)], "t string")
    got = [[(s.start, s.end, s.value) for s in r.s] for r in df.select(exprs.possible_spans(F.col("t"), "aa|ab").alias("s")).collect()]
    assert got == [[(0, 2, "aa"), (1, 3, "aa"), (5, 7, "ab")], [(0, 2, "aa"), (1, 3, "ab")], [], [], []]


def test_key_blocks_in_parts(spark, monkeypatch):
    """The open block goes on over the parts of a file."""
    rng = random.Random(5)
    text = lambda: rng.choice(["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----END-----END PRIVATE KEY-----", *["x"] * 9])
    rows = [(f"p{p}", n, text()) for p in range(3) for n in range(200)]
    want, inside = [], {}
    for p, n, t in rows:
        was = inside.get(p, False)
        want.append((p, n, was))
        begin, end = t.find("-----BEGIN PRIVATE KEY-----"), t.rfind("-----END PRIVATE KEY-----")
        inside[p] = (end < 0) if was else begin >= 0 and end < begin
    df = spark.createDataFrame(rows, "path string, line long, text string").repartition(4)
    for part in (1, 7, 1 << 16):
        monkeypatch.setattr(secret_rules, "PART_LINES", part)
        assert sorted((r.path, r.line, r.inside_key) for r in secret_rules.outside_key_blocks(df).collect()) == want
    assert sorted(r.path for r in secret_rules.unterminated(df).collect()) == sorted(p for p, open_ in inside.items() if open_)


def test_detectors_join_no_ranges(spark, lines):
    plan = secret_rules.detect(lines)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_growing_files(spark):
    """Parts that are cut anywhere and come out of turn give every line once, with context on both sides."""
    text = "token=abc\n" + "é word password='Aa9_0123456789abcdef' " * 60 + "\n\nlast ghp_" + "a1" * 18
    parts = [("f", i // 300, text[i : i + 300], i + 300 >= len(text)) for i in range(0, len(text), 300)] + [("g", 0, None, False), ("g", 1, "z", False)]
    df = lambda rows: spark.createDataFrame(rows, "path string, seq long, text string, last boolean")
    made = streams.arrivals(spark, [df(parts[5:2:-1]), df(parts[:3] + parts[:1]), df(parts[6:])], lambda rows: streams.grown(rows, chunk=100, left=20, right=50))
    rows = made.orderBy("line", "chunk").collect()
    whole = {n: t for n, t in enumerate(text.split("\n"), 1) if t}
    assert {n: "".join(r.text[r.lead : r.lead + r.own] for r in rows if r.line == n) for n in whole} == whole and {r.path for r in rows} == {"f"}
    long = [r for r in rows if r.line == 2]
    assert [r.chunk for r in long] == list(range(len(long))) and all(r.lead == 20 for r in long[1:]) and all(len(r.text) == r.lead + r.own + min(50, max(0, len(whole[2]) - 100 * (r.chunk + 1))) for r in long)
