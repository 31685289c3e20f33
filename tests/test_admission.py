"""Budgets of the graph in the order of insertion, against a walk over the findings one by one."""

import hashlib
import random

import pytest

from harborscan.operators import admission, correlation
from pyspark.sql import functions as F

COLUMNS = ["fingerprint", "scanner_id", "category", "rule_id", "path", "line", "col", "severity", "confidence", "function_id", "source_category", "source_line", "sink_kind", "package", "ecosystem", "version", "advisory_id", "import_name"]


def finding(rng, i):
    sast = rng.random() < 0.3
    package = rng.random() < 0.3
    return (
        hashlib.sha256(str(i).encode()).hexdigest(), "sast.python" if sast else "behavior", "sast" if sast else "behavior", "SAST.PYTHON.COMMAND_INJECTION" if sast else rng.choice(["BEHAVIOR.PROCESS_EXEC", "BEHAVIOR.SHELL_EXEC", "BEHAVIOR.NETWORK_REQUEST"]),
        f"p{rng.randint(0, 4)}.py", rng.randint(1, 6), 1, "MEDIUM", rng.choice(["LOW", "MEDIUM"]), rng.choice([None, "f", "g"]), rng.choice([None, "HTTP"]) if sast else None, "3", rng.choice([None, "exec"]) if sast else None,
        rng.choice(["a", "B"]) if package else None, "PyPI" if package else None, "1" if package else None, rng.choice([None, "CVE-1"]) if package else None, None,
    )


def walked(rows, max_nodes, max_edges):
    """Nodes, edges and ended budgets of the entity phase; rows: fingerprint, [(step, id, is an edge)]."""
    nodes, edges, ended = [], [], set()
    for _, steps in sorted(rows.items()):
        if ended:
            break
        for _, id, is_edge in sorted(steps):
            if not is_edge and id not in nodes:
                if len(nodes) >= max_nodes:
                    ended.add("CORRELATION_NODE_LIMIT")
                    break
                nodes.append(id)
            elif is_edge and id not in edges:
                if len(edges) >= max_edges:
                    ended.add("CORRELATION_EDGE_LIMIT")
                    continue
                edges.append(id)
    return nodes, edges, ended


SCHEMA = ", ".join(f"{c} {'long' if c in ('line', 'col') else 'string'}" for c in COLUMNS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [finding(rng, i) for i in range(40)]


@pytest.mark.parametrize("budgets", [(3, 1000), (1000, 5), (25, 60), (30, 31)])
def test_entities_within_budgets(spark, rows, budgets):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    steps = {}
    for r in admission.additions(df).collect():
        steps.setdefault(r.fingerprint, []).append((r.step, r.id, r.src is not None))
    nodes, edges, ended = walked(steps, *budgets)
    g = admission.graph(df, max_nodes=budgets[0], max_edges=budgets[1])
    assert [(r.node_id, r.place) for r in g.nodes.orderBy("place").collect()] == [(n, i) for i, n in enumerate(nodes, 1)]
    got = [r.edge_id for r in g.edges.orderBy("place").collect()]
    assert got[: len(edges)] == edges and (not ended or len(got) == len(edges))
    told = {r.code for r in g.states.where("ended").collect()}
    assert told == ended and admission.state(g.states).first()[0] == ("ABORTED" if ended else "COMPLETE")
    ids = {n for n in nodes}
    assert all(r.src in ids and r.dst in ids for r in g.edges.collect())


def test_same_graph_whatever_the_order(spark, rows):
    of = lambda df: [sorted(map(tuple, x.collect())) for x in admission.graph(df, max_nodes=50, max_edges=70)]
    mixed = list(rows)
    random.Random(8).shuffle(mixed)
    assert of(spark.createDataFrame(rows, SCHEMA)) == of(spark.createDataFrame(mixed, SCHEMA).repartition(5))


def test_all_edges_of_an_unbounded_graph(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    g = admission.graph(df)
    parts = [correlation.entity_edges(df), correlation.supports(df), correlation.overlaps(df), correlation.secret_network(df), correlation.dependency_use(df), correlation.sequences(df)]
    assert {r.edge_id for r in g.edges.collect()} == {r.edge_id for p in parts for r in p.collect()}
    assert {r.node_id for r in g.nodes.collect()} == {r.node_id for r in correlation.entity_nodes(df).collect()}


def test_rules_stop_at_a_full_bucket(spark, rows):
    """Lines are taken in the order of their first finding; rules that span lines don't follow."""
    df = spark.createDataFrame(rows, SCHEMA)
    lines = sorted((r.f, r.n, r.path, r.line) for r in df.groupBy("path", "line").agg(F.min("fingerprint").alias("f"), F.count("*").alias("n")).collect())
    most = max(n for _, n, *_ in lines) - 1
    before = {(p, n) for f, _, p, n in lines if f < next(g for g, k, *_ in lines if k > most)}
    g = admission.graph(df, bucket=most)
    assert {r.code for r in g.states.where("ended").collect()} == {"CORRELATION_BUCKET_LIMIT"} and g.paths.count() == 0
    place = {"f:" + r[0]: (r[4], r[5]) for r in rows}
    rules = [r for r in g.edges.collect() if not r.rule.startswith(("CORRELATION.ENTITY", "CORRELATION.SAST.TRACE"))]
    want = [r for p in (correlation.supports(df), correlation.overlaps(df)) for r in p.collect() if place[r.src] in before]
    assert {r.edge_id for r in rules} == {r.edge_id for r in want}


def test_finding_and_path_budgets(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    g = admission.graph(df, max_findings=7)
    first = sorted(r[0] for r in rows)[:7]
    assert sorted(r.node_id for r in g.nodes.where("kind = 'FINDING'").collect()) == ["f:" + x for x in first]
    assert {r.code for r in g.states.where("ended").collect()} == {"CORRELATION_FINDING_LIMIT"}
    empty = admission.graph(df.limit(0))
    assert empty.nodes.count() == empty.edges.count() == 0 and admission.state(empty.states).first()[0] == "COMPLETE"


def test_places_of_findings_only_where_some_are_beyond(spark, monkeypatch):
    plans, kept = {}, admission.stored

    def stored(df, what):
        plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString())
        return kept(df, what)

    monkeypatch.setattr(admission, "stored", stored)
    rows = [(f"{i:064x}", "behavior.static", "behavior", "BEHAVIOR.PROCESS_EXEC", "a", i, 1, "MEDIUM", "HIGH") for i in range(6)]
    f = spark.createDataFrame(rows, "fingerprint string, scanner_id string, category string, rule_id string, path string, line long, col long, severity string, confidence string")
    assert admission.graph(f, max_nodes=3, max_findings=6).nodes.count() == 3 and "Window" not in plans.pop("additions")
    cut = admission.graph(f, max_nodes=100, max_findings=5)
    assert cut.nodes.where("kind = 'FINDING'").count() == 5 and "Window" in plans["additions"]
    assert cut.states.where("code = 'CORRELATION_FINDING_LIMIT'").first().ended
