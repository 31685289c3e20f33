"""The include graph against walks in plain Python."""

import random

from harborscan.operators import includes


def naive(edges):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    reach = {}
    for a in {x for e in edges for x in e}:
        todo, seen = [a], set()
        while todo:
            for x, y in edges:
                if x in todo and y not in seen:
                    seen.add(y)
                    todo.append(y)
            todo = [y for y in seen if any(x == y and z not in seen for x, z in edges)]
        reach[a] = seen
    out = set()
    for a in reach:
        if a in reach[a]:
            ring = {b for b in reach[a] if a in reach[b]}
            out.add((a, min(ring), len(ring)))
    return out


def found(spark, edges):
    return {tuple(r) for r in includes.cycles(spark.createDataFrame(edges, "path string, target string")).collect()}


def test_cycles_of_any_shape(spark):
    ring = [(f"r{k}", f"r{(k + 1) % 11}") for k in range(11)]  # longer than the eight steps of a walk
    edges = ring + [("in", "r3"), ("r5", "out"), ("self", "self"), ("r2", "r2"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("a", "b"), (None, "a"), ("a", None)]
    assert found(spark, edges) == naive(edges)
    assert found(spark, []) == set()


def test_cycles_of_a_random_graph(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(75)]
    assert found(spark, edges) == naive(edges)


def test_constraints_files(spark):
    files = spark.createDataFrame([(x,) for x in "abcd"], "path string")
    edges = spark.createDataFrame([("a", "b", True), ("b", "c", False), ("a", "c", None), ("c", "a", False), ("c", "x", False), ("d", "a", True)], "path string, target string, constraint_only boolean")
    states = includes.reached(files, edges, spark.createDataFrame([("a",), ("x",)], "path string"))
    assert sorted(map(tuple, states.collect())) == [("a", False, 0), ("a", True, 3), ("b", True, 1), ("c", False, 1), ("c", True, 2)]
    one = includes.reached(files, edges, spark.createDataFrame([("a",)], "path string"), max_depth=1)
    assert sorted(map(tuple, one.collect())) == [("a", False, 0), ("b", True, 1), ("c", False, 1)]
    records = spark.createDataFrame([("b", "p", "1.0", "EXACT", "DIRECT", None), ("b", "q", None, "CONSTRAINT", "DIRECT", ">2"), ("d", "z", "1", "EXACT", "DIRECT", None), ("c", "r", "3", "EXACT", "DIRECT", None)], "path string, name string, version string, version_kind string, directness string, constraint string")
    got = {tuple(r) for r in includes.as_read(records, states).collect()}
    assert got == {("b", "p", None, "CONSTRAINT", "UNKNOWN", "==1.0", True), ("b", "q", None, "CONSTRAINT", "UNKNOWN", ">2", True), ("c", "r", "3", "EXACT", "DIRECT", None, False), ("c", "r", None, "CONSTRAINT", "UNKNOWN", "==3", True)}


def test_no_table_of_unbounded_size_is_sent_to_all_tasks(spark, monkeypatch):
    """Where no number of rows may be sent, no join of the walks is a broadcast, however small its tables look."""
    monkeypatch.setattr(includes, "FEW", -1)
    plans, kept = [], includes.stored

    def stored(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, what)

    monkeypatch.setattr(includes, "stored", stored)
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("s", "s")]
    assert found(spark, edges) == naive(edges)
    rows = spark.createDataFrame([(p, t, p == "b") for p, t in edges], "path string, target string, constraint_only boolean")
    made = includes.reached(rows.select("path"), rows, rows.where("path = 'a'").select("path"))
    assert {(r.path, r.constraint_only, r.depth) for r in made.collect()} == {("a", False, 0), ("b", False, 1), ("a", True, 2), ("c", True, 2), ("b", True, 3), ("d", True, 3)}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_states_are_reached_over_any_number_of_steps(spark, monkeypatch):
    chain = [(f"f{k:02}", f"f{k + 1:02}", k == 9) for k in range(11)]  # longer than the eight steps of a walk
    edges = spark.createDataFrame([*chain, ("f11", "f07", False), ("f05", "f05", False), ("alone", "alone", True), ("f02", "gone", False), ("f01", "f02", None)], "path string, target string, constraint_only boolean")
    files = spark.createDataFrame([(f"f{k:02}",) for k in range(12)] + [("alone",), ("bare",)], "path string")
    roots = spark.createDataFrame([("f00",), ("alone",), ("bare",), ("gone",)], "path string")
    want = {(f"f{k:02}", k > 9) for k in range(12)} | {(f"f{k:02}", True) for k in range(7, 10)} | {("alone", False), ("alone", True), ("bare", False)}
    assert {(r.path, r.constraint_only) for r in includes.reached(files, edges, roots).collect()} == want
    for block, merges in ((1000, 24), (12, 24), (8, 1)):  # one block, parts that share blocks, parts cut into blocks
        monkeypatch.setattr(includes, "BLOCK", block)
        monkeypatch.setattr(includes, "MERGES", merges)
        got = includes.reachable(files, edges, roots).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert includes.reachable(files, edges, roots.limit(0)).count() == 0 and includes.reachable(files, edges.limit(0), roots).count() == 3


def test_blocks_of_a_random_graph(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}", rng.random() < 0.2) for _ in range(44)]
    edges = spark.createDataFrame(rows, "path string, target string, constraint_only boolean")
    files, roots = spark.createDataFrame([(f"n{k:02}",) for k in range(38)], "path string"), spark.createDataFrame([(f"n{k:02}",) for k in range(5)], "path string")
    want = {(r.path, r.constraint_only) for r in includes.reached(files, edges, roots).collect()}
    monkeypatch.setattr(includes, "BLOCK", 20)
    assert {tuple(r) for r in includes.reachable(files, edges, roots).collect()} == want


def test_query_of_constraints_files_has_no_depth():
    from harborscan.plans import dependency_queries

    assert "depth" not in dependency_queries.SQL["dependency_constraint_files"]
