"""A graph within its budgets: nodes and edges are admitted in the order in which findings add them, until a budget ends.

Findings come in the order of their fingerprints, and each adds its own node, its entities' nodes and the edges to them, one
after another. What is met again counts once, at its first place. Admission is a prefix of that order: places are counted
over written ranges, so no task orders the whole graph; the driver sees only the places at which budgets end. An edge needs both of its ends among the admitted nodes.

A node beyond its budget ends everything there. An edge beyond its budget is not added, the finding's own nodes still are,
and no later finding is looked at. Rules between findings follow only if nothing ended before: lines in the order of their
first finding, up to a line with more findings than its bucket holds, then the rules that span lines. Whatever ends early
makes the correlation ABORTED, and the budgets that did so are told.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from harborscan.functions.exprs import running_total
from harborscan.functions.scratch import stored
from harborscan.operators import correlation
from harborscan.operators.correlation import BUDGETS, complete, within_buckets

_EDGE = ["edge_type", "src", "dst", "confidence", "rule"]


class Graph(NamedTuple):
    """nodes: node_id, kind, place. edges: edge_id, edge_type, src, dst, confidence, rule, place. paths as attack_paths has
    them, with place. states: code, ended of each budget."""

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    states: DataFrame


def additions(findings: DataFrame) -> DataFrame:
    """fingerprint, step, id, kind (of nodes) and the columns of edges: what each finding adds, in the order of the steps."""
    f, own = complete(findings), correlation._node("fingerprint")
    nothing = F.lit(None).cast("string")

    def node(step: int, condition: str, id: Column, kind: str) -> Column:
        one = [F.lit(step).alias("step"), id.alias("id"), F.lit(kind).alias("kind"), *(nothing.alias(c) for c in _EDGE)]
        return F.when(F.expr(condition), F.struct(*one))

    def edge(step: int, condition: str, columns: list[Column]) -> Column:
        return F.when(F.expr(condition), F.struct(F.lit(step).alias("step"), columns[0].alias("id"), nothing.alias("kind"), *columns[1:]))

    made, parts = {}, [node(0, "true", own, "FINDING")]
    for i, (condition, kind, relation, entity, rule, inward) in enumerate(correlation._entities(f)):
        confidence = F.col("confidence") if kind in ("SOURCE", "SINK") else F.lit("HIGH")
        made[kind] = (condition, entity)
        parts += [node(2 * i + 1, condition, entity, kind), edge(2 * i + 2, condition, correlation._edge(relation, rule, *((entity, own) if inward else (own, entity)), confidence, True))]
    (one, source), (two, sink) = made["SOURCE"], made["SINK"]
    parts.append(edge(99, f"{one} AND {two}", correlation._edge("SOURCE_TO_SINK", "CORRELATION.SAST.TRACE", source, sink, F.col("confidence"), True)))
    return f.select("fingerprint", F.inline(F.array_compact(F.array(*parts))))


def _placed(added: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Each id once, with the fingerprint and step of its first addition and its place in that order, from 1."""
    first = added.groupBy(F.col("id").alias(name)).agg(F.min(F.struct("fingerprint", "step", *columns)).alias("first"))
    return running_total(first.select(name, "first.*"), ["fingerprint", "step", name], F.lit(1), "place")


def _end(placed: DataFrame, most: int, name: str) -> DataFrame:
    """One row: the fingerprint and step of what is first beyond the budget, or null."""
    return placed.where(F.col("place") == most + 1).agg(F.min(F.struct("fingerprint", "step")).alias(name))


def _local_edges(findings: DataFrame, bucket: int) -> tuple[DataFrame, str | None]:
    """Edges of lines (order: the line's first finding), and the first finding of the first line that is over the bucket."""
    lines = findings.groupBy("path", "line").agg(F.min("fingerprint").alias("first"), F.count("*").alias("n"))
    stop = lines.where(F.col("n") > bucket).agg(F.min("first")).first()[0]  # one row
    kept = within_buckets(findings, bucket)
    edges = correlation.supports(kept).withColumn("stage", F.lit(0)).unionByName(correlation.overlaps(kept).withColumn("stage", F.lit(1)))
    where = findings.select(F.concat(F.lit("f:"), "fingerprint").alias("src"), "path", "line").join(lines, ["path", "line"]).select("src", "first")
    edges = edges.join(where, "src")
    return (edges if stop is None else edges.where(F.col("first") < stop)), stop


def graph(findings: DataFrame, **budgets: int) -> Graph:
    """The graph of findings (one row a fingerprint) within the budgets, of which any may be given."""
    b = BUDGETS | budgets
    counted = running_total(findings, ["fingerprint"], F.lit(1), "__place")
    over_findings = counted.count() > b["max_findings"]
    f = (counted.where(F.col("__place") <= b["max_findings"]) if over_findings else counted).drop("__place")  # places only where some are beyond
    added = stored(additions(f), "additions")
    nodes = _placed(added.where("src IS NULL"), "node_id", ["kind"])
    edges = _placed(added.where("src IS NOT NULL"), "edge_id", _EDGE)
    n, e = _end(nodes, b["max_nodes"], "n").join(F.broadcast(_end(edges, b["max_edges"], "e"))).first()  # one row
    n, e = (x and (x.fingerprint, x.step) for x in (n, e))
    e = e if e and (n is None or e < n) else None
    n = n if n and (e is None or n[0] <= e[0]) else None  # what ends earlier keeps the other from being reached
    at = F.struct("fingerprint", "step")
    nodes = nodes.where((F.col("place") <= b["max_nodes"]) & (F.lit(e is None) | (F.col("fingerprint") <= F.lit(e and e[0])))).select("node_id", "kind", "place")
    edges = edges.where((F.col("place") <= b["max_edges"]) & (F.lit(True) if n is None else at < F.struct(F.lit(n[0]).alias("fingerprint"), F.lit(n[1]).alias("step")))).select("edge_id", *_EDGE, F.col("place").cast("long").alias("place"))
    ended = {"CORRELATION_FINDING_LIMIT": over_findings, "CORRELATION_NODE_LIMIT": n is not None, "CORRELATION_EDGE_LIMIT": e is not None, "CORRELATION_BUCKET_LIMIT": False, "CORRELATION_PATH_LIMIT": False}
    paths = correlation.attack_paths(f).withColumn("place", F.lit(0).cast("long"))
    if any(ended.values()):
        paths = paths.where("false")
    else:
        nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
        more, ended["CORRELATION_BUCKET_LIMIT"] = _rule_edges(f, nodes, edges, b["bucket"])
        before = edges.count()
        more = running_total(more, ["turn", "stage", "src", "dst", "edge_id"], F.lit(1), "place").withColumn("place", F.col("place").cast("long") + before)
        ended["CORRELATION_EDGE_LIMIT"] = bool(more.agg(F.max("place") > b["max_edges"]).first()[0])
        edges = edges.unionByName(more.where(F.col("place") <= b["max_edges"]).select("edge_id", *_EDGE, "place"))
        if any(ended.values()):
            paths = paths.where("false")
        else:
            paths = running_total(paths.drop("place"), ["title", "path_id"], F.lit(1), "place")
            ended["CORRELATION_PATH_LIMIT"] = bool(paths.agg(F.max("place") > b["max_paths"]).first()[0])
            paths = paths.where(F.col("place") <= b["max_paths"])
    return Graph(nodes, edges, paths, findings.sparkSession.createDataFrame(list(ended.items()), "code string, ended boolean"))


def _rule_edges(findings: DataFrame, nodes: DataFrame, edges: DataFrame, bucket: int) -> tuple[DataFrame, bool]:
    """Edges between findings that are no edges yet, with their turn and stage, and whether a line was over its bucket."""
    local, stop = _local_edges(findings, bucket)
    parts = [local.withColumn("turn", F.concat(F.lit("0"), "first")).drop("first")]
    if stop is None:
        wide = (correlation.secret_network(findings), correlation.dependency_use(findings), correlation.sequences(findings))
        parts += [w.withColumns({"stage": F.lit(2 + i), "turn": F.lit("1")}) for i, w in enumerate(wide)]
    found = stored(reduce(DataFrame.unionByName, parts), "rule_edges").dropDuplicates(["edge_id"])
    return correlation.anchored(found.join(edges.select("edge_id"), "edge_id", "left_anti"), nodes), stop is not None


def state(states: DataFrame) -> DataFrame:
    """One row, state: ABORTED if a budget ended, else COMPLETE."""
    return states.agg(F.when(F.bool_or("ended"), "ABORTED").otherwise("COMPLETE").alias("state"))
