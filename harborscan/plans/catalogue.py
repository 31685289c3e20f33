"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from harborscan.operators import report
from harborscan.plans import code_queries, context_queries, dependency_queries, discovery_queries, gate_queries, package_queries, project_queries, scan_queries, stream_queries

MODULES = [discovery_queries, gate_queries, scan_queries, context_queries, dependency_queries, package_queries, code_queries, stream_queries, project_queries]


def flagship(spark, sf_dir):
    """The gate's decision with the count of each severity."""
    counts = report.severity_counts(scan_queries.all_findings(spark, sf_dir))
    return counts.join(scan_queries.gate_decision(spark, sf_dir).select("status", "coverage", "reasons"))


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
