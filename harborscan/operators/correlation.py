"""Findings as a typed graph: nodes, edges, groups, attack paths and explained priorities.

A finding has fingerprint, scanner_id, category, rule_id, path, line, col, severity, confidence; functions, sources and
packages are optional columns (function_id, source_category, package). Every join is on a file, a line or a name; the
line distance of secrets and network calls is joined by buckets of lines, so that a file is no cross product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.functions.exprs import CONFIDENCES, SEVERITIES, fingerprint, rank, redact_path, unrank

# Which behaviours agree with which rule, and the sets of rules that the clusters need.
COMMAND = ["BEHAVIOR.PROCESS_EXEC", "BEHAVIOR.SHELL_EXEC", "BEHAVIOR.POWERSHELL_EXEC", "BEHAVIOR.CMD_EXEC"]
PERSISTENCE = ["BEHAVIOR.REGISTRY_WRITE", "BEHAVIOR.STARTUP_PERSISTENCE", "BEHAVIOR.SCHEDULED_TASK", "BEHAVIOR.SERVICE_MODIFICATION"]
NETWORK, PROCESS = "BEHAVIOR.NETWORK_REQUEST", "BEHAVIOR.PROCESS_EXEC"
OPTIONAL = dict.fromkeys(["function_id", "source_category", "source_line", "sink_kind", "package", "ecosystem", "version", "advisory_id", "import_name"], "string")
PROXIMITY = 5


def short_id(*fields: Column | str) -> Column:
    return F.substring(fingerprint(*fields), 1, 24)


def complete(findings: DataFrame) -> DataFrame:
    """findings with all optional columns."""
    return findings.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in findings.columns})


# The shapes of identifiers, and the budgets.
TOKEN = r"^[A-Za-z0-9_.:@/+\-]{1,256}$"
BUDGETS = {"max_findings": 10_000, "max_nodes": 20_000, "max_edges": 30_000, "max_paths": 1000, "bucket": 32}


def invalid_reason(f: DataFrame) -> Column:
    """Why a finding is not admitted, by the first test that fails; null if it is. Columns for evidence (array of k, v),
    package, version and advisory_id are tested where the table has them."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    token = lambda c: yes(F.col(c).rlike(TOKEN))
    out = F.when(F.col("fingerprint").isNull() | F.col("path").isNull(), "INVALID_IDENTITY_OR_LOCATION_TYPE")
    if "evidence" in f.columns:
        sound = (F.size("evidence") <= 64) & F.forall("evidence", lambda e: e["k"].isNotNull() & e["v"].isNotNull() & (F.length(e["k"]) <= 128) & (F.length(e["v"]) <= 2048))
        out = out.when(F.col("evidence").isNull() | ~yes(sound), "INVALID_STRUCTURED_EVIDENCE")
    if "package" in f.columns:
        version = F.lit(True) if "version" not in f.columns else F.col("version").isNull() | token("version")
        out = out.when(F.col("package").isNotNull() & ~(token("package") & token("ecosystem") & version), "INVALID_DEPENDENCY_COORDINATE")
    if "advisory_id" in f.columns:
        out = out.when(F.col("advisory_id").isNotNull() & ~token("advisory_id"), "INVALID_VULNERABILITY_REFERENCE")
    path = F.col("path")
    odd = path.rlike(r"^/|\\|:|(^|/)(\.\.?)?(/|$)|[\x00-\x1f]") | (F.length(path) > 512)
    place = odd | F.col("line").isNull() | ~F.col("line").between(1, 10_000_000) | ~F.coalesce(F.col("col"), F.lit(1)).between(1, 1_000_000)
    return (
        out.when(~yes(F.col("fingerprint").rlike("^[0-9a-f]{64}$")), "INVALID_FINGERPRINT")
        .when((redact_path(path) != path) & (F.length(path) <= 512), "UNREDACTED_OR_UNSAFE_PATH").when(yes(place), "INVALID_LOCATION")
        .when(rank(F.col("severity"), SEVERITIES).isNull() | rank(F.col("confidence"), CONFIDENCES).isNull(), "INVALID_SEVERITY_OR_CONFIDENCE")
        .when(~(token("rule_id") & token("scanner_id") & token("category")), "INVALID_RULE_SCANNER_OR_CATEGORY")
    )


def invalid_details(findings: DataFrame, most: int = 100) -> DataFrame:
    """code, count, path, message of rejected findings: the first in the order of ``ordinal`` one by one (a bounded list),
    the rest as one row. Only safe parts of a finding are told."""
    bad = findings.withColumn("__reason", invalid_reason(findings)).where("__reason IS NOT NULL")
    yes = lambda c: F.coalesce(c, F.lit(False))
    identity = F.when(yes(F.col("fingerprint").rlike("^[0-9a-f]{64}$")), F.col("fingerprint")).otherwise(F.concat(F.lit("input-"), F.col("ordinal").cast("string")))
    rule = F.when(yes(F.col("rule_id").rlike(r"^[A-Z][A-Z0-9_.]{0,127}$")), redact_path(F.col("rule_id"))).otherwise("unavailable")
    safe = yes(~F.col("path").rlike(r"^/|\\|:|(^|/)(\.\.?)?(/|$)") & F.length("path").between(1, 512))
    line = F.when(F.col("line").between(1, 10_000_000), F.col("line").cast("string")).otherwise("unknown")
    message = F.concat(F.lit("Correlation input rejected (scanner pipeline); finding="), identity, F.lit("; rule="), rule, F.lit("; line="), line, F.lit("; reason="), F.col("__reason"))
    code, one = F.lit("CORRELATION_INVALID_FINDING").alias("code"), F.lit(1).cast("long").alias("count")
    first = bad.orderBy("ordinal").limit(most).select(code, one, F.when(safe, redact_path(F.col("path"))).alias("path"), message.alias("message"))
    rest = bad.agg((F.count("*") - most).alias("count")).where("count > 0").select(code, "count", F.lit(None).cast("string").alias("path"), F.lit(f"reason=DETAILS_OMITTED; attribution limit={most}").alias("message"))
    return first.unionAll(rest)


def ingested(findings: DataFrame) -> DataFrame:
    """One row per fingerprint (the first in rule, path and line order) with the number of equal and of clashing others."""
    order = ["rule_id", "scanner_id", "path", "line", "col"]
    first = F.min(F.struct(*order, *(c for c in findings.columns if c not in order + ["fingerprint"]))).alias("f")
    place = F.struct(*order)
    kept = findings.groupBy("fingerprint").agg(first, F.count("*").alias("n"), F.count_if(F.lit(True)).alias("__n"), F.collect_set(place).alias("__places"))
    return kept.select("fingerprint", "f.*", (F.size("__places") - 1).cast("long").alias("n_collisions"), (F.col("n") - F.size("__places")).cast("long").alias("n_duplicates"))


def _edge(kind: str, rule: str, a: Column, b: Column, confidence: Column, directed: bool) -> list[Column]:
    left, right = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
    return [short_id("edge-v1", kind, left, right, rule).alias("edge_id"), F.lit(kind).alias("edge_type"), left.alias("src"), right.alias("dst"), confidence.alias("confidence"), F.lit(rule).alias("rule")]


def _lower(a: str, b: str) -> Column:
    return unrank(F.least(rank(F.col(a), CONFIDENCES), rank(F.col(b), CONFIDENCES)), CONFIDENCES)


def _node(column: str) -> Column:
    return F.concat(F.lit("f:"), F.col(column))


def _side(df: DataFrame, mark: str, keys: list[str]) -> DataFrame:
    """df with all columns but the keys renamed for one side of a join."""
    return df.select(*keys, *(F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in keys))


def _entities(f: DataFrame) -> list[tuple[str, str, str, Column, str, bool]]:
    """(condition, node kind, edge kind, the entity's node, the edge's rule, whether the edge ends at the finding)."""
    own = "category = 'sast' AND source_category IS NOT NULL AND source_line IS NOT NULL"
    return [
        ("true", "FILE", "SAME_FILE", F.concat(F.lit("file:"), short_id("file-v1", F.col("path"))), "CORRELATION.ENTITY.FILE", False),
        ("function_id IS NOT NULL", "FUNCTION", "SAME_FUNCTION", F.concat(F.lit("function:"), short_id("function-v1", F.col("path"), F.col("function_id"))), "CORRELATION.ENTITY.FUNCTION", False),
        ("package IS NOT NULL", "DEPENDENCY", "SAME_DEPENDENCY", F.concat(F.lit("dependency:"), short_id("dependency-v1", F.col("ecosystem"), F.lower("package"), F.coalesce("version", F.lit("")))), "CORRELATION.ENTITY.DEPENDENCY", False),
        ("package IS NOT NULL AND advisory_id IS NOT NULL", "VULNERABILITY", "SAME_VULNERABILITY", F.concat(F.lit("vulnerability:"), short_id("vulnerability-v1", F.col("advisory_id"))), "CORRELATION.ENTITY.VULNERABILITY", False),
        (own, "SOURCE", "SAME_SOURCE", F.concat(F.lit("source:"), short_id("source-v1", F.col("path"), F.col("source_category"), F.col("source_line"))), "CORRELATION.ENTITY.SOURCE", True),
        ("category = 'sast' AND sink_kind IS NOT NULL", "SINK", "SAME_SINK", F.concat(F.lit("sink:"), short_id("sink-v1", F.col("path"), F.col("line"), F.col("sink_kind"))), "CORRELATION.ENTITY.SINK", False),
    ]


def entity_nodes(findings: DataFrame) -> DataFrame:
    """node_id, kind: findings, files, functions, packages, advisories, and sources and sinks of findings of category ``sast``."""
    f = complete(findings)
    kinds = [f.select(_node("fingerprint").alias("node_id"), F.lit("FINDING").alias("kind"))]
    kinds += [f.where(condition).select(node.alias("node_id"), F.lit(kind).alias("kind")) for condition, kind, _, node, _, _ in _entities(f)]
    return reduce(DataFrame.unionAll, kinds).distinct()


def entity_edges(findings: DataFrame) -> DataFrame:
    """Edges of findings with their entities, and of a finding's source with its sink."""
    f, own = complete(findings), _node("fingerprint")
    made, parts = {}, []
    for condition, kind, edge, node, rule, inward in _entities(f):
        confidence = F.col("confidence") if kind in ("SOURCE", "SINK") else F.lit("HIGH")
        made[kind] = (condition, node)
        parts.append(f.where(condition).select(*_edge(edge, rule, *((node, own) if inward else (own, node)), confidence, True)))
    (one, source), (two, sink) = made["SOURCE"], made["SINK"]
    parts.append(f.where(f"{one} AND {two}").select(*_edge("SOURCE_TO_SINK", "CORRELATION.SAST.TRACE", source, sink, F.col("confidence"), True)))
    return reduce(DataFrame.unionAll, parts).dropDuplicates(["edge_id"])


def anchored(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes, each id once."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").dropDuplicates(["edge_id"])


def anchored_entity_edges(findings: DataFrame) -> DataFrame:
    """The entity edges both of whose ends are entity nodes of the same findings. Each end that has a name is one, as an
    edge's condition holds its nodes' conditions: so no edge meets the table of nodes, and edges are dealt once."""
    return entity_edges(findings).where("src IS NOT NULL AND dst IS NOT NULL")


def supports(findings: DataFrame) -> DataFrame:
    """Behaviours that agree with a vulnerability on its line, and general ones with special ones on their column."""
    keys = ["path", "line"]
    behaviour = findings.where("scanner_id IN ('behavior', 'behavior.static')")
    b, s = _side(behaviour, "b", keys), _side(findings.where("scanner_id IN ('sast', 'sast.python')"), "s", keys)
    agree = ((F.col("s_rule_id") == "SAST.PYTHON.COMMAND_INJECTION") & F.col("b_rule_id").isin(*COMMAND)) | ((F.col("s_rule_id") == "SAST.PYTHON.DYNAMIC_CODE_EXEC") & (F.col("b_rule_id") == "BEHAVIOR.DYNAMIC_CODE"))
    sink = b.join(s, keys).where(agree).select(*_edge("SUPPORTS", "CORRELATION.SAST_BEHAVIOR.SAME_SINK", _node("b_fingerprint"), _node("s_fingerprint"), _lower("s_confidence", "b_confidence"), True))
    keys = ["path", "line", "col"]
    commands = behaviour.where(F.col("rule_id").isin(*COMMAND) & F.col("col").isNotNull())
    g, x = _side(commands.where(F.col("rule_id") == PROCESS), "g", keys), _side(commands.where(F.col("rule_id") != PROCESS), "x", keys)
    special = g.join(x, keys).select(*_edge("SUPPORTS", "CORRELATION.BEHAVIOR.SAME_SINK_SPECIFIC", _node("g_fingerprint"), _node("x_fingerprint"), _lower("g_confidence", "x_confidence"), True))
    return sink.unionAll(special).dropDuplicates(["edge_id"])


def overlaps(findings: DataFrame) -> DataFrame:
    """Command behaviours of different rules on one line."""
    keys = ["path", "line"]
    commands = within_buckets(findings.where(F.col("rule_id").isin(*COMMAND)))
    a, b = _side(commands, "a", keys), _side(commands, "b", keys)
    pairs = a.join(b, keys).where("a_fingerprint < b_fingerprint AND a_rule_id <> b_rule_id")
    return pairs.select(*_edge("OVERLAPS", "CORRELATION.BEHAVIOR.OVERLAP", _node("a_fingerprint"), _node("b_fingerprint"), _lower("a_confidence", "b_confidence"), False)).dropDuplicates(["edge_id"])


def secret_network(findings: DataFrame, proximity: int = PROXIMITY) -> DataFrame:
    """Secrets and network calls of a file within some lines, or in one function: a band join by buckets of lines."""
    f = complete(findings)
    width = proximity + 1
    secret = f.where("scanner_id = 'secrets'").select("path", "fingerprint", "line", "function_id")
    network = f.where(F.col("rule_id") == NETWORK).select("path", "fingerprint", "line", "function_id")
    s = _side(secret.withColumn("bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("line") / width) + d))), "s", ["path", "bucket"])
    n = _side(network.withColumn("bucket", F.floor(F.col("line") / width)), "n", ["path", "bucket"])
    close = s.join(n, ["path", "bucket"]).where(F.abs(F.col("s_line") - F.col("n_line")) <= proximity).drop("bucket")
    keys = ["path", "function_id"]
    same = _side(secret.where("function_id IS NOT NULL"), "s", keys).join(_side(network, "n", keys), keys)
    both = close.select("s_fingerprint", "n_fingerprint", F.coalesce(F.col("s_function_id") == F.col("n_function_id"), F.lit(False)).alias("same")).unionAll(same.select("s_fingerprint", "n_fingerprint", F.lit(True)))
    confidence = F.when(F.col("same"), "MEDIUM").otherwise("LOW")
    return both.distinct().select(*_edge("RELATED_BEHAVIOR", "CORRELATION.SECRET.NETWORK_CONTEXT", _node("s_fingerprint"), _node("n_fingerprint"), confidence, False))


def dependency_use(findings: DataFrame) -> DataFrame:
    """Packages of PyPI whose plain name is imported somewhere."""
    f = complete(findings)
    packages = f.where("ecosystem = 'PyPI' AND package IS NOT NULL AND NOT contains(package, '-')").select(F.lower("package").alias("name"), F.col("fingerprint").alias("a"))
    imports = f.where("import_name IS NOT NULL").select(F.lower("import_name").alias("name"), F.col("fingerprint").alias("b"))
    return packages.join(imports, "name").select(*_edge("POSSIBLE_DEPENDENCY_USE", "CORRELATION.DEPENDENCY.PROJECT_REFERENCE", _node("a"), _node("b"), F.lit("MEDIUM"), False)).dropDuplicates(["edge_id"])


def sequences(findings: DataFrame, proximity: int = PROXIMITY) -> DataFrame:
    """A network call and a later process start of one function, within some lines: joined by buckets as well."""
    f = complete(findings).where("function_id IS NOT NULL")
    width, keys = proximity + 1, ["path", "function_id", "bucket"]
    n = f.where(F.col("rule_id") == NETWORK).withColumn("bucket", F.explode(F.array(F.floor(F.col("line") / width), F.floor(F.col("line") / width) + 1)))
    e = f.where(F.col("rule_id") == PROCESS).withColumn("bucket", F.floor(F.col("line") / width))
    pairs = _side(n.select(*keys, "fingerprint", "line"), "n", keys).join(_side(e.select(*keys, "fingerprint", "line"), "e", keys), keys).where((F.col("n_line") < F.col("e_line")) & (F.col("e_line") - F.col("n_line") <= proximity))
    return pairs.select(*_edge("POSSIBLE_SEQUENCE", "CORRELATION.BEHAVIOR.LOCAL_SEQUENCE", _node("n_fingerprint"), _node("e_fingerprint"), F.lit("LOW"), True)).dropDuplicates(["edge_id"])


def attack_paths(findings: DataFrame, proximity: int = PROXIMITY) -> DataFrame:
    """path_id, title, members, severity, confidence: downloads that are launched, and clusters of one function.

    A cluster is the first network call, the first persistence or credential access, and the first process start of a
    function, if their lines span no more than ``proximity``.
    """
    f = complete(findings)
    single = f.where("rule_id = 'BEHAVIOR.DOWNLOAD_EXECUTE'").select(
        short_id("path-v1", _node("fingerprint")).alias("path_id"), F.lit("DOWNLOAD_EXECUTE").alias("title"), F.array(_node("fingerprint")).alias("members"), "severity", F.lit("MEDIUM").alias("confidence"))
    place = F.struct("line", "fingerprint", rank(F.col("severity"), SEVERITIES).alias("sev"))
    out = single
    for title, rules, rule_id in (("PERSISTENCE", PERSISTENCE, "CORRELATION.BEHAVIOR.PERSISTENCE_CLUSTER"), ("CREDENTIAL", ["BEHAVIOR.CREDENTIAL_ACCESS"], "CORRELATION.BEHAVIOR.CREDENTIAL_CLUSTER")):
        firsts = f.where("function_id IS NOT NULL").groupBy("path", "function_id").agg(
            F.min(F.when(F.col("rule_id") == NETWORK, place)).alias("n"), F.min(F.when(F.col("rule_id").isin(*rules), place)).alias("c"), F.min(F.when(F.col("rule_id") == PROCESS, place)).alias("e"))
        lines = [F.col(f"{x}.line") for x in "nce"]
        near = firsts.where("n IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL").where(F.greatest(*lines) - F.least(*lines) <= proximity)
        nodes = [F.concat(F.lit("f:"), F.col(f"{x}.fingerprint")) for x in "nce"]
        out = out.unionAll(near.select(short_id("path-v1", rule_id, *nodes).alias("path_id"), F.lit(title).alias("title"), F.array(*nodes).alias("members"), unrank(F.greatest(*(F.col(f"{x}.sev") for x in "nce")), SEVERITIES).alias("severity"), F.lit("LOW").alias("confidence")))
    return out


def groups(findings: DataFrame, support: DataFrame) -> DataFrame:
    """group_id, primary, supporters: findings that support another are members of its group and have none of their own."""
    pairs = support.select(F.substring("src", 3, 64).alias("supporter"), F.substring("dst", 3, 64).alias("fingerprint")).distinct()
    members = pairs.groupBy("fingerprint").agg(F.array_sort(F.collect_set("supporter")).alias("supporters"))
    primary = findings.select("fingerprint").join(pairs.select(F.col("supporter").alias("fingerprint")).distinct(), "fingerprint", "left_anti")
    return primary.join(members, "fingerprint", "left").select(short_id("group-v1", F.col("fingerprint")).alias("group_id"), F.col("fingerprint").alias("primary"), F.coalesce("supporters", F.array().cast("array<string>")).alias("supporters"))


def assessments(findings: DataFrame, support: DataFrame, related: DataFrame, incomplete: bool = False) -> DataFrame:
    """One row per primary finding: evidence, confidence, exposure and priority, each explained by its columns."""
    f = complete(findings)
    pairs = support.select(F.substring("src", 3, 64).alias("supporter"), F.substring("dst", 3, 64).alias("fingerprint")).distinct()
    ranked = f.select(F.col("fingerprint").alias("supporter"), rank(F.col("confidence"), CONFIDENCES).alias("r"))
    weakest = pairs.join(ranked, "supporter").groupBy("fingerprint").agg(F.min("r").alias("weakest"), F.count("*").alias("n_supporters"))
    touched = related.select(F.explode(F.array("src", "dst")).alias("node")).select(F.substring("node", 3, 64).alias("fingerprint")).distinct().withColumn("near_network", F.lit(True))
    primary = f.join(pairs.select(F.col("supporter").alias("fingerprint")).distinct(), "fingerprint", "left_anti")
    rows = primary.join(weakest, "fingerprint", "left").join(touched, "fingerprint", "left")
    sast, supported = F.col("scanner_id").isin("sast", "sast.python"), F.col("n_supporters").isNotNull()
    number = F.least(rank(F.col("confidence"), CONFIDENCES), F.coalesce("weakest", F.lit(9)))
    number = F.least(number, F.lit(1)) if incomplete else number
    external = F.coalesce(F.col("source_category") == "HTTP_INPUT", F.lit(False))  # what the priority needs: a gate spares the join of ``related``
    exposure = F.when(external, "EXTERNAL_INPUT").when(F.col("near_network"), "NETWORK_CONTEXT").otherwise("UNKNOWN")
    bonus = F.when(supported & (number == 2) & external & F.col("severity").isin("LOW", "MEDIUM"), 1).otherwise(0)
    priority = F.lower(unrank(F.least(rank(F.col("severity"), SEVERITIES) + bonus, F.lit(4)), SEVERITIES))
    return rows.select(
        short_id("assessment-v1", short_id("group-v1", F.col("fingerprint"))).alias("assessment_id"), "fingerprint", "scanner_id", "rule_id", "path", "line", "severity", unrank(number, CONFIDENCES).alias("confidence"),
        F.when(supported & sast, "STRONG").when(sast | (F.col("scanner_id") == "dependencies"), "MODERATE").otherwise("WEAK").alias("evidence"),
        F.when(supported, "STRONG").otherwise("WEAK").alias("correlation"), exposure.alias("exposure"), priority.alias("priority"), F.coalesce("n_supporters", F.lit(0)).cast("long").alias("n_supporters"),
    )


def oversized(findings: DataFrame, most: int = 32) -> DataFrame:
    """Lines with more findings than a local bucket may hold: they abort correlation, and are told rather than dropped."""
    return findings.groupBy("path", "line").agg(F.count("*").alias("n")).where(F.col("n") > most)


def within_buckets(findings: DataFrame, most: int = 32) -> DataFrame:
    """The findings outside oversized lines: what pair joins work on, so that no line makes more than its square of the
    bucket's size. Those left out are told by ``budget_state``."""
    return findings.join(oversized(findings, most).select("path", "line"), ["path", "line"], "left_anti")


def budget_state(findings: DataFrame, nodes: DataFrame, edges: DataFrame, paths: DataFrame, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """code, n, allowed, over: each budget with what the scan needs; any that is over makes the correlation ABORTED."""
    b = BUDGETS | budgets
    per_line = findings.groupBy("path", "line").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    parts = [("CORRELATION_FINDING_LIMIT", findings.agg(F.count("*").alias("n")), b["max_findings"]), ("CORRELATION_NODE_LIMIT", nodes.agg(F.count("*").alias("n")), b["max_nodes"]), ("CORRELATION_EDGE_LIMIT", edges.agg(F.count("*").alias("n")), b["max_edges"]), ("CORRELATION_PATH_LIMIT", paths.agg(F.count("*").alias("n")), b["max_paths"]), ("CORRELATION_BUCKET_LIMIT", per_line, b["bucket"])]
    return reduce(DataFrame.unionAll, [df.select(F.lit(code).alias("code"), "n", F.lit(most).cast("long").alias("allowed"), (F.col("n") > most).alias("over")) for code, df, most in parts])


def completeness(budgets: DataFrame, components: DataFrame, n_invalid: Column, n_collisions: Column) -> DataFrame:
    """One row, state: ABORTED over a budget, FAILED if a scanner failed, PARTIAL if one is incomplete or inputs were bad.

    components: component, state. The two numbers are literals or columns of a one-row table.
    """
    over = budgets.agg(F.coalesce(F.bool_or("over"), F.lit(False)).alias("over"))
    seen = components.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("state") == "FAILED"), F.lit(False)).alias("failed"), F.coalesce(F.bool_or(~F.col("state").isin("COMPLETE", "DISABLED")), F.lit(False)).alias("unfinished"))
    both = over.join(F.broadcast(seen))  # one row each
    state = F.when(F.col("over"), "ABORTED").when(F.col("failed"), "FAILED").when((F.col("n") == 0) | F.col("unfinished") | (n_invalid > 0) | (n_collisions > 0), "PARTIAL").otherwise("COMPLETE")
    return both.select(state.alias("state"))


def dependency_relevance(findings: DataFrame, uses: DataFrame) -> DataFrame:
    """fingerprint, relevance of findings with a package: REFERENCED if an import names it, else PRESENT."""
    used = uses.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select(F.substring("node", 3, 64).alias("fingerprint"), F.lit(True).alias("used"))
    f = complete(findings).where("package IS NOT NULL").select("fingerprint")
    return f.join(used, "fingerprint", "left").select("fingerprint", F.when(F.col("used"), "REFERENCED").otherwise("PRESENT").alias("relevance"))
