"""Roll-ups of findings, coverage, rendered reports and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborscan.functions.exprs import CONFIDENCES, SEVERITIES, rank, redact_path
from harborscan.functions.scratch import stored
from harborscan.operators.discovery import tagged_as_test

STATES = ["DISABLED", "COMPLETE", "PARTIAL", "ABORTED", "FAILED"]
IDENTITY = ["fingerprint", "scanner_id", "category", "rule_id", "path", "line", "col", "severity", "confidence"]


def deduplicated(findings: DataFrame) -> DataFrame:
    """Findings of equal identity once; a fingerprint of several identities keeps all of them, marked as colliding."""
    from pyspark.sql import Window

    once = findings.dropDuplicates(IDENTITY)
    return once.withColumn("n_same_fingerprint", F.count("*").over(Window.partitionBy("fingerprint")).cast("long"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n for all five severities, zeros too."""
    spark = findings.sparkSession
    dense = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return dense.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def counts(findings: DataFrame) -> DataFrame:
    """severity, category, n by each and by all: one pass of grouping sets."""
    return findings.cube("severity", "category").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def coverage(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """component, state."""
    return spark.createDataFrame(rows, "component string, state string")


def overall(components: DataFrame) -> DataFrame:
    """The worst state of all components that are enabled and no review: overall, reasons."""
    worst = F.max(F.when((F.col("state") != "DISABLED") & (F.col("component") != "ai"), rank(F.col("state"), STATES)))
    reasons = F.array_sort(F.collect_set(F.when(F.col("state").isin("PARTIAL", "ABORTED", "FAILED"), F.concat_ws("_", "component", "state"))))
    names = F.array(*map(F.lit, STATES))
    return components.agg(worst.alias("w"), reasons.alias("reasons")).select(F.coalesce(F.get(names, F.col("w").cast("int")), F.lit("COMPLETE")).alias("overall"), F.array_join("reasons", ",").alias("reasons"))


def layers(components: DataFrame) -> DataFrame:
    """layer, state: worst state of each presentation layer; a missing component is disabled."""
    spark = components.sparkSession
    dims = spark.createDataFrame([("SOURCE", c) for c in ("discovery", "secrets", "sast", "behavior")] + [("DEPENDENCY", "dependencies"), ("CORRELATION", "correlation")], "layer string, component string")
    order = ["FAILED", "ABORTED", "PARTIAL", "DISABLED", "COMPLETE"]
    joined = dims.join(components, "component", "left").withColumn("r", rank(F.coalesce("state", F.lit("DISABLED")), order))
    return joined.groupBy("layer").agg(F.min("r").alias("r")).select("layer", F.get(F.array(*map(F.lit, order)), F.col("r").cast("int")).alias("state"))


# How many rows of each kind a report shows.
CAPS = {"findings": 1000, "diagnostics": 300, "attack_paths": 100, "ai_reviews": 100, "finding_groups": 1000, "risk_assessments": 1000}


def shown(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows by order, each with n_total and n_omitted: a bounded list that tells what it leaves out."""
    total = rows.agg(F.count("*").alias("n_total"))
    return rows.orderBy(*order).limit(most).join(F.broadcast(total)).withColumn("n_omitted", F.greatest(F.col("n_total") - most, F.lit(0)))  # one row


def truncation(tables: dict[str, DataFrame], caps: dict[str, int] = CAPS) -> DataFrame:
    """part, n_total, n_shown, truncated: for each part of the report."""
    one = lambda name, df: df.agg(F.count("*").alias("n_total")).select(F.lit(name).alias("part"), "n_total", F.least("n_total", F.lit(caps[name])).cast("long").alias("n_shown"), (F.col("n_total") > caps[name]).alias("truncated"))
    return reduce(DataFrame.unionAll, [one(n, df) for n, df in tables.items()])


def catalogue(findings: DataFrame) -> DataFrame:
    """rule_id, title, help_uri, conflict: each rule as the first finding (by fingerprint) describes it, and whether others differ."""
    rule = F.struct("title", "help_uri")
    rows = findings.groupBy("rule_id").agg(F.min_by(rule, "fingerprint").alias("r"), F.countDistinct(rule).alias("n"))
    return rows.select("rule_id", "r.title", "r.help_uri", (F.col("n") > 1).alias("conflict"))


def diagnostics(notes: DataFrame) -> DataFrame:
    """source, code, path, message, count: of each scanner once per code (secrets) or per code and path (others), with the
    first message, in report order."""
    place = F.when(F.col("source") != "secrets", F.col("path"))
    rows = notes.groupBy("source", "code", place.alias("place")).agg(F.min(F.struct("path", "message")).alias("m"), F.count("*").alias("count"))
    return rows.select("source", "code", "m.path", "m.message", "count").orderBy("source", "code", F.coalesce("path", F.lit("")), "message")


def scanner_summaries(files: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per scanner: considered, scanned, skipped, bytes, candidates, emitted, suppressed, duplicates, limits_hit, state.

    files: scanner_id, path, size_bytes, state (SCANNED, SKIPPED or LIMIT); hits: scanner_id, fate (EMITTED, SUPPRESSED, DUPLICATE or LIMIT).
    """
    f = files.groupBy("scanner_id").agg(F.count("*").alias("considered"), F.count_if(F.col("state") == "SCANNED").alias("scanned"), F.count_if(F.col("state") != "SCANNED").alias("skipped"), F.coalesce(F.sum(F.when(F.col("state") == "SCANNED", F.col("size_bytes"))), F.lit(0)).alias("bytes"), F.count_if(F.col("state") == "LIMIT").alias("file_limits"))
    fate = lambda x: F.count_if(F.col("fate") == x).alias(x.lower())
    h = hits.groupBy("scanner_id").agg(F.count("*").alias("candidates"), fate("EMITTED"), fate("SUPPRESSED"), fate("DUPLICATE"), fate("LIMIT"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    limits = F.col("file_limits") + zero("limit")
    return f.join(h, "scanner_id", "left").select(
        "scanner_id", "considered", "scanned", "skipped", "bytes", zero("candidates").alias("candidates"), zero("emitted").alias("emitted"), zero("suppressed").alias("suppressed"), zero("duplicate").alias("duplicates"), limits.alias("limits_hit"), F.when(limits > 0, "PARTIAL").otherwise("COMPLETE").alias("state"))


def safe_uri(uri: Column) -> Column:
    """An http(s) address with a host and without user, query or fragment, of at most 2,048 characters; null for others."""
    plain = uri.rlike(r"(?i)^https?://[^/?#@\s]+(/[^?#\s]*)?$") & (F.length(uri) <= 2048)
    return F.when(plain, redact_path(uri))


def safe_report_path(path: Column) -> Column:
    """A relative path without credential shapes; others are one fixed mark."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(path.isNotNull(), F.when(p.rlike(r"^/|^[A-Za-z]:|(^|/)(\.\.?)?(/|$)"), "[UNSAFE PATH]").otherwise(F.substring(redact_path(p), 1, 500)))


def url_shape(url: Column) -> Column:
    """A URL's scheme, whether it names a user, and its number of query fields; host and values are never kept."""
    u = F.substring(url, 1, 4096)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]{0,31})://[^/?#]+", 1))
    place, asked = F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    n = F.size(F.filter(F.split(asked, "&"), lambda x: x != ""))
    shape = F.concat(scheme, F.lit("://"), F.when(place.contains("@"), "[USER]:[REDACTED]@").otherwise(""), F.lit("[HOST]"), F.when(n > 0, F.concat(F.lit("?["), n.cast("string"), F.lit(" REDACTED QUERY FIELDS]"))).otherwise(""))
    return F.when((scheme == "") | (n > 32) | url.isNull(), "[REDACTED URL]").otherwise(shape)


def report_view(findings: DataFrame, members: DataFrame, priorities: DataFrame, reviews: DataFrame, proposals: DataFrame) -> DataFrame:
    """Findings as a reader sees them: role, priority, review and proposal joined by fingerprint; a supporting finding has
    its group's proposal; only safe texts.

    members: fingerprint, primary, role; priorities: fingerprint, priority; reviews: fingerprint, verdict; proposals: fingerprint, proposal_id.
    """
    role = members.groupBy("fingerprint").agg(F.max(F.struct("role", "primary")).alias("m"))
    rows = findings.join(role, "fingerprint", "left").join(priorities, "fingerprint", "left").join(reviews, "fingerprint", "left").withColumn("owner", F.coalesce("m.primary", "fingerprint"))
    rows = rows.join(proposals.withColumnRenamed("fingerprint", "owner"), "owner", "left")
    path = safe_report_path(F.col("path"))
    return rows.select(
        "fingerprint", "scanner_id", "rule_id", "severity", "confidence", F.coalesce("m.role", F.lit("primary")).alias("role"), "priority", "verdict", "proposal_id", path.alias("path"), "line",
        F.when(tagged_as_test(F.col("path")), "context:test_code").otherwise("").alias("tags"),
    )


def report_document(assessed: DataFrame, state: DataFrame, most: int = 1000) -> DataFrame:
    """The report as one JSON row: counts over all findings, the first ``most`` of them, coverage and truncation.

    The findings' assessments are stored once: four parts of the report read them."""
    columns = ["fingerprint", "rule_id", "path", "line", "severity", "confidence", "priority"]
    assessed = stored(assessed.select(*columns), "assessed")
    dense = severity_counts(assessed).agg(F.sort_array(F.collect_list(F.struct("severity", "n"))).alias("severity"))
    by_priority = assessed.groupBy("priority").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("priority", "n"))).alias("risk_priority"))
    view = F.struct(*columns)
    first = assessed.orderBy("fingerprint", "rule_id", "path").limit(most).agg(F.sort_array(F.collect_list(view)).alias("findings"))  # bounded by most
    total = assessed.agg(F.count("*").alias("n"))
    row = total.join(F.broadcast(dense)).join(F.broadcast(by_priority)).join(F.broadcast(first)).join(F.broadcast(state.select("overall")))  # one row each
    counts = F.struct("risk_priority", F.size("findings").alias("rendered_findings"), "severity", F.col("n").alias("total_findings"))
    body = F.struct(F.struct("overall").alias("coverage"), "findings", (F.col("n") > most).alias("report_truncated"), F.lit("1.1").alias("schema_version"), F.struct(counts.alias("counts")).alias("summary"))
    return row.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def matching(findings: DataFrame, text: str = "", over: tuple[str, ...] = ("rule_id", "path"), **allowed: list[str]) -> DataFrame:
    """The findings a viewer asks for: columns among the allowed values, and a text in any of some columns, case apart."""
    for column, values in allowed.items():
        findings = findings.where(F.col(column).isin(*values))
    return findings.where(F.contains(F.lower(F.concat_ws(" ", *over)), F.lit(text.lower()))) if text else findings


def top(assessed: DataFrame, k: int = 20) -> DataFrame:
    """The k findings to show first, by priority, severity, confidence and place: a top-k report that tells the total."""
    order = [F.desc(rank(F.upper("priority"), SEVERITIES)), F.desc(rank(F.col("severity"), SEVERITIES)), F.desc(rank(F.col("confidence"), CONFIDENCES)), "path", "line", "fingerprint"]
    return shown(assessed, order, k)


def report_json(assessed: DataFrame) -> DataFrame:
    """fingerprint, json: each finding as a canonical JSON object, its keys sorted; a sink writes them as lines."""
    keys = sorted(["fingerprint", "rule_id", "path", "line", "severity", "confidence", "priority", "evidence", "exposure"])
    return assessed.select("fingerprint", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("json"))


def sarif(assessed: DataFrame) -> DataFrame:
    """fingerprint, json: each finding as a SARIF 2.1.0 result."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    uri = F.regexp_replace(F.regexp_replace(F.url_encode("path"), "%2F", "/"), r"\+", "%20")
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(level.alias("level"), place.alias("locations"), F.struct(F.col("rule_id").alias("text")).alias("message"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), F.col("rule_id").alias("ruleId"))
    return assessed.select("fingerprint", F.to_json(result).alias("json"))


def gate(assessed: DataFrame, state: DataFrame, block_severity: str = "HIGH", partial_blocks: bool = True) -> DataFrame:
    """status, n_blockers, n_warnings, coverage, reasons: one row, from primary findings and the overall coverage.

    Behaviour alone only warns; a vulnerability blocks by severity if its confidence is high, by priority in any case.
    """
    least = SEVERITIES.index(block_severity)
    behaviour = F.col("scanner_id").startswith("behavior")
    severe = (rank(F.col("severity"), SEVERITIES) >= least) & ~(F.col("scanner_id").startswith("sast") & (F.col("confidence") != "HIGH"))
    blocks = ~behaviour & (severe | (rank(F.upper("priority"), SEVERITIES) >= least))
    sums = assessed.agg(F.count_if(blocks).alias("n_blockers"), F.count_if(~blocks).alias("n_warnings"))
    both = state.select("overall").join(F.broadcast(sums))  # one row each
    bad = F.col("overall").isin("ABORTED", "FAILED")
    partial = F.col("overall") == "PARTIAL"
    blocked = (F.col("n_blockers") > 0) | bad | (partial & partial_blocks)
    reasons = F.array_compact(F.array(F.when(F.col("n_blockers") > 0, "BLOCKING_PRIMARY_FINDINGS"), F.when(partial, "COVERAGE_PARTIAL"), F.when(F.col("n_warnings") > 0, "NON_BLOCKING_PRIMARY_FINDINGS"), F.when(bad, F.concat(F.lit("SCAN_"), "overall"))))
    status = F.when(blocked, "BLOCK").when((F.col("n_warnings") > 0) | partial, "WARN").otherwise("PASS")
    return both.select(status.alias("status"), "n_blockers", "n_warnings", F.col("overall").alias("coverage"), F.array_join(F.array_sort(reasons), ",").alias("reasons"))


def review_subjects(assessed: DataFrame, paths: DataFrame, groups: DataFrame, k: int = 20) -> DataFrame:
    """What a reviewer should see first, k of them, with the number of all: critical findings, high ones, attack paths and
    urgent assessments, then urgent groups of several findings."""
    urgent = assessed.where("priority IN ('critical', 'high')")
    two = F.lit(2).cast("long").alias("rank")
    severe = assessed.where("severity IN ('CRITICAL', 'HIGH')").select(F.when(F.col("severity") == "CRITICAL", 0).otherwise(1).cast("long").alias("rank"), F.lit("finding").alias("kind"), F.col("fingerprint").alias("subject"))
    chains = paths.select(two, F.lit("attack_path").alias("kind"), F.col("path_id").alias("subject"))
    rated = urgent.select(two, F.lit("risk_assessment").alias("kind"), F.col("assessment_id").alias("subject"))
    many = groups.where(F.size("supporters") > 0).join(urgent.select(F.col("fingerprint").alias("primary")), "primary", "left_semi").select(F.lit(3).cast("long").alias("rank"), F.lit("finding_group").alias("kind"), F.col("group_id").alias("subject"))
    return shown(severe.unionAll(chains).unionAll(rated).unionAll(many).distinct(), ["rank", "kind", "subject"], k).drop("n_omitted")


GUIDANCE = {"secrets": "Rotate the credential, remove it from the source and its history, and load it from a secret store.", "behavior.static": "Confirm that the operation is meant, and limit its inputs.", "sast.python": "Validate the input and use an interface that keeps data and code apart.", "dependencies": "Update to a fixed version."}


def remediation_plan(assessed: DataFrame, k: int = 50) -> DataFrame:
    """Proposals for the k most severe findings, and how many are left without: proposal_id, fingerprint, rule_id, guidance, n_omitted."""
    table = F.create_map(*(F.lit(x) for pair in GUIDANCE.items() for x in pair))
    order = [F.desc(rank(F.col("severity"), SEVERITIES)), "path", "line", "fingerprint"]
    proposal = F.substring(F.sha2(F.concat(F.lit("remediation-v1:"), "fingerprint"), 256), 1, 24)
    return shown(assessed, order, k).select(proposal.alias("proposal_id"), "fingerprint", "rule_id", F.try_element_at(table, F.col("scanner_id")).alias("guidance"), "n_omitted")
