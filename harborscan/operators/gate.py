"""The gate over finished reports: each report is one JSON text in one row, checked and judged inside the row.

A report is untrusted: what is missing, of another type, too long or at odds with itself makes it invalid, with the
names of all tests that fail. Numbers, strings and booleans are told apart by the JSON's own types. No row meets another,
so any number of reports is judged in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from harborscan.functions.exprs import CONFIDENCES, SEVERITIES, rank

# Limits, vocabularies and the default policy of report version 1.1.
MAX_BYTES, MAX_FINDINGS, MAX_GROUPS, MAX_DIAGNOSTICS, MAX_COUNT = 16 << 20, 1000, 1000, 300, 1_000_000_000
SCHEMA_VERSION, TOOL = "1.1", "harborscan"
REQUIRED = ["schema_version", "tool", "scan", "coverage", "summary", "diagnostics", "findings", "finding_groups", "risk_assessments", "ai_reviews", "remediation_proposals", "report_truncated"]
CATEGORY = {"secrets": "secret", "sast.python": "vulnerability", "behavior.static": "behavior", "dependencies": "dependency"}
ROLES = ["primary", "supporting", "contextual", "duplicate"]
STATES = ["COMPLETE", "PARTIAL", "ABORTED", "FAILED"]
REQUESTS = ["batch_requests_used", "batch_requests_limit", "detail_requests_used", "detail_requests_limit", "total_requests_used", "total_requests_limit", "deduplicated_advisories"]
ADVISORIES = ["advisories_seen", "advisories_accepted", "advisories_truncated", "advisory_limit"]
EXIT = {"PASS": 0, "WARN": 10, "BLOCK": 20}

_FINDINGS = (
    "array<struct<id:string,fingerprint:string,rule_id:string,scanner_id:string,category:string,title:string,description:string,severity:string,confidence:string,role:string,risk_priority:string,"
    "location:struct<path:string,start_line:bigint>>>"
)
_GROUPS = "array<struct<id:string,primary:string,members:array<struct<fingerprint:string,role:string>>>>"
_DIAGNOSTICS = "array<struct<code:string,source:string,message:string,path:string>>"


@dataclass(frozen=True)
class Policy:
    """What blocks. Reviews by a model never do."""

    block_severity: str = "HIGH"
    tool: str = TOOL
    block_priority: str = "high"
    partial_blocks: bool = True
    no_data_blocks: bool = False
    behavior_warns: bool = True

    def __post_init__(self):
        if self.block_severity not in SEVERITIES or self.block_priority.upper() not in SEVERITIES:
            raise ValueError("invalid gate policy")


def _value(path: str, kind: str, of: str = "j") -> Column:
    """A value of one JSON type; null for others."""
    names = {"bigint": "BIGINT", "string": "STRING", "boolean": "BOOLEAN"}
    v = F.try_variant_get(of, path, "variant")
    return F.when(F.schema_of_variant(v) == names[kind], F.try_variant_get(of, path, kind))


def _there(path: str, of: str = "j") -> Column:
    """Whether a key is there, be its value null or of any size."""
    return F.try_variant_get(of, path, "variant").isNotNull()


def _list(path: str, schema: str) -> Column:
    text = F.to_json(F.try_variant_get("j", path, "variant"))
    return F.from_json(text, schema)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _all(array: Column, test) -> Column:
    return _true(F.forall(array, lambda x: _true(test(x))))


def _count(value: Column) -> Column:
    return _true(value.between(0, MAX_COUNT))


def _relative(path: Column) -> Column:
    return path.isNull() | (~path.rlike(r"^/|^[A-Za-z]:|(^|/)(\.\.?)?(/|$)|\\") & (F.length(path) <= 500))


def parsed(reports: DataFrame) -> DataFrame:
    """report_id, json and the typed parts of each report; nothing is dropped. Doubled keys make a text unreadable.

    Every value that tests compare is taken out once: of the dependencies as d_<name>, with has_<name>, whether it is there.
    """
    j = reports.select("report_id", "json", F.when(F.octet_length("json") <= MAX_BYTES, F.try_parse_json("json")).alias("j"))
    j = j.withColumn("d", F.try_variant_get("j", "$.summary.dependency", "variant"))
    return j.select(
        "*", *(_value(f"$.{n}", "bigint", "d").alias(f"d_{n}") for n in [*REQUESTS, *ADVISORIES, "no_data", "matches", "exact_versions"]), *(_there(f"$.{n}", "d").alias(f"has_{n}") for n in [*REQUESTS, *ADVISORIES, "provider_budget_reached", "advisory_limit_reached"]),
        *(_value(f"$.summary.counts.{n}_findings", "bigint").alias(n) for n in ("total", "rendered")), _value("$.schema_version", "string").alias("version"), _list("$.findings", _FINDINGS).alias("findings"), _list("$.finding_groups", _GROUPS).alias("groups"), _list("$.diagnostics", _DIAGNOSTICS).alias("diagnostics"),
        _list("$.coverage.components", "array<struct<component:string,status:string>>").alias("components"), _value("$.coverage.overall", "string").alias("overall"),
        _value("$.report_truncated", "boolean").alias("truncated"), _value("$.no_data", "bigint", "d").alias("no_data"),
        _value("$.provider_budget_reached", "boolean", "d").alias("budget_reached"), _value("$.advisory_limit_reached", "boolean", "d").alias("advisory_limit_reached"),
    )


def _together(names: list[str], flag: str, value: str) -> tuple[Column, Column]:
    """(none of the keys is there, all are there as counts with a boolean flag, whose value is the column ``value``)."""
    none = ~reduce(lambda a, b: a | b, [_true(F.col(f"has_{n}")) for n in [*names, flag]])
    whole = reduce(lambda a, b: a & b, [_count(F.col(f"d_{n}")) for n in names], F.col(value).isNotNull())
    return none, whole


def violations(r: DataFrame, tool: str = TOOL) -> Column:
    """The names of all tests that a parsed report fails, in a fixed order."""
    dep = lambda n: F.col(f"d_{n}")
    f, g = F.col("findings"), F.col("groups")
    marks = F.transform(f, lambda x: x["fingerprint"])
    total, rendered = F.col("total"), F.col("rendered")
    incomplete = F.exists("components", lambda c: (c["component"] != "ai") & ~c["status"].isin("COMPLETE", "DISABLED"))
    no_requests, all_requests = _together(REQUESTS, "provider_budget_reached", "budget_reached")
    no_advisories, all_advisories = _together(ADVISORIES, "advisory_limit_reached", "advisory_limit_reached")
    requests = all_requests & _true(
        (dep("total_requests_used") == dep("batch_requests_used") + dep("detail_requests_used")) & (dep("batch_requests_used") <= dep("batch_requests_limit"))
        & (dep("detail_requests_used") <= dep("detail_requests_limit")) & (dep("total_requests_used") <= dep("total_requests_limit"))
    )
    cut = F.col("advisory_limit_reached")
    advisories = all_advisories & _true((dep("advisories_seen") == dep("advisories_accepted") + dep("advisories_truncated")) & (cut == (dep("advisories_truncated") > 0)) & ~(cut & (F.col("overall") == "COMPLETE")))
    supporting = F.transform(F.filter(F.flatten(F.transform(g, lambda x: x["members"])), lambda m: m["role"] != "primary"), lambda m: m["fingerprint"])
    category = F.create_map(*(F.lit(x) for pair in CATEGORY.items() for x in pair))
    tests = [
        ("KEYS", reduce(lambda a, b: a & b, [_there(f"$.{k}") for k in REQUIRED])),
        ("TOOL", _value("$.tool.name", "string") == tool),
        ("SCAN", _value("$.scan.profile", "string").isin("quick", "standard", "deep") & _value("$.scan.offline", "boolean").isNotNull()),
        ("COVERAGE", F.col("overall").isin(*STATES) & F.size("components").between(1, 32) & _all(F.col("components"), lambda c: c["status"].isin(*STATES, "DISABLED"))),
        ("COVERAGE_CONTRADICTION", ~((F.col("overall") == "COMPLETE") & incomplete)),
        ("TRUNCATED", F.col("truncated").isNotNull()),
        ("COUNTS", _count(total) & _count(rendered) & (rendered == F.size(f)) & (total >= rendered) & ~((total > rendered) & ~F.col("truncated"))),
        ("DEPENDENCY", _count(dep("no_data")) & _count(dep("matches")) & _count(dep("exact_versions"))),
        ("REQUESTS", no_requests | requests),
        ("ADVISORIES", no_advisories | advisories),
        ("FINDINGS", (F.size(f) <= MAX_FINDINGS) & _all(f, lambda x: x["fingerprint"].rlike("^[0-9a-f]{64}$") & x["id"].rlike("^[A-Za-z0-9_.:-]{1,128}$") & (F.length("json") > 0)
            & x["severity"].isin(*SEVERITIES) & x["confidence"].isin(*CONFIDENCES) & x["role"].isin(*ROLES) & (x["risk_priority"].isNull() | F.upper(x["risk_priority"]).isin(*SEVERITIES)) & (F.length(x["title"]) <= 500))),
        ("IDENTITY", (F.size(F.array_distinct(marks)) == F.size(f)) & (F.size(F.array_distinct(F.transform(f, lambda x: x["id"]))) == F.size(f))),
        ("CATEGORY", _all(f, lambda x: F.try_element_at(category, x["scanner_id"]) == x["category"])),
        ("PATHS", _all(f, lambda x: _relative(x["location"]["path"])) & _all(F.col("diagnostics"), lambda d: _relative(d["path"]))),
        ("GROUPS", (F.size(g) <= MAX_GROUPS) & _all(g, lambda x: F.array_contains(marks, x["primary"]) & _all(x["members"], lambda m: F.array_contains(marks, m["fingerprint"]) & m["role"].isin(*ROLES)))),
        ("ROLES", ~F.exists(f, lambda x: (x["role"] == "primary") & _true(F.array_contains(supporting, x["fingerprint"])))),
        ("DIAGNOSTICS", (F.size("diagnostics") <= MAX_DIAGNOSTICS) & _all(F.col("diagnostics"), lambda d: d["code"].rlike("^[A-Z][A-Z0-9_]{0,99}$"))),
    ]
    failed = F.array_compact(F.array(*(F.when(~_true(ok), name) for name, ok in tests)))
    return F.when(F.octet_length("json") > MAX_BYTES, F.array(F.lit("SIZE"))).when(F.col("j").isNull(), F.array(F.lit("JSON"))).otherwise(failed)


def validated(reports: DataFrame, tool: str = TOOL) -> DataFrame:
    """The parsed reports with violations (array) and error (a fixed code, null where valid)."""
    r = parsed(reports)
    r = r.withColumn("violations", violations(r, tool))
    code = F.when(F.array_contains("violations", "SIZE"), "GATE_REPORT_TOO_LARGE").when(F.col("j").isNotNull() & _true(F.col("version") != SCHEMA_VERSION), "GATE_UNSUPPORTED_SCHEMA").when(F.size("violations") > 0, "GATE_INVALID_REPORT")
    return r.withColumn("error", code)


def decided(reports: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per report: status, n_blockers, n_warnings, reasons, diagnostics, exit_code. An invalid report has an error,
    no status, and exit code 2."""
    r = validated(reports, policy.tool)
    primary = F.filter("findings", lambda x: x["role"] == "primary")

    def behaviour(x):
        return x["scanner_id"].startswith("behavior")

    def blocks(x):
        severe = (rank(x["severity"], SEVERITIES) >= SEVERITIES.index(policy.block_severity)) & ~(x["scanner_id"].startswith("sast") & x["severity"].isin("HIGH", "CRITICAL") & (x["confidence"] != "HIGH"))
        urgent = _true(rank(F.upper(x["risk_priority"]), SEVERITIES) >= SEVERITIES.index(policy.block_priority.upper()))
        return ~behaviour(x) & (severe | urgent)

    blockers = F.size(F.filter(primary, blocks)).cast("long")
    warnings = F.size(F.filter(primary, lambda x: ~blocks(x) & (~behaviour(x) | policy.behavior_warns))).cast("long")
    r = r.withColumns({"n_blockers": blockers, "n_warnings": warnings})
    budget, cut = (_true(F.col(c)) for c in ("budget_reached", "advisory_limit_reached"))
    partial, stopped, none, noted = F.col("overall") == "PARTIAL", F.col("overall").isin("ABORTED", "FAILED"), F.col("no_data") > 0, F.size("diagnostics") > 0
    reasons = [
        ("BLOCKING_PRIMARY_FINDINGS", F.col("n_blockers") > 0), ("COVERAGE_PARTIAL", partial), ("DEPENDENCY_ADVISORY_LIMIT_REACHED", cut), ("DEPENDENCY_NO_DATA", none),
        ("DEPENDENCY_PROVIDER_BUDGET_REACHED", budget), ("NON_BLOCKING_PRIMARY_FINDINGS", F.col("n_warnings") > 0), ("REPORT_TRUNCATED", F.col("truncated")),
        ("SCAN_ABORTED", F.col("overall") == "ABORTED"), ("SCAN_DIAGNOSTICS", noted), ("SCAN_FAILED", F.col("overall") == "FAILED"),
    ]
    blocked = (F.col("n_blockers") > 0) | budget | cut | stopped | F.col("truncated") | (partial & policy.partial_blocks) | (none & policy.no_data_blocks)
    warned = (F.col("n_warnings") > 0) | noted | partial | none
    valid = F.col("error").isNull()
    status = F.when(valid, F.when(blocked, "BLOCK").when(warned, "WARN").otherwise("PASS"))
    codes = F.create_map(*(F.lit(x) for pair in EXIT.items() for x in pair))
    said = F.array_join(F.array_compact(F.array(*(F.when(_true(c), n) for n, c in reasons))), ",")
    return r.select(
        "report_id", "error", status.alias("status"), F.when(valid, F.col("n_blockers")).alias("n_blockers"), F.when(valid, F.col("n_warnings")).alias("n_warnings"), F.when(valid, said).alias("reasons"),
        F.when(valid, F.array_join(F.array_sort(F.array_distinct(F.transform("diagnostics", lambda d: d["code"]))), ",")).alias("diagnostics"), F.coalesce(F.try_element_at(codes, status), F.lit(2)).cast("long").alias("exit_code"),
    )


def over_threshold(reports: DataFrame, fail_on: str) -> DataFrame:
    """report_id, n_over, exit_code: whether primary findings reach a severity (10), none does (0), or no report is there (3)."""
    r = validated(reports)
    over = F.size(F.filter("findings", lambda x: (x["role"] == "primary") & (rank(x["severity"], SEVERITIES) >= SEVERITIES.index(fail_on.upper())))).cast("long")
    return r.select("report_id", F.when(F.col("error").isNull(), over).alias("n_over"), F.when(F.col("error").isNotNull(), 3).when(over > 0, 10).otherwise(0).cast("long").alias("exit_code"))
