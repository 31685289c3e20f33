"""Patches and reviews: which files a patch may touch, what it changes, whether that is safe, and what a reviewer is told.

Nothing is written and no model is called: patches are pairs of texts, answers are JSON texts in rows. Differences are made
by one Python helper for each pair (difflib has no expression); all else is column expressions.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.functions.exprs import CONFIDENCES, redact_text
from harborscan.operators.discovery import name_of, unsafe_component

# What an added line must not bring in, the shape of answers, and the budgets.
SUPPRESSION = r"(?i)(#\s*(?:nosec|noqa|type:\s*ignore)|harborscan.{0,30}(?:ignore|exclude)|disable.{0,20}rule)"
DANGEROUS = r"(?i)\b(?:eval|exec|os\.system)\s*\(|shell\s*=\s*True\b|verify\s*=\s*False\b|\bsubprocess\b|(?:pip|npm|uv)\s+install\b"
ADDRESS = r"(?i)\b(?:https?|ftp)://"
DESTRUCTIVE = r"(?m)^\s*(?:pass|return\s+None|raise\s+NotImplementedError)\b"
FORBIDDEN_NAMES = [".env", "agents.md", "project_status.md", "handoff.md", "harborscan.toml"]
PATCH = {"changed_lines": 50, "hunks": 5, "diff_bytes": 32768}
REVIEW = {"reviews": 20, "requests": 22, "context_chars": 4000, "total_chars": 40_000, "output_tokens": 2048, "total_output_tokens": 20_000}
REVIEW_LISTS = ["rationale", "supporting_evidence", "contradictory_evidence", "missing_context", "remediation", "limitations"]
PATCH_LISTS = ["assumptions", "rationale", "limitations"]


def may_patch(path: Column, kind: Column, content_kind: Column, encoding: Column) -> Column:
    """Whether a patch may touch a file: UTF-8 source, no repository, workflow, key or instruction file, no unsafe name."""
    parts = F.split(path, "/")
    folded, name = F.transform(parts, F.lower), name_of(path)
    safe = ~F.exists(parts, lambda p: unsafe_component(p)) & (content_kind == "TEXT") & encoding.isin("utf-8", "utf-8-sig") & kind.isin("SOURCE_CODE", "SCRIPT")
    workflow = F.array_contains(folded, ".github") & F.coalesce(F.get(folded, F.lit(1)) == "workflows", F.lit(False))
    forbidden = F.array_contains(folded, ".git") | workflow | name.isin(*FORBIDDEN_NAMES) | name.startswith(".env.") | name.rlike(r"\.(pem|key|p12|pfx)$")
    return F.coalesce(safe & ~forbidden, F.lit(False))


CHANGES = "struct<diff:string,removed:string,added:string,changed:int,hunks:int>"


def _changes(path: str, before: str, after: str) -> tuple:
    old, new = before.splitlines(), after.splitlines()
    ops = [o for o in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if o[0] != "equal"]
    removed, added = [x for _, i, j, _, _ in ops for x in old[i:j]], [x for _, _, _, i, j in ops for x in new[i:j]]
    diff = "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}", n=0))
    return diff, "\n".join(removed), "\n".join(added), len(removed) + len(added), len(ops)


def changes(path: str, before: str, after: str) -> Column:
    """The unified difference of two text columns without context, its removed and added lines, and their numbers."""

    @F.pandas_udf(CHANGES)
    def compared(paths: pd.Series, olds: pd.Series, news: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_changes(p or "", o or "", n or "") for p, o, n in zip(paths, olds, news, strict=True)], columns=["diff", "removed", "added", "changed", "hunks"])

    return compared(path, before, after)


def rejection(c: Column) -> Column:
    """Why a change is not proposed, by the first test that fails; null if none does."""
    removed, added = c["removed"], c["added"]
    fresh = lambda p: added.rlike(p) & ~removed.rlike(p)
    comment = lambda t: t.rlike(r"(?m)^\s*#")
    lines = F.size(F.split(removed, "\n"))
    return (
        F.when((c["hunks"] == 0) | (c["hunks"] > PATCH["hunks"]) | (c["changed"] > PATCH["changed_lines"]), "PATCH_TOO_LARGE")
        .when((F.trim(removed) != "") & (F.trim(added) == ""), "PATCH_DESTRUCTIVE_CHANGE").when(fresh(SUPPRESSION), "PATCH_SECURITY_SUPPRESSION_DETECTED").when(fresh(DANGEROUS) | fresh(ADDRESS), "PATCH_NEW_HIGH_FINDING")
        .when(fresh(DESTRUCTIVE) | ((lines > 11) & (F.length(added) < F.floor(F.length(removed) / 2))) | (comment(added) & ~comment(removed)), "PATCH_DESTRUCTIVE_CHANGE")
        .when((redact_text(removed) != removed) | (redact_text(added) != added), "PATCH_SECRET_EXPOSURE").when(F.octet_length(c["diff"]) > PATCH["diff_bytes"], "PATCH_TOO_LARGE")
    )


def applied(source: Column, edits: Column) -> Column:
    """What line edits (array of start_line, end_line, replacement) make of a source, as text and fault: edits that overlap
    or leave the source are not made. A replacement stands for whole lines, ends included."""
    lines = F.split(source, "\n")
    n = F.size(lines) - F.when(source.endswith("\n"), 1).otherwise(0)
    ordered = F.array_sort(edits)
    bad = F.exists(ordered, lambda e: e["start_line"].isNull() | e["end_line"].isNull() | (e["start_line"] < 1) | (e["start_line"] > e["end_line"]) | (e["end_line"] > n) | F.contains(e["replacement"], F.lit("\r")))
    pairs = F.transform(ordered, lambda e, i: (i > 0) & (e["start_line"] <= F.get(ordered, i - 1)["end_line"]))
    fault = F.when((F.size(edits) < 1) | (F.size(edits) > PATCH["hunks"]), "PATCH_TOO_LARGE").when(F.coalesce(bad, F.lit(True)) | F.exists(pairs, lambda p: p), "PATCH_OVERLAPPING_EDITS")

    def one(acc, e):
        given = F.split(F.regexp_replace(e["replacement"], "\n$", ""), "\n")
        return F.concat(F.slice(acc, F.lit(1), e["start_line"].cast("int") - 1), given, F.slice(acc, e["end_line"].cast("int") + 1, F.size(acc)))

    text = F.array_join(F.aggregate(F.reverse(ordered), lines, one), "\n")
    return F.struct(F.when(fault.isNull(), text).alias("text"), fault.alias("fault"))


def hit_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, rule_id, line, col, change: hits that a patch removed and hits that it brought, as bags."""
    keys = ["path", "rule_id", "line", "col"]
    b, a = before.select(*keys), after.select(*keys)
    return b.exceptAll(a).withColumn("change", F.lit("REMOVED")).unionAll(a.exceptAll(b).withColumn("change", F.lit("NEW")))


def token_estimates(context: Column, max_output: int = REVIEW["output_tokens"]) -> tuple[Column, Column]:
    """(tokens that a patch request is reckoned to take, tokens of a review request)."""
    return F.floor(F.length(context) / 4) + max_output, F.length(context).cast("long")


def _typed(path: str, kind: str) -> Column:
    v = F.try_variant_get("j", path, "variant")
    return F.when(F.schema_of_variant(v) == {"string": "STRING", "boolean": "BOOLEAN", "bigint": "BIGINT"}[kind], F.try_variant_get("j", path, kind))


def _shape(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("j", path, "variant")), F.lit("MISSING"))


def _strings(path: str, most: int = 8, length: int = 500) -> Column:
    """Whether a value is a list of so many short strings at most."""
    values = F.try_variant_get("j", path, "array<string>")
    return _shape(path).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce((F.size(values) <= most) & F.forall(values, lambda x: F.length(x) <= length), F.lit(False))


def _keys() -> Column:
    return F.array_sort(F.json_object_keys("response"))


def _with_json(answers: DataFrame) -> DataFrame:
    return answers.withColumn("j", F.when(F.length("response") <= 32768, F.try_parse_json("response")))


def patch_answers(answers: DataFrame) -> DataFrame:
    """answers (response, allowed_file) with fault (a fixed code or null) and edits (array of start_line, end_line, replacement)."""
    a = _with_json(answers)
    edits = F.from_json(F.to_json(F.try_variant_get("j", "$.replacements", "variant")), "array<struct<start_line:bigint,end_line:bigint,replacement:string>>")
    can = _typed("$.can_propose_patch", "boolean")
    yes = lambda c: F.coalesce(c, F.lit(False))
    shape = yes(_keys() == F.array(*map(F.lit, sorted(["can_propose_patch", "target_file", "replacements", *PATCH_LISTS])))) & can.isNotNull()
    items = yes((F.size(edits) <= 5) & F.forall(edits, lambda e: e["start_line"].isNotNull() & e["end_line"].isNotNull() & e["replacement"].isNotNull() & (F.length(e["replacement"]) <= 10_000)))
    lists = yes(_strings("$.assumptions") & _strings("$.rationale") & _strings("$.limitations"))
    fault = F.when(F.col("j").isNull() | ~shape, "PATCH_AI_RESPONSE_INVALID").when(~yes(_typed("$.target_file", "string") == F.col("allowed_file")), "PATCH_SCOPE_VIOLATION").when(~lists | ~items | (can != (F.size(edits) > 0)), "PATCH_AI_RESPONSE_INVALID")
    return a.withColumns({"fault": fault, "edits": F.when(fault.isNull(), edits)}).drop("j")


def review_answers(answers: DataFrame, verdicts: list[str]) -> DataFrame:
    """answers (response, context_status) with valid, verdict and confidence; a stale context is never highly certain."""
    a = _with_json(answers)
    yes = lambda c: F.coalesce(c, F.lit(False))
    keys = yes(_keys() == F.array(*map(F.lit, sorted(["verdict", "confidence", "summary", *REVIEW_LISTS]))))
    verdict, confidence, summary = (_typed(f"$.{k}", "string") for k in ("verdict", "confidence", "summary"))
    lists = F.lit(True)
    for name in REVIEW_LISTS:
        lists = lists & _strings(f"$.{name}")
    valid = keys & yes(verdict.isin(*verdicts)) & yes(confidence.isin(*CONFIDENCES)) & yes(F.length(summary).between(1, 500)) & yes(lists)
    sure = F.when((F.col("context_status") == "STALE") & (confidence == "HIGH"), "MEDIUM").otherwise(confidence)
    return a.withColumns({"valid": valid, "verdict": F.when(valid, verdict), "confidence": F.when(valid, sure)}).drop("j")


def contexts(findings: DataFrame, lines: DataFrame, most_chars: int = REVIEW["context_chars"], around: int = 5) -> DataFrame:
    """fingerprint, context, context_status, mark: what a reviewer of each finding is told, as JSON with redacted lines
    around it. Secrets and findings without lines have no source; a context over the limit loses its source, and one that
    is still too long is null.

    The lines around come from a join on file and line number: each finding asks for its few lines.
    """
    asked = findings.where("scanner_id <> 'secrets' AND line IS NOT NULL").select("fingerprint", "path", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line"))
    entry = F.struct("line", F.substring(redact_text(F.col("text")), 1, 200).alias("text"))
    source = asked.join(lines.select("path", "line", "text"), ["path", "line"]).groupBy("fingerprint").agg(F.sort_array(F.collect_list(entry)).alias("source"))
    f = findings.join(source, "fingerprint", "left")
    base = [
        F.lit("finding").alias("subject_type"), F.col("fingerprint").alias("subject_id"), F.lit("UNTRUSTED_DATA_ONLY").alias("source_trust"), "rule_id", "severity", "confidence", F.struct("path", F.col("line").alias("line")).alias("location"),
    ]
    status = F.when(F.col("source").isNotNull(), "CURRENT").otherwise("UNAVAILABLE")
    full = F.to_json(F.struct(*base, status.alias("context_status"), F.col("source").alias("untrusted_source_context")))
    short = F.to_json(F.struct(*base, F.lit("UNAVAILABLE").alias("context_status"), F.lit("[CONTEXT TRUNCATED]").alias("truncation")))
    fits = F.length(full) <= most_chars
    context = F.when(fits, full).when(F.length(short) <= most_chars, short)
    told = f.select("fingerprint", context.alias("context"), F.when(context.isNull(), "LIMIT").when(fits, status).otherwise("UNAVAILABLE").alias("context_status"))
    return told.withColumn("mark", F.sha2("context", 256))


def review_budget(subjects: DataFrame, most: dict[str, int] = REVIEW) -> DataFrame:
    """subjects (rank, kind, subject, context) of a bounded list, with state: SELECTED while requests, characters and reserved
    output last, then ABORTED. Subjects without a context are FAILED and take nothing."""
    limits = REVIEW | most
    bounded = subjects.orderBy("rank", "kind", "subject").limit(limits["reviews"])
    order = Window.orderBy("rank", "kind", "subject").rowsBetween(Window.unboundedPreceding, 0)  # a list of at most ``reviews`` rows
    usable = F.col("context").isNotNull()
    n, chars = F.sum(usable.cast("long")).over(order), F.sum(F.coalesce(F.length("context"), F.lit(0)).cast("long")).over(order)
    over = (n > limits["requests"]) | (chars > limits["total_chars"]) | (n * limits["output_tokens"] > limits["total_output_tokens"])
    told = bounded.withColumns({"requests": n, "chars": chars, "__over": over})
    stopped = F.max(F.col("__over").cast("int")).over(order) == 1
    return told.withColumn("state", F.when(stopped, "ABORTED").when(usable, "SELECTED").otherwise("FAILED")).drop("__over")
