"""Behaviour signals in script lines, by tables of expressions for each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.functions.exprs import fingerprint, match_spans, redact_path

# Fixed values: (rule, expression) for each language, and the rules' severities.
RULES = {
    "powershell": [
        ("NETWORK_REQUEST", r"\b(?:Invoke-WebRequest|Invoke-RestMethod|DownloadString)\b"), ("PROCESS_EXEC", r"\bStart-Process\b"),
        ("DYNAMIC_CODE", r"\b(?:Invoke-Expression|iex)\b"), ("SHELL_EXEC", r"\b(?:Invoke-Expression|iex)\b"), ("FILE_DELETE", r"\bRemove-Item\b"),
        ("REGISTRY_WRITE", r"\b(?:Set-ItemProperty|New-ItemProperty)\b.*\b(?:HKLM|HKCU|Registry:)"),
        ("SCHEDULED_TASK", r"\b(?:Register-ScheduledTask|New-ScheduledTask|schtasks)\b"), ("SERVICE_MODIFICATION", r"\b(?:New-Service|Set-Service)\b"),
        ("SECURITY_CONTROL", r"\b(?:Set-MpPreference|Add-MpPreference)\b"), ("ENVIRONMENT_READ", r"\$env:[A-Za-z_][A-Za-z0-9_]*"), ("ENCODED_COMMAND", r"(?<!\w)-(?:EncodedCommand|enc)\b"),
    ],
    "batch": [
        ("POWERSHELL_EXEC", r"\b(?:powershell|pwsh)(?:\.exe)?\b"), ("PROCESS_EXEC", r"\b(?:powershell|pwsh|cmd|certutil|bitsadmin|mshta|rundll32|regsvr32|wmic)(?:\.exe)?\b"),
        ("SHELL_EXEC", r"\bcmd(?:\.exe)?\s+/c\b"), ("CMD_EXEC", r"\bcmd(?:\.exe)?\s+/c\b"), ("WINDOWS_TOOL", r"\b(?:certutil|bitsadmin|mshta|rundll32|regsvr32|wmic)(?:\.exe)?\b"),
        ("NETWORK_REQUEST", r"\b(?:certutil\s+-urlcache|bitsadmin\s+/transfer)\b"), ("REGISTRY_WRITE", r"\breg(?:\.exe)?\s+add\b"),
        ("SCHEDULED_TASK", r"\bschtasks(?:\.exe)?\s+/(?:create|change|delete)\b"), ("SERVICE_MODIFICATION", r"\bsc(?:\.exe)?\s+(?:create|config|delete|start|stop)\b"),
        ("FILE_DELETE", r"\b(?:del|erase|rmdir|rd)\b"), ("RECURSIVE_DELETE", r"\b(?:del|rmdir|rd)\s+/(?:s|q)\b"), ("PROCESS_TERMINATION", r"\btaskkill(?:\.exe)?\b"),
        ("SECURITY_CONTROL", r"\bnetsh(?:\.exe)?\s+(?:advfirewall|firewall)\b"), ("ENCODED_COMMAND", r"(?<!\w)-(?:EncodedCommand|enc)\b"),
    ],
    "shell": [
        ("NETWORK_REQUEST", r"\b(?:curl|wget)\b"), ("PROCESS_EXEC", r"\b(?:sh|bash)\s+-c\b"), ("SHELL_EXEC", r"\b(?:sh|bash)\s+-c\b"),
        ("RECURSIVE_DELETE", r"\brm\s+-[A-Za-z]*r[A-Za-z]*f\b|\brm\s+-[A-Za-z]*f[A-Za-z]*r\b"), ("DYNAMIC_CODE", r"\beval\s+"),
    ],
    "javascript": [
        ("PROCESS_EXEC", r"\bchild_process\.(?:exec|spawn|execSync|spawnSync)\s*\("), ("SHELL_EXEC", r"\bchild_process\.(?:exec|execSync)\s*\("),
        ("DYNAMIC_CODE", r"\b(?:eval|Function)\s*\("), ("NETWORK_REQUEST", r"\b(?:fetch|axios\.(?:get|post|request))\s*\("),
        ("FILE_DELETE", r"\bfs\.(?:rm|rmdir|unlink)(?:Sync)?\s*\("), ("ENVIRONMENT_READ", r"\bprocess\.env\.[A-Za-z_][A-Za-z0-9_]*"),
    ],
}
SEVERITY = {
    "PROCESS_EXEC": "INFO", "SHELL_EXEC": "MEDIUM", "POWERSHELL_EXEC": "MEDIUM", "CMD_EXEC": "MEDIUM", "ENCODED_COMMAND": "MEDIUM", "DYNAMIC_CODE": "MEDIUM", "NETWORK_REQUEST": "INFO",
    "FILE_DELETE": "LOW", "RECURSIVE_DELETE": "MEDIUM", "REGISTRY_WRITE": "MEDIUM", "STARTUP_PERSISTENCE": "MEDIUM", "SCHEDULED_TASK": "MEDIUM", "SERVICE_MODIFICATION": "MEDIUM",
    "CREDENTIAL_ACCESS": "LOW", "ENVIRONMENT_READ": "INFO", "DLL_LOAD": "LOW", "PROCESS_TERMINATION": "LOW", "SECURITY_CONTROL": "MEDIUM", "HIDDEN_PROCESS": "LOW",
    "DOWNLOAD_EXECUTE": "MEDIUM", "WINDOWS_TOOL": "LOW",
}
OUT_FILE, START_FILE = r"(?iU)(?<!\w)-OutFile\s+[\"']?([A-Za-z0-9._/-]{1,128})", r"(?iU)\bStart-Process\s+[\"']?([A-Za-z0-9._/-]{1,128})"
SCRIPT_GROUPS = ["javascript", "typescript", "jsx", "tsx"]


def is_live(text: Column, max_bytes: int = 8192) -> Column:
    start = F.regexp_replace(text, r"^\s+", "")
    comment = start.startswith("#") | start.startswith("//") | start.startswith("REM ") | start.startswith("rem ") | start.startswith("::")
    return (F.octet_length(text) <= max_bytes) & (start != "") & ~comment


def live(lines: DataFrame, max_bytes: int = 8192) -> DataFrame:
    """Lines up to the limit that are neither blank nor comments."""
    return lines.where(is_live(F.col("text"), max_bytes))


def _group(language: Column) -> Column:
    return F.when(language.isin(*SCRIPT_GROUPS), "javascript").otherwise(language)


def matches(text: Column, language: Column) -> Column:
    """Whether any rule of its language matches a line."""
    out = F.lit(False)
    for name, rules in RULES.items():
        out = F.when(_group(language) == name, text.rlike("(?iU)" + "|".join(f"(?:{pattern})" for _, pattern in rules))).otherwise(out)
    return out


def confidence_of(text: Column) -> Column:
    return F.when(text.rlike("[\"']"), "LOW").otherwise("MEDIUM")


def found_in(text: Column, language: Column) -> Column:
    """array<struct<rule_id,rule_order,col>> of a line's matches."""
    none = F.array().cast("array<struct<rule_id:string,rule_order:int,col:int>>")

    def one(order: int, rule: str, pattern: str):
        spans = match_spans(text, "(?iU)" + pattern)
        return F.coalesce(F.transform(spans, lambda s: F.struct(F.lit(f"BEHAVIOR.{rule}").alias("rule_id"), F.lit(order).alias("rule_order"), (s["start"] + 1).alias("col"))), none)

    def of(name: str):
        return F.concat(*(one(order, *x) for order, x in enumerate(RULES[name])))

    found = none
    for name in RULES:
        found = F.when(_group(language) == name, of(name)).otherwise(found)
    return found


def hits(lines: DataFrame, max_bytes: int = 8192) -> DataFrame:
    """path, line, col, rule_id, confidence, for lines (path, language, line, text): one row per match."""
    rows = live(lines, max_bytes).select("path", "line", confidence_of(F.col("text")).alias("confidence"), F.inline(found_in(F.col("text"), F.col("language"))))
    return rows.select("path", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "rule_id", "confidence", "rule_order")


def deduplicated(found: DataFrame) -> DataFrame:
    """One hit for each path, rule, line and column."""
    return found.groupBy("path", "rule_id", "line", "col").agg(F.max_by("confidence", "rule_order").alias("confidence"))


def capped(found: DataFrame, per_file: int = 100) -> DataFrame:
    """The first hits of each file in the order of lines, rules and columns."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("line", "rule_order", "col"))
    return found.withColumn("__n", place).where(F.col("__n") <= per_file).drop("__n")


def download_execute(lines: DataFrame) -> DataFrame:
    """PowerShell launches of a file that the same script downloaded on the same or an earlier line: path, line, target."""
    ps = live(lines.where("language = 'powershell'"))
    got = ps.where(F.col("text").contains("Invoke-WebRequest")).select("path", "line", F.regexp_extract("text", OUT_FILE, 1).alias("target")).where("target <> ''")
    run = ps.select("path", "line", F.regexp_extract("text", START_FILE, 1).alias("target")).where("target <> ''")
    first = got.groupBy("path", "target").agg(F.min("line").alias("since"))
    return run.join(first, ["path", "target"]).where("since <= line").select("path", F.col("line").cast("long").alias("line"), "target")


def download_hits(lines: DataFrame) -> DataFrame:
    """Hits of downloads that are launched, in the form of all other hits: one for each launch."""
    return download_execute(lines).select("path", "line", F.lit(1).cast("long").alias("col"), F.lit("BEHAVIOR.DOWNLOAD_EXECUTE").alias("rule_id"), F.lit("MEDIUM").alias("confidence")).distinct()


def findings(found: DataFrame) -> DataFrame:
    """Findings of hits: path (redacted), line, column, rule, rating and fingerprint."""
    severity = F.create_map(*(F.lit(x) for r, s in SEVERITY.items() for x in (f"BEHAVIOR.{r}", s)))
    path = redact_path(F.col("path"))
    mark = fingerprint("static-finding-v1", F.col("rule_id"), path, F.col("line"), F.col("col"), F.lit("text"))
    return found.select(
        mark.alias("fingerprint"), F.lit("behavior.static").alias("scanner_id"), F.lit("behavior").alias("category"), "rule_id", path.alias("path"), "line", "col",
        F.try_element_at(severity, F.col("rule_id")).alias("severity"), "confidence", F.lit("behavior").alias("label"), F.lit(0).cast("long").alias("value_length"),
    )
