"""One scan from files to a decision: scope, admission, detectors, suppression, caps with states, masks, counters, gate.

The files are read once. That pass writes the lines that may hold a candidate or show a behaviour (a small part of all lines)
and one row for each file, and its counters are observed while it writes; all later steps read what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from harborscan.functions.exprs import redact_path, running
from harborscan.functions.scratch import stored
from harborscan.operators import behavior_rules, correlation, discovery, report, secret_context, secret_rules
from harborscan.operators.secret_rules import CANDIDATE

CAPS = {"per_rule": 100, "per_file": 100, "total": 1000, "max_line_bytes": 16384, "large_file": 1 << 20, "behavior_per_file": 100, "behavior_line_bytes": 8192}
_PLAIN = [secret_rules.private_key_candidates, secret_rules.provider_candidates, secret_rules.connection_candidates, secret_rules.jwt_candidates]


@dataclass(frozen=True)
class Scan:
    """findings: up to the total; notes: component, code, path (what makes a component partial); traversal and secrets: one
    row of counters each; states: component, state."""

    findings: DataFrame
    notes: DataFrame
    traversal: DataFrame
    secrets: DataFrame
    states: DataFrame


def _decoded(content: Column, encoding: Column) -> Column:
    """Texts of contents in other encodings; null where one does not hold."""

    @F.pandas_udf("string")
    def texts(contents: pd.Series, encodings: pd.Series) -> pd.Series:
        def one(c, e):
            try:
                return None if c is None else bytes(c).decode(e)
            except UnicodeError:
                return None

        if contents.isna().all():
            return pd.Series([None] * len(contents), dtype=object)
        return pd.Series([one(c, e) for c, e in zip(contents, encodings)], dtype=object)

    return texts(content, encoding)


def _told(content: Column) -> Column:
    """content_kind and encoding, as ``discovery.sniff`` tells them. Valid UTF-8 without control characters and without magic
    bytes or a mark of its encoding is plain text by expressions; only the heads of other contents are decoded by Python."""
    known = "struct<content_kind:string,encoding:string>"
    head, raw = F.substring(content, 1, 8192), content.cast("string")
    plain = content.isNull() | (F.is_valid_utf8(raw) & ~raw.startswith("\ufeff") & ~head.cast("string").rlike(r"[\x00-\x08\x0b\x0e-\x1f]") & discovery.magic_of(head).isNull())
    odd = discovery.sniff(F.when(~plain, content))
    return F.when(plain, F.struct(F.lit("TEXT"), F.lit("utf-8")).cast(known)).otherwise(F.struct(odd["content_kind"], odd["encoding"]).cast(known))


def read(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """files (path, content) with what discovery tells of them and, where a scanner takes them, their text.

    Contents out of scope are not looked at. UTF-8 is checked and read without Python; other encodings by a decoder.
    """
    path = F.col("path")
    known = files.select("path", F.octet_length("content").cast("long").alias("size_bytes"), discovery.scope_of(path, include, exclude).alias("reason"), "content")
    known = known.withColumn("content", F.when(F.col("reason").isNull(), F.col("content"))).withColumns({"s": _told(F.col("content")), "language": discovery.language_of(path), "magic": discovery.magic_of(F.col("content")), "name": discovery.name_of(path), "suffix": discovery.suffix_of(path)})
    kind = discovery.kind_of(path, F.coalesce("language", F.lit("")), F.col("magic"), F.col("name"), F.col("suffix"))
    rows = known.select("path", "size_bytes", "reason", "content", "s.content_kind", F.lower("s.encoding").alias("encoding"), "language", kind.alias("kind"))
    takes = {c: discovery.admission_of(c) & F.col("reason").isNull() for c in ("secrets", "behavior")}
    rows = rows.withColumns(takes | {"in_tests": discovery.in_tests(path)})
    utf8, raw = F.col("encoding").isin("utf-8", "utf-8-sig", "ascii"), F.col("content").cast("string")
    plain = F.when(F.is_valid_utf8(raw), raw)
    odd = F.col("secrets") & ~utf8
    other = _decoded(F.when(odd, F.col("content")), F.when(odd, F.col("encoding")))
    return rows.withColumn("text", F.when(F.col("secrets"), F.regexp_replace(F.when(utf8, plain).otherwise(other), "^\ufeff", ""))).drop("content")


def _js() -> Column:
    return F.coalesce(F.col("language").isin(*secret_context.JS_LANGUAGES), F.lit(False))


def _first_pass(files: DataFrame, most: dict[str, int]) -> tuple[DataFrame, dict]:
    """Rows of files (line 0) and of lines worth a look, with the behaviours they show, written once, and the counters
    observed meanwhile."""
    fitting = lambda x: (F.octet_length(x) <= most["max_line_bytes"]) | (F.col("size_bytes") > most["large_file"])
    parts = F.when(F.col("text").isNotNull(), F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    proven = F.when(_js(), secret_context.environment_parameters(F.col("text")))
    names = lambda test: lambda x: x.contains("secrets") & fitting(x) & test(x)
    python = (F.col("language") == "python") & F.col("text").contains("secrets")
    cut = files.select("path", "size_bytes", "reason", "language", "content_kind", "secrets", "behavior", "in_tests", F.col("text").isNull().alias("unread"), proven.alias("proven"), python.alias("python"), parts.alias("p"))
    # The line that imports the generator at the top of a file that binds its name in no other way.
    since = F.when(F.col("python") & ~F.exists("p", names(secret_context.binds_generator)), F.nullif(F.array_position(F.transform("p", names(secret_context.imports_generator)), F.lit(True)), F.lit(0)))
    cut = cut.withColumn("since", since).drop("python")
    rows = cut.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "p")).alias("line", "text")).withColumn("before", F.when(F.col("line") > 1, F.get("p", F.col("line") - 2))).drop("p")
    text, is_file = F.col("text"), F.col("line") == 0
    fits, lent = fitting(text), _js() & F.coalesce(F.col("before").rlike(secret_context.PENDING), F.lit(False))
    wide = F.col("behavior") & (F.octet_length("text") > most["behavior_line_bytes"])
    acts = F.col("behavior") & behavior_rules.is_live(text, most["behavior_line_bytes"]) & behavior_rules.matches(text, F.col("language"))
    worth = text.rlike(secret_rules.LIKELY) | text.contains("-----") | lent
    kept = rows.where(is_file | ~fits | worth | wide | acts).withColumn("fits", F.coalesce(fits, F.lit(True)))
    trusted = F.coalesce((F.col("line") > F.col("since")) & secret_context.uses_generator(text), F.lit(False))
    shown = F.when(F.col("fits"), text)
    # A file's own row has no text of another; lines carry what the detectors need.
    kept = kept.select(
        "path", F.col("line").cast("long").alias("line"), "size_bytes", "reason", "language", "content_kind", "secrets", "in_tests", "unread", "proven", shown.alias("text"), "fits", F.when(lent, F.col("before")).alias("before"), trusted.alias("trusted"),
        secret_rules.key_mark(shown).alias("mark"), F.coalesce(wide, F.lit(False)).alias("wide"), F.when(acts, behavior_rules.found_in(text, F.col("language"))).alias("acts"), F.when(acts, behavior_rules.confidence_of(text)).alias("confidence"))
    seen = Observation()
    one = lambda c: F.count_if(is_file & c)
    sums = {
        "entries_seen": one(F.lit(True)), "files_excluded": one(F.col("reason").isNotNull()), "default_exclusions": one(F.col("reason").startswith("EXCLUDED_DEFAULT")), "user_exclusions": one(F.col("reason") == "EXCLUDED_USER_POLICY"),
        "files_discovered": one(F.col("reason").isNull()), "files_inspected": one(F.col("content_kind").isNotNull() & F.col("reason").isNull()), "bytes_inspected": F.coalesce(F.sum(F.when(is_file & F.col("reason").isNull(), F.col("size_bytes"))), F.lit(0)),
        "considered": one(F.col("reason").isNull()), "applicable": one(F.col("secrets")), "scanned": one(F.col("secrets") & ~F.col("unread")), "bytes": F.coalesce(F.sum(F.when(is_file & F.col("secrets") & ~F.col("unread"), F.col("size_bytes"))), F.lit(0)), "long_lines": F.count_if(~F.col("fits")),
        "last_line": F.coalesce(F.max("line"), F.lit(0)),
    }
    written = stored(kept.observe(seen, *(c.cast("long").alias(n) for n, c in sums.items())), "scan")
    return written, seen.get


def _value(c: Column) -> Column:
    return F.substring(F.col("text"), c["start"] + 1, c["value_length"])


def _candidates(lines: DataFrame, whole: bool) -> tuple[DataFrame, Observation]:
    """path, line and the candidates of each line outside key blocks, still with overlaps; and how many the context took away."""
    text, none = F.col("text"), F.array().cast(CANDIDATE)
    plain = F.concat(*(d(text) for d in _PLAIN))
    show = lambda c: secret_context.made_up(_value(c), F.col("in_tests"))
    assigned, entropic = secret_rules.assignment_candidates(text), secret_rules.entropy_candidates(text)
    rows = lines.where(~_js()).select("path", "line", "mark", plain.alias("plain"), assigned.alias("a"), entropic.alias("e"), "trusted", "in_tests", "text")
    rows = rows.withColumns({"a2": F.filter("a", lambda c: ~F.col("trusted") & ~show(c)), "e2": F.filter("e", lambda c: ~show(c))})
    seen = Observation()
    gone = F.coalesce(F.sum(F.size("a") - F.size("a2") + F.size("e") - F.size("e2")), F.lit(0)).cast("long")
    first = rows.select("path", "line", "mark", "a", "e", "a2", "e2", F.concat("plain", "a2", "e2").alias("c")).observe(seen, gone.alias("suppressed")).select("path", "line", "mark", "c")
    js = lines.where(_js())
    literal = js.where(text.rlike(secret_rules.CONTEXT)).withColumn("l", secret_context.literals_of("text")).withColumn("e", entropic)
    inside = F.filter("e", lambda c: F.exists("l", lambda s: (s["start"] <= c["start"]) & (c["end"] <= s["end"])) & ~secret_context.made_up(_value(c), F.col("in_tests"), True))
    unmarked = F.lit(None).cast("string").alias("mark")
    more = secret_context.js_found(js.select("path", "line", "text", "proven", "before")).select("path", "line", unmarked, "c")
    more = js.select("path", "line", "mark", plain.alias("c")).unionByName(more).unionByName(literal.select("path", "line", unmarked, inside.alias("c")))
    of_js = more.groupBy("path", "line").agg(F.max("mark").alias("mark"), F.flatten(F.collect_list("c")).alias("c"))  # of one line
    both = first.unionByName(of_js).where((F.size("c") > 0) | F.col("mark").isNotNull())
    swept = secret_rules.swept(both.repartition("path") if whole else stored(both, "candidates"), whole)
    return swept.select("path", "line", F.when(F.col("inside_key"), none).otherwise(F.col("c")).alias("c")), seen


def limited(hits: DataFrame, per_rule: int, per_file: int, whole: bool = False) -> DataFrame:
    """hits with ``over``: beyond the first of a rule or of all in a file. Places are running sums over parts of a file, so
    that a file of any number of hits is many tasks' work; ``whole``: no file has more lines than a part."""
    parted = hits.withColumn("__part", F.floor(F.col("line") / secret_rules.PART_LINES))
    ruled = running(parted if whole else stored(parted, "hits"), ["path", "rule_id"], "__part", ["line", "start"], whole, __r=("sum", F.lit(1)))
    ruled = ruled.withColumn("over_rule", F.coalesce("__r", F.lit(0)) >= per_rule).drop("__r")
    placed = running(ruled if whole else stored(ruled, "ruled"), ["path"], "__part", ["line", "start", "rule_id"], whole, __f=("sum", (~F.col("over_rule")).cast("int")))
    return placed.withColumn("over", F.col("over_rule") | (F.coalesce("__f", F.lit(0)) >= per_file)).drop("__part", "__f", "over_rule")


def _secrets(lines: DataFrame, most: dict[str, int], whole: bool) -> tuple[DataFrame, DataFrame, dict]:
    """Findings with masked paths, one mark each and their state; notes (code, path); and counters. ``whole``: no file has more
    lines than a part, so that all steps within a file share one exchange of its few candidates."""
    looked = lines.where("line > 0 AND fits AND secrets").drop("fits")
    found, context = _candidates(looked, whole)
    seen, told = Observation(), Observation()
    chosen = secret_rules.without_overlaps(F.col("c"))
    n, m = F.coalesce(F.sum(F.size("c")), F.lit(0)), F.coalesce(F.sum(F.size("k")), F.lit(0))
    kept = found.withColumn("k", chosen).observe(seen, n.cast("long").alias("candidates"), (n - m).cast("long").alias("duplicates"))
    hits = limited(kept.select("path", "line", F.inline("k")), most["per_rule"], most["per_file"], whole)
    hits = secret_rules.near_pairs(hits if whole else stored(hits, "ruled"), counts=~F.col("over"))
    hits = stored(hits.withColumn("shown", redact_path(F.col("path"))).observe(told, F.count_if(~F.col("over")).cast("long").alias("within")), "limited")
    within = hits.where("NOT over").drop("over")
    if told.get["within"] <= most["total"]:  # no order of all hits where none is beyond the total
        placed = within.withColumn("state", F.lit("EMITTED"))
    else:
        placed = stored(secret_context.global_cap(within, most["total"]).drop("place"), "placed")
    raw = F.col("path")
    masked = placed.where("state = 'EMITTED'").withColumns({"file": raw, "ordinal": F.col("start"), "by": F.substring(F.sha2(raw, 256), 1, 16)}).withColumn("path", F.col("shown")).drop("shown")
    # Marks tell paths apart, so that only findings of masked paths can share one: no path as it is equals a masked one unless it has the mask's word.
    shared = F.coalesce(F.col("path").contains("[REDACTED]"), F.lit(True))
    marked = stored(secret_context.distinct_marks(stored(masked.where(shared), "masked"), F.col("by"), F.substring("by", 1, 2)), "marked")
    found = marked.unionByName(secret_context.own_marks(masked.where(~shared)))
    marks = looked.where("mark IS NOT NULL").groupBy("path").agg(F.max_by("mark", "line").alias("last")).where("last = 'B'")
    note = lambda df, code: df.select(F.lit(code).alias("code"), "path").distinct()
    notes = [
        note(hits.where("over"), "SECRET_MATCH_LIMIT_REACHED"), note(placed.where("state = 'ABORTED'"), "SECRET_TOTAL_LIMIT_REACHED"), note(marks, "SECRET_PRIVATE_KEY_UNTERMINATED"),
        note(marked.where("collided").select(F.col("file").alias("path")), "SECRET_FINGERPRINT_COLLISION"), note(lines.where("NOT fits"), "SECRET_LINE_TOO_LONG"), note(lines.where("line = 0 AND secrets AND unread"), "SECRET_DECODE_FAILED"),
    ]
    return found.drop("file", "ordinal", "by"), reduce(DataFrame.unionByName, notes), lambda: context.get | seen.get


def scan(files: DataFrame, include: list[str] = (), exclude: list[str] = (), **caps: int) -> Scan:
    """The scan of files (path, content: binary). Null contents count as unread; equal paths are not expected."""
    spark, most = files.sparkSession, CAPS | caps
    known = read(files, include, exclude)
    lines, counted = _first_pass(known, most)
    whole = counted["last_line"] < secret_rules.PART_LINES
    found, notes, told = _secrets(lines, most, whole)
    columns = ["fingerprint", "scanner_id", "category", "rule_id", "path", "line", "col", "severity", "confidence", "value_length", "collided"]
    secret = found.withColumns({"scanner_id": F.lit("secrets"), "category": F.lit("secret"), "col": (F.col("start") + 1).cast("long"), "value_length": F.col("value_length").cast("long")}).select(*columns)
    hits = lines.where("size(acts) > 0").select("path", "line", "confidence", F.inline("acts")).withColumn("col", F.col("col").cast("long"))
    parted = hits.withColumn("__part", F.floor(F.col("line") / secret_rules.PART_LINES))
    placed = running(parted.repartition("path") if whole else parted, ["path"], "__part", ["line", "rule_order", "col"], whole, __n=("sum", F.lit(1))).withColumn("over", F.coalesce("__n", F.lit(0)) >= most["behavior_per_file"])
    placed = stored(placed.drop("__n", "__part"), "behavior")
    behaviour = behavior_rules.findings(behavior_rules.deduplicated(placed.where("NOT over"))).withColumn("collided", F.lit(False)).select(*columns)
    over = placed.where("over").select(F.lit("behavior").alias("component"), F.lit("BEHAVIOR_MATCH_LIMIT_REACHED").alias("code"), "path").distinct()
    skipped = lines.where("wide").select(F.lit("behavior"), F.lit("BEHAVIOR_LINE_TOO_LONG"), "path").distinct()
    notes = stored(notes.select(F.lit("secrets").alias("component"), "code", "path").unionAll(over).unionAll(skipped), "notes")
    state = notes.groupBy("component").agg(F.when(F.bool_or(F.col("code") == "SECRET_TOTAL_LIMIT_REACHED"), "ABORTED").otherwise("PARTIAL").alias("state"))
    states = report.coverage(spark, [("discovery", "COMPLETE"), ("secrets", "COMPLETE"), ("sast", "DISABLED"), ("behavior", "COMPLETE"), ("dependencies", "DISABLED"), ("correlation", "COMPLETE")])
    states = states.withColumnRenamed("state", "__all").join(F.broadcast(state), "component", "left").select("component", F.coalesce("state", "__all").alias("state"))  # at most a row a component
    return Scan(stored(secret.unionByName(behaviour), "findings"), notes, _traversal(spark, lines, counted), _summary(spark, counted, told(), found, notes), states)


def _row(spark: SparkSession, counters: dict[str, int]) -> DataFrame:
    return spark.range(1).select(*(F.lit(v or 0).cast("long").alias(k) for k, v in counters.items()))


def _traversal(spark: SparkSession, lines: DataFrame, seen: dict[str, int]) -> DataFrame:
    """Counters of the first pass, and of folders, from the names that it wrote: a folder is excluded if its files are."""
    parts = F.split("path", "/")
    folders = lines.where("line = 0 AND instr(path, '/') > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"), F.col("reason").isNotNull().alias("out"))
    per = folders.groupBy("folder").agg(F.bool_and("out").alias("out")).agg(F.count_if(~F.col("out")).alias("directories_visited"), F.count_if("out").alias("directories_excluded"))
    names = ["entries_seen", "files_discovered", "files_inspected", "bytes_inspected", "files_excluded", "default_exclusions", "user_exclusions"]
    return _row(spark, {n: seen[n] for n in names}).join(F.broadcast(per))  # one row each


def _summary(spark: SparkSession, seen: dict[str, int], told: dict[str, int], found: DataFrame, notes: DataFrame) -> DataFrame:
    names = ["considered", "applicable", "scanned", "bytes", "long_lines"]
    counters = {n: seen[n] for n in names} | {n: told[n] for n in ("candidates", "suppressed", "duplicates")}
    emitted = found.agg(F.count("*").alias("emitted"))
    limits = notes.where("component = 'secrets'").agg(F.count_if(F.col("code").endswith("LIMIT_REACHED")).alias("limits_hit"), F.when(F.count_if(F.col("code") == "SECRET_TOTAL_LIMIT_REACHED") > 0, "ABORTED").when(F.count("*") > 0, "PARTIAL").otherwise("COMPLETE").alias("state"))
    return _row(spark, counters).join(F.broadcast(emitted)).join(F.broadcast(limits))  # one row each


def decision(done: Scan, **policy) -> DataFrame:
    """The gate's row for a scan: its findings, assessed, and its states."""
    found = done.findings.drop("collided", "value_length").withColumns({"function_id": F.lit(None).cast("string"), "source_category": F.lit(None).cast("string")})
    assessed = correlation.assessments(found, correlation.supports(found), correlation.secret_network(found))
    return report.gate(assessed, report.overall(done.states), **policy)
