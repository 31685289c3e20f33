"""Credential-like values in lines: detectors, overlaps, caps and findings. Values never leave; spans and lengths do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.functions.exprs import entropy, fingerprint, let, match_spans, redact_path, running
from harborscan.functions.scratch import stored

# The rules' expressions. (?U) makes \w and \b know all letters, as the rules mean them.
PROVIDERS = [
    ("SECRET.GITHUB.TOKEN", "github", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", "HIGH", "HIGH"),
    ("SECRET.AWS.ACCESS_KEY", "aws_access_key_id", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "LOW", "MEDIUM"),
    ("SECRET.STRIPE.SECRET_KEY", "stripe", r"\bsk_(?:live|test)_[A-Za-z0-9]{24,128}\b", "HIGH", "HIGH"),
    ("SECRET.SLACK.TOKEN", "slack", r"\bxox[baprs]-[A-Za-z0-9-]{20,128}\b", "HIGH", "HIGH"),
    ("SECRET.GITLAB.TOKEN", "gitlab", r"\bglpat-[A-Za-z0-9_-]{20,128}\b", "HIGH", "HIGH"),
]
#: What every provider's token begins with.
PROVIDER_MARK = r"gh[pousr]_|AKIA|ASIA|sk_|xox|glpat-"
CONNECTION = r"(?iU)\b(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]{1,128}:[^\s@/]{1,256}@"
ASSIGNMENT_KEY = "aws_secret_access_key|api[_-]?key|api[_-]?token|client[_-]?secret|access[_-]?token|auth[_-]?token|password|passwd|private[_-]?key|connection[_-]?string|secret|token"
ASSIGNMENT = rf"(?iU)(?<![\w-])({ASSIGNMENT_KEY})[\"']?\s*(?::|=)\s*(\"[^\"\r\n]{{0,256}}\"|'[^'\r\n]{{0,256}}'|[^\s,;#]{{0,256}})"
JWT = r"(?U)\b[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,1024}\.[A-Za-z0-9_-]{8,1024}\b"
ENTROPY_VALUE = r"(?U)(?<!\w)[A-Za-z0-9_-]{20,128}(?!\w)"
CONTEXT = r"(?iU)\b(?:api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|password|passwd|secret|token|bearer)\b"
HASH_CONTEXT = r"(?iU)\b(?:sha\d*|checksum|digest|integrity|commit|etag|hash)\b"
PEM_BEGIN, PEM_END = (rf"-----{x} (?:(?:RSA|EC|DSA|OPENSSH) )?PRIVATE KEY-----" for x in ("BEGIN", "END"))
PLACEHOLDER = (
    r"(?i)^(?:your(?:[_-](?:api[_-]?key|token|secret|password))?(?:[_-]here)?|change[_-]?me|replace[_-]?me|insert[_-]?(?:key|token|secret)[_-]?here|"
    r"(?:example|sample|dummy|fake|test|placeholder)(?:[_-](?:api[_-]?key|token|secret|password|only))?|not[_-]?a[_-]?real[_-]?(?:key|token|secret)|password|secret|token|abc123|"
    r"x{6,}|0{6,}|\*{4,}|<[^>]{1,64}>)$"
)
REFERENCE = r"(?i)^(?:\$\{?[A-Za-z_][A-Za-z0-9_]*\}?|%(?:[A-Za-z_][A-Za-z0-9_]*)%|(?:os\.(?:getenv|environ)|process\.env|import\.meta\.env|env\.)\b.*|(?:vault|aws-secretsmanager|secret)://[^\s]+)$"
UUID = r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[1-8][a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}$"

CANDIDATE = "array<struct<rule_id:string,label:string,start:int,end:int,severity:string,confidence:string,priority:int,value_length:int>>"


def is_placeholder(value: Column) -> Column:
    bare = F.regexp_replace(value, "^[\"'`\\s]+|[\"'`\\s]+$", "")
    return let(bare, lambda v: (v == "") | F.lower(v).isin("none", "null", "nil", "undefined", "false") | v.rlike(PLACEHOLDER) | v.rlike(REFERENCE))


def classes(value: Column) -> Column:
    return sum((value.rlike(p).cast("int") for p in (r"(?U)\p{Lower}", r"(?U)\p{Upper}", r"\p{Nd}", r"[_\-+/=]")), F.lit(0))


def as_candidate(rule, label, start, end, severity, confidence, priority) -> Column:
    return F.struct(rule.alias("rule_id"), label.alias("label"), start.alias("start"), end.alias("end"), severity.alias("severity"), confidence.alias("confidence"), F.lit(priority).alias("priority"), (end - start).alias("value_length"))


def _none() -> Column:
    return F.array().cast(CANDIDATE)


def _provider(text: Column, rule: str, label: str, pattern: str, severity: str, confidence: str) -> Column:
    spans = F.filter(F.coalesce(match_spans(text, "(?U)" + pattern), F.array().cast("array<struct<start:int,end:int,value:string>>")), lambda s: ~is_placeholder(s["value"]))
    return F.transform(spans, lambda s: as_candidate(F.lit(rule), F.lit(label), s["start"], s["end"], F.lit(severity), F.lit(confidence), 1))


def provider_candidates(text: Column) -> Column:
    return F.when(text.rlike(PROVIDER_MARK), F.concat(*(_provider(text, *p) for p in PROVIDERS)).cast(CANDIDATE)).when(text.isNotNull(), _none())


def private_key_candidates(text: Column) -> Column:
    at = F.length(F.get(F.split(text, PEM_BEGIN, 2), F.lit(0)))  # in code points, as all offsets
    length = F.length(F.regexp_substr(text, F.lit(PEM_BEGIN)))
    return F.when(text.rlike(PEM_BEGIN), F.array(as_candidate(F.lit("SECRET.PRIVATE_KEY.PEM"), F.lit("private_key"), at, (at + length).cast("int"), F.lit("HIGH"), F.lit("HIGH"), 0))).otherwise(_none()).cast(CANDIDATE)


def connection_candidates(text: Column) -> Column:
    """The password's span; the label is the scheme."""
    spans = F.coalesce(match_spans(text, CONNECTION), F.array().cast("array<struct<start:int,end:int,value:string>>"))
    password = lambda s: F.regexp_extract(s["value"], r"^[^:]+://[^\s:@/]+:(.*)@$", 1)
    kept = F.filter(spans, lambda s: ~is_placeholder(password(s)))
    return F.transform(kept, lambda s: as_candidate(F.lit("SECRET.CONNECTION_STRING"), F.lower(F.regexp_extract(s["value"], "^([^:]+):", 1)), s["end"] - 1 - F.length(password(s)), s["end"] - 1, F.lit("HIGH"), F.lit("HIGH"), 2)).cast(CANDIDATE)


def _json_object(segment: Column) -> Column:
    plain = F.translate(segment, "-_", "+/")
    padded = F.rpad(plain, (F.length(plain) + F.pmod(-F.length(plain), F.lit(4))).cast("int"), "=")
    text = F.try_to_binary(padded, F.lit("base64"))
    return F.coalesce((F.octet_length(text) <= 1024) & F.schema_of_variant(F.try_parse_json(F.decode(text, "utf-8"))).startswith("OBJECT"), F.lit(False))


def jwt_candidates(text: Column) -> Column:
    spans = F.coalesce(match_spans(text, JWT), F.array().cast("array<struct<start:int,end:int,value:string>>"))
    kept = F.filter(spans, lambda s: _json_object(F.substring_index(s["value"], ".", 1)) & _json_object(F.regexp_extract(s["value"], r"^[^.]*\.([^.]*)", 1)) & ~is_placeholder(s["value"]))
    return F.transform(kept, lambda s: as_candidate(F.lit("SECRET.JWT"), F.lit("jwt"), s["start"], s["end"], F.lit("MEDIUM"), F.lit("MEDIUM"), 3)).cast(CANDIDATE)


def assignment_part(s: Column) -> Column:
    """key, value, start and end of what the assignment's expression matched; a quote that is not closed is no value."""

    def part(raw: Column) -> Column:
        quoted = raw.rlike("^([\"']).*\\1$") & (F.length(raw) >= 2)
        opened = raw.rlike("^[\"']") & (F.length(raw) >= 2)
        key = F.regexp_replace(F.lower(F.regexp_extract(s["value"], rf"(?iU)^({ASSIGNMENT_KEY})", 1)), "-", "_")
        return F.struct(
            key.alias("key"), F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw).alias("value"),
            (s["end"] - F.length(raw) + opened.cast("int")).alias("start"), (s["end"] - opened.cast("int")).alias("end"),
        )

    return let(F.regexp_extract(s["value"], rf"(?iU)^(?:{ASSIGNMENT_KEY})[\"']?\s*(?::|=)\s*(.*)$", 1), part)


def looked_up_apart(parts: Column) -> Column:
    """The parts whose values are not looked up in the environment."""
    return F.filter(parts, lambda p: ~p["value"].rlike(r"^(?:os\.getenv\(|os\.environ\[|process\.env\.|env\.)"))


def assignment_candidates(text: Column) -> Column:
    """key = value: weak values survive for password-like keys only; example lines lower the confidence."""
    spans = F.coalesce(match_spans(text, ASSIGNMENT), F.array().cast("array<struct<start:int,end:int,value:string>>"))
    example = text.rlike(r"(?iU)\b(?:example|sample|placeholder|documentation)\b")
    return F.when(text.rlike(HASH_CONTEXT), _none()).otherwise(rated_assignments(looked_up_apart(F.transform(spans, assignment_part)), example)).cast(CANDIDATE)


def rated_assignments(parts: Column, example: Column) -> Column:
    """Candidates of array<struct<key,value,start,end>>: weak values survive for password-like keys only."""
    fits = F.filter(parts, lambda p: (F.length(p["value"]) >= 8) & (F.length(p["value"]) <= 256))
    sized = F.transform(fits, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"), p["start"].alias("start"), p["end"].alias("end"), classes(p["value"]).alias("n")))
    cut = F.filter(sized, lambda p: (p["n"] >= 2) & ~is_placeholder(p["value"]) & ~p["value"].rlike(UUID))
    rated = F.transform(cut, lambda p: F.struct(p["key"].alias("key"), p["start"].alias("start"), p["end"].alias("end"), ((F.length(p["value"]) >= 16) & (p["n"] >= 3) & (entropy(p["value"]) >= 3.2)).alias("strong")))
    kept = F.filter(rated, lambda p: p["strong"] | p["key"].isin("password", "passwd", "aws_secret_access_key", "client_secret"))
    aws = lambda p: p["key"] == "aws_secret_access_key"
    return F.transform(kept, lambda p: as_candidate(F.lit("SECRET.GENERIC.ASSIGNMENT"), p["key"], p["start"], p["end"], F.when(p["strong"] & aws(p), "HIGH").otherwise("MEDIUM"), F.when(example, "LOW").when(p["strong"] & aws(p), "HIGH").when(p["strong"], "MEDIUM").otherwise("LOW"), 4))


def entropy_candidates(text: Column) -> Column:
    """Runs of 20 to 128 token characters of at least 3.5 bits each, with a secret word in the 40 characters before."""
    spans = F.coalesce(match_spans(text, ENTROPY_VALUE), F.array().cast("array<struct<start:int,end:int,value:string>>"))
    near = lambda s: F.substring(text, F.greatest(s["start"] - 40, F.lit(0)) + 1, s["start"] - F.greatest(s["start"] - 40, F.lit(0))).rlike(CONTEXT)
    kept = F.filter(spans, lambda s: near(s) & ~is_placeholder(s["value"]) & ~s["value"].rlike(UUID) & (entropy(s["value"]) >= 3.5))
    made = F.transform(kept, lambda s: as_candidate(F.lit("SECRET.GENERIC.ENTROPY"), F.lit("entropy"), s["start"], s["end"], F.lit("LOW"), F.lit("LOW"), 5))
    return F.when(text.rlike(CONTEXT) & ~text.rlike(HASH_CONTEXT), made).otherwise(_none()).cast(CANDIDATE)


DETECTORS = [private_key_candidates, provider_candidates, connection_candidates, jwt_candidates, assignment_candidates, entropy_candidates]


def without_overlaps(candidates: Column) -> Column:
    """Greedy choice by priority, start, length (longest first) and rule; the kept ones by start."""
    keyed = F.transform(candidates, lambda c: F.struct(c["priority"].alias("p"), c["start"].alias("s"), (-c["value_length"]).alias("n"), c["rule_id"].alias("r"), c.alias("c")))
    ordered = F.transform(F.sort_array(keyed), lambda k: k["c"])
    kept = F.aggregate(ordered, _none(), lambda acc, c: F.when(F.exists(acc, lambda a: (a["start"] < c["end"]) & (c["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(c))))
    by_place = F.sort_array(F.transform(kept, lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e"), c["rule_id"].alias("r"), c.alias("c"))))
    return F.when(F.size(candidates) <= 1, candidates).otherwise(F.transform(by_place, lambda k: k["c"]))


#: A line without any of these words or marks has no candidate: a cheap test before the detectors.
LIKELY = r"(?i)key|token|secret|passw|bearer|connection|PRIVATE|gh[pousr]_|AKIA|ASIA|sk_|xox|glpat-|://|eyJ|\.[A-Za-z0-9_-]{8,}\."


#: Lines of one part of a file: a file of more lines is swept in several tasks.
PART_LINES = 1 << 16


def key_mark(text: Column) -> Column:
    """What a line does to private key blocks: B, a block is open after it; E, none is; null, nothing.

    A BEGIN inside a block changes nothing and one whose line also ends the block opens none, so the last mark tells.
    """
    return F.when(text.contains("-----"), F.when(text.rlike(PEM_BEGIN) & ~text.rlike(f"{PEM_BEGIN}.*{PEM_END}"), "B").when(text.rlike(PEM_END), "E"))


def key_blocks(lines: DataFrame) -> DataFrame:
    """path, begin, end (null: none) of the private key blocks: lines after begin up to end are inside.

    A BEGIN whose line also ends the block opens none, and one inside a block says nothing. Only the lines with a marker
    take part, so nothing else is shuffled.
    """
    text = F.col("text")
    mark = F.when(text.rlike(PEM_BEGIN) & ~text.rlike(f"{PEM_BEGIN}.*{PEM_END}"), "B").when(text.rlike(PEM_END), "E")
    marks = lines.where(text.rlike(f"{PEM_BEGIN}|{PEM_END}")).select("path", "line", mark.alias("mark")).where("mark IS NOT NULL")
    order = Window.partitionBy("path").orderBy("line")
    opened = F.coalesce(F.lag("mark").over(order), F.lit("E")) == "E"
    after = order.rowsBetween(1, Window.unboundedFollowing)
    ends = F.first(F.when(F.col("mark") == "E", F.col("line")), ignorenulls=True).over(after)
    return marks.select("path", F.col("line").alias("begin"), ends.alias("end"), ((F.col("mark") == "B") & opened).alias("__opens")).where("__opens").drop("__opens")


def swept(rows: DataFrame, whole: bool = False) -> DataFrame:
    """rows (path, line, mark and others) with inside_key: whether the last mark on an earlier line of the file opened a
    block. The line of BEGIN counts as outside, that of END as inside.

    The open block is carried from part to part of a file, so no join by ranges is made and no file is one task. ``whole``:
    no file has more lines than a part.
    """
    parted = rows.withColumn("__part", F.floor(F.col("line") / PART_LINES))
    known = running(parted, ["path"], "__part", ["line"], whole, __open=("last", F.col("mark")))
    return known.withColumn("inside_key", F.coalesce(F.col("__open") == "B", F.lit(False))).drop("__part", "__open")


def outside_key_blocks(lines: DataFrame) -> DataFrame:
    """lines with inside_key."""
    return swept(lines.withColumn("mark", key_mark(F.col("text")))).drop("mark")


def unterminated(lines: DataFrame) -> DataFrame:
    """path of files that end inside a key block: their scan is partial."""
    mark = key_mark(F.col("text"))
    return lines.select("path", "line", mark.alias("mark")).where("mark IS NOT NULL").groupBy("path").agg(F.max_by("mark", "line").alias("last")).where("last = 'B'").select("path")


def detect(lines: DataFrame, detectors=DETECTORS, max_bytes: int = 16384, large_file: int = 1 << 20) -> DataFrame:
    """path, line and candidate columns of all lines outside key blocks, without overlaps.

    Lines over the limit are left out of files up to ``large_file`` bytes, but matched whole in larger ones, where
    lines carry their file's size as ``file_bytes``; lines without it count as lines of small files. ``skipped_lines``
    tells which are left out; ``long_lines`` has one line matched by many tasks.
    """
    text = F.col("text")
    likely = text.rlike(LIKELY) & _fits(lines, max_bytes, large_file)
    found = F.when(likely, F.concat(*(d(text) for d in detectors))).otherwise(_none())
    marked = lines.where(likely | text.contains("-----")).select("path", "line", found.alias("c"), key_mark(text).alias("mark"))
    rows = stored(marked.where((F.size("c") > 0) | F.col("mark").isNotNull()), "candidates")
    return swept(rows).where((F.size("c") > 0) & ~F.col("inside_key")).select("path", "line", F.inline(without_overlaps(F.col("c"))))


def _fits(lines: DataFrame, max_bytes: int, large_file: int) -> Column:
    fits = F.octet_length("text") <= max_bytes
    return fits | (F.col("file_bytes") > large_file) if "file_bytes" in lines.columns else fits


def skipped_lines(lines: DataFrame, max_bytes: int = 16384, large_file: int = 1 << 20) -> DataFrame:
    """path, n_skipped: files with lines that no detector sees, which makes their scan partial."""
    return lines.where(~_fits(lines, max_bytes, large_file)).groupBy("path").agg(F.count("*").alias("n_skipped"))


def capped(hits: DataFrame, per_rule: int = 100, per_file: int = 100) -> DataFrame:
    """The first hits of each rule in a file, and of those the first of each file."""
    order = ["line", "start", "rule_id"]
    ruled = hits.withColumn("__r", F.row_number().over(Window.partitionBy("path", "rule_id").orderBy(*order))).where(F.col("__r") <= per_rule).drop("__r")
    return ruled.withColumn("__f", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("__f") <= per_file).drop("__f")


def near_pairs(hits: DataFrame, lines: int = 5, counts: Column | None = None) -> DataFrame:
    """AWS ids and secrets within some lines of each other in a file become HIGH / HIGH: one window per side, no join.
    Hits for which ``counts`` does not hold are no part of a pair."""
    around = Window.partitionBy("path").orderBy("line").rangeBetween(-lines, lines)
    label = F.col("label") if counts is None else F.when(counts, F.col("label"))
    is_id, is_secret = label == "aws_access_key_id", label == "aws_secret_access_key"
    both = (is_id & F.max(is_secret).over(around)) | (is_secret & F.max(is_id).over(around))
    raised = hits.withColumn("__both", F.coalesce(both, F.lit(False)))
    return raised.withColumns({c: F.when(F.col("__both"), "HIGH").otherwise(F.col(c)) for c in ("severity", "confidence")}).drop("__both")


def findings(hits: DataFrame) -> DataFrame:
    """Findings without values: path (redacted), line, column, rule, rating and fingerprint."""
    path = redact_path(F.col("path"))
    mark = fingerprint("secret-finding-v1", F.col("rule_id"), path, F.col("line"), F.col("start") + 1, F.col("label"), F.col("label"))
    return hits.select(
        mark.alias("fingerprint"), F.lit("secrets").alias("scanner_id"), F.lit("secret").alias("category"), "rule_id", path.alias("path"), F.col("line").cast("long").alias("line"),
        (F.col("start") + 1).cast("long").alias("col"), "severity", "confidence", "label", F.col("value_length").cast("long").alias("value_length"),
    )
