"""Long lines in windows: one line is many tasks' work, and what is found is what matching the whole line finds.

A line is cut into chunks; a window is a chunk with some text before and after it. Every place where a rule's expression
could match is found, overlapping ones too, and belongs to the chunk in which it begins: what it needs to see lies within
the window, as no expression looks back more than LEFT or ahead more than RIGHT characters. Which of them a scan from the
left takes is settled afterwards on spans alone: where no earlier possible match reaches, the choice starts anew, and only
runs of overlapping ones are followed one by one. Words that speak for a whole line are gathered from its windows.

Values stay in their window's task. A name and its value may stand up to GAP - 1 blanks apart; where more follow, the line
is told as INCOMPLETE, since what lies beyond is not looked for.

``windows`` cuts lines that are in a table; ``grown`` makes the same windows of files that arrive part by part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.functions.exprs import entropy, possible_spans, running
from harborscan.functions.scratch import stored
from harborscan.operators import secret_rules as rules
from harborscan.operators.secret_rules import ASSIGNMENT_KEY, CANDIDATE, CONTEXT, HASH_CONTEXT, LIKELY, PEM_BEGIN, PEM_END

#: Characters of context on each side, and in bytes; the blanks from which a line is incomplete; bytes of a chunk.
LEFT, RIGHT, GAP = 64, 8704, 4096
LEFT_BYTES, RIGHT_BYTES, CHUNK_BYTES = 4 * LEFT, 4 * RIGHT, 1 << 17
#: Characters that expressions look ahead from where they begin: words and tokens, connections, three-part tokens; and an
#: assignment beside whose chunk no SHORT_GAP blanks follow each other.
WORD_REACH, CONNECTION_REACH, JWT_REACH, ASSIGNMENT_REACH, SHORT_GAP = 192, 512, 2688, 1024, 256
#: Chunks that one part of a line's chunks holds, where sums go on from part to part.
PART_CHUNKS = 1 << 10
EXAMPLE = r"(?iU)\b(?:example|sample|placeholder|documentation)\b"
#: The expressions with bounded blanks; all others are bounded as they are.
ASSIGNMENT = rules.ASSIGNMENT.replace(r"\s*", rf"\s{{0,{GAP - 1}}}")
UNBOUNDED = rf"(?iU)(?<![\w-])(?:{ASSIGNMENT_KEY})[\"']?(?:\s{{{GAP}}}|\s{{0,{GAP - 1}}}(?::|=)\s{{{GAP}}})"
_NO_SPANS = lambda: F.array().cast("array<struct<start:int,end:int,value:string>>")
_FOUND = "array<struct<rule:int,start:int,end:int,c:struct<rule_id:string,label:string,start:int,end:int,severity:string,confidence:string,priority:int,value_length:int>>>"


def windows(lines: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """path, line, chunk, lead, own and text: the chunk's characters are ``own`` many after the first ``lead`` of text."""
    whole = lines.select("path", "line", F.col("text").cast("binary").alias("b"), F.octet_length("text").alias("n")).where("n > 0")
    begins = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))))

    def cut(p: Column) -> Column:
        """p, or the place up to three bytes before it at which a character begins."""
        inner = lambda q: F.hex(F.substring("b", q + 1, F.lit(1))).between("80", "BF")
        return F.when((p <= 0) | (p >= F.col("n")), p).when(~inner(p), p).when(~inner(p - 1), p - 1).when(~inner(p - 2), p - 2).otherwise(p - 3)

    at = F.col("chunk") * size
    placed = begins.withColumns({"first": cut(at), "last": cut(F.least(at + size, "n")), "low": cut(F.greatest(at - LEFT_BYTES, F.lit(0))), "high": cut(F.least(at + size + RIGHT_BYTES, "n"))})
    part = lambda a, b: F.substring("b", F.col(a) + 1, F.col(b) - F.col(a)).cast("string")
    lead, own = F.length(part("low", "first")), F.length(part("first", "last"))
    made = placed.select("path", "line", F.col("chunk").cast("long").alias("chunk"), lead.alias("lead"), own.alias("own"), F.substring(part("low", "high"), F.lit(1), lead + own + RIGHT).alias("text"))
    return made.repartition("path", "line", "chunk")


def found_in(made: DataFrame) -> DataFrame:
    """What each window holds, without any text: path, line, chunk, own, flags of the line, its first key mark and last end
    mark, and spans (rule, start, end, and the candidate if its value passes), counted from the chunk's begin.

    Of the text after a chunk each expression is shown what it can look at, as most need far less of it than the longest."""
    text, lead, own = F.col("text"), F.col("lead"), F.col("own")
    mine = lambda spans: F.filter(spans, lambda s: (s["start"] >= lead) & (s["start"] < lead + own))
    until = lambda reach: F.substring(text, F.lit(1), lead + own + reach)
    has = lambda pattern, shown: F.size(mine(possible_spans(shown, pattern))) > 0
    words = until(WORD_REACH)
    digits = F.when(words.rlike(r"(?iU)sha\d{100}"), text).otherwise(words)  # the one expression that any run of digits may follow
    blank = rf"(?U)(?<!\s)\s{{{SHORT_GAP}}}"  # looked for where blanks begin only
    assignments = F.when(F.substring(text, lead + own + 1, F.lit(ASSIGNMENT_REACH)).rlike(blank), text).otherwise(until(ASSIGNMENT_REACH))
    begins, ends = (F.when(words.contains("-----"), mine(possible_spans(words, mark))).otherwise(_NO_SPANS()) for mark in (PEM_BEGIN, PEM_END))
    place = lambda s, field: (s[field] - lead).cast("long")

    def near(s: Column) -> Column:
        low = F.greatest(s["start"] - 40, F.lit(0))
        return F.substring(text, low + 1, s["start"] - low).rlike(CONTEXT)

    def entropy_candidate(s: Column) -> Column:
        kept = near(s) & ~rules.is_placeholder(s["value"]) & ~s["value"].rlike(rules.UUID) & (entropy(s["value"]) >= 3.5)
        return F.when(kept, rules.as_candidate(F.lit("SECRET.GENERIC.ENTROPY"), F.lit("entropy"), F.lit(0), F.length(s["value"]), F.lit("LOW"), F.lit("LOW"), 5))

    def of_value(detector) -> Callable[[Column], Column]:
        """The one candidate that a detector finds in what its own expression matched."""
        return lambda s: F.get(detector(s["value"]), F.lit(0))

    def assigned(s: Column) -> Column:
        part = rules.assignment_part(F.struct((s["start"] - s["start"]).alias("start"), (s["end"] - s["start"]).alias("end"), s["value"].alias("value")))
        return F.get(rules.rated_assignments(rules.looked_up_apart(F.array(part)), F.lit(False)).cast(CANDIDATE), F.lit(0))

    three = F.when(until(JWT_REACH).contains("."), until(JWT_REACH)).otherwise("")
    detectors = [("(?U)" + p[2], words, of_value(rules.provider_candidates)) for p in rules.PROVIDERS]
    detectors += [(rules.CONNECTION, until(CONNECTION_REACH), of_value(rules.connection_candidates)), (rules.JWT, three, of_value(rules.jwt_candidates)), (ASSIGNMENT, assignments, assigned), (rules.ENTROPY_VALUE, words, entropy_candidate)]

    def told(number: int, pattern: str, shown: Column, judged: Callable[[Column], Column]) -> Column:
        one = lambda s: F.struct(F.lit(number).alias("rule"), place(s, "start").cast("int").alias("start"), place(s, "end").cast("int").alias("end"), judged(s).alias("c")).cast(_FOUND[len("array<") : -1])
        return F.transform(mine(possible_spans(shown, pattern)), one)

    parts = [told(number, *d) for number, d in enumerate(detectors)]
    spans = F.when(until(JWT_REACH).rlike(LIKELY), F.concat(*parts)).otherwise(F.array().cast(_FOUND))
    gap = F.when(text.rlike(rf"(?U)(?<!\s)\s{{{GAP}}}"), has(UNBOUNDED, text)).otherwise(False)
    first = F.get(begins, F.lit(0))
    return made.select(
        "path", "line", "chunk", F.col("own").cast("long").alias("own"), has(HASH_CONTEXT, digits).alias("hash"), has(EXAMPLE, words).alias("example"), has(CONTEXT, words).alias("context"), gap.alias("gap"),
        place(first, "start").alias("begin"), place(first, "end").alias("begin_end"), F.when(F.size(ends) > 0, place(F.get(ends, F.size(ends) - 1), "start")).alias("end_mark"),
        spans.alias("spans"),
    )


def taken(spans: DataFrame) -> DataFrame:
    """spans (path, line, rule, chunk, start, end and others) that a scan from the left takes: each begins where the one
    taken before it has ended, or later. Runs of overlapping ones are followed in their order, all others stay as they are."""
    keys = ["path", "line", "rule"]
    reach = stored(running(stored(spans, "spans"), keys, "chunk", ["start"], __reach=("max", F.col("end"))).withColumn("__head", F.coalesce(F.col("start") >= F.col("__reach"), F.lit(True))), "reach")
    named = running(reach, keys, "chunk", ["start"], __run=("last", F.when(F.col("__head"), F.col("start"))))
    named = named.withColumn("__run", F.when(F.col("__head"), F.col("start")).otherwise(F.col("__run"))).drop("__reach")
    size = F.count("*").over(Window.partitionBy(*keys, "__run").orderBy("start").rowsBetween(-1, 1))  # 1: alone
    counted = named.withColumn("__alone", size == 1)
    runs = counted.where("NOT __alone").drop("__alone", "__head").repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "start")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, until = None, 0
        for b in batches:
            at = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, "__run", "start", "end")}
            keep = []
            for *name, start, end in zip(*at.values()):
                until = until if name == run else start
                run = name
                keep.append(start >= until)
                until = end if keep[-1] else until
            yield b.filter(pa.array(keep, pa.bool_()))

    return counted.where("__alone").drop("__alone", "__head", "__run").unionByName(runs.mapInArrow(follow, runs.schema).drop("__run"))


def resolved(found: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """path, line and candidate columns of the lines whose windows ``found`` tells, without overlaps.

    inside: path, line of lines that are inside a private key block; they have no candidates.
    """
    narrow = stored(found, "windows")
    if inside is not None:
        narrow = narrow.join(inside.select("path", "line").distinct(), ["path", "line"], "left_anti")
    placed = stored(running(narrow.withColumn("part", F.floor(F.col("chunk") / PART_CHUNKS)), ["path", "line"], "part", ["chunk"], at=("sum", F.col("own"))).drop("part"), "placed")
    told = placed.groupBy("path", "line").agg(F.bool_or("hash").alias("hash"), F.bool_or("example").alias("example"), F.bool_or("context").alias("context"), F.min(F.when(F.col("begin").isNotNull(), F.struct((F.col("at") + F.col("begin")).alias("start"), (F.col("at") + F.col("begin_end")).alias("end")))).alias("key"))
    spans = placed.select("path", "line", "chunk", "at", F.inline("spans")).withColumns({"start": F.col("at") + F.col("start"), "end": F.col("at") + F.col("end")}).drop("at")
    hits = taken(spans).where("c IS NOT NULL").join(told.drop("key"), ["path", "line"])
    generic = F.col("c.rule_id").isin("SECRET.GENERIC.ASSIGNMENT", "SECRET.GENERIC.ENTROPY")
    hits = hits.where(~(generic & F.col("hash")) & ((F.col("c.rule_id") != "SECRET.GENERIC.ENTROPY") | F.col("context")))
    low = (F.col("c.rule_id") == "SECRET.GENERIC.ASSIGNMENT") & F.col("example")
    one = lambda c: F.col(f"c.{c}").alias(c)
    moved = F.struct(one("rule_id"), one("label"), (F.col("start") + F.col("c.start")).cast("int").alias("start"), (F.col("start") + F.col("c.end")).cast("int").alias("end"), one("severity"), F.when(low, "LOW").otherwise(F.col("c.confidence")).alias("confidence"), one("priority"), one("value_length"))
    keys = told.where("key.start IS NOT NULL").select("path", "line", F.floor(F.col("key.start") / CHUNK_BYTES).alias("chunk"), F.struct(F.lit("SECRET.PRIVATE_KEY.PEM").alias("rule_id"), F.lit("private_key").alias("label"), F.col("key.start").cast("int").alias("start"), F.col("key.end").cast("int").alias("end"), F.lit("HIGH").alias("severity"), F.lit("HIGH").alias("confidence"), F.lit(0).alias("priority"), (F.col("key.end") - F.col("key.start")).cast("int").alias("value_length")).alias("c"))
    return apart(hits.select("path", "line", moved.alias("c")).select("path", "line", F.floor(F.col("c.start") / CHUNK_BYTES).alias("chunk"), "c").unionByName(keys))


def apart(hits: DataFrame) -> DataFrame:
    """The greedy choice among overlapping candidates of all rules, in each group of candidates that touch."""
    one = CANDIDATE[len("array<") : -1]
    rows = stored(hits.select("path", "line", "chunk", F.col("c").cast(one).alias("c"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.rule_id").alias("rule_id")), "hits")
    order = ["start", "rule_id", "end"]
    reach = stored(running(rows, ["path", "line"], "chunk", order, reach=("max", F.col("end"))).withColumn("head", F.coalesce(F.col("start") >= F.col("reach"), F.lit(True))), "touching")
    named = running(reach, ["path", "line"], "chunk", order, run=("last", F.when(F.col("head"), F.struct("start", "rule_id"))))
    named = named.withColumn("run", F.when(F.col("head"), F.struct("start", "rule_id")).otherwise(F.col("run")))
    grouped = named.groupBy("path", "line", "run").agg(F.collect_list("c").alias("c"))
    return grouped.select("path", "line", F.inline(rules.without_overlaps(F.col("c").cast(CANDIDATE))))


def marks(found: DataFrame) -> DataFrame:
    """path, line, mark (B, E or null) of lines by their windows, as key_mark has them of whole lines."""
    at = F.coalesce(F.sum("own").over(Window.partitionBy("path", "line").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.select("path", "line", (at + F.col("begin_end")).alias("b"), (at + F.col("end_mark")).alias("e"))
    ends = placed.groupBy("path", "line").agg(F.min("b").alias("b"), F.max("e").alias("e"))
    return ends.select("path", "line", F.when(F.col("b").isNotNull() & ~F.coalesce(F.col("e") >= F.col("b"), F.lit(False)), "B").when(F.col("e").isNotNull(), "E").alias("mark"))


def states(found: DataFrame, most: int = 100_000) -> DataFrame:
    """path, line, state: INCOMPLETE where blanks run on between a name and its value, LIMIT over ``most`` possible matches."""
    n = found.groupBy("path", "line").agg(F.bool_or("gap").alias("gap"), F.sum(F.size("spans")).alias("n"))
    return n.select("path", "line", F.when(F.col("gap"), "INCOMPLETE").when(F.col("n") > most, "LIMIT").otherwise("COMPLETE").alias("state"))


def scan_windows(made: DataFrame) -> DataFrame:
    """path, line and candidate columns of the lines that these windows cover; lines inside key blocks have none."""
    found = stored(found_in(made), "found")
    return resolved(found, rules.swept(stored(marks(found), "marks")).where("inside_key"))


def scan(lines: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The same of lines (path, line, text) of any length."""
    return scan_windows(windows(lines, size))
