"""Column expressions that all operators share. Python stays out of the data path here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONFIDENCES = ["LOW", "MEDIUM", "HIGH"]


def rank(column: Column, order: list[str]) -> Column:
    """The place of an ordinal value, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0)) - 1


def unrank(number: Column, order: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, order)), number.cast("int"))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches, offsets from 0 in code points.

    The parts between matches and the matches are folded side by side. The pattern must not match the empty string.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    kind = "struct<spans:array<struct<start:int,end:int,value:string>>,at:int>"
    empty = F.struct(F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"), F.lit(0).alias("at")).cast(kind)

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("spans"), end.alias("at")).cast(kind)

    matched = F.filter(pairs, lambda x: x["m"].isNotNull())  # what follows the last match has none
    return F.when(text.rlike(pattern), F.aggregate(matched, empty, step, lambda acc: acc["spans"]))


def possible_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of what the pattern would match at every place, overlapping matches included.

    What a scan from the left finds are those of them that begin at or after the end of the last one it took, so these
    spans need no knowledge of what stands further to the left than the pattern looks.
    """
    pieces, found = F.split(text, f"(?={pattern})", -1), F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1))
    block = 64  # lengths are summed by blocks first

    def starts(p: Column) -> Column:
        """Where each piece begins, from the lengths of the pieces."""
        n = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / block).cast("int")), lambda k: n(F.slice(p, k * block + 1, F.lit(block))))
        before = let(sums, lambda of: F.transform(of, lambda _, k: n(F.slice(of, F.lit(1), k))))
        at = lambda known, i: F.get(known, F.floor(i / block).cast("int")) + n(F.slice(p, F.floor(i / block).cast("int") * block + 1, i % block))
        return let(before, lambda known: F.transform(p, lambda _, i: at(known, i)))

    def spans(x: Column) -> Column:
        # Each match but one at the very beginning starts a new piece.
        begun = F.slice(x["at"], F.size(x["at"]) - F.size(x["found"]) + 1, F.size(x["found"]))
        return F.zip_with(begun, x["found"], lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value")))

    begins = let(F.transform(pieces, F.length), starts)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(F.struct(begins.alias("at"), found.alias("found")), spans)).otherwise(none)


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character, rounded to six places; 0 for empty values and those over 1024 characters."""
    share = lambda n: F.transform(F.array_distinct(F.split(value, "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    bits = let(F.length(value), lambda n: F.aggregate(share(n), F.lit(0.0), lambda a, p: a - p * F.log2(p)))
    return F.round(F.when((F.length(value) > 0) & (F.length(value) <= 1024), bits).otherwise(0.0), 6)


def fingerprint(*fields: Column | str) -> Column:
    """SHA-256 over the fields, each as four big-endian length bytes and its UTF-8 bytes."""
    # A fold over the fields: written out for each, they make a method that Java leaves uncompiled.
    texts = F.array(*(F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields))
    part = lambda text: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")), F.encode(text, "utf-8"))
    return F.sha2(F.aggregate(texts, F.lit(b""), lambda acc, text: F.concat(acc, part(text))), 256)


def fingerprint_sql(*fields: str) -> str:
    """The same in DuckDB; fields are SQL expressions of type VARCHAR."""
    parts = " || ".join(f"unhex(lpad(to_hex(strlen({f})), 8, '0')) || encode({f})" for f in fields)
    return f"sha256({parts})"


# Token shapes that are redacted in paths and texts.
TOKEN_SHAPES = [
    r"gh[pousr]_[A-Za-z0-9]{36}", r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"AIza[A-Za-z0-9_-]{35}",
    r"sk_(?:live|test)_[A-Za-z0-9]{24,128}", r"xox[baprs]-[A-Za-z0-9-]{20,128}", r"glpat-[A-Za-z0-9_-]{20,128}",
]
PATH_ASSIGNMENT = r"(?i)(password|token|secret|api[_-]?key|credential)([=_:-])[^/\\]{4,}"
#: What every text has in which one of these is replaced: one look spares most paths all of them.
REDACTED_MARK = r"gh[pousr]_|AKIA|ASIA|AIza|sk_|xox|glpat-|(?i:password|token|secret|key|credential)[=_:-]"
#: To the end of the URL, however long: no tail of one stays in a text.
TEXT_URL = r"(?i)\b(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s\"'<>]+"
TEXT_BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"
TEXT_AUTH = r"(?i)\b(Authorization\s*[:=]\s*)(?:Bearer|Basic)\s+[^\s,;\"']+"
TEXT_ASSIGNMENT = r"(?i)\b(password|passwd|token|secret|api[_-]?key|credential|client[_-]?secret)\s*[:=]\s*['\"]?[^'\"\s,;]{4,}"


def display_safe(text: Column) -> Column:
    """Control, format and surrogate characters as escapes: \\xhh, \\uhhhh or \\Uhhhhhhhh; all others as they are."""
    code = lambda c: F.hex(F.encode(c, "utf-32"))
    shown = lambda c: F.lower(code(c))
    escape = lambda c: F.when(code(c) < "00000100", F.concat(F.lit("\\x"), F.substring(shown(c), 7, 2))).when(code(c) < "00010000", F.concat(F.lit("\\u"), F.substring(shown(c), 5, 4))).otherwise(F.concat(F.lit("\\U"), shown(c)))
    known = lambda c: F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").otherwise(escape(c))
    whole = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[\p{Cc}\p{Cf}\p{Cs}]"), known(c)).otherwise(c)), "")
    return F.when(text.rlike(r"[\p{Cc}\p{Cf}\p{Cs}]"), whole).otherwise(text)


def redact_path(path: Column) -> Column:
    safe = path
    for shape in TOKEN_SHAPES:
        safe = F.regexp_replace(safe, shape, "[REDACTED]")
    return F.when(path.rlike(REDACTED_MARK), F.regexp_replace(safe, PATH_ASSIGNMENT, "$1$2[REDACTED]")).otherwise(path)


def redact_text(text: Column) -> Column:
    """Credential shapes of free text replaced: key blocks, URLs, authorisation, tokens and assignments, in this order."""
    text = F.regexp_replace(text, r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]")
    text = F.regexp_replace(text, TEXT_URL, "[REDACTED URL]")
    text = F.regexp_replace(text, TEXT_AUTH, "$1[REDACTED]")
    text = F.regexp_replace(text, TEXT_BEARER, "Bearer [REDACTED]")
    text = F.regexp_replace(text, "|".join(TOKEN_SHAPES), "[REDACTED TOKEN]")
    return F.regexp_replace(text, TEXT_ASSIGNMENT, "$1=[REDACTED]")


def running_total(df, order: list[str], value: Column, name: str):
    """A running sum in a global order without one task for all rows.

    Rows are dealt into ranges of about equal size and written with their range's number, so that totals and rows see
    the same ranges; totals are summed over the few ranges, rows only within theirs.
    """
    from pyspark.sql import Window

    from harborscan.functions.scratch import stored

    ranged = stored(df.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__part").agg(F.sum("__value").alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.sum("__value").over(within)).drop("__part", "__before", "__value")


def running(rows, keys: list[str], part: str, order: list[str], whole: bool = False, **values: tuple[str, Column]):
    """rows with running aggregates over the rows of the same keys that come before them.

    values: name = (kind, column) with kind last (of those not null), max or sum. Rows are cut into parts that ascend with
    the order, and no key is one task's work: windows run within a part, and what the parts before it give is worked out
    from one row a part. rows is read twice, so it should be a stored table or a cheap one. Where it is known that no key has
    rows in more than one part (``whole``), the window is all and rows is read once.
    """
    from pyspark.sql import Window

    kinds = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}
    totals = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order))), "max": F.max, "sum": F.sum}
    before = Window.unboundedPreceding, -1
    if whole:
        alone = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        return rows.withColumns({name: F.coalesce(F.sum(c).over(alone), F.lit(0)) if kind == "sum" else kinds[kind](c).over(alone) for name, (kind, c) in values.items()})
    own, earlier = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(*before), Window.partitionBy(*keys).orderBy(part).rowsBetween(*before)
    parts = rows.groupBy(*keys, part).agg(*(totals[kind](c).alias(f"__{name}") for name, (kind, c) in values.items()))
    carried = parts.select(*keys, part, *(kinds[kind](F.col(f"__{name}")).over(earlier).alias(f"__{name}") for name, (kind, _) in values.items()))
    here = rows.withColumns({name: kinds[kind](c).over(own) for name, (kind, c) in values.items()})
    both = {
        name: F.coalesce(F.col(name), F.col(f"__{name}")) if kind == "last" else F.greatest(name, f"__{name}") if kind == "max" else F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"__{name}"), F.lit(0))
        for name, (kind, _) in values.items()
    }
    return here.join(carried, [*keys, part]).withColumns(both).drop(*(f"__{name}" for name in values))
