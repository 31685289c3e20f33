"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Five statistics are taken from every whole text. Each method rule rejects a document whose statistic is above a cutoff.
Cutoffs are chosen per stratum (language) on labelled documents: for every stratum, rule and candidate cutoff the
hypothesis "this rule rejects more than ``risk`` of the good documents" is tested with the exact binomial tail; with
``k`` of ``n`` good documents rejected its p-value is P(Bin(n, risk) <= k). A stratum and rule take their cutoffs in a
fixed sequence, from the loosest to the strictest, and stop before the first whose p-value is above ``error`` divided by
the number of strata with good documents times that of rules. Testing in a fixed sequence needs no further division by
the number of cutoffs; Bonferroni's correction over the sequences holds the chance of any false claim, in all strata at
once, to ``error``. As a lower cutoff rejects no fewer documents, p-values rise along the sequence, so the last cutoff
before the stop is the lowest with a p-value within the level. A stratum or rule without one rejects nothing. All rules together
falsely reject at most ``risk`` times the number of rules, in all strata at once with probability ``1 - error``. Every
stratum is tested, however many there are; the more there are, the more good documents each needs (286 for four strata
if none of them is rejected).

The statistics are written once to a scratch table, narrow and without texts, and read for calibration and verdicts.
The thresholds are one row for each stratum that has any. Their number is not bounded, so they are joined without a
forced broadcast; the rows of a stratum are dealt over SALTS keys, to each of which its thresholds are copied.

Defined cases: null text has no words and fails the base; null language is the stratum ''; a document with several
labels is good only if all say so; labels without documents and documents without labels are unused; with no labels
nothing but the base rejects; repeated documents each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harborscan.llm.common import stored

RISK, ERROR = 0.02, 0.05
#: Keys over which the rows of one stratum are dealt for the join with its thresholds.
SALTS = 64
#: Candidate cutoffs of each rule, lowest (strictest) first.
CUTOFFS = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0],
    "repeated_lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeated_words": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5],
    "long_words": [6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
}
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


_NO_WINDOWS = "array<struct<g:string,i:int>>"


def _windows(w: Column, make) -> Column:
    last = F.size(w) - 3
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: make(i, F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))


def hashed_windows(w: Column) -> Column:
    """A hash for each three-word window: if all differ, so do the windows, and nothing needs sorting."""
    return _windows(w, lambda i, *x: F.xxhash64(*x))


def sorted_windows(w: Column, hashes: Column) -> Column:
    """Where windows may repeat: the windows with their places, equal ones side by side."""
    made = _windows(w, lambda i, *x: F.struct(F.concat_ws(" ", *x).alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(made)).otherwise(F.array().cast(_NO_WINDOWS))


def repeated_word_count(s: Column) -> Column:
    """Words inside windows that occur twice or more, of the sorted windows."""

    def twice(x, k):
        return F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False))

    places = F.transform(F.filter(s, twice), lambda x: x["i"])
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))).cast("long")


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more``, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of every document.

    Arrays that later expressions use more than once are columns of a projection of their own: Catalyst then keeps the
    projections apart, and each array is made once.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    solid = F.translate("t", " \t\n\x0b\x0c\r", "")
    words = F.array_remove(F.split("t", _SPACE), "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD))
    counted = (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long")
    parts = base.select("doc_id", *more, F.length(solid).cast("long").alias("word_chars"), counted.alias("n_symbols"), words.alias("w"), lines.alias("l"))
    n_dup = (F.size("l") - F.size(F.array_distinct("l"))).cast("long")
    hashed = parts.select("doc_id", *more, F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("l").cast("long").alias("n_lines"), n_dup.alias("n_dup_lines"), "w", hashed_windows(F.col("w")).alias("h"))
    windows = hashed.select("doc_id", *more, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", sorted_windows(F.col("w"), F.col("h")).alias("s"))
    return windows.select("doc_id", *more, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated_word_count(F.col("s")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_scores() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly: the terms' logarithms are folded, so that large n don't underflow. 1 where k is above the mean."""
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(acc, j):
        log = acc["log"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    fold = F.aggregate(F.sequence(F.lit(1), k.cast("int")), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).when(k > n * p, 1.0).when(k < 1, F.exp(first)).otherwise(fold)


def thresholds(scored: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cutoffs: dict = CUTOFFS) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_rejected, p_value for each stratum and rule that has a cutoff within the risk."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg((F.min("quality") == 1).alias("good")).where("good").select("doc_id")
    held = scored.where(~base_failed()).join(good, "doc_id", "left_semi")
    counts = stored(held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col(r) > c).alias(f"{r}|{i}") for r, cs in cutoffs.items() for i, c in enumerate(cs))), "strata")
    strata = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_strata"))
    tests = counts.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}|{i}").alias("k")) for r, cs in cutoffs.items() for i, c in enumerate(cs)))).alias("t"))
    tests = tests.select("stratum", "n", "t.*").withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), risk))
    safe = tests.join(F.broadcast(strata)).where(F.col("p_value") <= error / (F.col("n_strata") * len(cutoffs)))  # one row
    return safe.groupBy("stratum", "rule").agg(F.min_by(F.struct("cutoff", F.col("n").alias("n_good"), F.col("k").alias("n_rejected"), "p_value"), "cutoff").alias("x")).select("stratum", "rule", "x.*")


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cutoffs: dict = CUTOFFS) -> DataFrame:
    """One row per document: the base statistics, base_failed, kept, and the rules that rejected it."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum") if "lang" in docs.columns else F.lit("").alias("stratum")
    scored = stored(statistics(docs.select("doc_id", "text", lang), "stratum"), "quality").withColumns(rule_scores())
    cut = thresholds(scored, labels, risk, error, cutoffs)
    wide = cut.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut|{r}") for r in cutoffs))
    salted = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(salted, ["stratum", "salt"], "left")
    rejects = F.filter(F.array(*(F.when(F.col(r) > F.col(f"cut|{r}"), F.lit(r)) for r in cutoffs)), lambda x: x.isNotNull())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.size(rejects) == 0)).alias("kept"), F.array_join(rejects, ",").alias("rejected_by"),
    )
