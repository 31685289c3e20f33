"""Cutoffs and verdicts of every stratum against a plain walk over the fixed sequences."""

from math import comb

from pyspark.sql import functions as F

from harborscan.llm import quality_rules


def tail(k, n, p):
    return 1.0 if k > n * p else sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_strata_that_occur_set_the_level(spark):
    sizes = {"en": 2000, "de": 507, "fr": 505, "es": 321, "xx": 150}
    rows, i = [], 0
    for lang, n in sizes.items():
        for j in range(n):
            rows.append((i, lang, 100, 0, [0.05, 0.12, 0.3, 0.7][(j % 100 > 1) + (j % 400 == 0) + (j % 2 == 0) * (j % 100 > 1)], 5.0 + (j % 300 == 0)))
            i += 1
    scored = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, n_repeat_words long, x double, y double")
    labels = scored.select("doc_id", F.lit(1).alias("quality")).unionByName(spark.createDataFrame([(-1, 1), (None, 1)], "doc_id long, quality int"))
    cutoffs = {"x": [0.01, 0.1, 0.2, 0.5, 0.8], "y": [4.0, 5.5, 9.0]}
    got = {(r.stratum, r.rule): r.cutoff for r in quality_rules.thresholds(scored, labels, cutoffs=cutoffs).collect()}
    want, level = {}, quality_rules.ERROR / (len(sizes) * len(cutoffs))
    for lang, n in sizes.items():
        for at, rule in ((4, "x"), (5, "y")):
            for c in reversed(cutoffs[rule]):
                if tail(sum(r[at] > c for r in rows if r[1] == lang), n, quality_rules.RISK) > level:
                    break
                want[lang, rule] = c
    assert got == want
    assert {lang for lang, _ in got} == {"en", "de", "fr", "es"}


def test_verdicts_of_languages(spark):
    """A document of a language is judged by its own language's cutoffs; without labels nothing but the base rejects."""
    good, bad = " ".join(f"word{j}" for j in range(60)), " ".join(f"#{j}#&" for j in range(60))
    rows = [(i, lang, good) for i, lang in enumerate(["de"] * 300 + ["fr"] * 300 + [None] * 5)] + [(900, "de", bad), (901, "fr", bad), (901, "fr", bad), (902, None, bad), (903, "es", bad), (904, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.where("doc_id < 900 AND lang IS NOT NULL").select("doc_id", F.lit(1).alias("quality"))
    out = [(r.doc_id, r.kept) for r in quality_rules.quality(docs, labels).where("doc_id >= 900").collect()]
    assert sorted(out) == [(900, False), (901, False), (901, False), (902, True), (903, True), (904, False)]
    assert quality_rules.quality(docs, labels).where("doc_id < 900 AND NOT kept").count() == 0
    assert {r.kept for r in quality_rules.quality(docs, labels.limit(0)).where("doc_id BETWEEN 900 AND 903").collect()} == {True}
