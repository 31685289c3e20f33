"""Advisory lookups in stages: what a cache knows, what may be asked of a provider, and what its budgets leave.

Keys come in their sorted order, ``batch_size`` in a request. Each request of a batch is followed by one request for each
advisory that no earlier batch has named, so what a batch may ask for depends on what all batches before it used: prefix sums
over batches, of which no more than the budget of batches (a parameter) are looked at. The first batch whose requests no
longer fit ends the asking. What had been answered by then stays, with the keys of that batch marked incomplete.

States: UNSUPPORTED_ECOSYSTEM; the cached status, with STALE_ before it where an old row serves offline; OFFLINE_NO_CACHE;
PENDING (to be asked); and in its place MATCHED, NO_MATCH, QUERY_FAILED (its batch failed) or NO_DATA (not asked any more).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from harborscan.functions.exprs import running_total
from harborscan.functions.scratch import stored
from harborscan.operators.dependencies import PROVIDER

KEY = ["ecosystem", "name", "version"]
# The ecosystems that a provider knows.
ECOSYSTEMS = ["PyPI", "npm", "crates.io", "Go"]


def staged(keys: DataFrame, cache: DataFrame, now: str, ttl_seconds: int, offline: bool = False, ecosystems: list[str] = ECOSYSTEMS) -> DataFrame:
    """ecosystem, name, version, state and age_seconds by the latest cache row up to ``now`` (fetched_at, status)."""
    at = F.lit(now).cast("timestamp")
    latest = cache.where(F.col("fetched_at") <= at).groupBy(*KEY).agg(F.max(F.struct("fetched_at", "status")).alias("c"))
    age = F.unix_seconds(at) - F.unix_seconds(F.col("c.fetched_at"))
    old, known = age > ttl_seconds, F.col("ecosystem").isin(*ecosystems)
    state = (
        F.when(~known, "UNSUPPORTED_ECOSYSTEM").when(F.col("c").isNotNull() & ~old, F.col("c.status")).when(F.lit(offline) & F.col("c").isNotNull(), F.concat(F.lit("STALE_"), F.col("c.status")))
        .when(F.lit(offline), "OFFLINE_NO_CACHE").otherwise("PENDING")
    )
    return keys.select(*KEY).distinct().join(latest, KEY, "left").select(*KEY, state.alias("state"), F.when(known, age).alias("age_seconds"))


def _asked(pending: DataFrame, answers: DataFrame, p: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Pending keys with their batch and its answer, and what each batch within the budget of batches may use."""
    numbered = running_total(pending.withColumn("__key", F.concat_ws("\u0001", *KEY)), ["__key"], F.lit(1), "n")
    batched = numbered.withColumn("batch", F.floor((F.col("n") - 1) / p["batch_size"]).cast("long"))
    told = stored(batched.join(answers.select(*KEY, "advisory_ids", "error"), KEY, "left").select(*KEY, "batch", "advisory_ids", F.coalesce("error", F.lit(False)).alias("error")), "asked")
    failed = told.where(F.col("batch") < p["batch_requests"]).groupBy("batch").agg(F.bool_or("error").alias("failed"))
    named = told.where(F.col("batch") < p["batch_requests"]).join(F.broadcast(failed.where("NOT failed").select("batch")), "batch", "left_semi").select("batch", F.explode("advisory_ids").alias("advisory_id"))
    fresh = stored(named.groupBy("advisory_id").agg(F.min("batch").alias("batch")), "details")
    details = fresh.groupBy("batch").agg(F.count("*").alias("wanted"))
    order = Window.orderBy("batch")  # at most the budget of batches
    b = failed.join(details, "batch", "left").fillna(0, ["wanted"])
    b = b.withColumn("used", F.coalesce(F.sum("wanted").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.withColumn("left", F.least(F.lit(p["detail_requests"]) - F.col("used"), F.lit(p["total_requests"]) - (F.col("batch") + 1) - F.col("used")))
    b = b.withColumn("stop", F.when(F.col("left") < F.col("wanted"), F.col("batch"))).withColumn("stop", F.min("stop").over(Window.partitionBy(F.lit(0))))
    # The batch that ends the asking is asked itself, if a request is left for it.
    b = b.where(F.col("stop").isNull() | (F.col("batch") < F.col("stop")) | ((F.col("batch") == F.col("stop")) & (F.col("left") >= 0)))
    place = F.row_number().over(Window.partitionBy("batch").orderBy("advisory_id"))
    got = fresh.withColumn("place", place).join(F.broadcast(b.select("batch", "left")), "batch").where(F.col("place") <= F.col("left")).select("advisory_id")
    return told.join(F.broadcast(b.select("batch", "failed")), "batch", "left"), b.join(F.broadcast(got.agg(F.count("*").alias("n_details")))).join(F.broadcast(got.agg(F.sort_array(F.collect_set("advisory_id")).alias("got"))))


def answered(first: DataFrame, answers: DataFrame, **limits: int) -> DataFrame:
    """The rows of ``staged`` with every PENDING one answered or given up, incomplete, and the advisories that were fetched.

    answers: ecosystem, name, version, advisory_ids, error: what a provider would say of a key. advisory_ids holds those whose
    details were fetched; incomplete tells that there are more.
    """
    p = PROVIDER | limits
    told, used = _asked(first.where("state = 'PENDING'"), answers, p)
    got = F.broadcast(used.select("got").distinct())  # one row of at most the budget of details
    ids = F.coalesce("advisory_ids", F.array().cast("array<string>"))
    rows = told.join(got, F.lit(True), "left").withColumn("ids", ids)
    kept = F.when(F.col("failed").isNull() | F.col("failed"), F.array().cast("array<string>")).otherwise(F.array_intersect("ids", F.coalesce("got", F.array().cast("array<string>"))))
    state = F.when(F.col("failed").isNull(), "NO_DATA").when(F.col("failed"), "QUERY_FAILED").when(F.size("ids") > 0, "MATCHED").otherwise("NO_MATCH")
    rows = rows.select(*KEY, "batch", state.alias("state"), (~F.coalesce("failed", F.lit(True)) & (F.size(kept) < F.size(F.array_distinct("ids")))).alias("incomplete"), F.array_sort(kept).alias("advisory_ids"))
    rest = first.where("state <> 'PENDING'").select(*KEY, F.lit(None).cast("long").alias("batch"), "state", F.lit(False).alias("incomplete"), F.array().cast("array<string>").alias("advisory_ids"))
    return rest.unionByName(rows)


def requests(first: DataFrame, answers: DataFrame, **limits: int) -> DataFrame:
    """One row: requests used of each kind and whether a budget ended the asking, counted from what was asked."""
    p = PROVIDER | limits
    told, used = _asked(first.where("state = 'PENDING'"), answers, p)
    b = used.agg(F.count("*").alias("batch_requests_used"), F.coalesce(F.max("n_details"), F.lit(0)).alias("detail_requests_used"), F.coalesce(F.bool_or(F.col("stop").isNotNull()), F.lit(False)).alias("stopped"))
    more = told.agg(F.coalesce(F.bool_or(F.col("failed").isNull()), F.lit(False)).alias("more"))
    return b.join(F.broadcast(more)).select("batch_requests_used", "detail_requests_used", (F.col("batch_requests_used") + F.col("detail_requests_used")).alias("total_requests_used"), (F.col("stopped") | F.col("more")).alias("provider_budget_reached"))


def retained(cache: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """The cache after the answers: complete ones in the place of old rows; failures and incomplete ones change nothing."""
    new = rows.where("batch IS NOT NULL AND state IN ('MATCHED', 'NO_MATCH') AND NOT incomplete").select(*KEY, F.lit(now).cast("timestamp").alias("fetched_at"), F.col("state").alias("status"))
    return cache.select(*KEY, "fetched_at", "status").join(new.select(*KEY), KEY, "left_anti").unionByName(new)
