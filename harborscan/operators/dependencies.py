"""Package inventories: normalised records, lock and declaration reconciliation, advisory lookups and matches.

A record has project, ecosystem, name, version, resolved (from a lock), directness, dep_group, constraint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborscan.functions.exprs import fingerprint, redact_path, running_total
from harborscan.functions.scratch import stored


def normal_name(ecosystem: Column, name: Column) -> Column:
    """PyPI names in lower case with single dashes; npm and crates.io in lower case; Go as it is."""
    return F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).when(ecosystem.isin("npm", "crates.io"), F.lower(name)).otherwise(name)


def safe_exact_version(version: Column) -> Column:
    return version.rlike(r"^[A-Za-z0-9][A-Za-z0-9.+!_-]{0,127}$") & ~version.rlike(r"^(?:gh[pousr]_|AKIA|ASIA|sk_|xox)")


def version_kind(ecosystem: Column, spec: Column) -> Column:
    """EXACT, CONSTRAINT, VCS, LOCAL_PATH, URL or UNRESOLVED of a version as a manifest writes it."""
    s = F.trim(spec)
    exact = F.when(ecosystem == "PyPI", s.rlike(r"^===?\s*[0-9A-Za-z][0-9A-Za-z.+!_-]*$")).when(ecosystem == "crates.io", s.rlike(r"^=\s*\d+(\.\d+)*$")).otherwise(s.rlike(r"^v?\d+\.\d+\.\d+([-+][0-9A-Za-z.-]+)?$"))
    return (
        F.when(s.isNull() | (s == "") | (s == "*"), "UNRESOLVED").when(s.rlike(r"^(git\+|git:|github:|ssh:)"), "VCS").when(s.rlike(r"^(file:|link:|workspace:|\.\.?/|/)"), "LOCAL_PATH")
        .when(s.rlike(r"^https?://"), "URL").when(exact, "EXACT").otherwise("CONSTRAINT")
    )


def distinct_records(records: DataFrame) -> DataFrame:
    """One record for each ecosystem, name, version, project and origin: the first by all other columns."""
    keys = ["ecosystem", "name", "version", "project", "resolved"]
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def reconciled(records: DataFrame) -> DataFrame:
    """Records in which a lock's entry stands for the project's declarations of its package.

    It is direct if the project declares the package and the lock does not call it transitive; its group is the first
    known one, and its constraint the first given one, of the declarations in version order.
    """
    once, keys = distinct_records(records), ["ecosystem", "name", "project"]
    locked, declared = once.where("resolved"), once.where("NOT resolved")
    order = F.struct("version", "directness", "dep_group", "constraint")
    said = declared.groupBy(*keys).agg(
        F.min(F.when(F.col("dep_group") != "UNKNOWN", F.struct("version", "dep_group"))).alias("g"), F.min(F.when(F.col("constraint").isNotNull(), F.struct("version", "constraint"))).alias("c"), F.min(order).alias("__any"))
    joined = locked.join(said, keys, "left")
    directness = F.when(F.col("__any").isNotNull() & (F.col("directness") != "TRANSITIVE"), "DIRECT").otherwise(F.col("directness"))
    columns = ["ecosystem", "name", "version", "project", "resolved"]
    merged = joined.select(*columns, directness.alias("directness"), F.coalesce("g.dep_group", "dep_group").alias("dep_group"), F.coalesce("c.constraint", "constraint").alias("constraint"))
    return merged.unionByName(declared.join(locked.select(*keys).distinct(), keys, "left_anti").select(*columns, "directness", "dep_group", "constraint"))


def exact_keys(records: DataFrame) -> DataFrame:
    return records.where(F.col("version").isNotNull() & safe_exact_version(F.col("version"))).select("ecosystem", "name", "version").distinct()


def lookups(keys: DataFrame, cache: DataFrame, now: str, ttl_seconds: int, offline: bool = True) -> DataFrame:
    """keys with their latest cache row up to ``now`` and the state that follows from its age.

    cache: ecosystem, name, version, fetched_at, status. Only the latest row of a key is joined: the as-of step is one
    aggregation before the join.
    """
    on = ["ecosystem", "name", "version"]
    at = F.lit(now).cast("timestamp")
    latest = cache.where(F.col("fetched_at") <= at).groupBy(*on).agg(F.max(F.struct("fetched_at", "status")).alias("c"))
    age = F.unix_seconds(at) - F.unix_seconds(F.col("c.fetched_at"))
    stale = age > ttl_seconds
    state = F.when(F.col("c").isNull(), "OFFLINE_NO_CACHE" if offline else "PENDING").when(stale & F.lit(not offline), "PENDING").when(stale, F.concat(F.lit("STALE_"), F.col("c.status"))).otherwise(F.col("c.status"))
    return keys.join(latest, on, "left").select(*on, state.alias("state"), age.alias("age_seconds"))


def batches(keys: DataFrame, size: int = 50) -> DataFrame:
    """keys with the number of the request that asks for them: sorted, ``size`` in each."""
    ordered = keys.withColumn("__key", F.concat_ws("\u0001", "ecosystem", "name", "version"))
    numbered = running_total(ordered, ["__key"], F.lit(1), "__n")
    return numbered.select("ecosystem", "name", "version", F.floor((F.col("__n") - 1) / size).cast("long").alias("batch"))


# Shapes of advisory ids and score vectors.
ADVISORY_ID, CVSS_VECTOR = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$", r"^CVSS:[0-9.]+/[A-Za-z0-9:/._-]{1,190}$"
PROVIDER = {"batch_size": 50, "batch_requests": 10, "detail_requests": 50, "total_requests": 60, "advisories": 100}


def advisory_severity(severity: Column) -> Column:
    """A database's own severity; MEDIUM where it has none of the five."""
    s = F.upper(severity)
    return F.when(s.isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), s).otherwise("MEDIUM")


def cvss_vector(scores: Column) -> Column:
    """The first valid vector among the first eight scores (type, score)."""
    return F.get(F.transform(F.filter(F.slice(scores, 1, 8), lambda x: x["type"].startswith("CVSS_") & x["score"].rlike(CVSS_VECTOR) & (F.length(x["score"]) <= 200)), lambda x: x["score"]), F.lit(0))


def safe_reference(url: Column) -> Column:
    """An http(s) address with a host and no user, query or fragment, of at most 500 characters; null for others."""
    return F.when(url.rlike(r"^https?://[^/?#@\s]+(/[^?#\s]*)?$") & (F.length(url) <= 500) & (redact_path(url) == url), url)


def lookup_faults(results: DataFrame) -> DataFrame:
    """results with fault: why a provider's answer is not used, null where it is sound.

    results: status, incomplete, vulnerabilities (array of id, withdrawn, severity, summary, aliases, fixed, references, cvss).
    """
    v = F.col("vulnerabilities")
    some = lambda test: F.exists(v, lambda x: F.coalesce(test(x), F.lit(True)))
    odd_id = lambda i: ~i.rlike(ADVISORY_ID) | (redact_path(i) != i)
    fault = (
        F.when(F.col("status").isNull() | F.col("incomplete").isNull() | (F.size(v) > PROVIDER["advisories"]), "LOOKUP_SHAPE_INVALID")
        .when(~F.col("status").isin("MATCHED", "NO_MATCH") & (F.size(v) > 0), "LOOKUP_STATUS_INVALID").when(~F.col("status").isin("MATCHED", "NO_MATCH"), None)
        .when((F.col("status") == "NO_MATCH") & F.col("incomplete"), "INCOMPLETE_NO_MATCH").when((F.size(v) > 0) != (F.col("status") == "MATCHED"), "LOOKUP_STATUS_MISMATCH")
        .when(some(lambda x: x["withdrawn"]), "VULNERABILITY_INVALID").when(some(lambda x: odd_id(x["id"])), "ADVISORY_ID_INVALID")
        .when(some(lambda x: ~x["severity"].isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")), "SEVERITY_INVALID").when(some(lambda x: (F.length(x["summary"]) > 300) | (redact_path(x["summary"]) != x["summary"])), "SUMMARY_INVALID")
        .when(some(lambda x: (F.size(x["aliases"]) > 100) | F.exists(x["aliases"], odd_id)), "ALIASES_INVALID").when(some(lambda x: (F.size(x["fixed"]) > 40) | F.exists(x["fixed"], lambda f: ~safe_exact_version(f))), "FIXED_VERSION_INVALID")
        .when(some(lambda x: (F.size(x["references"]) > 20) | F.exists(x["references"], lambda r: safe_reference(r).isNull())), "REFERENCES_INVALID")
        .when(F.exists(v, lambda x: F.coalesce(~x["cvss"].rlike(CVSS_VECTOR), F.lit(False))), "CVSS_VECTOR_INVALID")
    )
    return results.withColumn("fault", fault)


def capped_advisories(answers: DataFrame, keys: list[str], most: int = 100) -> DataFrame:
    """answers (keys, position, advisory_id) with accepted: each key's distinct ids in order, and of all ids of a batch the
    first ``most`` distinct ones by the batch's order; others are told as truncated, not dropped.

    The order of ids in a batch is that of their first key and position: ranks of first places, no loop over rows.
    """
    once = answers.groupBy("batch", *keys, "advisory_id").agg(F.min("position").alias("position"))
    first = once.groupBy("batch", "advisory_id").agg(F.min(F.struct(*keys, "position")).alias("place"))
    known = first.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy("place")))
    return once.join(known.select("batch", "advisory_id", "rank"), ["batch", "advisory_id"]).select("batch", *keys, "advisory_id", "position", (F.col("rank") <= most).alias("accepted"))


def detail_requests(accepted: DataFrame, fetched: DataFrame, most: int = 50) -> DataFrame:
    """advisory_id, state of the ids to be fetched: REUSED if known already, FETCHED up to the budget by id, then BUDGET."""
    ids = accepted.select("advisory_id").distinct()
    reused = ids.join(fetched.select("advisory_id").distinct(), "advisory_id", "left_semi").select("advisory_id", F.lit("REUSED").alias("state"))
    fresh = ids.join(fetched.select("advisory_id").distinct(), "advisory_id", "left_anti")
    numbered = running_total(fresh, ["advisory_id"], F.lit(1), "n")
    return reused.unionAll(numbered.select("advisory_id", F.when(F.col("n") <= most, "FETCHED").otherwise("BUDGET").alias("state")))


def provider_budget(n_keys: int, n_details: int, limits: dict[str, int] = PROVIDER) -> dict[str, int | bool]:
    """Requests used and allowed of each kind, and whether a budget was reached."""
    p = PROVIDER | limits
    batches = -(-n_keys // p["batch_size"])
    used_b = min(batches, p["batch_requests"], p["total_requests"])
    used_d = min(n_details, p["detail_requests"], p["total_requests"] - used_b)
    return {"batch_requests_used": used_b, "batch_requests_limit": p["batch_requests"], "detail_requests_used": used_d, "detail_requests_limit": p["detail_requests"], "total_requests_used": used_b + used_d, "total_requests_limit": p["total_requests"], "provider_budget_reached": used_b < batches or used_d < n_details}


def merged_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new complete answers in the place of old rows of their keys; other answers are not kept."""
    on = ["ecosystem", "name", "version"]
    new = answers.where("status IN ('MATCHED', 'NO_MATCH') AND NOT incomplete").drop("incomplete")
    return cache.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def first_party(records: DataFrame, projects: DataFrame) -> DataFrame:
    """records with first_party: the one entry of the root lock that has the root project's name and is that folder itself.

    records: path, name, editable (the entry's source is the root folder); projects: repo, name of the root manifest.
    Several entries of that name prove nothing.
    """
    n = F.count("*").over(Window.partitionBy("repo", "path", "name"))
    told = records.withColumn("__n", n).join(projects.select("repo", F.col("name").alias("__project")), "repo", "left")
    proof = (F.col("path") == "uv.lock") & (F.col("name") == F.col("__project")) & F.col("editable") & (F.col("__n") == 1)
    return told.withColumn("first_party", F.coalesce(proof, F.lit(False))).drop("__n", "__project")


def fixed_versions(affected: Column) -> Column:
    """Sorted distinct fixed versions of affected ranges' events, 40 at most (the reference's own limit of a report)."""
    events = F.flatten(F.flatten(F.transform(affected, lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull()))), 1, 40)


def normalized_advisories(raw: DataFrame) -> DataFrame:
    """advisory_id, ecosystem, name, version, severity, cve, fixed: advisories not withdrawn, one row for each version.

    raw: advisory_id and json as a provider answers.
    """
    schema = "struct<id:string,withdrawn:string,aliases:array<string>,database_specific:struct<severity:string>,severity:array<struct<type:string,score:string>>,affected:array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>>"
    a = raw.select("advisory_id", F.from_json("json", schema).alias("j")).where("j.withdrawn IS NULL")
    rows = a.select("advisory_id", advisory_severity(F.col("j.database_specific.severity")).alias("severity"), F.array_join(F.array_sort(F.filter(F.coalesce("j.aliases", F.array().cast("array<string>")), lambda x: x.startswith("CVE-"))), ",").alias("cve"), F.array_join(fixed_versions(F.col("j.affected")), ",").alias("fixed"), F.explode("j.affected").alias("p"))
    return rows.select("advisory_id", "severity", "cve", "fixed", F.col("p.package.ecosystem").alias("ecosystem"), normal_name(F.col("p.package.ecosystem"), F.col("p.package.name")).alias("name"), F.explode("p.versions").alias("version")).distinct()


def findings(records: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding for each package version and advisory: projects joined, direct if any is, confidence by the lock."""
    keys = ["ecosystem", "name", "version"]
    merged = records.where(safe_exact_version(F.col("version"))).join(advisories, keys).groupBy(*keys, "advisory_id", "severity", "fixed").agg(
        F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"), F.bool_or(F.col("directness") == "DIRECT").alias("direct"), F.bool_or("resolved").alias("resolved"))
    mark = fingerprint("dependency-v1", "DEPENDENCY.KNOWN_VULNERABILITY", F.col("ecosystem"), F.col("name"), F.col("version"), F.col("advisory_id"))
    return merged.select(mark.alias("fingerprint"), *keys, "advisory_id", "severity", F.when(F.col("resolved"), "HIGH").otherwise("MEDIUM").alias("confidence"), "direct", "fixed", "projects")


def metrics(records: DataFrame, looked_up: DataFrame) -> DataFrame:
    """One row of counters over records and lookups; the cache's youngest and oldest age."""
    r = records.agg(F.count("*").alias("n_records"), F.count_if("resolved").alias("n_resolved"), F.count_if(F.col("directness") == "DIRECT").alias("n_direct"), F.count_if(F.col("directness") == "TRANSITIVE").alias("n_transitive"), F.count_if(F.col("directness") == "UNKNOWN").alias("n_unknown"), F.countDistinct("project").alias("n_projects"))
    s = looked_up.agg(F.count("*").alias("n_keys"), F.count_if(F.col("state").endswith("NO_CACHE")).alias("n_no_data"), F.count_if(F.col("state").startswith("STALE")).alias("n_stale"), F.min("age_seconds").alias("min_age"), F.max("age_seconds").alias("max_age"))
    return r.join(F.broadcast(s))  # one row each


def full_metrics(records: DataFrame, looked_up: DataFrame, found: DataFrame, requests: dict, caps: dict, ttl_seconds: int = 86400) -> DataFrame:
    """One row of all counters: records (version, identity), lookups (state, age_seconds), findings, requests and caps."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    hit = ~F.col("state").isin("OFFLINE_NO_CACHE", "PENDING", "NO_DATA", "QUERY_FAILED")
    r = records.agg(F.count("*").alias("dependencies_discovered"), F.count_if(F.col("version").isNotNull()).alias("exact_dependencies"), F.count_if(F.col("identity") == "FIRST_PARTY_ROOT").alias("first_party_roots"),
                    F.count_if(F.col("version").isNull() & (F.col("identity") != "FIRST_PARTY_ROOT")).alias("unresolved_dependencies"))
    s = looked_up.agg(F.count("*").alias("unique_package_versions"), F.count_if(hit).alias("cache_hits"), F.count_if(F.col("state").startswith("STALE")).alias("stale_cache_hits"), F.count_if(F.col("state") == "PENDING").alias("provider_queries"),
                      zero(F.max(F.when(hit, F.col("age_seconds")))).alias("oldest_cache_age_seconds"), zero(F.min(F.when(hit, F.col("age_seconds")))).alias("newest_cache_age_seconds"), F.count_if(~hit).alias("no_data"))
    f = found.agg(F.count("*").alias("vulnerability_matches"))
    fixed = {**requests, **caps, "cache_ttl_seconds": ttl_seconds}
    row = r.join(F.broadcast(s)).join(F.broadcast(f))  # one row each
    return row.select("*", *(F.lit(v if isinstance(v, bool) else int(v)).cast("boolean" if isinstance(v, bool) else "long").alias(k) for k, v in fixed.items()))


def include_loops(edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """path of manifests that include themselves over at most ``max_depth`` steps: a join a step, each written."""
    start = stored(edges.select("path", "target").where("target IS NOT NULL").distinct(), "includes")
    walk, looped = start, start.where("path = target").select("path")
    for _ in range(max_depth - 1):
        nexts = start.select(F.col("path").alias("target"), F.col("target").alias("__next"))
        walk = stored(walk.where("path <> target").join(nexts, "target").select("path", F.col("__next").alias("target")).distinct(), "includes")
        if walk.isEmpty():
            break
        looped = looped.unionAll(walk.where("path = target").select("path"))
    return looped.distinct()


def included(files: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 8) -> DataFrame:
    """path, depth of all manifests that roots include, over at most ``max_depth`` steps; a path counts once, at its least depth.

    edges: path, target. Each step is one join with the paths that the last one reached for the first time, written before the next.
    """
    seen = reached = stored(roots.join(files, "path", "left_semi").select("path", F.lit(0).cast("long").alias("depth")), "included")
    for depth in range(1, max_depth + 1):
        step = reached.join(edges, "path").select(F.col("target").alias("path")).distinct()
        reached = stored(step.join(files, "path", "left_semi").join(seen, "path", "left_anti").select("path", F.lit(depth).cast("long").alias("depth")), "included")
        if reached.isEmpty():
            break
        seen = seen.unionAll(reached)
    return seen
