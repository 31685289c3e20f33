"""Queries of package inventories over orders, lines and parts as projects, records and advisories, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from harborscan.functions.exprs import fingerprint_sql
from harborscan.operators import dependencies as deps, includes, lookups
from harborscan.sources.corpora import table

QUERIES, SQL = {}, {}
NOW, TTL = "1998-01-01 00:00:00", 86400 * 365


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    eco = F.get(F.array(*map(F.lit, ("PyPI", "npm", "crates.io", "Go"))), (F.col("l_linenumber") % 4).cast("int"))
    s = F.col("l_suppkey")
    version = F.concat_ws(".", (s % 4).cast("string"), (s % 3).cast("string"), F.lit("0"))
    group = F.when(F.col("l_returnflag") == "R", "dev").when(F.col("l_returnflag") == "A", "optional").otherwise("UNKNOWN")
    direct = F.when(F.col("l_quantity") < 15, "TRANSITIVE").when(F.col("l_quantity") < 30, "UNKNOWN").otherwise("DIRECT")
    resolved = F.col("l_linestatus") == "F"
    return li.select(
        F.concat(F.lit("p"), (F.col("l_orderkey") % 97).cast("string")).alias("project"), eco.alias("ecosystem"), deps.normal_name(eco, F.concat(F.lit("Pkg_."), (F.col("l_partkey") % 500).cast("string"))).alias("name"),
        version.alias("version"), resolved.alias("resolved"), direct.alias("directness"), group.alias("dep_group"), F.when(~resolved & (s % 2 == 0), F.concat(F.lit(">="), (s % 4).cast("string"))).alias("constraint"))


RECORDS_SQL = """raw AS (SELECT 'p' || (l_orderkey % 97) AS project, ['PyPI', 'npm', 'crates.io', 'Go'][1 + l_linenumber % 4] AS ecosystem, l_partkey % 500 AS k, l_suppkey AS s, l_linestatus = 'F' AS resolved,
    CASE WHEN l_quantity < 15 THEN 'TRANSITIVE' WHEN l_quantity < 30 THEN 'UNKNOWN' ELSE 'DIRECT' END AS directness, CASE l_returnflag WHEN 'R' THEN 'dev' WHEN 'A' THEN 'optional' ELSE 'UNKNOWN' END AS dep_group FROM lineitem),
records AS (SELECT project, ecosystem, CASE ecosystem WHEN 'PyPI' THEN 'pkg-' || k WHEN 'Go' THEN 'Pkg_.' || k ELSE 'pkg_.' || k END AS name, (s % 4) || '.' || (s % 3) || '.0' AS version, resolved, directness, dep_group,
    CASE WHEN NOT resolved AND s % 2 = 0 THEN '>=' || (s % 4) END AS "constraint" FROM raw),
once AS (SELECT ecosystem, name, version, project, resolved, m.* FROM (SELECT ecosystem, name, version, project, resolved,
    first({'directness': directness, 'dep_group': dep_group, 'constraint': "constraint"} ORDER BY directness, dep_group, "constraint" NULLS FIRST) AS m FROM records GROUP BY ALL)),
said AS (SELECT ecosystem, name, project, first(dep_group ORDER BY version, dep_group) FILTER (WHERE dep_group <> 'UNKNOWN') AS g, first("constraint" ORDER BY version, "constraint") FILTER (WHERE "constraint" IS NOT NULL) AS c FROM once WHERE NOT resolved GROUP BY ALL),
inventory AS (SELECT o.ecosystem, o.name, o.version, o.project, resolved, CASE WHEN s.project IS NOT NULL AND directness <> 'TRANSITIVE' THEN 'DIRECT' ELSE directness END AS directness, coalesce(g, dep_group) AS dep_group, coalesce(c, "constraint") AS "constraint"
    FROM once o LEFT JOIN said s USING (ecosystem, name, project) WHERE resolved
  UNION ALL SELECT ecosystem, name, version, project, resolved, directness, dep_group, "constraint" FROM once o WHERE NOT resolved AND NOT EXISTS (SELECT 1 FROM once x WHERE x.resolved AND x.ecosystem = o.ecosystem AND x.name = o.name AND x.project = o.project)),
keys AS (SELECT DISTINCT ecosystem, name, version FROM inventory)"""


def inventory(spark, sf_dir):
    return deps.reconciled(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT * FROM inventory")
def dependency_reconcile(spark, sf_dir):
    return inventory(spark, sf_dir)


@query(f"WITH {RECORDS_SQL} SELECT * FROM keys")
def dependency_exact_keys(spark, sf_dir):
    return deps.exact_keys(inventory(spark, sf_dir))


def cache(spark, sf_dir):
    """An advisory cache from orders: one fetch of a package version for each order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    eco = F.get(F.array(*map(F.lit, ("PyPI", "npm", "crates.io", "Go"))), (F.col("o_orderkey") % 4).cast("int"))
    version = F.concat_ws(".", (k % 4).cast("string"), (F.col("o_orderkey") % 3).cast("string"), F.lit("0"))
    name = deps.normal_name(eco, F.concat(F.lit("Pkg_."), (F.col("o_orderkey") % 500).cast("string")))
    return o.select(eco.alias("ecosystem"), name.alias("name"), version.alias("version"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.when(F.col("o_orderstatus") == "F", "MATCHED").otherwise("NO_MATCH").alias("status"))


_CACHE_SQL = f"""cache AS (SELECT ecosystem, CASE ecosystem WHEN 'PyPI' THEN 'pkg-' || k WHEN 'Go' THEN 'Pkg_.' || k ELSE 'pkg_.' || k END AS name, version, fetched_at, status FROM (
  SELECT ['PyPI', 'npm', 'crates.io', 'Go'][1 + o_orderkey % 4] AS ecosystem, o_orderkey % 500 AS k, (o_custkey % 4) || '.' || (o_orderkey % 3) || '.0' AS version, o_orderdate AS fetched_at, CASE WHEN o_orderstatus = 'F' THEN 'MATCHED' ELSE 'NO_MATCH' END AS status FROM orders)),
latest AS (SELECT ecosystem, name, version, max({{'f': fetched_at, 's': status}}) AS c FROM cache WHERE fetched_at <= TIMESTAMP '{NOW}' GROUP BY ALL),
looked AS (SELECT ecosystem, name, version, c, (epoch(TIMESTAMP '{NOW}') - epoch(c.f))::BIGINT AS age_seconds FROM keys LEFT JOIN latest USING (ecosystem, name, version)),
lookups AS (SELECT ecosystem, name, version, CASE WHEN c IS NULL THEN 'OFFLINE_NO_CACHE' WHEN age_seconds > {TTL} THEN 'STALE_' || c.s ELSE c.s END AS state, age_seconds FROM looked)"""


def _lookups(spark, sf_dir):
    return deps.lookups(deps.exact_keys(inventory(spark, sf_dir)), cache(spark, sf_dir), NOW, TTL)


@query(f"WITH {RECORDS_SQL}, {_CACHE_SQL} SELECT * FROM lookups")
def dependency_lookup_asof(spark, sf_dir):
    return _lookups(spark, sf_dir)


@query(f"WITH {RECORDS_SQL} SELECT ecosystem, name, version, ((row_number() OVER (ORDER BY ecosystem || chr(1) || name || chr(1) || version) - 1) // 50)::BIGINT AS batch FROM keys")
def dependency_batches(spark, sf_dir):
    return deps.batches(deps.exact_keys(inventory(spark, sf_dir)))


def raw_advisories(spark, sf_dir):
    """A provider's answers from part: JSON for every seventh size, some withdrawn."""
    p = table(spark, sf_dir, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    eco = F.get(F.array(*map(F.lit, ("PyPI", "npm", "crates.io", "Go"))), (k % 4).cast("int"))
    severity = F.get(F.array(*map(F.lit, ("critical", "HIGH", "moderate", "low", "odd"))), (z % 5).cast("int"))
    json = F.concat(
        F.lit('{"id":"ADV-'), k.cast("string"), F.lit('",'), F.when(z % 11 == 0, F.lit('"withdrawn":"2020-01-01T00:00:00Z",')).otherwise(F.lit("")), F.lit('"aliases":["GHSA-x","CVE-2020-'), k.cast("string"), F.lit('"],"database_specific":{"severity":"'), severity,
        F.lit('"},"affected":[{"package":{"ecosystem":"'), eco, F.lit('","name":"Pkg_.'), (k % 500).cast("string"), F.lit('"},"versions":["'), (z % 4).cast("string"), F.lit('.0.0","'), (z % 4).cast("string"), F.lit('.1.0"],"ranges":[{"events":[{"introduced":"0"},{"fixed":"'), (z % 4 + 1).cast("string"), F.lit('.0.0"}]}]}]}'))
    return p.where(z % 7 == 0).select(F.concat(F.lit("ADV-"), k.cast("string")).alias("advisory_id"), json.alias("json"))


_ADVISORIES_SQL = """adv AS (SELECT 'ADV-' || p_partkey AS advisory_id, CASE p_size % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 3 THEN 'LOW' ELSE 'MEDIUM' END AS severity, 'CVE-2020-' || p_partkey AS cve, (p_size % 4 + 1) || '.0.0' AS fixed,
    ['PyPI', 'npm', 'crates.io', 'Go'][1 + p_partkey % 4] AS ecosystem, p_partkey % 500 AS k, unnest([(p_size % 4) || '.0.0', (p_size % 4) || '.1.0']) AS version FROM part WHERE p_size % 7 = 0 AND p_size % 11 <> 0),
advisories AS (SELECT DISTINCT advisory_id, severity, cve, fixed, ecosystem, CASE ecosystem WHEN 'PyPI' THEN 'pkg-' || k WHEN 'Go' THEN 'Pkg_.' || k ELSE 'pkg_.' || k END AS name, version FROM adv)"""


@query(f"WITH {_ADVISORIES_SQL} SELECT * FROM advisories")
def advisory_normalize(spark, sf_dir):
    return deps.normalized_advisories(raw_advisories(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL}, {_ADVISORIES_SQL}, j AS (SELECT i.ecosystem, i.name, i.version, advisory_id, severity, fixed, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, bool_or(directness = 'DIRECT') AS direct, bool_or(resolved) AS resolved
  FROM inventory i JOIN advisories a ON i.ecosystem = a.ecosystem AND i.name = a.name AND i.version = a.version GROUP BY ALL)
SELECT {fingerprint_sql("'dependency-v1'", "'DEPENDENCY.KNOWN_VULNERABILITY'", "ecosystem", "name", "version", "advisory_id")} AS fingerprint, ecosystem, name, version, advisory_id, severity, CASE WHEN resolved THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, direct, fixed, projects FROM j""")
def dependency_findings(spark, sf_dir):
    return deps.findings(inventory(spark, sf_dir), deps.normalized_advisories(raw_advisories(spark, sf_dir)))


@query(f"""WITH {RECORDS_SQL}, {_CACHE_SQL}, r AS (SELECT count(*) AS n_records, count(*) FILTER (WHERE resolved) AS n_resolved, count(*) FILTER (WHERE directness = 'DIRECT') AS n_direct, count(*) FILTER (WHERE directness = 'TRANSITIVE') AS n_transitive,
  count(*) FILTER (WHERE directness = 'UNKNOWN') AS n_unknown, count(DISTINCT project) AS n_projects FROM inventory),
s AS (SELECT count(*) AS n_keys, count(*) FILTER (WHERE state LIKE '%NO_CACHE') AS n_no_data, count(*) FILTER (WHERE state LIKE 'STALE%') AS n_stale, min(age_seconds) AS min_age, max(age_seconds) AS max_age FROM lookups) SELECT * FROM r, s""")
def dependency_metrics(spark, sf_dir):
    return deps.metrics(inventory(spark, sf_dir), _lookups(spark, sf_dir))


@query("""SELECT p_partkey, CASE WHEN spec IS NULL OR spec = '' THEN 'UNRESOLVED' WHEN spec LIKE 'git+%' THEN 'VCS' WHEN spec LIKE 'file:%' THEN 'LOCAL_PATH' WHEN spec LIKE 'https:%' THEN 'URL' WHEN spec LIKE '==%' THEN 'EXACT' ELSE 'CONSTRAINT' END AS kind
FROM (SELECT p_partkey, [NULL, '==1.' || p_size, '>=1.0,<2', 'git+https://h/r', 'file:../x', 'https://h/x.whl', '==1.*'][1 + p_partkey % 7] AS spec FROM part)""".replace("WHEN spec LIKE '==%' THEN 'EXACT'", "WHEN spec LIKE '==%' AND spec NOT LIKE '%*' THEN 'EXACT'"))
def dependency_version_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    spec = F.get(F.array(F.lit(None).cast("string"), F.concat(F.lit("==1."), F.col("p_size").cast("string")), F.lit(">=1.0,<2"), F.lit("git+https://h/r"), F.lit("file:../x"), F.lit("https://h/x.whl"), F.lit("==1.*")), (F.col("p_partkey") % 7).cast("int"))
    return p.select("p_partkey", deps.version_kind(F.lit("PyPI"), spec).alias("kind"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS path, unnest([c_custkey * 2, c_custkey * 3 + 1]) AS target FROM customer), f AS (SELECT c_custkey AS path FROM customer WHERE c_custkey % 13 <> 0),
r(path, depth) AS (SELECT path, 0 FROM f WHERE path % 50 = 1 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.path = r.path JOIN f ON f.path = e.target WHERE r.depth < 8)
SELECT 'req/' || path || '.txt' AS path, min(depth)::BIGINT AS depth FROM r GROUP BY ALL""")
def dependency_include_graph(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit("req/"), x.cast("string"), F.lit(".txt"))
    k = F.col("c_custkey")
    files = c.where(k % 13 != 0).select(name(k).alias("path"))
    edges = c.select(name(k).alias("path"), F.explode(F.array(name(k * 2), name(k * 3 + 1))).alias("target"))
    return deps.included(files, edges, c.where(k % 50 == 1).select(name(k).alias("path")))


# Manifests of customers: a large urgent order includes the manifest of the next one of its nation and segment.

_INCLUDES_SQL = """m AS (SELECT c_nationkey, c_mktsegment, 'req/' || c_custkey || '.txt' AS path, o_orderkey, o_orderdate, o_orderstatus = 'F' AS constraint_only FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000),
e AS (SELECT path, lead(path) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY o_orderdate, o_orderkey) AS target, constraint_only FROM m)"""


def _include_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 150000")
    m = o.join(table(spark, sf_dir, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))  # millions of rows in few bytes
    path = F.concat(F.lit("req/"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    follow = F.lead(path).over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("o_orderdate", "o_orderkey"))
    return m.select(path.alias("path"), follow.alias("target"), (F.col("o_orderstatus") == "F").alias("constraint_only"))


@query(f"""WITH RECURSIVE {_INCLUDES_SQL}, d AS (SELECT DISTINCT path, target FROM e WHERE target IS NOT NULL), r AS (SELECT path, target FROM d UNION SELECT r.path, d.target FROM r JOIN d ON d.path = r.target),
c AS (SELECT x.path, x.target FROM r x JOIN r y ON x.path = y.target AND x.target = y.path) SELECT path, min(target) AS cycle, count(*) AS n_files FROM c GROUP BY path""")
def manifest_include_cycles(spark, sf_dir):
    """Every manifest that includes itself over any number of steps, with its cycle's name and size."""
    return includes.cycles(_include_lines(spark, sf_dir))


@query(f"""WITH RECURSIVE {_INCLUDES_SQL}, f AS (SELECT 'req/' || c_custkey || '.txt' AS path, c_acctbal FROM customer WHERE c_acctbal > -500),
r(path, constraint_only) AS (SELECT path, false FROM f WHERE c_acctbal > 5000 UNION SELECT e.target, r.constraint_only OR e.constraint_only FROM r JOIN e USING (path) JOIN f ON f.path = e.target),
s AS (SELECT DISTINCT path, constraint_only FROM r), v AS (SELECT 'req/' || o_custkey || '.txt' AS path, 'pkg' || o_orderkey AS name, CASE WHEN o_orderstatus = 'O' THEN '1.' || o_custkey END AS version, CASE WHEN o_orderstatus = 'P' THEN '>=2' END AS declared FROM orders)
SELECT path, name, CASE WHEN NOT constraint_only THEN version END AS version, CASE WHEN constraint_only OR version IS NULL THEN 'CONSTRAINT' ELSE 'EXACT' END AS version_kind, CASE WHEN constraint_only THEN 'UNKNOWN' ELSE 'DIRECT' END AS directness,
  CASE WHEN constraint_only THEN coalesce('==' || version, declared) ELSE declared END AS "constraint", constraint_only FROM v JOIN s USING (path)""")
def dependency_constraint_files(spark, sf_dir):
    """Records of all manifests reached from the roots over any number of steps: pins of constraints files become constraints."""
    c, o = table(spark, sf_dir, "customer").where("c_acctbal > -500"), table(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("req/"), F.col(k).cast("string"), F.lit(".txt")).alias("path")
    states = includes.reachable(c.select(name("c_custkey")), _include_lines(spark, sf_dir), c.where("c_acctbal > 5000").select(name("c_custkey")))
    pinned = F.col("o_orderstatus") == "O"
    records = o.select(
        name("o_custkey"), F.concat(F.lit("pkg"), F.col("o_orderkey").cast("string")).alias("name"), F.when(pinned, F.concat(F.lit("1."), F.col("o_custkey").cast("string"))).alias("version"),
        F.when(pinned, "EXACT").otherwise("CONSTRAINT").alias("version_kind"), F.lit("DIRECT").alias("directness"), F.when(F.col("o_orderstatus") == "P", ">=2").alias("constraint"))
    return includes.as_read(records, states)


# Lookups in stages: keys and answers of the parts. Parts of one brand share advisories; some answers are errors.

_ONLINE_NOW = "2024-01-03 00:00:00"
_ONLINE = {"batch_size": 20, "batch_requests": 8, "detail_requests": 45, "total_requests": 50}


def _online(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n = k.cast("string")
    key = [F.get(F.array(*map(F.lit, ["PyPI", "npm", "crates.io", "Go", "Maven"])), (k % 5).cast("int")).alias("ecosystem"), F.concat(F.lit("pkg"), n).alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version")]
    keys = p.select(*key)
    status = F.when(F.col("p_size") % 2 == 0, "MATCHED").otherwise("NO_MATCH")
    cache = p.where(k % 3 == 0).select(*key, F.timestamp_seconds(F.unix_seconds(F.lit(_ONLINE_NOW).cast("timestamp")) - F.col("p_size") * 3600).alias("fetched_at"), status.alias("status"))
    brand = F.regexp_replace("p_brand", "[^0-9]", "")
    ids = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 4).cast("int") + 1), lambda i: F.concat(F.lit("ADV-"), brand, F.lit("-"), (i - 1).cast("string")))
    answers = p.where(k % 7 != 0).select(*key, F.slice(ids, F.lit(2), F.size(ids) - 1).alias("advisory_ids"), (F.md5(n) < "02").alias("error"))
    return lookups.staged(keys, cache, _ONLINE_NOW, 86400), answers, cache


_ONLINE_SQL = f"""k AS (SELECT ['PyPI', 'npm', 'crates.io', 'Go', 'Maven'][1 + p_partkey % 5] AS ecosystem, 'pkg' || p_partkey AS name, '1.' || p_size AS version, p_partkey, p_size, regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand FROM part),
st AS (SELECT *, CASE WHEN ecosystem = 'Maven' THEN 'UNSUPPORTED_ECOSYSTEM' WHEN p_partkey % 3 = 0 AND p_size <= 24 THEN CASE WHEN p_size % 2 = 0 THEN 'MATCHED' ELSE 'NO_MATCH' END ELSE 'PENDING' END AS first FROM k),
pe AS (SELECT *, (row_number() OVER (ORDER BY ecosystem || chr(1) || name || chr(1) || version) - 1) // {_ONLINE["batch_size"]} AS batch, p_partkey % 7 <> 0 AND md5(p_partkey::VARCHAR) < '02' AS error, CASE WHEN p_partkey % 7 <> 0 THEN list_transform(range(1, p_size % 4 + 1), lambda i: 'ADV-' || brand || '-' || i) ELSE [] END AS ids FROM st WHERE first = 'PENDING'),
fb AS (SELECT batch, bool_or(error) AS failed FROM pe WHERE batch < {_ONLINE["batch_requests"]} GROUP BY batch),
ids AS (SELECT id, min(batch) AS batch FROM (SELECT unnest(ids) AS id, batch FROM pe JOIN fb USING (batch) WHERE NOT failed) GROUP BY id),
w AS (SELECT fb.batch, failed, count(id) AS wanted FROM fb LEFT JOIN ids USING (batch) GROUP BY ALL),
u AS (SELECT *, coalesce(sum(wanted) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w),
l AS (SELECT *, least({_ONLINE["detail_requests"]} - used, {_ONLINE["total_requests"]} - batch - 1 - used) AS room FROM u),
s AS (SELECT *, (SELECT min(batch) FROM l WHERE room < wanted) AS stop FROM l), b AS (SELECT * FROM s WHERE stop IS NULL OR batch < stop OR (batch = stop AND room >= 0)),
got AS (SELECT id FROM (SELECT id, batch, room, row_number() OVER (PARTITION BY batch ORDER BY id) AS n FROM ids JOIN b USING (batch)) WHERE n <= room),
r AS (SELECT ecosystem, name, version, pe.batch, ids, failed, list_sort(list_filter(ids, lambda x: list_contains(g, x))) AS kept FROM pe LEFT JOIN b USING (batch), (SELECT coalesce(list(id), []) AS g FROM got))"""


@query(f"""WITH {_ONLINE_SQL} SELECT ecosystem, name, version, NULL::BIGINT AS batch, first AS state, false AS incomplete, '' AS advisory_ids FROM st WHERE first <> 'PENDING'
UNION ALL SELECT ecosystem, name, version, batch, CASE WHEN failed IS NULL THEN 'NO_DATA' WHEN failed THEN 'QUERY_FAILED' WHEN len(ids) > 0 THEN 'MATCHED' ELSE 'NO_MATCH' END, NOT coalesce(failed, true) AND len(kept) < len(ids), CASE WHEN failed IS NULL OR failed THEN '' ELSE array_to_string(kept, ',') END FROM r""")
def dependency_online_lookup(spark, sf_dir):
    """Every key's state after an online lookup within budgets; answers that were cut stay, marked incomplete."""
    first, answers, _ = _online(spark, sf_dir)
    return lookups.answered(first, answers, **_ONLINE).withColumn("advisory_ids", F.array_join("advisory_ids", ","))


@query(f"""WITH {_ONLINE_SQL} SELECT count(*) AS batch_requests_used, (SELECT count(*) FROM got) AS detail_requests_used, count(*) + (SELECT count(*) FROM got) AS total_requests_used, coalesce(bool_or(stop IS NOT NULL), false) OR (SELECT coalesce(bool_or(failed IS NULL), false) FROM r) AS provider_budget_reached FROM b""")
def dependency_online_requests(spark, sf_dir):
    first, answers, _ = _online(spark, sf_dir)
    return lookups.requests(first, answers, **_ONLINE)
