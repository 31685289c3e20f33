"""Queries of lock files, record safety, provider answers, patches, reviews and what others plug in, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborscan.operators import behavior_rules, correlation, dependencies as deps, manifests, registry, remediation, secret_rules
from harborscan.plans import dependency_queries, scan_queries
from harborscan.plans.dependency_queries import _CACHE_SQL, RECORDS_SQL
from harborscan.plans.scan_queries import _sid, CODE_LINES_SQL, FINDINGS_SQL
from harborscan.sources import corpora
from harborscan.sources.corpora import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _pick(names, k):
    return F.get(F.array(*(F.lit(n) for n in names)), k.cast("int"))


_LIST = lambda names: "[" + ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in names) + "]"


def _suppliers(spark, sf_dir, folder, text):
    """path, text of a file for each supplier; text has {k} and {v} for its key and nation."""
    s = table(spark, sf_dir, "supplier")
    k, v = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    name = folder.rpartition("/")
    return s.select(F.concat(F.lit(f"{name[0]}/"), k, F.lit(f"/{name[2]}")).alias("path"), F.replace(F.replace(F.lit(text), F.lit("{k}"), k), F.lit("{v}"), v).alias("text"))


@query("""SELECT 'py/' || s_suppkey || '/Pipfile.lock' AS path, unnest(['flask', 'own', 'repo', 'star', 'pytest']) AS name, unnest(['==2.' || s_nationkey, 'file:', 'git+', '*', '==8.0']) AS spec,
  unnest(['RUNTIME', 'RUNTIME', 'RUNTIME', 'RUNTIME', 'DEV']) AS dep_group, unnest([true, false, false, false, true]) AS resolved FROM supplier""")
def manifest_pipfile_lock(spark, sf_dir):
    text = '{"_meta":{},"default":{"flask":{"version":"==2.{v}"},"own":{"path":"."},"repo":{"git":"https://h/r","version":"==1"},"star":{"version":"*"}},"develop":{"pytest":{"version":"==8.0","hashes":["a"]}}}'
    return manifests.pipfile_lock(_suppliers(spark, sf_dir, "py/Pipfile.lock", text)).select("path", "name", "spec", "dep_group", "resolved")


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier)
SELECT 'py/' || k || '/pyproject.toml' AS path, unnest(['flask', 'rich', 'own', 'web']) AS name, unnest(['^2.' || v, '>=13', 'file:', 'git+']) AS spec, false AS resolved FROM s
UNION ALL SELECT 'uv/' || k || '/uv.lock', unnest(['idna', 'app', 'fork', 'wheel']), unnest(['==3.' || v, 'file:', 'git+', 'https://']), unnest([true, false, false, false]) FROM s
UNION ALL SELECT 'po/' || k || '/poetry.lock', unnest(['six', 'dir']), unnest(['==1.' || v, 'file:']), unnest([true, false]) FROM s
UNION ALL SELECT 'rs/' || k || '/Cargo.lock', unnest(['serde', 'own', 'fork']), unnest(['==1.' || v, 'file:', 'git+']), unnest([true, false, false]) FROM s""")
def manifest_locks(spark, sf_dir):
    files = [
        ("py/pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.12"\nflask = "^2.{v}"\nrich = { version = ">=13" }\nown = { path = "../own" }\nweb = { git = "https://h/r" }\n'),
        ("uv/uv.lock", '[[package]]\nname = "idna"\nversion = "3.{v}"\nsource = { registry = "https://pypi.org/simple" }\n[[package]]\nname = "app"\nversion = "0.1"\nsource = { editable = "." }\n[[package]]\nname = "fork"\nversion = "1"\nsource = { git = "https://h/r" }\n[[package]]\nname = "wheel"\nversion = "1"\nsource = { url = "https://h/w.whl" }\n'),
        ("po/poetry.lock", '[[package]]\nname = "six"\nversion = "1.{v}"\n[[package]]\nname = "dir"\nversion = "1"\n[package.source]\ntype = "directory"\nurl = "../dir"\n'),
        ("rs/Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.{v}"\nsource = "registry+https://github.com/rust-lang/crates.io-index"\n[[package]]\nname = "own"\nversion = "0.1"\n[[package]]\nname = "fork"\nversion = "1"\nsource = "git+https://h/r"\n'),
    ]
    made = [_suppliers(spark, sf_dir, *f) for f in files]
    return manifests.parsed(made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])).select("path", "name", "spec", "resolved")


@query("""SELECT 'js/' || s_suppkey || '/package-lock.json' AS path, unnest(['lodash', 'left-pad', 'lodash', 'own', 'repo', 'tar']) AS name, unnest(['4.17.' || s_nationkey, '1.3.0', '3.0.0', 'file:', 'git+', 'https://']) AS spec,
  unnest(['UNKNOWN', 'DEV', 'UNKNOWN', 'UNKNOWN', 'OPTIONAL', 'UNKNOWN']) AS dep_group, unnest(['DIRECT', 'UNKNOWN', 'TRANSITIVE', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN']) AS directness, unnest([true, true, true, false, false, false]) AS resolved FROM supplier""")
def manifest_npm_lock(spark, sf_dir):
    text = '{"lockfileVersion":3,"packages":{"":{"dependencies":{"lodash":"^4"}},"node_modules/lodash":{"version":"4.17.{v}","resolved":"https://registry.npmjs.org/lodash"},"node_modules/left-pad":{"version":"1.3.0","dev":true},"node_modules/left-pad/node_modules/lodash":{"version":"3.0.0"},"node_modules/own":{"version":"1.0.0","link":true},"node_modules/repo":{"version":"1.0.0","resolved":"git+ssh://h/r","optional":true},"node_modules/tar":{"version":"1.0.0","resolved":"https://elsewhere/tar.tgz"}}}'
    return manifests.parsed(_suppliers(spark, sf_dir, "js/package-lock.json", text)).select("path", "name", "spec", "dep_group", "directness", "resolved")


@query("""SELECT 'go/' || s_suppkey || '/go.mod' AS path, unnest(['a.b/c', 'd.e/f', 'g.h/i']) AS name, unnest(['v1.' || s_nationkey || '.0', 'file:replaced', 'v0.1.0']) AS spec, unnest([true, false, true]) AS resolved, unnest(['DIRECT', 'TRANSITIVE', 'DIRECT']) AS directness FROM supplier""")
def manifest_go_replace(spark, sf_dir):
    text = "module m\nrequire (\n\ta.b/c v1.{v}.0\n\td.e/f v2.0.0 // indirect\n)\nrequire g.h/i v0.1.0\nreplace (\n\td.e/f => ../f\n)\n"
    return manifests.go_mod(_suppliers(spark, sf_dir, "go/go.mod", text)).select("path", "name", "spec", "resolved", "directness")


_NAMES = ["Flask_App", "ghp_" + "a" * 36, "../evil", "@scope/ok", "Bad Name", "serde"]
_SPECS = ["==1.2", ">=1,<2", "git+https://h/r", None, "== token=abcdefgh", "file:../x", "=1.0.3"]


@query(f"""WITH r AS (SELECT o_orderkey, {_LIST(_NAMES)}[1 + o_orderkey % 6] AS name, {_LIST(_SPECS)}[1 + (o_orderkey // 6) % 7] AS spec FROM orders),
n AS (SELECT *, lower(replace(name, '_', '-')) AS normal, name NOT LIKE 'ghp%' AND name NOT LIKE '..%' AND name NOT LIKE '@%' AND name NOT LIKE '% %' AS named FROM r)
SELECT o_orderkey, CASE WHEN named THEN normal END AS name, CASE WHEN named AND spec = '==1.2' THEN '1.2' END AS version,
  CASE WHEN named THEN CASE WHEN spec IS NULL THEN 'UNRESOLVED' WHEN spec LIKE 'git+%' THEN 'VCS' WHEN spec LIKE 'file:%' THEN 'LOCAL_PATH' WHEN spec = '==1.2' THEN 'EXACT' ELSE 'CONSTRAINT' END END AS kind,
  CASE WHEN named THEN CASE WHEN spec IS NULL THEN 'UNRESOLVED' WHEN spec LIKE 'git+%' THEN 'VCS' WHEN spec LIKE 'file:%' THEN 'LOCAL_PATH' ELSE 'REGISTRY' END END AS identity,
  CASE WHEN named AND spec IN ('==1.2', '>=1,<2', '=1.0.3') THEN spec END AS "constraint", CASE WHEN named THEN 'OK' ELSE 'PARSE_ERROR' END AS status FROM n""")
def manifest_record_safety(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.lit("PyPI").alias("ecosystem"), _pick(_NAMES, F.col("o_orderkey") % 6).alias("name"), _pick(_SPECS, F.floor(F.col("o_orderkey") / 6) % 7).alias("spec"), F.lit("RUNTIME").alias("dep_group"), F.lit(False).alias("resolved"), F.lit("DIRECT").alias("directness"), F.lit("OK").alias("status"))
    return manifests.checked(r).select(F.col("path").cast("long").alias("o_orderkey"), "name", "version", "kind", "identity", "constraint", "status")


_FILES = ["yarn.lock", "src/App.csproj", "pom.xml", "uv.lock", "Gemfile", "a.txt"]


@query(f"SELECT p_partkey || '/' || {_LIST(_FILES)}[1 + p_partkey % 6] AS path, 'DEPENDENCY_UNSUPPORTED_FORMAT' AS code FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)")
def manifest_unread_formats(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return manifests.unread(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), _pick(_FILES, F.col("p_partkey") % 6)).alias("path")))


_REFERENCES = ["base.txt", "../common/./x.txt", "../../../out.txt", "/abs.txt", "c:\\x.txt", "sub//y.txt", "..", "a/../b/z.txt"]


@query(f"""SELECT o_orderkey, ['', 'req/', 'req/in/'][1 + o_orderkey % 3] AS folder, CASE o_orderkey % 8 WHEN 0 THEN ['base.txt', 'req/base.txt', 'req/in/base.txt'][1 + o_orderkey % 3] WHEN 1 THEN [NULL, 'common/x.txt', 'req/common/x.txt'][1 + o_orderkey % 3]
  WHEN 5 THEN ['sub/y.txt', 'req/sub/y.txt', 'req/in/sub/y.txt'][1 + o_orderkey % 3] WHEN 6 THEN [NULL, NULL, 'req'][1 + o_orderkey % 3] WHEN 7 THEN ['b/z.txt', 'req/b/z.txt', 'req/in/b/z.txt'][1 + o_orderkey % 3] END AS target FROM orders""")
def manifest_include_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    folder = _pick(["", "req/", "req/in/"], F.col("o_orderkey") % 3)
    return o.select("o_orderkey", folder.alias("folder"), manifests.include_target(F.concat(folder, F.lit("r.txt")), _pick(_REFERENCES, F.col("o_orderkey") % 8)).alias("target"))


@query("""WITH e AS (SELECT c_custkey % 40 AS a, (c_custkey * 7) % 40 AS b FROM customer), d AS (SELECT DISTINCT a, b FROM e),
w2 AS (SELECT DISTINCT x.a, y.b FROM d x JOIN d y ON x.b = y.a WHERE x.a <> x.b), w3 AS (SELECT DISTINCT x.a, y.b FROM w2 x JOIN d y ON x.b = y.a WHERE x.a <> x.b), w4 AS (SELECT DISTINCT x.a, y.b FROM w3 x JOIN d y ON x.b = y.a WHERE x.a <> x.b)
SELECT DISTINCT 'r' || a AS path FROM (SELECT * FROM d UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4) WHERE a = b""")
def manifest_include_loops(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit("r"), (x % 40).cast("string"))
    return deps.include_loops(c.select(name(F.col("c_custkey")).alias("path"), name(F.col("c_custkey") * 7).alias("target")), max_depth=4)


_ANSWERS_SQL = """ans AS (SELECT o_orderkey % 5 AS batch, o_orderkey % 100 AS k, o_orderkey AS position, 'GHSA-' || (o_custkey % 60) AS advisory_id FROM orders),
once AS (SELECT batch, k, advisory_id, min(position) AS position FROM ans GROUP BY ALL), f AS (SELECT batch, advisory_id, min({'k': k, 'position': position}) AS place FROM once GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY place) AS n FROM f)"""


def _answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select((k % 5).alias("batch"), (k % 100).alias("k"), k.alias("position"), F.concat(F.lit("GHSA-"), (F.col("o_custkey") % 60).cast("string")).alias("advisory_id"))


@query(f"WITH {_ANSWERS_SQL} SELECT once.batch, k, advisory_id, position, n <= 25 AS accepted FROM once JOIN r USING (batch, advisory_id)")
def advisory_caps(spark, sf_dir):
    return deps.capped_advisories(_answers(spark, sf_dir), ["k"], 25)


@query(f"""WITH {_ANSWERS_SQL}, i AS (SELECT DISTINCT advisory_id FROM once JOIN r USING (batch, advisory_id) WHERE n <= 25), fresh AS (SELECT advisory_id, row_number() OVER (ORDER BY advisory_id) AS n FROM i WHERE substr(advisory_id, 6)::INT >= 10)
SELECT advisory_id, 'REUSED' AS state FROM i WHERE substr(advisory_id, 6)::INT < 10 UNION ALL SELECT advisory_id, CASE WHEN n <= 20 THEN 'FETCHED' ELSE 'BUDGET' END FROM fresh""")
def advisory_details(spark, sf_dir):
    accepted = deps.capped_advisories(_answers(spark, sf_dir), ["k"], 25).where("accepted")
    known = _answers(spark, sf_dir).where(F.substring("advisory_id", 6, 9).cast("int") < 10)
    return deps.detail_requests(accepted, known, 20)


@query(f"""WITH {RECORDS_SQL}, {_CACHE_SQL}, c AS (SELECT ecosystem, name, version, max(fetched_at) AS fetched_at, max(status) AS status FROM cache GROUP BY ALL),
n AS (SELECT ecosystem, name, version, TIMESTAMP '1998-01-01' AS fetched_at, CASE WHEN length(version) % 2 = 1 AND name LIKE '%1' THEN 'NO_DATA' ELSE 'NO_MATCH' END AS status, name LIKE '%2' AS incomplete FROM c WHERE ecosystem = 'npm'), k AS (SELECT * FROM n WHERE status = 'NO_MATCH' AND NOT incomplete)
SELECT ecosystem, name, version, fetched_at, status FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.ecosystem = c.ecosystem AND k.name = c.name AND k.version = c.version) UNION ALL SELECT ecosystem, name, version, fetched_at, status FROM k""")
def advisory_cache_merge(spark, sf_dir):
    c = dependency_queries.cache(spark, sf_dir).groupBy("ecosystem", "name", "version").agg(F.max("fetched_at").alias("fetched_at"), F.max("status").alias("status"))
    n = c.where("ecosystem = 'npm'").withColumns({"fetched_at": F.lit("1998-01-01").cast("timestamp"), "status": F.when((F.length("version") % 2 == 1) & F.col("name").endswith("1"), "NO_DATA").otherwise("NO_MATCH"), "incomplete": F.col("name").endswith("2")})
    return deps.merged_cache(c, n)


_FAULTS = ["", "LOOKUP_STATUS_INVALID", "INCOMPLETE_NO_MATCH", "LOOKUP_STATUS_MISMATCH", "VULNERABILITY_INVALID", "ADVISORY_ID_INVALID", "SEVERITY_INVALID", "SUMMARY_INVALID", "ALIASES_INVALID", "FIXED_VERSION_INVALID", "REFERENCES_INVALID", "CVSS_VECTOR_INVALID", "", ""]


@query(f"SELECT o_orderkey, {_LIST(_FAULTS)}[1 + o_orderkey % {len(_FAULTS)}] AS fault FROM orders")
def advisory_validation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, lit = F.col("o_orderkey") % len(_FAULTS), F.lit
    sound = F.struct(
        F.when(k == 5, "bad id").otherwise("GHSA-1").alias("id"), (k == 4).alias("withdrawn"), F.when(k == 6, "SEVERE").otherwise("HIGH").alias("severity"), F.when(k == 7, F.repeat(lit("x"), 301)).otherwise(F.col("o_orderpriority")).alias("summary"), F.array(F.when(k == 8, "-x").otherwise("CVE-1")).alias("aliases"),
        F.array(F.when(k == 9, "1 or 2").otherwise("1.2")).alias("fixed"), F.array(F.when(k == 10, "https://u@h/").otherwise("https://h/a")).alias("references"), F.when(k == 11, "CVSS:9").when(k == 12, "CVSS:3.1/AV:N/AC:L/PR:N").alias("cvss"),
    )
    none = k.isin(2, 3, 13)
    status = F.when(k == 1, "NO_DATA").when(none & (k != 3), "NO_MATCH").otherwise("MATCHED")
    answers = o.select("o_orderkey", status.alias("status"), (k == 2).alias("incomplete"), F.when(none, F.filter(F.array(sound), lambda x: lit(False))).otherwise(F.array(sound)).alias("vulnerabilities"))
    return deps.lookup_faults(answers).select("o_orderkey", F.coalesce("fault", lit("")).alias("fault"))


@query("""SELECT o_orderkey, ['CVSS:3.1/AV:N/AC:L/PR:N', '', '', ''][1 + o_orderkey % 4] AS vector, ['CRITICAL', 'MEDIUM', 'INFO'][1 + o_orderkey % 3] AS severity FROM orders""")
def advisory_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    entry = lambda kind, score: F.struct(F.lit(kind).alias("type"), F.lit(score).alias("score"))
    scores = F.when(k == 0, F.array(entry("OTHER", "AV:X/AC:X/PR:X"), entry("CVSS_V3", "bad"), entry("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N"))).when(k == 1, F.array(entry("CVSS_V2", "AV:N/AC:L/Au:N"))).when(k == 2, F.array(*[entry("CVSS_V3", "bad")] * 8, entry("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N")))
    vector = deps.cvss_vector(scores)
    return o.select("o_orderkey", F.coalesce(vector, F.lit("")).alias("vector"), deps.advisory_severity(_pick(["critical", "odd", "info"], F.col("o_orderkey") % 3)).alias("severity"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey AS repo, ['uv.lock', 'a/uv.lock'][1 + c_custkey % 2] AS path, 'app' || (c_custkey % 20) AS name, c_custkey % 3 = 0 AS editable FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY repo, path, name) AS k FROM r)
SELECT c_custkey, path = 'uv.lock' AND name = 'app' || (repo % 20) AND editable AND k = 1 AS first_party FROM n""")
def dependency_first_party(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    records = c.select("c_custkey", F.col("c_nationkey").alias("repo"), _pick(["uv.lock", "a/uv.lock"], F.col("c_custkey") % 2).alias("path"), F.concat(F.lit("app"), (F.col("c_custkey") % 20).cast("string")).alias("name"), (F.col("c_custkey") % 3 == 0).alias("editable"))
    return deps.first_party(records, n.select(F.col("n_nationkey").alias("repo"), F.concat(F.lit("app"), (F.col("n_nationkey") % 20).cast("string")).alias("name"))).select("c_custkey", "first_party")


@query(f"""WITH {RECORDS_SQL}, {_CACHE_SQL}, k AS (SELECT count(*) AS n FROM keys)
SELECT (SELECT count(*) FROM inventory) AS dependencies_discovered, (SELECT count(version) FROM inventory) AS exact_dependencies, 0::BIGINT AS first_party_roots, (SELECT count(*) - count(version) FROM inventory) AS unresolved_dependencies, n AS unique_package_versions,
  (SELECT count(*) FROM lookups WHERE state <> 'OFFLINE_NO_CACHE') AS cache_hits, (SELECT count(*) FROM lookups WHERE state LIKE 'STALE%') AS stale_cache_hits, 0::BIGINT AS provider_queries, (SELECT coalesce(max(age_seconds), 0) FROM lookups) AS oldest_cache_age_seconds,
  (SELECT coalesce(min(age_seconds), 0) FROM lookups) AS newest_cache_age_seconds, (SELECT count(*) FROM lookups WHERE state = 'OFFLINE_NO_CACHE') AS no_data, (SELECT count(*) FROM lookups WHERE state LIKE '%MATCHED') AS vulnerability_matches,
  least(ceil(n / 50.0), 10)::BIGINT AS batch_requests_used, 10::BIGINT AS batch_requests_limit, 50::BIGINT AS detail_requests_used, 50::BIGINT AS detail_requests_limit, (least(ceil(n / 50.0), 10) + 50)::BIGINT AS total_requests_used, 60::BIGINT AS total_requests_limit,
  true AS provider_budget_reached, 140::BIGINT AS advisories_seen, 100::BIGINT AS advisories_accepted, 40::BIGINT AS advisories_truncated, {dependency_queries.TTL}::BIGINT AS cache_ttl_seconds FROM k""")
def dependency_summary(spark, sf_dir):
    keys = deps.exact_keys(dependency_queries.inventory(spark, sf_dir))
    looked = dependency_queries._lookups(spark, sf_dir)
    used = deps.provider_budget(keys.count(), 70)
    records = dependency_queries.inventory(spark, sf_dir).withColumn("identity", F.lit("REGISTRY"))
    return deps.full_metrics(records, looked, looked.where("state LIKE '%MATCHED'"), used, {"advisories_seen": 140, "advisories_accepted": 100, "advisories_truncated": 40}, dependency_queries.TTL)


# Patches and reviews.

_PATHS = ["src/a.py", ".git/x.py", ".github/workflows/y.py", "a/AGENTS.md", "k.pem", "b/../c.py", "x/.env.py", "tools/d.sh"]


@query(f"SELECT o_orderkey, o_orderkey % 8 IN (0, 7) AND o_orderkey % 3 <> 0 AS allowed FROM orders")
def patch_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", remediation.may_patch(_pick(_PATHS, k % 8), F.lit("SOURCE_CODE"), F.lit("TEXT"), F.when(k % 3 == 0, "utf-16-le").otherwise("utf-8")).alias("allowed"))


_EDITS = [("x = f(verify=False)", "x = f(verify=True)", ""), ("check(a)", "", "PATCH_DESTRUCTIVE_CHANGE"), ("run(a)", "run(a)  # nosec", "PATCH_SECURITY_SUPPRESSION_DETECTED"), ("y = a", "y = eval(a)", "PATCH_NEW_HIGH_FINDING"), ("y = b", "y = g('https://h')", "PATCH_NEW_HIGH_FINDING"), ("return v", "return None", "PATCH_DESTRUCTIVE_CHANGE"), ("z = 1", "# z\nz = 1", "PATCH_DESTRUCTIVE_CHANGE"), ("p = q", "password = 'Abcdef12'", "PATCH_SECRET_EXPOSURE"), ("same", "same", "PATCH_TOO_LARGE")]


@query(f"""WITH e AS (SELECT c_custkey, {_LIST([a for a, _, _ in _EDITS])}[1 + c_custkey % 9] AS old, {_LIST([b for _, b, _ in _EDITS])}[1 + c_custkey % 9] AS new FROM customer)
SELECT c_custkey, CASE WHEN old = new THEN '' WHEN new LIKE '%' || chr(10) || old THEN '--- a/m.py' || chr(10) || '+++ b/m.py' || chr(10) || '@@ -1,0 +2 @@' || chr(10) || '+' || split_part(new, chr(10), 1) || chr(10)
  WHEN new = '' THEN '--- a/m.py' || chr(10) || '+++ b/m.py' || chr(10) || '@@ -2 +2 @@' || chr(10) || '-' || old || chr(10) || '+' || chr(10)
  ELSE '--- a/m.py' || chr(10) || '+++ b/m.py' || chr(10) || '@@ -2 +2 @@' || chr(10) || '-' || old || chr(10) || '+' || new || chr(10) END AS diff, {_LIST([c for _, _, c in _EDITS])}[1 + c_custkey % 9] AS fault FROM e""")
def patch_differences(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, head = F.col("c_custkey"), F.concat(F.lit("n = "), F.col("c_custkey").cast("string"), F.lit("\n"))
    rows = c.select("c_custkey", F.lit("m.py").alias("path"), F.concat(head, _pick([a for a, _, _ in _EDITS], k % 9), F.lit("\nend\n")).alias("old"), F.concat(head, _pick([b for _, b, _ in _EDITS], k % 9), F.lit("\nend\n")).alias("new"))
    rows = rows.withColumn("c", remediation.changes("path", "old", "new"))
    return rows.select("c_custkey", "c.diff", F.coalesce(remediation.rejection(F.col("c")), F.lit("")).alias("fault"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a' || chr(10) || 'X' || chr(10) || 'c' || chr(10) || 'd' || chr(10) WHEN 1 THEN 'A' || chr(10) || 'b' || c_custkey || chr(10) || 'Y' || chr(10) || 'Z' || chr(10) ELSE '' END AS text,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 4 THEN 'PATCH_TOO_LARGE' ELSE 'PATCH_OVERLAPPING_EDITS' END AS fault FROM customer""")
def patch_apply(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    edit = lambda a, b, t: F.struct(F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line"), F.lit(t).alias("replacement"))
    edits = F.when(k == 0, F.array(edit(2, 2, "X\n"))).when(k == 1, F.array(edit(3, 4, "Y\nZ"), edit(1, 1, "A"))).when(k == 2, F.array(edit(1, 2, "A"), edit(2, 3, "B"))).when(k == 3, F.array(edit(5, 5, "q"))).otherwise(F.array(*[edit(1, 1, "x")] * 6))
    rows = c.select("c_custkey", F.concat(F.lit("a\nb"), F.col("c_custkey").cast("string"), F.lit("\nc\nd\n")).alias("source"), edits.alias("edits"))
    got = rows.select("c_custkey", remediation.applied(F.col("source"), F.col("edits")).alias("r"))
    return got.select("c_custkey", F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.fault", F.lit("")).alias("fault"))


@query(f"""WITH {FINDINGS_SQL}, a AS (SELECT path, rule_id, line, col FROM findings WHERE line % 7 <> 0 UNION ALL SELECT path, rule_id, line + 1, col FROM findings WHERE line % 11 = 0), b AS (SELECT path, rule_id, line, col FROM findings)
SELECT *, 'REMOVED' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'NEW' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def patch_hit_changes(spark, sf_dir):
    f = scan_queries.stored(scan_queries.all_findings(spark, sf_dir), "findings").select("path", "rule_id", "line", "col")
    after = f.where("line % 7 <> 0").unionAll(f.where("line % 11 = 0").withColumn("line", F.col("line") + 1))
    return remediation.hit_changes(f, after)


@query("SELECT doc_id, (length(text) // 4 + 2048)::BIGINT AS patch_tokens, length(text)::BIGINT AS review_tokens FROM documents")
def token_estimates(spark, sf_dir):
    patch, review = remediation.token_estimates(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", patch.cast("long").alias("patch_tokens"), review.alias("review_tokens"))


_PATCH_FAULTS = ["", "PATCH_SCOPE_VIOLATION", "PATCH_AI_RESPONSE_INVALID", "PATCH_AI_RESPONSE_INVALID", "PATCH_AI_RESPONSE_INVALID", "PATCH_AI_RESPONSE_INVALID", ""]


@query(f"SELECT o_orderkey, {_LIST(_PATCH_FAULTS)}[1 + o_orderkey % 7] AS fault, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 6 THEN 0 ELSE -1 END::BIGINT AS n_edits FROM orders")
def patch_answers(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    edit = F.concat(F.lit('[{"start_line":'), F.when(k == 3, '"1"').otherwise("1"), F.lit(',"end_line":2,"replacement":"x"}]'))
    text = F.concat(
        F.lit('{"can_propose_patch":'), F.when(k.isin(2, 6), "false").otherwise("true"), F.lit(',"target_file":"'), F.when(k == 1, "other.py").otherwise("a.py"), F.lit('","assumptions":[],"rationale":["r"],"limitations":['), F.when(k == 4, "7").otherwise('"l"'), F.lit('],"replacements":'),
        F.when(k == 6, "[]").when(k == 3, F.replace(edit, F.lit('"1"'), F.lit("null"))).otherwise(edit), F.when(k == 5, ',"more":1').otherwise(""), F.lit("}"))
    got = remediation.patch_answers(o.select("o_orderkey", text.alias("response"), F.lit("a.py").alias("allowed_file")))
    return got.select("o_orderkey", F.coalesce("fault", F.lit("")).alias("fault"), F.coalesce(F.size("edits"), F.lit(-1)).cast("long").alias("n_edits"))


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 4) AS valid, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'LIKELY' END AS verdict, CASE WHEN o_orderkey % 5 = 0 THEN 'HIGH' WHEN o_orderkey % 5 = 4 THEN 'MEDIUM' END AS confidence FROM orders")
def review_answers(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    lists = ",".join(f'"{n}":["x"]' for n in remediation.REVIEW_LISTS)
    text = F.concat(F.lit('{"verdict":"'), F.when(k == 1, "SURELY").otherwise("LIKELY"), F.lit('","confidence":"HIGH","summary":"'), F.when(k == 2, "").otherwise("s"), F.lit('",' + lists), F.when(k == 3, "").otherwise("}"))
    return remediation.review_answers(o.select("o_orderkey", text.alias("response"), F.when(k == 4, "STALE").otherwise("CURRENT").alias("context_status")), ["LIKELY", "UNLIKELY"]).select("o_orderkey", "valid", "verdict", "confidence")


@query(f"""WITH {FINDINGS_SQL}, a AS (SELECT fingerprint, path, unnest(generate_series(line - 1, line + 1)) AS at FROM findings WHERE scanner_id <> 'secrets' AND line <= 40), s AS (SELECT fingerprint, count(*) AS n FROM a JOIN code_lines c ON a.path = c.path AND a.at = c.line GROUP BY fingerprint)
SELECT f.fingerprint, CASE WHEN n IS NULL THEN 'UNAVAILABLE' ELSE 'CURRENT' END AS context_status, coalesce(n, 0) AS n_lines FROM findings f LEFT JOIN s USING (fingerprint) WHERE line <= 40""")
def review_contexts(spark, sf_dir):
    f = scan_queries.stored(scan_queries.all_findings(spark, sf_dir), "findings").where("line <= 40")
    got = remediation.contexts(f, corpora.code_lines(spark, sf_dir), around=1)
    lines = F.size(F.from_json("context", "untrusted_source_context array<struct<line:bigint>>")["untrusted_source_context"])
    return got.select("fingerprint", "context_status", F.when(F.col("context_status") == "CURRENT", lines).otherwise(0).cast("long").alias("n_lines"))


@query("""WITH s AS (SELECT p_size % 4 AS rank, p_brand AS kind, p_partkey AS subject, CASE WHEN p_partkey % 6 <> 0 THEN 300 + p_size * 10 END AS n FROM part ORDER BY 1, 2, 3 LIMIT 20),
r AS (SELECT *, sum(CASE WHEN n IS NULL THEN 0 ELSE 1 END) OVER w AS requests, sum(coalesce(n, 0)) OVER w AS chars FROM s WINDOW w AS (ORDER BY rank, kind, subject)), o AS (SELECT *, requests > 22 OR chars > 5000 OR requests * 2048 > 20000 AS over FROM r)
SELECT rank, kind, subject, requests::BIGINT AS requests, chars::BIGINT AS chars, CASE WHEN max(over::INT) OVER (ORDER BY rank, kind, subject) = 1 THEN 'ABORTED' WHEN n IS NULL THEN 'FAILED' ELSE 'SELECTED' END AS state FROM o""")
def review_budget(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    context = F.when(F.col("p_partkey") % 6 != 0, F.repeat(F.lit("x"), F.col("p_size") * 10 + 300))
    return remediation.review_budget(p.select((F.col("p_size") % 4).alias("rank"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("subject"), context.alias("context")), {"total_chars": 5000}).drop("context")


# What others plug in.


@query(f"WITH {FINDINGS_SQL} SELECT scanner_id, rule_id, count(*) AS n FROM fs GROUP BY ALL")
def registered_scanners(spark, sf_dir):
    shell = lambda: F.col("path").endswith(".sh")
    scanners = [
        registry.Scanner("secrets", shell, lambda f: secret_rules.findings(secret_rules.detect(f))),
        registry.Scanner("behavior.static", shell, lambda f: behavior_rules.findings(behavior_rules.hits(f.withColumn("language", F.lit("shell"))))),
    ]
    return registry.run_scanners(scanners, corpora.code_lines(spark, sf_dir)).groupBy("scanner_id", "rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {FINDINGS_SQL}, p AS (SELECT DISTINCT 'f:' || a.fingerprint AS src, 'f:' || b.fingerprint AS dst FROM findings a JOIN findings b USING (path) WHERE a.line + 1 = b.line AND a.rule_id = 'BEHAVIOR.NETWORK_REQUEST' AND b.rule_id = 'BEHAVIOR.SHELL_EXEC')
SELECT {_sid("'edge-v1'", "'NEXT_LINE'", "src", "dst", "'OWN.NEXT'")} AS edge_id, src, dst FROM p""")
def registered_rules(spark, sf_dir):
    def next_line(findings, nodes):
        a = findings.where("rule_id = 'BEHAVIOR.NETWORK_REQUEST'").select("path", (F.col("line") + 1).alias("line"), F.col("fingerprint").alias("a"))
        b = findings.where("rule_id = 'BEHAVIOR.SHELL_EXEC'").select("path", "line", F.col("fingerprint").alias("b"))
        return a.join(b, ["path", "line"]).select(*correlation._edge("NEXT_LINE", "OWN.NEXT", correlation._node("a"), correlation._node("b"), F.lit("LOW"), True))

    f = scan_queries.stored(scan_queries.all_findings(spark, sf_dir), "findings")
    return registry.run_rules({"next": next_line}, f, correlation.entity_nodes(f)).select("edge_id", "src", "dst")


@query(f"""WITH {RECORDS_SQL}, {dependency_queries._ADVISORIES_SQL} SELECT advisory_id, a.ecosystem, a.name, a.version, severity, fixed FROM advisories a WHERE EXISTS (SELECT 1 FROM keys k WHERE k.ecosystem = a.ecosystem AND k.name = a.name AND k.version = a.version)""")
def registered_provider(spark, sf_dir):
    snapshot = deps.normalized_advisories(dependency_queries.raw_advisories(spark, sf_dir))
    return registry.ask(lambda keys: snapshot, deps.exact_keys(dependency_queries.inventory(spark, sf_dir)))


@query("""WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents WHERE text <> ''), c AS (SELECT doc_id, n, unnest(generate_series(0, (n - 1) // 1000)) AS chunk FROM d)
SELECT doc_id, chunk, least(1000, n - chunk * 1000)::BIGINT AS n_bytes FROM c""")
def content_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    return registry.chunks(d, 1000).select(F.col("path").alias("doc_id"), F.col("chunk").cast("long").alias("chunk"), F.octet_length("content").cast("long").alias("n_bytes"))
