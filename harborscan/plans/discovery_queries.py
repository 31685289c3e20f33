"""Queries of discovery: names, patterns, ignore rules, limits, encodings and which scanner takes which file."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborscan.functions import exprs
from harborscan.operators import discovery
from harborscan.sources import corpora

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_TREE = [
    "Cargo.lock", "requirements-dev.txt", "package.json", "Pipfile", "App.csproj", ".env", ".env.prod", "id_rsa", "x.key", "private.bin", "a.pem", "b.crt", "ci.yml", "Dockerfile",
    "compose.yaml", "Makefile", "README.md", "notes.txt", "b.py", "c.pyw", "d.sh", "e.ps1", "f.bat", "g.go", "h.rs", "i.ini", "j.toml", "k.html", "l.css", "m.tsx", "n.mjs", "o.exe", "p", "q.TXT",
    "test_r.py", "s_test.py", "t.spec.ts", "u.test.jsx", "v.test.css", "w.jsonl",
]
_ROOTS = ["src", ".github/workflows", "tests/unit", "lib/Test", "docs/a/b/c", "build", "vendor/x"]
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_TREE_SQL = f"tree AS (SELECT p_partkey, {_LIST(_ROOTS)}[1 + (p_partkey // 3) % {len(_ROOTS)}] || '/' || {_LIST(_TREE)}[1 + p_partkey % {len(_TREE)}] AS path, p_name AS text FROM part)"


def tree(spark, sf_dir):
    """p_partkey, path, text: a file for each part, of every kind, in folders of several depths."""
    p = corpora.table(spark, sf_dir, "part")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    k = F.col("p_partkey")
    return p.select(k, F.concat(pick(_ROOTS, F.floor(k / 3) % len(_ROOTS)), F.lit("/"), pick(_TREE, k % len(_TREE))).alias("path"), F.col("p_name").alias("text"))


_KIND_SQL = """CASE WHEN name IN ('cargo.lock') THEN 'LOCKFILE' WHEN name IN ('package.json', 'pipfile') OR name LIKE 'requirements-%.txt' OR name LIKE '%.csproj' THEN 'DEPENDENCY_MANIFEST'
  WHEN name = '.env' OR starts_with(name, '.env.') THEN 'ENV_FILE' WHEN name = 'id_rsa' OR suffix = 'key' OR starts_with(name, 'private.') THEN 'KEY_MATERIAL_LIKE' WHEN suffix IN ('pem', 'crt') THEN 'CERTIFICATE_LIKE'
  WHEN starts_with(lower(path), '.github/workflows/') AND suffix IN ('yml', 'yaml') THEN 'CI_CONFIG' WHEN name IN ('dockerfile', 'compose.yaml') THEN 'CONTAINER_CONFIG' WHEN name = 'makefile' THEN 'CONFIG'
  WHEN suffix IN ('md', 'txt') THEN 'DOCUMENTATION' WHEN suffix IN ('py', 'pyw', 'mjs') THEN 'SOURCE_CODE' WHEN suffix IN ('sh', 'ps1', 'bat') THEN 'SCRIPT' WHEN suffix IN ('go', 'rs') THEN 'SOURCE_CODE'
  WHEN suffix IN ('ini', 'toml', 'yml', 'yaml', 'json') THEN 'CONFIG' ELSE 'UNKNOWN' END"""
_LANGUAGE_SQL = """CASE suffix WHEN 'py' THEN 'python' WHEN 'pyw' THEN 'python' WHEN 'sh' THEN 'shell' WHEN 'ps1' THEN 'powershell' WHEN 'bat' THEN 'batch' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'toml' THEN 'toml'
  WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' WHEN 'tsx' THEN 'tsx' WHEN 'mjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'jsx' THEN 'jsx' WHEN 'json' THEN 'json' WHEN 'md' THEN 'markdown' WHEN 'yml' THEN 'yaml' WHEN 'yaml' THEN 'yaml' END"""
_KINDS = f"""{_TREE_SQL}, n AS (SELECT *, lower(string_split(path, '/')[-1]) AS name FROM tree), x AS (SELECT *, regexp_extract(name, '^.+\\.([^.]+)$', 1) AS suffix FROM n),
kinds AS (SELECT p_partkey, path, name, suffix, {_LANGUAGE_SQL} AS language, {_KIND_SQL} AS kind FROM x)"""


@query(f"WITH {_KINDS} SELECT p_partkey, path, suffix, language, kind FROM kinds")
def tree_inventory(spark, sf_dir):
    t = tree(spark, sf_dir)
    language = discovery.language_of(F.col("path"))
    return t.select("p_partkey", "path", discovery.suffix_of(F.col("path")).alias("suffix"), language.alias("language"), discovery.kind_of(F.col("path"), F.coalesce(language, F.lit(""))).alias("kind"))


_INCLUDE, _EXCLUDE = ["build/*.md", "docs/a/"], ["vendor/", "*.t?t", "src/[b-d].*"]


@query(f"""WITH {_TREE_SQL} SELECT p_partkey, path,
  CASE WHEN (starts_with(path, 'build/') AND path LIKE '%.md') OR starts_with(path, 'docs/a/') THEN NULL WHEN starts_with(path, 'build/') THEN 'EXCLUDED_DEFAULT_BUILD'
    WHEN starts_with(path, 'vendor/') OR path LIKE '%.t_t' OR regexp_matches(path, '^src/[bcd][.]') THEN 'EXCLUDED_USER_POLICY' END AS reason,
  (starts_with(path, 'build/') AND path LIKE '%.md') OR starts_with(path, 'docs/a/') AS admitted_by_include, regexp_replace(path, '/[^/]*$', '') IN ('build', 'docs/a/b/c') AS folder_reopened FROM tree""")
def glob_policy(spark, sf_dir):
    path = F.col("path")
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return tree(spark, sf_dir).select("p_partkey", "path", discovery.scope_of(path, _INCLUDE, _EXCLUDE).alias("reason"), discovery.admits(path, _INCLUDE).alias("admitted_by_include"), discovery.may_hold_included(folder, _INCLUDE).alias("folder_reopened"))


_IGNORE = "# made\n*.txt\n!notes.txt\nlib/Test/\n\nsrc/?.sh\nunit/\n!unit/*.py\n"


@query(f"""WITH {_TREE_SQL}, n AS (SELECT *, string_split(path, '/')[-1] AS name FROM tree)
SELECT p_partkey, path, CASE WHEN contains(path, 'unit/') THEN true WHEN path = 'src/d.sh' THEN true WHEN starts_with(path, 'lib/Test/') THEN true WHEN name = 'notes.txt' THEN false ELSE name LIKE '%.txt' END AS ignored FROM n""")
def gitignore_filter(spark, sf_dir):
    t = tree(spark, sf_dir)
    own = t.sparkSession.createDataFrame([(".gitignore", _IGNORE)], "path string, text string")
    rules = discovery.root_ignore(t.select("path", "text").unionAll(own))
    return t.select("p_partkey", "path", discovery.ignored(F.col("path"), rules).alias("ignored"))


_PARTS = ["ok", "con", "COM1.txt", "a:b", "tail.", "tail ", "..", ".", "", "x\\\\y", "nul.tar.gz", "lpt", "ünder"]


@query(f"""WITH n AS (SELECT o_orderkey, {_LIST(_PARTS).replace(chr(92) * 2, chr(92))}[1 + o_orderkey % {len(_PARTS)}] AS name FROM orders)
SELECT o_orderkey, name, name IN ('', '.', '..') OR contains(name, chr(92)) AS unsafe, name IN ('', '.', '..') OR contains(name, chr(92)) OR contains(name, ':') OR regexp_matches(name, '[. ]$') OR regexp_matches(upper(name), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([.]|$)') AS unsafe_on_windows FROM n""")
def unsafe_components(spark, sf_dir):
    names = [n.replace("\\\\", "\\") for n in _PARTS]
    n = corpora.table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names)).cast("int")).alias("name"))
    return n.select("o_orderkey", "name", discovery.unsafe_component(F.col("name")).alias("unsafe"), discovery.unsafe_component(F.col("name"), True).alias("unsafe_on_windows"))


_UNIQUE = "(SELECT path || '.' || p_partkey AS path, strlen(text) AS size_bytes FROM tree)"


def _unique(spark, sf_dir):
    return tree(spark, sf_dir).select(F.concat("path", F.lit("."), F.col("p_partkey").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(f"""WITH {_TREE_SQL}, d AS (SELECT path, len(string_split(path, '/')) - 1 > 3 AS deep FROM {_UNIQUE}), r AS (SELECT *, (sum(CASE WHEN deep THEN 0 ELSE 1 END) OVER (ORDER BY lower(path), path))::BIGINT AS place FROM d)
SELECT path, place, CASE WHEN deep THEN 'DEPTH_LIMIT_REACHED' WHEN place > 90 THEN 'FILE_LIMIT_REACHED' ELSE 'ADMITTED' END AS state FROM r""")
def discovery_caps(spark, sf_dir):
    return discovery.capped(_unique(spark, sf_dir), max_depth=3, max_files=90)


_REASON_SQL = "CASE WHEN starts_with(path, 'build/') THEN 'EXCLUDED_DEFAULT_BUILD' WHEN starts_with(path, 'vendor/') THEN 'EXCLUDED_USER_POLICY' END"


@query(f"""WITH {_TREE_SQL}, e AS (SELECT path, {_REASON_SQL} AS reason FROM {_UNIQUE}), k AS (SELECT * FROM e WHERE reason IS NOT NULL)
SELECT path, reason, greatest((SELECT count(*) FROM k) - 20, 0) AS n_omitted FROM k ORDER BY lower(path), path LIMIT 20""")
def exclusion_list(spark, sf_dir):
    u = _unique(spark, sf_dir)
    return discovery.exclusion_list(u.select("path", discovery.scope_of(F.col("path"), exclude=["vendor/"]).alias("reason")).where("reason IS NOT NULL"), most=20)


@query(f"""WITH {_TREE_SQL}, u AS (SELECT path, size_bytes, {_REASON_SQL} AS reason FROM {_UNIQUE}), r AS (SELECT *, sum(CASE WHEN size_bytes <= 18 THEN size_bytes ELSE 0 END) OVER (ORDER BY lower(path), path) AS total FROM u),
s AS (SELECT *, CASE WHEN size_bytes > 18 THEN 'SKIPPED_SIZE' WHEN total > 900 THEN 'ABORTED_BUDGET' ELSE 'ADMITTED' END AS state FROM r)
SELECT count(*) AS entries_seen, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS directories_seen, count(*) FILTER (WHERE reason IS NULL AND state = 'ADMITTED') AS files_admitted,
  count(*) FILTER (WHERE NOT (reason IS NULL AND state = 'ADMITTED')) AS files_skipped, count(reason) AS files_excluded, count(*) FILTER (WHERE reason IS NULL AND state = 'SKIPPED_SIZE') AS files_too_large,
  count(*) FILTER (WHERE reason IS NULL AND state = 'ABORTED_BUDGET') AS files_aborted, coalesce(sum(size_bytes) FILTER (WHERE reason IS NULL AND state = 'ADMITTED'), 0)::BIGINT AS bytes_admitted, max(len(string_split(path, '/'))) AS deepest FROM s""")
def traversal_stats(spark, sf_dir):
    files = discovery.admitted(_unique(spark, sf_dir), 18, 900)
    return discovery.traversal_stats(files.withColumn("reason", discovery.scope_of(F.col("path"), exclude=["vendor/"])))


def contents(spark, sf_dir):
    """o_orderkey, content: bytes in several encodings, binaries among them, of each order's text."""
    o = corpora.table(spark, sf_dir, "orders")
    k, text = F.col("o_orderkey") % 11, F.concat(F.lit("#!/usr/bin/env -S python3 -u\r\nété "), F.col("o_orderpriority"))
    plain, control = F.encode(text, "utf-8"), F.concat(F.col("o_orderpriority"), F.repeat(F.lit("\x01"), 4))
    content = (
        F.when(k == 0, plain).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(k == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(k == 4, F.encode(text, "UTF-16LE")).when(k == 5, F.encode(text, "UTF-16BE")).when(k == 6, F.concat(F.unhex(F.lit("4D5A")), plain)).when(k == 7, F.concat(plain, F.unhex(F.lit("FF61"))))
        .when(k == 8, F.encode(control, "utf-8")).when(k == 9, F.concat(F.encode(F.lit("ab"), "utf-8"), F.unhex(F.lit("00")), plain)).otherwise(F.unhex(F.lit("")))
    )
    return o.select("o_orderkey", content.alias("content"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 IN (6, 8, 9) THEN 'BINARY' WHEN o_orderkey % 11 = 7 THEN 'UNKNOWN' ELSE 'TEXT' END AS content_kind,
  CASE o_orderkey % 11 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' WHEN 4 THEN 'utf-16-le' WHEN 5 THEN 'utf-16-be' WHEN 10 THEN 'utf-8' END AS encoding,
  CASE WHEN o_orderkey % 11 = 6 THEN 'pe' END AS magic, CASE WHEN o_orderkey % 11 = 10 THEN '' WHEN o_orderkey % 11 < 6 THEN '#!/usr/bin/env -S python3 -u' END AS first_line,
  o_orderkey % 11 = 7 AS decode_failed, CASE WHEN o_orderkey % 11 < 6 THEN 'python' END AS language FROM orders""")
def encoding_sniff(spark, sf_dir):
    c = contents(spark, sf_dir).select("o_orderkey", discovery.magic_of(F.col("content")).alias("magic"), discovery.sniff(F.col("content")).alias("s"))
    return c.select("o_orderkey", "s.content_kind", "s.encoding", "magic", "s.first_line", "s.decode_failed", discovery.shebang_language(F.col("s.first_line")).alias("language"))


_BANGS = ["#!/bin/sh", "#!/usr/bin/env node", "#! /usr/local/bin/python3.12 -I", "#!C:\\tools\\PWSH", "#!/usr/bin/env -i", "echo", "#!", "#!/usr/bin/env", "#!/opt/php8", "#!/bin/awk"]


@query(f"""SELECT o_orderkey, {_LIST(['shell', 'javascript', 'python', 'powershell', '', '', '', '', 'php', ''])}[1 + o_orderkey % 10] AS language FROM orders""")
def shebang_language(spark, sf_dir):
    o = corpora.table(spark, sf_dir, "orders")
    line = F.get(F.array(*map(F.lit, _BANGS)), (F.col("o_orderkey") % len(_BANGS)).cast("int"))
    return o.select("o_orderkey", F.coalesce(discovery.shebang_language(line), F.lit("")).alias("language"))


@query(f"""WITH {_KINDS}, t AS (SELECT *, p_partkey % 13 <> 0 AS is_text FROM kinds)
SELECT path, is_text AS secrets, is_text AND coalesce(language, '') = 'python' AND kind IN ('SOURCE_CODE', 'SCRIPT') AS sast,
  is_text AND kind IN ('SOURCE_CODE', 'SCRIPT', 'CONFIG', 'CI_CONFIG', 'CONTAINER_CONFIG') AND (coalesce(language, '') IN ('python', 'powershell', 'batch', 'shell', 'javascript', 'typescript', 'jsx', 'tsx') OR kind = 'CI_CONFIG') AS behavior,
  is_text AND kind IN ('LOCKFILE', 'DEPENDENCY_MANIFEST') AS dependencies,
  starts_with(path, 'tests/') OR starts_with(path, 'lib/Test/') OR starts_with(name, 'test_') OR name LIKE '%\\_test.py' ESCAPE '\\' OR regexp_matches(name, '[.](test|spec)[.](js|jsx|ts|tsx|mjs|mts|cjs|cts)$') AS in_tests,
  starts_with(path, 'tests/') OR starts_with(path, 'lib/Test/') OR regexp_matches(name, '[.](test|spec)[.]') AS tagged_as_test FROM t""")
def scanner_admission(spark, sf_dir):
    t = tree_inventory(spark, sf_dir)
    text = F.col("p_partkey") % 13 != 0
    return discovery.admissions(t.withColumns({"content_kind": F.when(text, "TEXT").otherwise("BINARY"), "encoding": F.when(text, "utf-8")}))


@query("""SELECT o_orderkey, replace(replace(replace('a' || chr(9) || o_orderpriority || chr(8206) || chr(917505) || chr(27) || chr(10), chr(9), '\\t'), chr(10), '\\n'), chr(27), '\\x1b').replace(chr(8206), '\\u200e').replace(chr(917505), '\\U000e0001') AS shown FROM orders""")
def display_escaping(spark, sf_dir):
    o = corpora.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", exprs.display_safe(F.concat(F.lit("a\t"), "o_orderpriority", F.lit("\u200e\U000e0001\x1b\n"))).alias("shown"))
