"""Queries over Python sources and manifests that are written row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborscan.functions.scratch import dealt
from harborscan.operators import manifests, python_code
from harborscan.sources.corpora import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Shapes of small Python files; the number of a customer chooses one and goes into its names.
TEMPLATES = [
    "import os\nx{n} = input()\nos.system('ls ' + x{n})\n",
    "import subprocess, shlex\ny = shlex.quote(input())\nsubprocess.run('ls ' + y, shell=True)\n",
    "import pickle\nfrom flask import request\npickle.loads(request.data)\neval(request.args.get('q{n}'))\n",
    "import requests\nr = requests.get('https://h/{n}', verify=False)\nopen('f{n}.bin', 'wb').write(r.content)\nimport subprocess\nsubprocess.run(['f{n}.bin'])\n",
    "import sys\nopen(sys.argv[1]).read()\n",
    "def f(db, name):\n    db.execute('select %s' % name)\nq = input()\ndb.execute(f'select {{q}}')\ndb.execute('select ?', (q,))\n",
    "import yaml, tempfile\nyaml.load(open('a'))\nyaml.load(open('a'), Loader=yaml.SafeLoader)\ntempfile.mktemp()\n",
    "def broken{n}(:\n",
]


def python_files(spark, sf_dir):
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", rows=5_000)
    n = F.col("c_custkey").cast("string")
    shape = F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("c_custkey") % len(TEMPLATES)).cast("int"))
    text = F.replace(F.replace(F.replace(shape, F.lit("{n}"), n), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    folder = F.when(F.col("c_custkey") % 3 == 0, "scripts").otherwise("app")
    return c.select(F.concat(folder, F.lit("/m"), n, F.lit(".py")).alias("path"), text.alias("text"))


_HITS = {
    0: [("sast", "COMMAND_INJECTION", 3, 1)], 2: [("sast", "UNSAFE_DESERIALIZATION", 3, 1), ("sast", "DYNAMIC_CODE_EXEC", 4, 1)],
    3: [("sast", "TLS_VERIFY_DISABLED", 2, 5)], 4: [("sast", "PATH_TRAVERSAL", 2, 1)], 5: [("sast", "SQL_INJECTION", 4, 1)], 6: [("sast", "UNSAFE_YAML_LOAD", 2, 1), ("sast", "INSECURE_TEMP_FILE", 4, 1)],
}
_SAST_SQL = " UNION ALL ".join(
    f"SELECT folder || '/m' || k || '.py' AS path, 'SAST.PYTHON.{rule}' AS rule_id, {line}::BIGINT AS line, {col}::BIGINT AS col, " + ("CASE WHEN folder = 'scripts' THEN 'LOW' ELSE 'MEDIUM' END" if rule == "PATH_TRAVERSAL" else f"'{python_code.RATING[rule][0]}'") + f" AS severity FROM c WHERE k % {len(TEMPLATES)} = {k}"
    for k, rows in _HITS.items() for _, rule, line, col in rows
)


@query(f"WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'scripts' ELSE 'app' END AS folder FROM customer) {_SAST_SQL}")
def sast_python_taint(spark, sf_dir):
    return python_code.scan(python_files(spark, sf_dir)).where("kind = 'sast'").select("path", "rule_id", "line", "col", "severity")


_BEHAVIOUR = {0: [("PROCESS_EXEC", 3, 1), ("SHELL_EXEC", 3, 1)], 1: [("PROCESS_EXEC", 3, 1), ("SHELL_EXEC", 3, 1)], 2: [("DYNAMIC_CODE", 4, 1)], 3: [("NETWORK_REQUEST", 2, 5), ("PROCESS_EXEC", 5, 1), ("DOWNLOAD_EXECUTE", 5, 1)]}
_BEHAVIOUR_SQL = " UNION ALL ".join(f"SELECT folder || '/m' || k || '.py' AS path, 'BEHAVIOR.{rule}' AS rule_id, {line}::BIGINT AS line, {col}::BIGINT AS col FROM c WHERE k % {len(TEMPLATES)} = {k}" for k, rows in _BEHAVIOUR.items() for rule, line, col in rows)


@query(f"WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'scripts' ELSE 'app' END AS folder FROM customer) {_BEHAVIOUR_SQL}")
def behavior_python_ast(spark, sf_dir):
    return python_code.scan(python_files(spark, sf_dir)).where("kind = 'behavior'").select("path", "rule_id", "line", "col")


@query(f"SELECT CASE WHEN c_custkey % {len(TEMPLATES)} = 7 THEN 'PARSE_ERROR' ELSE 'COMPLETE' END AS status, count(*) AS n FROM customer GROUP BY ALL")
def python_scan_coverage(spark, sf_dir):
    files = python_code.scan(python_files(spark, sf_dir)).groupBy("path").agg(F.max("status").alias("status"))
    return files.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT 'req/' || p_partkey || '.txt' AS path, unnest(['flask', 'idna', 'urllib3', 'other/x.txt', NULL]) AS name, unnest(['==1.' || p_size, '>=3.5', NULL, NULL, NULL]) AS spec, unnest(['OK', 'OK', 'OK', 'INCLUDE', 'UNSUPPORTED_OPTION']) AS status FROM part""")
def manifest_requirements(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("# pins\nflask==1."), F.col("p_size").cast("string"), F.lit("\nidna>=3.5 ; python_version > '3'\nurllib3[socks]\n-r other/x.txt\n--index-url https://h\n"))
    files = p.select(F.concat(F.lit("req/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"), text.alias("text"))
    return manifests.requirements(files).select("path", "name", "spec", "status")


@query("""SELECT 'web/' || s_suppkey || '/package.json' AS path, unnest(['lodash', 'left-pad', 'jest']) AS name, unnest(['4.17.' || s_nationkey, '^1.0.0', '~29']) AS spec, unnest(['RUNTIME', 'RUNTIME', 'DEV']) AS dep_group FROM supplier""")
def manifest_package_json(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit('{"name":"a","dependencies":{"lodash":"4.17.'), F.col("s_nationkey").cast("string"), F.lit('","left-pad":"^1.0.0"},"devDependencies":{"jest":"~29"}}'))
    files = s.select(F.concat(F.lit("web/"), F.col("s_suppkey").cast("string"), F.lit("/package.json")).alias("path"), text.alias("text"))
    return manifests.package_json(files).select("path", "name", "spec", "dep_group")


@query("""SELECT 'go/' || s_suppkey || '/go.mod' AS path, unnest(['a.b/c', 'd.e/f', 'g.h/i']) AS name, unnest(['v1.' || s_nationkey || '.0', 'v2.0.0', 'v0.1.0']) AS spec, unnest(['DIRECT', 'TRANSITIVE', 'DIRECT']) AS directness FROM supplier""")
def manifest_go_mod(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("module m\n\nrequire (\n\ta.b/c v1."), F.col("s_nationkey").cast("string"), F.lit(".0\n\td.e/f v2.0.0 // indirect\n)\nrequire g.h/i v0.1.0\n"))
    files = s.select(F.concat(F.lit("go/"), F.col("s_suppkey").cast("string"), F.lit("/go.mod")).alias("path"), text.alias("text"))
    return manifests.go_mod(files).select("path", "name", "spec", "directness")


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier)
SELECT 'rs/' || k || '/Cargo.toml' AS path, 'crates.io' AS ecosystem, unnest(['serde', 'rand']) AS name, unnest(['1.' || v, '0.8']) AS spec, unnest(['RUNTIME', 'DEV']) AS dep_group FROM s
UNION ALL SELECT 'py/' || k || '/uv.lock', 'PyPI', 'idna', '==3.' || v, 'UNKNOWN' FROM s UNION ALL SELECT 'py/' || k || '/pyproject.toml', 'PyPI', 'flask', '>=2', 'RUNTIME' FROM s
UNION ALL SELECT 'js/' || k || '/package-lock.json', 'npm', 'lodash', '4.' || v, 'UNKNOWN' FROM s""")
def manifest_parse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("v"))
    kinds = F.array(
        F.struct(F.concat(F.lit("rs/"), "k", F.lit("/Cargo.toml")).alias("path"), F.concat(F.lit('[dependencies]\nserde = "1.'), "v", F.lit('"\n[dev-dependencies]\nrand = { version = "0.8" }\n')).alias("text")),
        F.struct(F.concat(F.lit("py/"), "k", F.lit("/uv.lock")).alias("path"), F.concat(F.lit('[[package]]\nname = "idna"\nversion = "3.'), "v", F.lit('"\n')).alias("text")),
        F.struct(F.concat(F.lit("py/"), "k", F.lit("/pyproject.toml")).alias("path"), F.lit('[project]\nname = "a"\ndependencies = ["flask>=2"]\n').alias("text")),
        F.struct(F.concat(F.lit("js/"), "k", F.lit("/package-lock.json")).alias("path"), F.concat(F.lit('{"packages":{"":{},"node_modules/lodash":{"version":"4.'), "v", F.lit('"}}}')).alias("text")),
    )
    return manifests.parsed(s.select(F.inline(kinds))).select("path", "ecosystem", "name", "spec", "dep_group")


@query(f"""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'scripts' ELSE 'app' END || '/m' || c_custkey || '.py' AS path, CASE WHEN c_custkey % {len(TEMPLATES)} = 3 THEN 'EDITED' WHEN c_custkey % {len(TEMPLATES)} = 7 THEN 'UNPARSED' ELSE 'UNCHANGED' END AS status,
  CASE WHEN c_custkey % {len(TEMPLATES)} = 3 THEN replace(replace('{TEMPLATES[3].replace("'", "''")}', '{{n}}', c_custkey::VARCHAR), 'False', 'True') ELSE '' END AS edited FROM customer""")
def patch_tls_edit(spark, sf_dir):
    """Every file with what the one deterministic edit makes of it."""
    rows = python_code.tls_edits(python_files(spark, sf_dir))
    return rows.select("path", "status", F.when(F.col("status") == "EDITED", F.col("text")).otherwise("").alias("edited"))
