"""Virtual source trees and inventories, derived row by row from the given tables. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from harborscan.functions.scratch import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path and content of the files below a folder, by Spark's reader (any store that Spark opens)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return files.select("path", "length", "modificationTime", "content")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: documents, pages and conversation turns as files."""
    d, p, c = (table(spark, sf_dir, n) for n in ("documents", "pages", "conversations"))
    docs = d.select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    pages = p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    turns = c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), "text")
    return docs.unionAll(pages).unionAll(turns)


ARTIFACTS_SQL = """artifacts AS (
  SELECT 'docs/' || source || '/' || doc_id || '.txt' AS path, text FROM documents
  UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages
  UNION ALL SELECT 'conv/' || conv_id || '/' || turn || '.md', text FROM conversations)"""


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, text: one shell file for each user of events."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    secret = F.concat(F.lit("password = 'Aa9_"), F.substring(F.md5(n), 1, 16), F.lit("'"))
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("curl https://h/"), n)).when(kind == "error", F.concat(F.lit("rm -rf ./b"), n)).when(kind == "signup", F.lit('eval "$X"'))
        .when(kind == "view", F.lit("echo ok")).when(F.col("event_id") % 5 == 0, secret).otherwise(F.lit("bash -c 'x'"))
    )
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.concat(F.lit("svc/u"), F.col("user_id").cast("string"), F.lit(".sh")).alias("path"), line.cast("long").alias("line"), text.alias("text"))


CODE_LINES_SQL = """code_lines AS (
  SELECT 'svc/u' || user_id || '.sh' AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
         CASE event_type WHEN 'click' THEN 'curl https://h/' || event_id WHEN 'error' THEN 'rm -rf ./b' || event_id
              WHEN 'signup' THEN 'eval "$X"' WHEN 'view' THEN 'echo ok'
              ELSE CASE WHEN event_id % 5 = 0 THEN 'password = ''Aa9_' || substr(md5(event_id::VARCHAR), 1, 16) || '''' ELSE 'bash -c ''x''' END END AS text
  FROM events)"""


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, text: one settings file for each nation, a line for each customer, with credential shapes made from hashes."""
    c = table(spark, sf_dir, "customer")
    h = F.md5(F.col("c_custkey").cast("string"))
    k = F.col("c_custkey") % 11
    text = (
        F.when(k == 0, F.concat(F.lit("gh = ghp_"), h, F.substring(h, 1, 4)))
        .when(k == 1, F.concat(F.lit("id: AKIA"), F.upper(F.substring(h, 1, 16))))
        .when(k == 2, F.concat(F.lit("pay sk_live_"), F.substring(h, 1, 24), F.lit(" sk_test_"), h))
        .when(k == 3, F.concat(F.lit("hook xoxb-"), F.substring(h, 1, 20)))
        .when(k == 4, F.concat(F.lit("ci=glpat-"), F.substring(h, 1, 20)))
        .when(k == 5, F.concat(F.lit("db postgres://app:"), F.substring(h, 1, 12), F.lit("@db/x")))
        .when(k == 6, F.concat(F.lit("jwt "), F.regexp_replace(F.base64(F.encode(F.concat(F.lit('{"alg":"'), F.substring(h, 1, 6), F.lit('"}')), "utf-8")), "=", ""), F.lit("."), F.regexp_replace(F.base64(F.encode(F.concat(F.lit('{"sub":"'), F.substring(h, 1, 9), F.lit('"}')), "utf-8")), "=", ""), F.lit("."), F.substring(h, 1, 20)))
        .when(k == 7, F.lit("-----BEGIN RSA PRIVATE KEY-----")).when(k == 8, F.lit("-----END RSA PRIVATE KEY-----"))
        .when(k == 9, F.concat(F.lit("aws_secret_access_key = "), F.lit("Zz9/"), h))
        .otherwise(F.concat(F.lit("token: <your_token> "), F.substring(h, 1, 8)))
    )
    line = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return c.select(F.concat(F.lit("cfg/n"), F.col("c_nationkey").cast("string"), F.lit(".env")).alias("path"), line.cast("long").alias("line"), text.alias("text"))


CONFIG_LINES_SQL = """config_lines AS (
  SELECT 'cfg/n' || c_nationkey || '.env' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line,
    CASE c_custkey % 11 WHEN 0 THEN 'gh = ghp_' || h || substr(h, 1, 4) WHEN 1 THEN 'id: AKIA' || upper(substr(h, 1, 16))
      WHEN 2 THEN 'pay sk_live_' || substr(h, 1, 24) || ' sk_test_' || h WHEN 3 THEN 'hook xoxb-' || substr(h, 1, 20)
      WHEN 4 THEN 'ci=glpat-' || substr(h, 1, 20) WHEN 5 THEN 'db postgres://app:' || substr(h, 1, 12) || '@db/x'
      WHEN 6 THEN 'jwt ' || replace(base64(encode('{"alg":"' || substr(h, 1, 6) || '"}')), '=', '') || '.' || replace(base64(encode('{"sub":"' || substr(h, 1, 9) || '"}')), '=', '') || '.' || substr(h, 1, 20)
      WHEN 7 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 8 THEN '-----END RSA PRIVATE KEY-----'
      WHEN 9 THEN 'aws_secret_access_key = Zz9/' || h ELSE 'token: <your_token> ' || substr(h, 1, 8) END AS text
  FROM (SELECT *, md5(c_custkey::VARCHAR) AS h FROM customer))"""


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, line, text: a PowerShell, batch and JavaScript file for each brand of part."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    group = F.col("p_partkey") % 3
    k = F.col("p_size") % 8
    target = (F.floor(F.col("p_partkey") / 3) % 2).cast("string")
    ps = F.when(k == 0, F.concat(F.lit("Invoke-WebRequest https://h -OutFile f"), target, F.lit(".exe"))).when(k == 1, F.concat(F.lit("Start-Process f"), target, F.lit(".exe"))).when(k == 2, F.lit('iex "x"')).when(k == 3, F.lit("Remove-Item a")).when(k == 4, F.lit("Set-Service s")).when(k == 5, F.lit("$env:PATH and $env:HOME")).when(k == 6, F.lit("# iex x")).otherwise(F.lit("run -enc AAAA"))
    bat = F.when(k == 0, F.lit("powershell -enc AAAA")).when(k == 1, F.lit("cmd.exe /c dir")).when(k == 2, F.lit("certutil -urlcache x")).when(k == 3, F.lit("reg add HKLM")).when(k == 4, F.lit("schtasks /create x")).when(k == 5, F.lit("del /s x")).when(k == 6, F.lit("REM cmd /c")).otherwise(F.lit("taskkill /f"))
    js = F.when(k == 0, F.lit("child_process.exec('x')")).when(k == 1, F.lit("eval (x)")).when(k == 2, F.lit("fetch(u); axios.get(u)")).when(k == 3, F.lit("fs.unlinkSync(p)")).when(k == 4, F.lit("process.env.HOME")).when(k == 5, F.lit("// eval(x)")).when(k == 6, F.lit("new Function (s)")).otherwise(F.lit("let a = 1"))
    lang = F.when(group == 0, "powershell").when(group == 1, "batch").otherwise("javascript")
    text = F.when(group == 0, ps).when(group == 1, bat).otherwise(js)
    suffix = F.when(group == 0, ".ps1").when(group == 1, ".bat").otherwise(".js")
    line = F.row_number().over(Window.partitionBy("p_brand", "language").orderBy("p_partkey"))
    rows = p.select("p_partkey", "p_brand", lang.alias("language"), suffix.alias("suffix"), text.alias("text"))
    return rows.select(F.concat(F.lit("scripts/"), F.regexp_replace("p_brand", "#", ""), F.col("suffix")).alias("path"), "language", line.cast("long").alias("line"), "text")


SCRIPT_LINES_SQL = """script_lines AS (
  SELECT 'scripts/' || replace(p_brand, '#', '') || suffix AS path, language,
         row_number() OVER (PARTITION BY p_brand, language ORDER BY p_partkey) AS line, text
  FROM (SELECT p_partkey, p_brand,
    CASE p_partkey % 3 WHEN 0 THEN 'powershell' WHEN 1 THEN 'batch' ELSE 'javascript' END AS language,
    CASE p_partkey % 3 WHEN 0 THEN '.ps1' WHEN 1 THEN '.bat' ELSE '.js' END AS suffix,
    CASE p_partkey % 3
      WHEN 0 THEN CASE p_size % 8 WHEN 0 THEN 'Invoke-WebRequest https://h -OutFile f' || (p_partkey // 3 % 2) || '.exe' WHEN 1 THEN 'Start-Process f' || (p_partkey // 3 % 2) || '.exe'
        WHEN 2 THEN 'iex "x"' WHEN 3 THEN 'Remove-Item a' WHEN 4 THEN 'Set-Service s' WHEN 5 THEN '$env:PATH and $env:HOME' WHEN 6 THEN '# iex x' ELSE 'run -enc AAAA' END
      WHEN 1 THEN CASE p_size % 8 WHEN 0 THEN 'powershell -enc AAAA' WHEN 1 THEN 'cmd.exe /c dir' WHEN 2 THEN 'certutil -urlcache x' WHEN 3 THEN 'reg add HKLM'
        WHEN 4 THEN 'schtasks /create x' WHEN 5 THEN 'del /s x' WHEN 6 THEN 'REM cmd /c' ELSE 'taskkill /f' END
      ELSE CASE p_size % 8 WHEN 0 THEN 'child_process.exec(''x'')' WHEN 1 THEN 'eval (x)' WHEN 2 THEN 'fetch(u); axios.get(u)' WHEN 3 THEN 'fs.unlinkSync(p)'
        WHEN 4 THEN 'process.env.HOME' WHEN 5 THEN '// eval(x)' WHEN 6 THEN 'new Function (s)' ELSE 'let a = 1' END END AS text
    FROM part))"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, text: one file of a single long line for every twenty users, of what their events wrote in order."""
    e = table(spark, sf_dir, "events")
    h, kind, n = F.md5(F.col("event_id").cast("string")), F.col("event_type"), F.col("event_id").cast("string")
    text = (
        F.when(kind == "click", F.concat(F.lit("ghp_"), h, F.substring(h, 1, 4))).when(kind == "error", F.concat(F.lit("password=Aa9_"), F.substring(h, 1, 16)))
        .when(kind == "signup", F.concat(F.lit("é漢 db postgres://app:"), F.substring(h, 1, 12), F.lit("@db/x"))).when(kind == "view", F.lit("token=<your_token>")).otherwise(F.concat(F.lit("ok "), n))
    )
    files = e.groupBy(F.floor(F.col("user_id") / 20).alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", text.alias("text")))).alias("a"))
    return files.select(F.concat(F.lit("log/g"), F.col("k").cast("string"), F.lit(".log")).alias("path"), F.lit(1).cast("long").alias("line"), F.array_join("a.text", " ").alias("text"))


LOG_LINES_SQL = """log_pieces AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_
  FROM (SELECT 'log/g' || (user_id // 20) || '.log' AS path, event_id, h,
    CASE event_type WHEN 'click' THEN 'ghp_' || h || substr(h, 1, 4) WHEN 'error' THEN 'password=Aa9_' || substr(h, 1, 16)
      WHEN 'signup' THEN 'é漢 db postgres://app:' || substr(h, 1, 12) || '@db/x' WHEN 'view' THEN 'token=<your_token>' ELSE 'ok ' || event_id END AS text
    FROM (SELECT *, md5(event_id::VARCHAR) AS h FROM events)))"""


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a project's files, one for each order: settings, tests, scripts, generated keys, deployments whose name
    holds their token, binaries, installed packages and notes with private keys."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("n"), F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    n, h, k, g = F.col("n").cast("string"), F.col("h"), F.col("n") % 8, F.floor(F.col("n") / 8)
    value, token = F.concat(F.lit("Aa9_"), F.substring("h", 1, 16)), F.concat(F.lit("ghp_"), h, F.substring("h", 1, 4))
    odd = g % 2 == 1
    path = (
        F.when(k == 0, F.concat(F.lit("app/"), n, F.lit("/settings.py"))).when(k == 1, F.concat(F.when(odd, "app/").otherwise("tests/"), n, F.lit("/test_login.py"))).when(k == 2, F.concat(F.lit("web/"), n, F.lit("/client.js")))
        .when(k == 3, F.concat(F.lit("gen/"), n, F.lit("/keys.py"))).when(k == 4, F.concat(F.lit("deploy/"), F.floor(g / 2).cast("string"), F.lit("/"), token, F.lit(".sh"))).when(k == 5, F.concat(F.lit("bin/"), n, F.lit(".exe")))
        .when(k == 6, F.concat(F.lit("web/node_modules/"), n, F.lit("/x.js"))).otherwise(F.concat(F.lit("docs/"), n, F.lit(".md")))
    )
    path = F.when((k == 1) & odd, F.concat(F.lit("app/"), n, F.lit("/login.py"))).otherwise(path)
    text = (
        F.when(k.isin(0, 6), F.concat(F.lit("import os\npassword = '"), value, F.lit("'\n"))).when(k == 1, F.concat(F.lit("password = 'fake-login' # "), n))
        .when(k == 2, F.concat(F.lit("const password = process.env.PW;\nconst password = '"), value, F.lit("';"))).when(k == 3, F.concat(F.when(odd, "import os").otherwise("import secrets"), F.lit("\n\napi_key = secrets.token_hex(32)\n")))
        .when(k == 4, F.concat(F.lit("export GH="), token, F.lit("\ncurl https://h/"), n, F.lit("\n"))).when(k == 5, F.concat(F.lit("MZ"), token)).otherwise(F.concat(F.lit("# "), n, F.lit("\n-----BEGIN RSA PRIVATE KEY-----\npassword = '"), value, F.lit("'\n"), F.when(odd, "").otherwise("-----END RSA PRIVATE KEY-----\n")))
    )
    return o.select(path.alias("path"), F.encode(text, "utf-8").alias("content"))


#: The same files as numbers, with what their lines hold; their texts are not made again.
PROJECT_SQL = """project AS (SELECT n, h, n % 8 AS k, n // 8 AS g, 'Aa9_' || substr(h, 1, 16) AS value, 'ghp_' || h || substr(h, 1, 4) AS token FROM (SELECT o_orderkey AS n, md5(o_orderkey::VARCHAR) AS h FROM orders)),
project_files AS (SELECT *, CASE k WHEN 0 THEN 'app/' || n || '/settings.py' WHEN 1 THEN CASE WHEN g % 2 = 1 THEN 'app/' || n || '/login.py' ELSE 'tests/' || n || '/test_login.py' END WHEN 2 THEN 'web/' || n || '/client.js' WHEN 3 THEN 'gen/' || n || '/keys.py'
  WHEN 4 THEN 'deploy/' || (g // 2) || '/' || token || '.sh' WHEN 5 THEN 'bin/' || n || '.exe' WHEN 6 THEN 'web/node_modules/' || n || '/x.js' ELSE 'docs/' || n || '.md' END AS path,
  CASE k WHEN 0 THEN 44 WHEN 1 THEN 26 + length(n::VARCHAR) WHEN 2 THEN 73 WHEN 3 THEN CASE WHEN g % 2 = 1 THEN 43 ELSE 48 END WHEN 4 THEN 67 + length(n::VARCHAR) WHEN 5 THEN 42 WHEN 6 THEN 44
    ELSE 69 + length(n::VARCHAR) + CASE WHEN g % 2 = 1 THEN 0 ELSE 30 END END AS size_bytes FROM project)"""
