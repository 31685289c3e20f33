"""Manifests to package records: line formats by expressions, TOML and nested JSON by a parser inside the task."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib

from pyspark.sql import Column, DataFrame, functions as F

RECORD = "path string, ecosystem string, name string, spec string, dep_group string, resolved boolean, directness string, status string"
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[<>=!~]=?|===|@)[^;#]*)?"


def requirements(files: DataFrame) -> DataFrame:
    """Records of requirements files (path, text): exploded lines, comments and markers cut, options told apart."""
    rows = files.select("path", F.explode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("raw"))
    line = F.trim(F.regexp_replace("raw", r"(^|\s)#.*$", ""))
    cut = rows.select("path", line.alias("line")).where("line <> ''")
    name = F.regexp_extract("line", REQUIREMENT, 1)
    spec = F.nullif(F.trim(F.regexp_extract("line", REQUIREMENT, 2)), F.lit(""))
    include = F.col("line").rlike(r"^(-r|--requirement|-c|--constraint)\s*")
    status = F.when(include, "INCLUDE").when(F.col("line").rlike(r"^(-e|--editable)\b"), "EDITABLE").when(F.col("line").startswith("-"), "UNSUPPORTED_OPTION").when(name == "", "INVALID").otherwise("OK")
    target = F.regexp_extract("line", r"^(?:-r|--requirement|-c|--constraint)\s*(\S+)", 1)
    return cut.select("path", F.lit("PyPI").alias("ecosystem"), F.when(include, target).when(status == "OK", name).alias("name"), F.when(status == "OK", spec).alias("spec"), F.lit("RUNTIME").alias("dep_group"), F.lit(False).alias("resolved"), F.lit("DIRECT").alias("directness"), status.alias("status"))


def package_json(files: DataFrame) -> DataFrame:
    """Records of package.json files: the four groups, each a map of names to specs."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>, peerDependencies map<string,string>"
    groups = [("dependencies", "RUNTIME"), ("devDependencies", "DEV"), ("optionalDependencies", "OPTIONAL"), ("peerDependencies", "PEER")]
    j = files.select("path", F.from_json("text", schema).alias("j"))
    one = lambda c, g: F.transform(F.coalesce(F.map_entries(f"j.{c}"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.lit(g).alias("dep_group")))
    rows = j.select("path", F.inline(F.concat(*(one(c, g) for c, g in groups))))
    return rows.select("path", F.lit("npm").alias("ecosystem"), "name", "spec", "dep_group", F.lit(False).alias("resolved"), F.lit("DIRECT").alias("directness"), F.lit("OK").alias("status"))


def go_mod(files: DataFrame) -> DataFrame:
    """Records of go.mod files: require and replace, as lines or blocks, and ``// indirect`` marks. A replaced package is a
    local path, whatever its version. The block is found by a fold over the lines."""
    kind = "struct<mode:string,out:array<struct<mode:string,line:string,indirect:boolean>>>"
    start = F.struct(F.lit("").alias("mode"), F.array().cast("array<struct<mode:string,line:string,indirect:boolean>>").alias("out")).cast(kind)

    def step(acc, raw):
        line = F.trim(F.regexp_replace(F.split(raw, "//")[0], r"\s+", " "))
        opens = line.rlike(r"^(require|replace) \($")
        own = F.regexp_extract(line, "^(require|replace) ", 1)
        mode = F.when(own != "", own).otherwise(acc["mode"])
        take = (line != "") & ~opens & (line != ")") & mode.isin("require", "replace")
        entry = F.struct(mode.alias("mode"), F.regexp_replace(line, "^(require|replace) ", "").alias("line"), raw.contains("// indirect").alias("indirect"))
        return F.struct(F.when(opens, own).when(line == ")", "").otherwise(acc["mode"]).alias("mode"), F.when(take, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]).alias("out")).cast(kind)

    entries = files.select("path", F.aggregate(F.split(F.coalesce("text", F.lit("")), "\r?\n"), start, step, lambda a: a["out"]).alias("e"))
    replaced = F.transform(F.filter("e", lambda x: (x["mode"] == "replace") & x["line"].contains("=>")), lambda x: F.split(x["line"], " ")[0])
    needs = F.filter("e", lambda x: (x["mode"] == "require") & (F.size(F.split(x["line"], " ")) >= 2))
    rows = entries.select("path", replaced.alias("replaced"), F.explode(needs).alias("n"))
    name, version = F.split("n.line", " ")[0], F.split("n.line", " ")[1]
    local = F.array_contains("replaced", name)
    return rows.select(
        "path", F.lit("Go").alias("ecosystem"), name.alias("name"), F.when(local, "file:replaced").otherwise(version).alias("spec"), F.when(local, "UNKNOWN").otherwise("RUNTIME").alias("dep_group"), (~local).alias("resolved"),
        F.when(F.col("n.indirect"), "TRANSITIVE").otherwise("DIRECT").alias("directness"), F.lit("OK").alias("status"),
    )


def pipfile_lock(files: DataFrame) -> DataFrame:
    """Records of Pipfile.lock files: both sections as maps; entries from a repository, folder or file are no registry pins."""
    entry = "struct<version:string,git:string,path:string,file:string>"
    schema = f"default map<string,{entry}>, develop map<string,{entry}>"
    j = files.select("path", F.from_json("text", schema).alias("j"))
    one = lambda c, g: F.transform(F.coalesce(F.map_entries(f"j.{c}"), F.array().cast(f"array<struct<key:string,value:{entry}>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v"), F.lit(g).alias("dep_group")))
    rows = j.select("path", F.inline(F.concat(one("default", "RUNTIME"), one("develop", "DEV"))))
    spec = F.when(F.col("v.git").isNotNull(), "git+").when(F.col("v.path").isNotNull(), "file:").when(F.col("v.file").isNotNull(), "https://").otherwise(F.col("v.version"))
    exact = F.coalesce(spec.rlike(r"^==\s*[A-Za-z0-9]"), F.lit(False))
    bad = files.select("path", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("j"), "text").where(F.try_parse_json("text").isNull())
    failed = bad.select("path", *(F.lit(None).cast(t).alias(c) for c, t in (("ecosystem", "string"), ("name", "string"), ("spec", "string"), ("dep_group", "string"), ("resolved", "boolean"), ("directness", "string"))), F.lit("PARSE_ERROR").alias("status"))
    return rows.select("path", F.lit("PyPI").alias("ecosystem"), "name", spec.alias("spec"), "dep_group", exact.alias("resolved"), F.lit("UNKNOWN").alias("directness"), F.lit("OK").alias("status")).unionAll(failed)


#: How an entry that is no registry pin is told: the record's spec begins with it.
_ELSEWHERE = (("git", "git+"), ("path", "file:"), ("directory", "file:"), ("editable", "file:"), ("file", "file:"), ("url", "https://"))


def _elsewhere(source) -> str | None:
    """The spec of a source that names a repository, folder or address; null for a registry's."""
    if not isinstance(source, dict):
        return None
    return next((spec for key, spec in _ELSEWHERE if key in source or source.get("type") == key), None)


def _spec(value) -> str | None:
    return _elsewhere(value) or value.get("version") if isinstance(value, dict) else value if isinstance(value, str) else None


def _toml(path: str, text: str):
    """(ecosystem, requirement or (name, spec), group or None for a lock's entry)."""
    data, name = tomllib.loads(text), posixpath.basename(path).lower()
    if name == "pyproject.toml":
        project = data.get("project", {})
        for spec in project.get("dependencies", []):
            yield "PyPI", spec, "RUNTIME"
        for specs in project.get("optional-dependencies", {}).values():
            for spec in specs:
                yield "PyPI", spec, "OPTIONAL"
        for n, v in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
            if n.lower() != "python":
                yield "PyPI", (n, _spec(v)), "RUNTIME"
    elif name == "cargo.toml":
        for key, group in (("dependencies", "RUNTIME"), ("dev-dependencies", "DEV"), ("build-dependencies", "BUILD")):
            for n, v in data.get(key, {}).items():
                yield "crates.io", (n, _spec(v)), group
    elif name in ("uv.lock", "poetry.lock"):
        for p in data.get("package", []):
            yield "PyPI", (p["name"], _elsewhere(p.get("source")) or "==" + p["version"]), None
    elif name == "cargo.lock":
        for p in data.get("package", []):
            source = p.get("source")
            yield "crates.io", (p["name"], "file:" if source is None else "git+" if source.startswith("git+") else "==" + p["version"]), None
    elif name == "pipfile":
        for key, group in (("packages", "RUNTIME"), ("dev-packages", "DEV")):
            for n, v in data.get(key, {}).items():
                yield "PyPI", (n, _spec(v)), group


def _npm_spec(entry: dict) -> str | None:
    version, url = entry.get("version"), entry.get("resolved") or ""
    if not isinstance(version, str):
        return None
    if entry.get("link") is True or version.startswith(("file:", "link:")) or url.startswith(("file:", "link:")):
        return "file:"
    if version.startswith(("git+", "git://", "github:")) or url.startswith(("git+", "git://", "github:")):
        return "git+"
    elsewhere = url.startswith(("http://", "https://")) and not url.startswith("https://registry.npmjs.org/")
    return "https://" if elsewhere or version.startswith(("http://", "https://")) else version


def _npm_lock(data: dict):
    packages = data.get("packages", {})
    root = packages.get("", {})
    named = {n for key in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies") for n in root.get(key, {})}
    for place, p in packages.items():
        if place:
            n = place.rpartition("node_modules/")[2]
            top = place == f"node_modules/{n}"
            yield n, _npm_spec(p), "DEV" if p.get("dev") else "OPTIONAL" if p.get("optional") else "UNKNOWN", "TRANSITIVE" if not top else "DIRECT" if n in named else "UNKNOWN"
    todo = [(n, p, True) for n, p in data.get("dependencies", {}).items()] if "packages" not in data else []
    while todo:
        n, p, top = todo.pop()
        yield n, _npm_spec(p), "DEV" if p.get("dev") else "OPTIONAL" if p.get("optional") else "RUNTIME", "DIRECT" if top else "TRANSITIVE"
        todo += [(k, v, False) for k, v in p.get("dependencies", {}).items()]


def _pinned(spec: str | None) -> bool:
    return spec is not None and not spec.startswith(tuple(s for _, s in _ELSEWHERE))


def parse(path: str, text: str | None) -> list[tuple]:
    """Rows of RECORD for one TOML manifest or lock, or npm lock; a bad file is one row that says so. Only registry pins of
    a lock are resolved."""
    try:
        if posixpath.basename(path) == "package-lock.json":
            data = json.loads(text or "")
            if data.get("lockfileVersion", 1) not in (1, 2, 3):
                return [(path, None, None, None, None, None, None, "UNSUPPORTED_FORMAT")]
            return [(path, "npm", n, v, g, _pinned(v), d, "OK") for n, v, g, d in _npm_lock(data)]
        out = []
        for eco, spec, group in _toml(path, text or ""):
            if isinstance(spec, str):
                m = re.match(REQUIREMENT, spec)
                spec = (m[1], (m[2] or "").strip() or None) if m else (spec, None)
            locked = group is None
            out.append((path, eco, spec[0], spec[1], group or "UNKNOWN", locked and _pinned(spec[1]), "UNKNOWN" if locked else "DIRECT", "OK"))
        return out
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return [(path, None, None, None, None, None, None, "PARSE_ERROR")]


# What record texts may hold, and the manifests that are known but not read.
CONSTRAINT_TEXT = r"^[\p{L}\p{N}<>=!~^*|.,+ _-]{0,200}$"
NPM_NAME = r"^(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*$"
UNREAD = ["yarn.lock", "pnpm-lock.yaml", "packages.lock.json", "gemfile.lock", "composer.lock", "pom.xml", "build.gradle", "build.gradle.kts", "gemfile", "composer.json", "go.sum"]


def checked(records: DataFrame) -> DataFrame:
    """Records with version, kind, identity and a safe constraint: version only of exact ones, identity by where the package
    comes from, and no constraint that is long, odd or looks like a credential. Unsafe records have the status PARSE_ERROR."""
    from harborscan.functions.exprs import redact_path
    from harborscan.operators.dependencies import normal_name, safe_exact_version, version_kind

    kind = version_kind(F.col("ecosystem"), F.col("spec"))
    version = F.when(kind == "EXACT", F.trim(F.regexp_replace("spec", "^[=v]*(?=[0-9])", "")))
    version = F.when(F.col("ecosystem") == "Go", F.when(kind == "EXACT", F.trim("spec"))).otherwise(version)
    name = normal_name(F.col("ecosystem"), F.col("name"))
    named = F.coalesce((F.length(name) <= 128) & F.when(F.col("ecosystem") == "npm", name.rlike(NPM_NAME)).otherwise(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/@~+-]*$")) & (redact_path(F.col("name")) == F.col("name")), F.lit(False))
    safe = named & (kind.isin("CONSTRAINT", "UNRESOLVED", "VCS", "LOCAL_PATH", "URL") | F.coalesce(safe_exact_version(version), F.lit(False)))
    constraint = F.when(kind.isin("EXACT", "CONSTRAINT") & F.col("spec").rlike(CONSTRAINT_TEXT) & (redact_path(F.col("spec")) == F.col("spec")), F.trim("spec"))
    identity = F.when(kind.isin("LOCAL_PATH", "VCS", "URL", "UNRESOLVED"), kind).otherwise("REGISTRY")
    ok = (F.col("status") == "OK") & safe
    return records.select(
        "path", "ecosystem", F.when(ok, name).alias("name"), F.when(ok, version).alias("version"), F.when(ok, kind).alias("kind"), F.when(ok, identity).alias("identity"), F.when(ok, constraint).alias("constraint"),
        "dep_group", "resolved", "directness", F.when(ok, "OK").when(F.col("status") == "OK", "PARSE_ERROR").otherwise(F.col("status")).alias("status"),
    )


def unread(files: DataFrame) -> DataFrame:
    """path, code of dependency files of a format that is known but not read: their packages are missing, and that is told."""
    name = F.lower(F.substring_index("path", "/", -1))
    return files.where(name.isin(*UNREAD) | name.endswith(".csproj")).select("path", F.lit("DEPENDENCY_UNSUPPORTED_FORMAT").alias("code"))


def include_target(parent: Column, reference: Column) -> Column:
    """The path that a manifest's include names, steps resolved; null if it is absolute, odd or leaves the root."""
    value = F.replace(F.trim(reference), F.lit("\\"), F.lit("/"))
    bad = (value == "") | (F.length(value) > 300) | value.startswith("/") | value.rlike(r"[:\x00-\x1f]")
    folder = F.when(parent.contains("/"), F.regexp_replace(parent, "/[^/]*$", "")).otherwise("")
    steps = F.filter(F.split(F.concat_ws("/", folder, value), "/"), lambda p: ~p.isin("", "."))
    up = F.array(F.lit(".."))
    whole = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) == 0), up).when((p == "..") & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    path = F.array_join(whole, "/")
    return F.when(~bad & (path != "") & ~path.startswith(".."), path)


def parsed(files: DataFrame) -> DataFrame:
    """Records of TOML manifests, TOML locks and npm locks (path, text)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(RECORD)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = [r for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parse(path, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)
