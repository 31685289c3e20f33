"""Inventory, classification, scope and budgets of files, and their lines."""

from __future__ import annotations

import codecs
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from harborscan.functions.exprs import running_total

# Suffixes and names that tell a file's language and kind.
LANGUAGES = {
    "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "ps1": "powershell", "psm1": "powershell", "bat": "batch", "cmd": "batch", "sh": "shell", "bash": "shell", "c": "c", "h": "c",
    "cpp": "c++", "cc": "c++", "cxx": "c++", "hpp": "c++", "cs": "c#", "java": "java", "kt": "kotlin", "kts": "kotlin", "go": "go", "rs": "rust", "rb": "ruby",
    "php": "php", "swift": "swift", "sql": "sql", "html": "html", "htm": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "xml": "xml", "md": "markdown", "markdown": "markdown",
}
SCRIPTS = ["python", "javascript", "powershell", "batch", "shell"]
MANIFESTS = ["pyproject.toml", "requirements.txt", "pipfile", "package.json", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "gemfile", "composer.json"]
LOCKS = ["poetry.lock", "uv.lock", "pipfile.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "packages.lock.json", "gemfile.lock", "composer.lock"]
SOURCE_SUFFIXES = ["c", "h", "cpp", "cc", "cxx", "hpp", "cs", "java", "kt", "kts", "go", "rs", "rb", "php", "swift", "sql"]
CONFIG_SUFFIXES = ["json", "yaml", "yml", "toml", "xml", "ini", "cfg", "conf", "properties"]
SCRIPT_SOURCE_SUFFIXES = ["py", "pyw", "js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "cts"]
SCOPE = {
    "CACHE": [".uv-cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".pyright", ".pyre", "__pycache__", ".cache", ".tox", ".nox"],
    "ENVIRONMENT": [".venv", "venv", "env"],
    "DEPENDENCY_VENDOR": ["node_modules"],
    "BUILD_OUTPUT": ["dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit", "coverage", "htmlcov"],
    "GENERATED": [".git", ".hg", ".svn", ".pytest-tmp"],
}
SCOPE_REASON = {"CACHE": "CACHE", "ENVIRONMENT": "ENVIRONMENT", "DEPENDENCY_VENDOR": "VENDOR", "BUILD_OUTPUT": "BUILD", "GENERATED": "GENERATED"}
#: Magic bytes (hex) and what they tell.
MAGIC = {
    "4D5A": "pe", "7F454C46": "elf", "FEEDFACE": "mach_o", "CEFAEDFE": "mach_o", "FEEDFACF": "mach_o", "CFFAEDFE": "mach_o", "504B0304": "zip", "1F8B": "gzip",
    "255044462D": "pdf", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg",
}
SCOPE_FILES = {".coverage": "GENERATED", "coverage.xml": "GENERATED", "*.tsbuildinfo": "GENERATED"}
WINDOWS_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10))]
BEHAVIOR_LANGUAGES = ["python", "powershell", "batch", "shell", "javascript", "typescript", "jsx", "tsx"]
GITIGNORE_BYTES, GITIGNORE_LINES = 64 * 1024, 1024


def name_of(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def suffix_of(path: Column) -> Column:
    """The last suffix of the file name without its dot; none for names that only begin with a dot."""
    return F.regexp_extract(name_of(path), r"^.+\.([^.]+)$", 1)


def in_list(column: Column, values: list[str]) -> Column:
    return column.isin(*values)


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, suffix_of(path))


def kind_of(path: Column, language: Column, magic: Column | None = None, name: Column | None = None, suffix: Column | None = None) -> Column:
    """The kind of a text file (or of a binary one where magic is given); the order of the cases matters. Where a table has
    name_of and suffix_of the path as columns, they are not worked out for each case."""
    name, suffix = name_of(path) if name is None else name, suffix_of(path) if suffix is None else suffix
    start = F.when(magic.isin("pe", "elf", "mach_o"), "EXECUTABLE").when(magic.isin("zip", "gzip"), "ARCHIVE") if magic is not None else F.when(F.lit(False), "")
    script = language.isin(*SCRIPTS)
    return (
        start.when(name.isin(*LOCKS), "LOCKFILE")
        .when(name.isin(*MANIFESTS) | (name.startswith("requirements-") & name.endswith(".txt")) | (suffix == "csproj"), "DEPENDENCY_MANIFEST")
        .when((name == ".env") | name.startswith(".env."), "ENV_FILE")
        .when(name.isin("id_rsa", "id_ed25519") | suffix.isin("key", "p12", "pfx") | name.startswith("private."), "KEY_MATERIAL_LIKE")
        .when(suffix.isin("crt", "cer", "pem"), "CERTIFICATE_LIKE")
        .when(F.lower(path).startswith(".github/workflows/") & suffix.isin("yml", "yaml"), "CI_CONFIG")
        .when(name.isin("dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), "CONTAINER_CONFIG")
        .when(name.isin("makefile", "nginx.conf"), "CONFIG")
        .when(suffix.isin("md", "markdown", "rst", "txt"), "DOCUMENTATION")
        .when(script & suffix.isin(*SCRIPT_SOURCE_SUFFIXES), "SOURCE_CODE").when(script, "SCRIPT")
        .when(suffix.isin(*SOURCE_SUFFIXES), "SOURCE_CODE").when(suffix.isin(*CONFIG_SUFFIXES), "CONFIG").otherwise("UNKNOWN")
    )


def magic_of(content: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MAGIC.items() for x in pair))
    return F.try_element_at(table, F.regexp_extract(F.hex(F.substring(content, 1, 8)), f"^({'|'.join(MAGIC)})", 1))


def inventory(artifacts: DataFrame) -> DataFrame:
    """path, size_bytes, depth, suffix, language, kind of text artifacts (path, text)."""
    a = artifacts.select("path", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes")).withColumn("language", language_of(F.col("path")))
    return a.select("path", "size_bytes", F.size(F.split("path", "/")).cast("long").alias("depth"), suffix_of(F.col("path")).alias("suffix"), "language", kind_of(F.col("path"), F.coalesce("language", F.lit(""))).alias("kind"))


def checked_pattern(pattern: str) -> str:
    """A path pattern as it is matched; an unsafe one (absolute, with a drive, NUL or parent step) is an error."""
    p = pattern.replace("\\", "/")
    if not p or p[0] == "/" or ":" in p or "\0" in p or ".." in p.split("/"):
        raise ValueError("unsafe discovery pattern")
    return p[2:] if p.startswith("./") else p


def glob_expression(pattern: str) -> str:
    """An anchored expression of a shell pattern in which * and ? also stand for slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    return f"(?s)^{out}$"


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def glob_matches(pattern: str, path: Column, folder: bool = False) -> Column:
    """Whether a pattern matches a relative path: ``name/`` any folder of that name and all below it, ``a/b/`` that
    folder and all below, a pattern without a slash any part of the path, others the whole path."""
    p = checked_pattern(pattern)
    base = p.rstrip("/")
    if p.endswith("/"):
        if "/" in base:
            return (path == base) | path.startswith(base + "/")
        return F.array_contains(F.split(path, "/") if folder else _folders(path), base)
    if "/" not in p:
        return F.exists(F.split(path, "/"), lambda part: part.rlike(glob_expression(p)))
    return path.rlike(glob_expression(p))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scope_of(path: Column, include: list[str] = (), exclude: list[str] = (), folder: bool = False) -> Column:
    """Why a path is out of scope, or null: trusted includes win, then default folders and files, then the user's patterns."""
    out = F.when(_any(glob_matches(i, path, folder) for i in include), F.lit(None).cast("string"))
    under = lambda names: rf"(?:^|/)(?:{'|'.join(map(re.escape, names))})(?:/{'|' + chr(92) + 'z' if folder else ''})"
    which = F.lit(None).cast("string")
    for scope, names in reversed(SCOPE.items()):
        which = F.when(path.rlike(under(names)), f"EXCLUDED_DEFAULT_{SCOPE_REASON[scope]}").otherwise(which)
    out = out.when(path.rlike(under([n for names in SCOPE.values() for n in names])), which)  # one look for most paths
    if not folder:
        name = F.substring_index(path, "/", -1)
        for pattern, scope in SCOPE_FILES.items():
            out = out.when(name.rlike(glob_expression(pattern)), f"EXCLUDED_DEFAULT_{SCOPE_REASON[scope]}")
    return out.when(_any(glob_matches(e, path, folder) for e in exclude), "EXCLUDED_USER_POLICY")


def may_hold_included(folder: Column, include: list[str]) -> Column:
    """Whether an excluded folder is entered all the same: an include matches it, or names something below it."""
    below = [F.lit(checked_pattern(i)).startswith(F.concat(folder, F.lit("/"))) for i in include]
    return _any([glob_matches(i, folder, True) for i in include] + below)


def admits(path: Column, include: list[str] = ()) -> Column:
    """Without includes every file; else those that an include matches."""
    return _any(glob_matches(i, path) for i in include) if include else F.lit(True)


def ignore_rules(text: str | None) -> list[tuple[bool, str]]:
    """(negated, pattern) of a root ignore file, which is bounded; what cannot be understood is an error, not a guess."""
    if text is None:
        return []
    lines = text.removeprefix("\ufeff").splitlines()
    if len(text.encode()) > GITIGNORE_BYTES or len(lines) > GITIGNORE_LINES:
        raise ValueError("unavailable gitignore")
    out = []
    for line in filter(lambda x: x and not x.startswith("#"), map(str.strip, lines)):
        pattern = line.removeprefix("!")
        if not pattern or "[" in pattern or "]" in pattern:
            raise ValueError("unsupported gitignore pattern")
        checked_pattern(pattern)
        out.append((line != pattern, pattern))
    return out


def root_ignore(artifacts: DataFrame) -> list[tuple[bool, str]]:
    """The rules of the artifact ``.gitignore``: one row of bounded size."""
    row = artifacts.where("path = '.gitignore'").select(F.substring("text", 1, GITIGNORE_BYTES + 1)).first()
    return ignore_rules(row[0] if row else None)


def ignored(path: Column, rules: list[tuple[bool, str]], folder: bool = False) -> Column:
    """Whether the last rule that matches is no negation."""
    out = F.when(F.lit(False), F.lit(False))
    for negated, pattern in reversed(rules):
        out = out.when(glob_matches(pattern, path, folder), F.lit(not negated))
    return out.otherwise(F.lit(False))


def unsafe_component(name: Column, windows: bool = False) -> Column:
    """Whether a name must not become part of a path."""
    bad = name.isNull() | name.isin("", ".", "..") | name.rlike(r"[\x00/\\]")
    if windows:
        bad = bad | name.rlike(r":|[. ]$") | F.upper(F.substring_index(name, ".", 1)).isin(*WINDOWS_NAMES)
    return F.coalesce(bad, F.lit(True))


def shebang_language(line: Column) -> Column:
    """The language that a first line names, with ``env`` and its options looked through."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(F.substring(line, 3, 4096)), F.lit("\\"), F.lit("/")), r"\s+", " ")), " ")
    base = lambda w: F.substring_index(w, "/", -1)
    rest = F.filter(F.slice(words, 2, 1000), lambda w: ~w.startswith("-"))
    tool = F.when((base(F.get(words, F.lit(0))) == "env") & (F.size(words) > 1), base(F.coalesce(F.get(rest, F.lit(0)), F.lit("")))).otherwise(base(F.get(words, F.lit(0))))
    language = (
        F.when(tool.startswith("python"), "python").when(tool.isin("node", "nodejs", "deno"), "javascript").when(tool.isin("pwsh", "powershell"), "powershell")
        .when(tool.isin("bash", "sh", "zsh", "fish"), "shell").when(tool.startswith("ruby"), "ruby").when(tool.startswith("php"), "php")
    )
    return F.when(line.startswith("#!"), language)


SNIFF = "struct<content_kind:string,encoding:string,first_line:string,long_line:boolean,decode_failed:boolean>"


def _sniffed(data: bytes, longest: int) -> tuple:
    if not data:
        return ("TEXT", "utf-8", "", False, False)
    if data[:3] == b"\xef\xbb\xbf":
        encoding, body = "utf-8-sig", data
    elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding, body = "utf-16-le" if data[0] == 0xFF else "utf-16-be", data[2:]
    elif 0 in data:
        nulls = data[0::2].count(0), data[1::2].count(0)
        if max(nulls) < len(data) // 4 or min(nulls) > len(data) // 16:
            return ("BINARY", None, None, False, False)
        encoding, body = "utf-16-le" if nulls[1] > nulls[0] else "utf-16-be", data
    else:
        encoding, body = "utf-8", data
    try:
        text = codecs.getincrementaldecoder(encoding)("strict").decode(body)
    except UnicodeError:
        return ("UNKNOWN", None, None, False, True)
    if text and 20 * len(re.sub(r"[^\x00-\x08\x0b\x0e-\x1f]", "", text)) > len(text):
        return ("BINARY", None, None, False, False)
    first = text.partition("\n")[0].rstrip("\r")
    return ("TEXT", encoding, None, True, False) if len(first) > longest else ("TEXT", encoding, first, False, False)


def sniff(content: Column, prefix: int = 8192, longest: int = 8192) -> Column:
    """What the first bytes of a file tell: magic bytes by expression, else encoding and first line by one decode of the
    prefix for each row (a strict decode has no expression)."""

    @F.pandas_udf(SNIFF)
    def decoded(heads: pd.Series) -> pd.DataFrame:
        if heads.isna().all():  # none that needs a look
            return pd.DataFrame({"content_kind": "TEXT", "encoding": "utf-8", "first_line": "", "long_line": False, "decode_failed": False}, index=heads.index)
        return pd.DataFrame([_sniffed(bytes(h) if h is not None else b"", longest) for h in heads], columns=["content_kind", "encoding", "first_line", "long_line", "decode_failed"])

    head = F.substring(content, 1, prefix)
    known = F.lit(None).cast("string")
    binary = F.struct(F.lit("BINARY"), known, known, F.lit(False), F.lit(False)).cast(SNIFF)
    return F.when(magic_of(head).isNotNull(), binary).otherwise(decoded(head))


def in_tests(path: Column) -> Column:
    """Paths whose secrets may be made up: test folders, and file names of test runners."""
    name = name_of(path)
    return F.lower(path).rlike(r"(?:^|/)tests?/") | name.startswith("test_") | name.endswith("_test.py") | name.rlike(r"\.(test|spec)\.(js|jsx|ts|tsx|mjs|mts|cjs|cts)$")


def tagged_as_test(path: Column) -> Column:
    """Paths that a report marks as test code: the folders alike, but other names."""
    return F.arrays_overlap(F.transform(_folders(path), F.lower), F.array(F.lit("test"), F.lit("tests"))) | name_of(path).rlike(r"\.(test|spec)\.")


def admission_of(scanner: str) -> Column:
    """Whether a scanner takes a file, by kind, language, content_kind and encoding."""
    text = (F.col("content_kind") == "TEXT") & F.col("encoding").isNotNull()
    kind, language = F.col("kind"), F.coalesce("language", F.lit(""))
    takes = {
        "secrets": ~kind.isin("ARCHIVE", "BINARY", "EXECUTABLE"), "sast": (language == "python") & kind.isin("SOURCE_CODE", "SCRIPT"),
        "behavior": kind.isin("SOURCE_CODE", "SCRIPT", "CONFIG", "CI_CONFIG", "CONTAINER_CONFIG") & (language.isin(*BEHAVIOR_LANGUAGES) | (kind == "CI_CONFIG")),
        "dependencies": kind.isin("DEPENDENCY_MANIFEST", "LOCKFILE"),
    }
    return F.coalesce(text & takes[scanner], F.lit(False))


def admissions(files: DataFrame) -> DataFrame:
    """Which scanner takes which file: path, kind, language, content_kind, encoding and one boolean for each scanner."""
    scanners = [admission_of(s).alias(s) for s in ("secrets", "sast", "behavior", "dependencies")]
    return files.select("path", *scanners, in_tests(F.col("path")).alias("in_tests"), tagged_as_test(F.col("path")).alias("tagged_as_test"))


def admitted(files: DataFrame, max_file: int, max_total: int) -> DataFrame:
    """path, size_bytes, running_bytes, state: files in path order until the running total passes ``max_total``.

    Larger files than ``max_file`` are skipped and take nothing from the total. The first file that passes it and all
    after are aborted.
    """
    counted = files.withColumn("__size", F.when(F.col("size_bytes") <= max_file, F.col("size_bytes")).otherwise(0)).withColumn("__key", F.lower("path"))
    total = running_total(counted, ["__key", "path"], F.col("__size"), "running_bytes")
    state = F.when(F.col("size_bytes") > max_file, "SKIPPED_SIZE").when(F.col("running_bytes") > max_total, "ABORTED_BUDGET").otherwise("ADMITTED")
    return total.select("path", "size_bytes", F.col("running_bytes").cast("long").alias("running_bytes"), state.alias("state"))


def capped(files: DataFrame, max_depth: int, max_files: int) -> DataFrame:
    """path, place, state: files in path order; those too deep are skipped, those after ``max_files`` others aborted."""
    deep = F.size(F.split("path", "/")) - 1 > max_depth
    numbered = running_total(files.select("path", F.lower("path").alias("__key"), deep.alias("__deep")), ["__key", "path"], (~F.col("__deep")).cast("int"), "place")
    state = F.when(F.col("__deep"), "DEPTH_LIMIT_REACHED").when(F.col("place") > max_files, "FILE_LIMIT_REACHED").otherwise("ADMITTED")
    return numbered.select("path", F.col("place").cast("long").alias("place"), state.alias("state"))


def exclusion_list(excluded: DataFrame, most: int = 200) -> DataFrame:
    """path, reason, n_omitted: the first exclusions in path order (a bounded list) with the number of those left out."""
    total = excluded.agg(F.count("*").alias("__n"))
    first = excluded.orderBy(F.lower("path"), "path").limit(most)
    return first.join(F.broadcast(total)).select("path", "reason", F.greatest(F.col("__n") - most, F.lit(0)).alias("n_omitted"))  # one row


def traversal_stats(files: DataFrame) -> DataFrame:
    """One row of counters over path, size_bytes, reason (null: in scope) and state."""
    inside = F.col("reason").isNull()
    ok = inside & (F.col("state") == "ADMITTED")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    return files.agg(
        F.count("*").alias("entries_seen"), F.countDistinct(folder).alias("directories_seen"), F.count_if(ok).alias("files_admitted"), F.count_if(~ok).alias("files_skipped"),
        F.count_if(~inside).alias("files_excluded"), F.count_if(inside & (F.col("state") == "SKIPPED_SIZE")).alias("files_too_large"), F.count_if(inside & F.col("state").startswith("ABORTED")).alias("files_aborted"),
        F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)).alias("bytes_admitted"), F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(0)).cast("long").alias("deepest"),
    )


def lines(artifacts: DataFrame, *more: str) -> DataFrame:
    """path, line, text, n_bytes: a file's lines, ended by LF only; bytes count the end. No line follows a last LF."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = artifacts.select("path", *more, F.size(parts).alias("__n"), F.posexplode(parts).alias("__at", "__line"))
    rows = rows.where("NOT (__at = __n - 1 AND __line = '')")
    return rows.select("path", *more, (F.col("__at") + 1).cast("long").alias("line"), F.col("__line").alias("text"), (F.octet_length("__line") + F.when(F.col("__at") < F.col("__n") - 1, 1).otherwise(0)).cast("long").alias("n_bytes"))


def line_profile(artifacts: DataFrame, long_line: int = 16384) -> DataFrame:
    """Per file: lines, bytes of the longest, lines over the limit. Folded in the row: no line leaves it."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    sized = artifacts.select("path", F.transform(parts, lambda x, i: (F.octet_length(x) + F.when(i < F.size(parts) - 1, 1).otherwise(0)).cast("long")).alias("b"))
    solid = F.filter("b", lambda x: x > 0)
    return sized.select("path", F.size(solid).cast("long").alias("n_lines"), F.coalesce(F.array_max(solid), F.lit(0)).cast("long").alias("max_line_bytes"), F.size(F.filter(solid, lambda x: x > long_line)).cast("long").alias("long_lines"))
