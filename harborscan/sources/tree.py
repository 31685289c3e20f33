"""Files below a folder as a table, by a scan that never lists what is out of scope.

A Python data source: Spark asks it for partitions, one for each subtree, and tasks walk them. A folder that the scope
leaves out gives one row and is not entered, unless an include names something below it. Filters on ``path`` (equality,
prefix) and on ``entry`` are pushed into the walk, so a prefix lists its own subtree only. Any store that Arrow opens will do.

Rows: path (relative, with slashes), entry (FILE, EXCLUDED, LINK, LISTED: a folder that was listed), reason, size_bytes,
modified. Children come in the order of (casefold, name). The driver lists no more folders than it takes to find ``splits``
subtrees. Names that must not become part of a path are left out, with the reason UNSAFE_NAME.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from harborscan.operators.discovery import SCOPE, SCOPE_FILES, SCOPE_REASON, checked_pattern, glob_expression, ignore_rules

SCHEMA = "path string, entry string, reason string, size_bytes long, modified timestamp"
SPLITS = 64


class Scope:
    """``discovery.scope_of``, ``may_hold_included`` and ``ignored`` for one path at a time, as a walk needs them."""

    def __init__(self, include: list[str], exclude: list[str], ignore: list[tuple[bool, str]] = ()):
        self.include, self.exclude = ([checked_pattern(p) for p in ps] for ps in (include, exclude))
        self.ignore = [(negated, checked_pattern(p)) for negated, p in ignore]
        self.folders = {name: f"EXCLUDED_DEFAULT_{SCOPE_REASON[scope]}" for scope, names in reversed(SCOPE.items()) for name in names}
        self.files = {pattern: f"EXCLUDED_DEFAULT_{SCOPE_REASON[scope]}" for pattern, scope in SCOPE_FILES.items()}

    @staticmethod
    def matches(pattern: str, path: str, folder: bool) -> bool:
        parts, base = path.split("/"), pattern.rstrip("/")
        if pattern.endswith("/"):
            return path == base or path.startswith(base + "/") if "/" in base else base in (parts if folder else parts[:-1])
        expression = re.compile(glob_expression(pattern).removesuffix("$") + r"\Z")
        return bool(expression.match(path)) if "/" in pattern else any(map(expression.match, parts))

    def reason(self, path: str, folder: bool) -> str | None:
        """Why the path is out of scope, or None."""
        if any(self.matches(p, path, folder) for p in self.include):
            return None
        parts = path.split("/")
        named = [self.folders[p] for p in (parts if folder else parts[:-1]) if p in self.folders]
        if named:
            order = list(dict.fromkeys(self.folders[n] for names in SCOPE.values() for n in names))
            return min(named, key=order.index)
        if not folder:
            for pattern, why in self.files.items():
                if self.matches(pattern, parts[-1], False):
                    return why
        if any(self.matches(p, path, folder) for p in self.exclude):
            return "EXCLUDED_USER_POLICY"
        last = next((negated for negated, p in reversed(self.ignore) if self.matches(p, path, folder)), True)
        return None if last else "EXCLUDED_GITIGNORE"

    def enters(self, folder: str) -> bool:
        """Whether a folder is listed: it is in scope, or something below it may be."""
        why = self.reason(folder, True)
        if why is None or any(p.startswith(folder + "/") for p in self.include):
            return True
        return why == "EXCLUDED_GITIGNORE" and any(negated for negated, _ in self.ignore)

    def admits(self, path: str) -> bool:
        return not self.include or any(self.matches(p, path, False) for p in self.include)


def source() -> type[DataSource]:
    """The data source's class, made here so that it is sent as it is to wherever Spark runs it."""

    class Subtree(InputPartition):
        def __init__(self, folder: str | None, files: list = ()):
            self.folder, self.files = folder, files

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.root = options["root"].rstrip("/")
            self.scope = Scope(json.loads(options.get("include", "[]")), json.loads(options.get("exclude", "[]")), [tuple(x) for x in json.loads(options.get("ignore", "[]"))])
            self.splits = int(options.get("splits", SPLITS))
            self.prefix, self.entry, self.fs = "", None, None

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                    self.prefix = max(self.prefix, f.value, key=len)
                elif isinstance(f, EqualTo) and f.attribute == ("entry",) and self.entry is None:
                    self.entry = f.value
                    continue
                elif isinstance(f, EqualTo) and f.attribute == ("path",):
                    self.prefix = max(self.prefix, f.value, key=len)
                yield f  # Spark tests these as well

        def _children(self, folder: str) -> list:
            import os

            from pyarrow import fs

            if self.fs is None:
                self.fs, self.base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
            infos = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{folder}".rstrip("/"), recursive=False))
            found = []
            for i in infos:
                name = i.path.rsplit("/", 1)[-1]
                link = isinstance(self.fs, fs.LocalFileSystem) and os.path.islink(i.path)
                found.append((name.casefold(), name, "LINK" if link else "FOLDER" if i.type == fs.FileType.Directory else "FILE", i.size, i.mtime))
            return [(f"{folder}/{name}" if folder else name, kind, size, at) for _, name, kind, size, at in sorted(found, key=lambda x: x[:2])]

        def _wanted(self, folder: str) -> bool:
            """Whether the pushed prefix may lie below the folder, or the folder below the prefix."""
            return not folder or f"{folder}/".startswith(self.prefix) or self.prefix.startswith(f"{folder}/")

        def _listed(self, folder: str):
            """Rows of a folder's own entries, and the folders below it that are to be listed."""
            rows, below = [(folder, "LISTED", None, None, None)], []
            for path, kind, size, at in self._children(folder):
                if re.search(r"[\x00\\\n\r]", path):
                    rows.append((path, "EXCLUDED", "UNSAFE_NAME", None, None))
                elif kind == "LINK":
                    rows.append((path, "LINK", None, None, at))
                elif kind == "FOLDER":
                    why = self.scope.reason(path, True)
                    if self.scope.enters(path):
                        below += [path] if self._wanted(path) else []
                    elif why:
                        rows.append((path, "EXCLUDED", why, None, at))
                else:
                    why = self.scope.reason(path, False)
                    if why or self.scope.admits(path):
                        rows.append((path, "EXCLUDED" if why else "FILE", why, size, at))
            return [r for r in rows if self.entry in (None, r[1])], below

        def partitions(self):
            done, waiting = [], [""]
            while waiting and len(waiting) < self.splits:
                rows, below = self._listed(waiting.pop(0))
                done += rows
                waiting += below
                if len(done) > 10_000:  # the driver keeps no more rows than that; the rest is walked by tasks
                    break
            self.fs = None
            return [Subtree(None, done), *(Subtree(f) for f in waiting)]

        def read(self, partition):
            yield from partition.files
            waiting = [] if partition.folder is None else [partition.folder]
            while waiting:
                rows, below = self._listed(waiting.pop())
                yield from rows
                waiting += reversed(below)

    class Tree(DataSource):
        @classmethod
        def name(cls):
            return "harborscan_tree"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    return Tree


def files_of(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), gitignore: str | None = None, splits: int = SPLITS) -> DataFrame:
    """The scan as a table; gitignore is the text of the root's ignore file."""
    for pattern in (*include, *exclude):
        checked_pattern(pattern)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source())
    given = {"root": root, "include": json.dumps(list(include)), "exclude": json.dumps(list(exclude)), "ignore": json.dumps(ignore_rules(gitignore)), "splits": str(splits)}
    return spark.read.format("harborscan_tree").options(**given).load()
