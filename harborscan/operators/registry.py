"""Scanners, correlation rules and advisory providers that others bring: each a name and a function from tables to a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

FINDING = ["fingerprint", "scanner_id", "category", "rule_id", "path", "line", "col", "severity", "confidence"]
EDGE = ["edge_id", "edge_type", "src", "dst", "confidence", "rule"]
ADVISORY = ["advisory_id", "ecosystem", "name", "version", "severity", "fixed"]


@dataclass(frozen=True)
class Scanner:
    """``takes`` says of a file's row whether it is scanned; ``scan`` gives findings of the files taken."""

    name: str
    takes: Callable[[], Column]
    scan: Callable[[DataFrame], DataFrame]


def _checked(df: DataFrame, columns: list[str], who: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{who} lacks {', '.join(missing)}")
    return df.select(*columns)


def run_scanners(scanners: list[Scanner], files: DataFrame) -> DataFrame:
    """The findings of all scanners over the files that each takes, by the columns of a finding."""
    return reduce(DataFrame.unionByName, [_checked(s.scan(files.where(s.takes())), FINDING, s.name) for s in scanners])


def run_rules(rules: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of all rules, each id once, if both ends are nodes."""
    from harborscan.operators.correlation import anchored

    edges = reduce(DataFrame.unionByName, [_checked(rule(findings, nodes), EDGE, name) for name, rule in rules.items()])
    return anchored(edges, nodes)


def ask(provider: Callable[[DataFrame], DataFrame], keys: DataFrame) -> DataFrame:
    """A provider's advisories for package versions (ecosystem, name, version): only of keys that were asked for."""
    return _checked(provider(keys), ADVISORY, "provider").join(keys.select("ecosystem", "name", "version").distinct(), ["ecosystem", "name", "version"], "left_semi").select(*ADVISORY)


class LineScanner:
    """What a scanner does with one file: a new object for each, that is shown its lines in order and may keep what it needs
    between them. ``columns`` names what it tells beside path and line, as a DDL text."""

    columns = "rule_id string"

    def line(self, text: str):
        """What one line gives: tuples of ``columns``."""
        raise NotImplementedError

    def end(self):
        """What the file's end gives, at its last line."""
        return ()


def table_function(spark: SparkSession, name: str, scanner: type[LineScanner]) -> None:
    """Makes a scanner callable from SQL: ``SELECT * FROM name(TABLE(lines))`` over a table with path, line and text.

    The function itself asks for the files to be kept together and their lines in order, and for these three columns
    alone, so that no caller can forget it. A file's lines pass one by one: a scanner holds what it keeps, not the file.
    Null texts are shown as empty; a table without the columns, or anything that is no table, is an error of analysis.
    """
    needed = ["path", "line", "text"]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.LongType()), *T._parse_datatype_string(scanner.columns)])

    class Files:
        def __init__(self):
            self.scanner, self.at = scanner(), None

        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            if not lines.isTable:
                raise ValueError("a scanner takes a table of lines")
            if missing := [c for c in needed if c not in lines.dataType.names]:
                raise ValueError(f"the lines lack {', '.join(missing)}")
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("line")], select=[SelectedColumn(c) for c in needed])

        def eval(self, row):
            self.at = (row["path"], row["line"])
            for found in self.scanner.line(row["text"] or ""):
                yield (*self.at, *found)

        def terminate(self):
            if self.at:
                for found in self.scanner.end():
                    yield (*self.at, *found)

    spark.udtf.register(name, F.udtf(Files))


#: Settings: for each table its keys with default, least and greatest value.
SETTINGS: dict[str, dict[str, tuple[int, int, int]]] = {
    "discovery": {"max_file_size_bytes": (4 << 20, 1, 32 << 20), "max_file_count": (100_000, 1, 250_000), "max_directory_depth": (64, 1, 128), "max_entries": (200_000, 1, 500_000), "max_total_bytes_inspected": (128 << 20, 1, 512 << 20)},
    "secrets": {"max_file_bytes": (4 << 20, 1, 16 << 20), "max_line_bytes": (16 << 10, 1, 64 << 10), "max_findings_per_rule_per_file": (100, 1, 1000), "max_findings_per_file": (100, 1, 1000), "max_findings_total": (1000, 1, 10_000)},
    "behavior": {"max_file_bytes": (512 << 10, 1, 4 << 20), "max_line_bytes": (8 << 10, 1, 64 << 10), "max_findings_per_file": (100, 1, 1000), "max_findings_total": (1000, 1, 10_000)},
    "correlation": {"max_findings": (10_000, 1, 50_000), "max_nodes": (20_000, 1, 100_000), "max_edges": (30_000, 1, 200_000), "max_paths": (1000, 1, 10_000), "proximity_lines": (5, 0, 100)},
}


def settings(text: str) -> dict[str, dict[str, Any]]:
    """Settings of a TOML text over the defaults; an unknown key, another type or a value beyond its bound is an error."""
    import tomllib

    given = tomllib.loads(text)
    if unknown := given.keys() - SETTINGS.keys():
        raise ValueError(f"unknown table {sorted(unknown)[0]}")
    out = {t: {k: d for k, (d, _, _) in keys.items()} for t, keys in SETTINGS.items()}
    for name, values in given.items():
        if not isinstance(values, dict) or values.keys() - SETTINGS[name].keys():
            raise ValueError(f"unknown key in {name}")
        for key, value in values.items():
            _, low, high = SETTINGS[name][key]
            if type(value) is not int or not low <= value <= high:
                raise ValueError(f"{name}.{key} is out of bounds")
            out[name][key] = value
    return out


def chunks(files: DataFrame, size: int = 64 << 10) -> DataFrame:
    """path, chunk, content: files' bytes in pieces of ``size``; an empty file has none."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    rows = files.where(F.octet_length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return rows.select("path", "chunk", F.substring(F.col("content"), F.col("chunk") * size + 1, F.lit(size)).alias("content"))
