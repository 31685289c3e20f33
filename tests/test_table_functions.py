"""Scanners that SQL calls: files whole and in order, whatever the order and partitions of the lines."""

import pytest
from pyspark.errors import AnalysisException

from harborscan.operators import registry


def test_files_in_order(spark):
    class Repeats(registry.LineScanner):
        columns = "kind string, n int"

        def __init__(self):
            self.last, self.seen = None, 0

        def line(self, text):
            self.seen += 1
            if text == self.last:
                yield ("repeated", self.seen)
            self.last = text

        def end(self):
            yield ("end", self.seen)

    rows = [(f"f{i % 3}", i // 3 + 1, ["a", "a", None, "", "b"][i // 3 % 5], "other") for i in range(30)]
    lines = spark.createDataFrame(rows[::-1], "path string, line long, text string, kind string").repartition(5)
    lines.createOrReplaceTempView("shuffled_lines")
    registry.table_function(spark, "repeats", Repeats)
    got = sorted(map(tuple, spark.sql("SELECT * FROM repeats(TABLE(shuffled_lines))").collect()))
    want = []
    for f in ("f0", "f1", "f2"):
        text = [t or "" for p, _, t, _ in rows if p == f]
        want += [(f, i + 1, "repeated", i + 1) for i in range(1, 10) if text[i] == text[i - 1]] + [(f, 10, "end", 10)]
    assert got == sorted(want)
    assert spark.sql("SELECT * FROM repeats(TABLE(SELECT * FROM shuffled_lines WHERE false))").collect() == []


def test_other_tables_are_refused(spark):
    registry.table_function(spark, "plain", registry.LineScanner)
    with pytest.raises(AnalysisException, match="lack text"):
        spark.sql("SELECT * FROM plain(TABLE(SELECT 'p' AS path, 1 AS line))").collect()
    with pytest.raises(AnalysisException, match="takes a table"):
        spark.sql("SELECT * FROM plain(1)").collect()
