"""Narrow tables whose rows cost much are dealt to tasks by rows, not by bytes."""

import pytest
from pyspark.sql import functions as F

from harborscan.functions.scratch import dealt
from harborscan.plans import code_queries, gate_queries
from harborscan.sources.corpora import project_files


def test_tasks_follow_rows(spark):
    rows = spark.range(0, 1001, 1, 1)
    made = dealt(rows, "id", rows=100)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() == 11 and made.agg(F.sum("id")).first()[0] == 500500
    assert dealt(rows.where("id < 0"), "id").count() == 0


@pytest.mark.parametrize("made, tasks", [(gate_queries.reports, 3), (code_queries.python_files, 3), (project_files, 8)])
def test_small_files_are_many_tasks_work(spark, made, tasks):
    rows = made(spark, "/root/testdata/sf0.1")  # 15,000 customers, 150,000 orders: a small file each
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == tasks
