"""The pipeline on the smallest tables: each stage acts on its own input, and clean documents stay."""

import corpus_pipeline
from harborscan.llm.common import table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path_rows = stage(spark, docs, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert path_rows.columns == docs.columns
        docs = spark.createDataFrame(path_rows.collect(), path_rows.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and counts[-1] == counts[-2]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
