"""Every query with SQL gives the same rows in DuckDB, whatever their order."""

import os

import duckdb
import pytest

from harborscan.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        p = f"{small}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if v is None:
        return "-"
    if isinstance(v, (float, int, bool)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v).replace("+00:00", "")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    got = df.collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and {r.severity for r in rows} == {"INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"}
    assert {r.status for r in rows} <= {"PASS", "WARN", "BLOCK"}


def test_secrets_stay_out_of_findings(spark, small):
    from harborscan.operators import secret_rules
    from harborscan.sources import corpora

    rows = secret_rules.findings(secret_rules.detect(corpora.config_lines(spark, small))).collect()
    values = {r.text.split("=")[-1].strip() for r in corpora.config_lines(spark, small).collect() if "Zz9/" in r.text}
    assert rows and not any(v in str(r) for r in rows for v in values)
