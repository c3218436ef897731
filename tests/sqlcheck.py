"""A query's rows in Spark and its SQL's rows in DuckDB."""

import duckdb

DATA = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def assert_equal_to_sql(spark, plan, name, data=DATA):
    found = plan.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    got = [tuple(r.values()) for r in found.select(*columns).toArrow().to_pylist()]
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    want = con.sql(plan.SQL[name])
    assert columns == sorted(want.columns) and len(got) > 0
    want = [tuple(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()]
    left, right = sorted(got, key=repr), sorted(want, key=repr)
    differ = next(((a, b) for a, b in zip(left, right) if a != b), None)
    assert differ is None and len(left) == len(right), (columns, differ, len(left), len(right))
