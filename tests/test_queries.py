"""Every relational query against its DuckDB SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from brindle.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return "NaN" if math.isnan(x) else round(x, 6)
        return str(x) if x is not None else None

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data)
    cursor = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(cursor.fetchall())


def test_sketches_are_close(spark, data):
    from pyspark.sql import functions as F

    from brindle.sources.tables import table

    exact = {r[0]: r[1] for r in table(spark, data, "events").groupBy("event_type").agg(F.count_distinct("user_id")).collect()}
    for r in catalog.QUERIES["approximate_users"](spark, data).collect():
        assert abs(r["users"] - exact[r["event_type"]]) <= max(2, 0.1 * exact[r["event_type"]])


def test_sketched_medians_are_close(spark, data):
    """The rank of the sketch's median among the values is within its stated accuracy (1 in 10,000) and one value."""
    from pyspark.sql import functions as F

    from brindle.sources.tables import table

    events = table(spark, data, "events")
    found = catalog.QUERIES["approximate_users"](spark, data)
    rows = events.join(found, "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("med")).cast("int")).alias("upto"), F.avg((F.col("value") < F.col("med")).cast("int")).alias("below"), F.count("*").alias("n")).collect()
    assert rows and all(r["below"] <= 0.5 + 1e-4 + 1 / r["n"] and r["upto"] >= 0.5 - 1e-4 - 1 / r["n"] for r in rows)
