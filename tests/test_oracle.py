"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from siftline.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    r = con.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    own = sorted((tuple(plain(row[c]) for c in sorted(names)) for row in df.collect()), key=repr)
    other = sorted((tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall()), key=repr)
    assert own == other


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["balanced_agglomerative", "kmeans_balanced", "silhouette"])
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
