"""Every registered query against its SQL oracle (DuckDB) on the smallest given tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents labels conversations pages benchmark".split()
# keys without an oracle
SKIP: set[str] = set()
entry.queries()  # fills the registry
KEYS = [k for k in QUERIES if k not in SKIP]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def bag(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records"))


def test_every_key_has_an_oracle_or_is_rows_only():
    assert set(QUERIES) - set(entry.oracle_sql()) == SKIP


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    got = entry.queries()[key](spark, SF).toPandas()
    exp = con.execute(entry.oracle_sql()[key]).df()
    assert bag(got) == bag(exp)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["threshold", "score_level", "n", "accuracy"] and len(rows) > 0
