"""Every query with SQL gives what DuckDB gives on the smallest tables; none of them needs the training-data folder."""

import math
import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "authors batch_receipts corpus_docs documents edm_records holdout_works level_labels mix_targets train_pairs".split()
SQL = entry.oracle_sql()
NAMES = [k for k in entry.queries() if not re.match(r"p\d_", k)]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(df):
    def cell(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return None
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return None if math.isnan(v) else round(float(v), 9)
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_core_stands_alone():
    code = "import sys; sys.modules['zrno.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('p1_')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=False).returncode == 0
    core = [os.path.join(d, f) for d, _, fs in os.walk("zrno") if "llm" not in d for f in fs if f.endswith(".py")]
    assert core and not [f for f in core if "zrno.llm" in open(f, encoding="utf-8").read()]
