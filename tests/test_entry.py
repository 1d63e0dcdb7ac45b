"""Every registered query against its SQL, on the smallest tables; and the contract of the entry module."""

import glob
import math
import os
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    own = [x[0] for x in cur.description]
    assert sorted(own) == cols
    want = Counter(tuple(plain(r[own.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "file", "bm25", "score", "rank"]
    for name in entry.queries():
        if re.match(r"p\d+_", name):
            assert name.split("_")[0] in {f"p{n}" for n in range(1, 9)}


def test_nothing_imports_the_llm_part():
    for p in Path("lodespark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s+lodespark\.llm", p.read_text(), re.M), p
