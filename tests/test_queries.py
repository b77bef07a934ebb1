"""Registered queries against their SQL on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from cadenza import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return x if isinstance(x, (str, bool)) else round(float(x), 5)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_sql(spark, sql, name):
    got = plans.queries()[name](spark, DATA)
    want = sql.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(cell(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(cell(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5) for p, q in zip(x, y, strict=True)), (x, y)


def test_the_rest_stands_without_the_pipeline():
    """Nothing outside the subpackage llm imports it."""
    root = Path(__file__).resolve().parents[1] / "cadenza"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_kmeans_takes_all_starts(monkeypatch, spark):
    """The query leaves out none of the operator's restarts."""
    import inspect

    from cadenza.operators import clusters

    kmeans, used = inspect.signature(clusters.kmeans), []
    monkeypatch.setattr(clusters, "kmeans", lambda *a, **b: used.append(kmeans.bind(*a, **b)))
    plans.queries()["kmeans"](spark, DATA)
    used[0].apply_defaults()
    assert used[0].arguments["starts"] == 10
