"""Every relational query against its SQL on the smallest tables."""

import os
import re

import pytest

from compare import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

# long runs (stores, periods, streams) are covered by their own tests and by tests/compare.py
SLOW = ("A7", "A13", "F10", "L")


def names():
    from duelmark.catalog import REGISTRY

    return [n for n, q in REGISTRY.items() if q.sql is not None and not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    from duelmark.catalog import REGISTRY

    q = REGISTRY[name]
    status, _, _, note = compare(spark, con, name, q.run, q.oracle(), SF)
    assert status == "ok", note or status


def test_inventory_is_covered():
    from duelmark.catalog import REGISTRY

    have = {re.match(r"[A-Z]\d+", n).group(0) for n in REGISTRY}
    sizes = dict(A=15, B=33, C=7, D=17, E=27, F=16, G=5, H=4, I=16, J=7, K=5, L=5)
    assert not [f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1) if f"{k}{i}" not in have]


def test_entry_is_lazy_and_stable(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["entity", "seq", "n_prior", "prior_sum", "prior_mean", "last3_mean", "prev_time", "last_flag_time"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
