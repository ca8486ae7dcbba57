"""Every registered query has a callable; queries of the core equal their SQL on the smallest tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_core_queries_equal_sql(spark):
    import duckdb

    from seamline.plans.oracles import ORACLES
    from seamline.plans.queries import QUERIES

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")

    def plain(rows):
        return sorted(tuple("~" if v is None else repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)

    wrong = []
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        result = con.execute(sql)
        places = {d[0]: i for i, d in enumerate(result.description)}
        expected = [tuple(r[places[c]] for c in columns) for r in result.fetchall()]
        if plain(tuple(r) for r in df.select(*columns).collect()) != plain(expected):
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
