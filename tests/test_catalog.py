"""Every registered query against its SQL on the smallest tables, and that the rest works without the text operators."""

import os
import subprocess
import sys

import pytest

from tidewrack.plans import catalog

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@needs_data
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in catalog.ORACLE:
        con = duckdb.connect()
        for t in os.listdir(DATA):
            con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
        res = con.execute(catalog.ORACLE[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=str)


def test_core_stands_alone():
    code = "import sys; sys.modules['tidewrack.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'feed_page' in q and not any(k.startswith('p1_') for k in q); e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
