import os
from collections import Counter

import duckdb
import pytest

from tripleloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{t}')")
        found = con.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
