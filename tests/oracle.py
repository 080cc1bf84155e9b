"""A query's rows against those of its SQL, run by DuckDB on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    return None if isinstance(x, float) and x != x else round(x, 6) if isinstance(x, float) else x


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(str(_plain(r[k])) for k in order) for r in rows)


def same(spark, folder, query, sql):
    con = duckdb.connect()
    for path in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{path}'")
    df = query(spark, folder)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(result.fetchall(), columns)
