"""Run a query and its SQL on the same tables and compare rows as multisets of strings."""

from pathlib import Path

import duckdb


def connection(folder: str):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, list):
        return [shown(x) for x in v]
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(str([shown(r[c]) for c in names]) for r in table.to_pylist())


def agree(spark, query, sql, folder):
    mine, theirs = rows(query(spark, folder).toArrow()), rows(connection(folder).execute(sql).to_arrow_table())
    assert mine == theirs
