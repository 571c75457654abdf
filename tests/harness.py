"""Run a registered query and its oracle and compare the rows."""

from __future__ import annotations

import math
import tempfile

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='oracle-')}'")
    con.execute("SET max_temp_directory_size = '4GB'")
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return _canonical(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return _canonical(columns, cur.fetchall())


def difference(got, want):
    """A short text on the first difference, or None."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    in_got, in_want = set(got[1]), set(want[1])
    only_got = [r for r in got[1] if r not in in_want][:2]
    only_want = [r for r in want[1] if r not in in_got][:2]
    return f"rows {len(got[1])} vs {len(want[1])}\n   spark {only_got}\n   oracle {only_want}"
