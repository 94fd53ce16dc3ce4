"""Run a query in Spark and its check in DuckDB, and compare names, types, rows."""

import glob
import os
import re

import duckdb

FAMILY = {
    "string": "str", "varchar": "str", "bigint": "int", "int": "int", "integer": "int", "hugeint": "int",
    "double": "double", "date": "date", "boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts",
}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def family(type_):
    t = str(type_).lower()
    m = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", t)
    return f"decimal(_,{m.group(2)})" if m else FAMILY.get(t, t)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, int) and not isinstance(v, bool):
        return int(v)
    return v


def compare(spark, con, build, sql, sf_dir):
    """List of differences, and the number of rows."""
    df = build(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"], len(mine)
    types = {d[0]: family(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    for f in df.schema.fields:
        if family(f.dataType.simpleString()) != types[f.name]:
            out.append(f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}")
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if len(a) != len(b):
        out.append(f"{len(a)} rows != {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"only spark: {sorted(sa - sb)[:3]}")
        out.append(f"only sql: {sorted(sb - sa)[:3]}")
    return out, len(a)
