"""Runs a catalogue query's SQL on the same files."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(sql: str, folder: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    columns = sorted(con.sql(sql).columns)
    named = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(repr(tuple(plain(x) for x in r)) for r in con.sql(f"select {named} from ({sql})").fetchall())
