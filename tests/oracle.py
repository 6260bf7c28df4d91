"""Rows of a Spark query beside those of its SQL in DuckDB."""

import glob
import os

import duckdb


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(value) if isinstance(value, list) else value


def rows(found, columns):
    return sorted(repr(tuple(_plain(v) for v in r)) for r in found), columns


def of_spark(df):
    columns = sorted(df.columns)
    return rows(df.select(*columns).collect(), columns)


def of_duckdb(sf_dir, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    columns = sorted(con.sql(sql).columns)
    return rows(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), columns)
