"""Compare a query's Spark rows with the rows of its SQL counterpart."""

import datetime
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def sql_rows(con, text):
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    return sorted(names), rows(names, cursor.fetchall())


def sql_types(con, text):
    return {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {text}").fetchall()}


def plan(df, mode="simple"):
    jvm = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(jvm.fromString(mode))
