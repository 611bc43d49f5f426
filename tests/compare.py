"""Run registered queries and their SQL side by side: python tests/compare.py SF [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows)


def sql_rows(con, statement):
    con.execute(statement)
    columns = [d[0] for d in con.description]
    return sorted(columns), rows_of(columns, con.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, statements = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = []
    for name in names:
        try:
            t0 = time.time()
            columns, rows = spark_rows(queries[name](spark, sf))
            t1 = time.time()
            wanted_columns, wanted = sql_rows(con, statements[name])
            t2 = time.time()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        same = columns == wanted_columns and rows == wanted
        print(f"{'ok   ' if same else 'DIFF '} {name:26s} rows={len(rows)} spark={t1 - t0:.2f}s sql={t2 - t1:.2f}s", flush=True)
        if not same:
            bad.append(name)
            print("  columns", columns, wanted_columns, len(rows), len(wanted))
            left, right = set(rows) - set(wanted), set(wanted) - set(rows)
            print("  spark only", len(left), [tuple(x[:250] for x in r) for r in sorted(left)[:3]])
            print("  sql only  ", len(right), [tuple(x[:250] for x in r) for r in sorted(right)[:3]])
    print(f"{len(names) - len(bad)} of {len(names)} agree; not: {bad}")


if __name__ == "__main__":
    main()
