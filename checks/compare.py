"""Runs registered queries against their SQL on the same tables and reports differences.

    python -m checks.compare [--sf 0.01] [name …]
"""

from __future__ import annotations

import argparse
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from checks import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES.split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = 0
    for name, query in catalog.QUERIES.items():
        if args.names and name not in args.names:
            continue
        try:
            start = time.time()
            df = query(spark, sf_dir)
            columns = sorted(df.columns)
            ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
            took = time.time() - start
            sql = catalog.ORACLES.get(name)
            if sql is None:
                print(f"{name:28} {len(ours):7} rows, {took:5.1f}s, no SQL")
                continue
            start = time.time()
            result = con.execute(sql)
            their_columns = [d[0] for d in result.description]
            at = [their_columns.index(c) for c in columns] if sorted(their_columns) == columns else None
            theirs = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr) if at else their_columns
            same = ours == theirs
            bad += not same
            print(f"{name:28} {len(ours):7} rows, {took:5.1f}s, sql {time.time() - start:4.1f}s, {'same' if same else 'DIFFERENT'}")
            if not same and at:
                only = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
                print("   ", columns, len(theirs), "\n    ours  ", str(only[0])[:1500], "\n    theirs", str(only[1])[:1500])
            elif not same:
                print("   ", columns, sorted(their_columns))
        except Exception as error:
            bad += 1
            print(f"{name:28} FAILED {type(error).__name__}: {str(error)[:1200]}")
            if not isinstance(error, duckdb.Error):
                traceback.print_exc(limit=-2)
    print("all same" if not bad else f"{bad} to look at")


if __name__ == "__main__":
    main()
