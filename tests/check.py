"""``python tests/check.py [sf_dir] [name ...]``: queries against their oracles, with seconds."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from finframe.session import clear_steps  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", os.path.abspath("spark-warehouse/check")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = harness.oracle_connection(sf_dir)
    builders, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in builders.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            got = harness.spark_rows(build(spark, sf_dir))
            took = time.time() - began
            note = harness.difference(got, harness.oracle_rows(con, oracles[name])) if name in oracles else "no oracle"
        except Exception as exc:  # noqa: BLE001 - report and go on
            took, note, got = time.time() - began, f"ERROR {type(exc).__name__}: {str(exc)[:600]}", ([], [])
        bad += bool(note) and note != "no oracle"
        print(f"{'ok ' if note is None else '-- '} {name:34s} {took:6.2f}s rows={len(got[1])} {note or ''}", flush=True)
    clear_steps(spark)
    print("failures:", bad)


main()
