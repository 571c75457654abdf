"""A corpus over many families reads its bases from tables written once."""

import __spark_entry__ as entry

SMALLEST = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_family_reads_written_bases(spark):
    plan = _plan(entry.queries()["qa_every_family"](spark, SMALLEST))
    for table in ("lineitem.parquet", "part.parquet", "orders.parquet"):
        assert plan.count(f"{SMALLEST}/{table}") == 0
