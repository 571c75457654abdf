"""The corpus over all families."""

from pyspark.sql import functions as F

from finframe.operators import corpus
from finframe.plans.family_queries import _every


def test_every_family_is_there_once_per_id(spark):
    records = _every(spark, "/root/testdata/sf0.001").select("id", "template_family", "category", "dataset_scope", F.size("required_facts").alias("n")).cache()
    assert corpus.duplicate_ids(records).count() == 0
    assert records.select("template_family").distinct().count() >= 24
    scopes = {tuple(r) for r in records.select("category", "dataset_scope").distinct().collect()}
    assert {("answerable", "single"), ("answerable", "cross"), ("unanswerable", "single"), ("unanswerable", "cross"), ("extrapolation", "single")} <= scopes
    assert records.where("n < 1").count() == 0
