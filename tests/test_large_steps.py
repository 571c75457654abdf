"""What keeps the large steps small: postings and places that stay with their rows."""

from pyspark.sql import functions as F

from finframe.operators import phrases as ph
from finframe.operators import text as tx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _articles(spark, n=300):
    rows = [(i, f"head {i % 7}", "sub", "in", f"the bank no {i} rose, the bank fell {'again ' * (i % 5)}") for i in range(n)]
    out = spark.createDataFrame(rows, "article_id bigint, headline string, subhead string, intro string, text string")
    return out.withColumn("publication_date", F.lit("2016-01-01").cast("date")).repartition(5)


def test_scores_are_the_only_rows_that_move(spark):
    index = tx.build_index(_articles(spark), False)
    asked = spark.createDataFrame([(1, "bank again"), (2, "fell")], "query_id int, query string")
    plan = _plan(tx.bm25(index, asked))
    assert plan.count("Exchange hashpartitioning") == 1
    files = index.postings.select("article_id", F.input_file_name().alias("f")).groupBy("article_id").agg(F.countDistinct("f").alias("n"))
    assert files.where("n <> 1").count() == 0


def test_notes_do_not_score(spark):
    index = tx.build_index(_articles(spark), True)
    asked = spark.createDataFrame([(1, "banks"), (2, "zzqx")], "query_id int, query string")
    noted = {r.query_id: list(r.warnings) for r in tx.search_notes(index, asked, tx.asked_terms(index, asked)).collect()}
    assert len(noted[1]) == 1 and noted[2][0] == "no row holds a word of the query"


def test_places_of_an_article_lie_in_one_file(spark):
    index = ph.build_phrases(_articles(spark))
    files = index.places.select("article_id", F.input_file_name().alias("f")).groupBy("article_id").agg(F.countDistinct("f").alias("n"))
    assert files.where("n <> 1").count() == 0
    assert ph.phrase_hits(_articles(spark), index, ["the bank fell"]).count() == 300
