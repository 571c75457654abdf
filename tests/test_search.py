"""Phrases from places, and the best rows from blocks, against the plain forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finframe.functions.matching import literal_regex_of
from finframe.operators import cross as cx
from finframe.operators import phrases as ph
from finframe.operators import pruned as pr
from finframe.operators import text as tx

SCHEMA = "article_id bigint, headline string, subhead string, intro string, text string, publication_date date"
TEXTS = [
    "The Reserve Bank raised rates.", "the reserve  bank", "reserve bank, reserve bank reserve", "(reserve bank) 50% of", "a.b a,b a_b", "S&P 500 fell; s&p 500 rose",
    "café au lait CAFÉ", "Caféau lait", "bank" + " " * 30 + "rates", "banK rates", "reſerve bank", "", None, "rates", "..bank..", "bank-rates bank--rates", "dış bank",
]
PHRASES = [
    "reserve bank", "Reserve Bank", "bank reserve", "bank", "rates", "(reserve", "bank)", "50%", "a.b", "a_b", "S&P 500", "café", "café au", "CAFÉ au lait", "bank" + " " * 30 + "rates",
    "bank" + " " * 29 + "rates", "..", "%", "banK", "bank rates", "reserve  bank", "reserve bank reserve", "bank--rates", "..bank..", " bank", "rates ", "x", "the reserve bank raised rates.", "dış",
]


@pytest.fixture(scope="module")
def articles(spark):
    day = dt.date(2016, 1, 1)
    rows = [(i, f"h{i % 3}", None, "", t, day + dt.timedelta(days=i % 5)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def plain(articles, phrases):
    texts = articles.select("article_id", tx.all_text(articles).alias("t"))
    pats = articles.sparkSession.createDataFrame([(p,) for p in phrases], "pattern string")
    return {tuple(r) for r in texts.crossJoin(pats).where(F.regexp_like("t", literal_regex_of(F.col("pattern")))).select("pattern", "article_id").collect()}


def test_phrases_equal_the_plain_form(spark, articles, tmp_path):
    index = ph.build_phrases(articles)
    table = spark.createDataFrame([(p,) for p in [*PHRASES, "", "bank", None]], "pattern string")
    got = [tuple(r) for r in ph.phrase_hits(articles, index, table).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(articles, PHRASES)
    index.write(str(tmp_path / "places"))
    again = ph.phrase_hits(articles, ph.read_phrases(spark, str(tmp_path / "places")), PHRASES)
    assert {tuple(r) for r in again.collect()} == set(got)


def test_phrases_on_random_texts(spark):
    rng = random.Random(5)
    words, gaps = ["a", "b", "Ab", "c_", "9"], [" ", " ", "  ", ", ", "-", "é", "."]
    make = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    rows = [(i, make(2), make(1), None, make(rng.randint(0, 30)), dt.date(2016, 1, 1)) for i in range(150)]
    found = spark.createDataFrame(rows, SCHEMA)
    phrases = sorted({make(rng.randint(1, 4)).strip() if rng.random() < 0.7 else rng.choice(gaps).strip() + make(2) for _ in range(120)})
    index = ph.build_phrases(found)
    assert {tuple(r) for r in ph.phrase_hits(found, index, phrases).collect()} == plain(found, phrases)


def test_phrases_of_nothing(spark, articles):
    index = ph.build_phrases(articles)
    assert ph.phrase_hits(articles, index, []).count() == 0
    empty = articles.where("article_id < 0")
    assert ph.phrase_hits(empty, ph.build_phrases(empty), PHRASES).count() == 0


def _rows_read(df):
    """Rows that the scans of an executed plan gave out, by file listing of the table."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec":
                out.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_listed_phrase_reads_few_places(spark):
    rows = [(i, "", "", "", " ".join(f"w{(i * 7 + j) % 4000:04d}" for j in range(60)), dt.date(2016, 1, 1)) for i in range(2000)]
    index = ph.build_phrases(spark.createDataFrame(rows, SCHEMA))
    few = index.places.where(F.col("run").isin("w0100", "w0101"))
    # files and row groups hold one range of runs each
    assert _rows_read(few)[0] <= index.places.count() / 4


def test_no_text_is_read_for_plain_phrases(spark, articles):
    index = ph.build_phrases(articles.where(~F.col("article_id").isin(9, 10, 16)))  # texts without letters taken for plain ones
    trap = articles.withColumn("text", F.raise_error(F.lit("a text was read")).cast("string"))
    assert ph.phrase_hits(trap, index, ["reserve bank", "50%"]).count() == 4
    with pytest.raises(Exception, match="a text was read"):
        ph.phrase_hits(trap, index, ["café au"]).count()


def test_search_ranks_by_date_in_a_window(articles):
    index = ph.build_phrases(articles)
    got = ph.phrase_search(articles, index, ["bank"], 3, "2016-01-02", "2016-01-04").orderBy("rank").collect()
    days = {r.article_id: (r.publication_date, r.headline, r.article_id) for r in articles.collect()}
    held = {a for p, a in plain(articles, ["bank"])}
    want = sorted(days[a] for a in held if dt.date(2016, 1, 2) <= days[a][0] <= dt.date(2016, 1, 4))[:3]
    assert [(r.publication_date, r.headline, r.article_id) for r in got] == want and [r.rank for r in got] == [1, 2, 3]
    assert ph.phrase_search(articles, index, ["bank"], start="2017-01-02", end="2016-01-04").count() == 0


def test_news_by_places_equals_news_by_texts(spark, articles):
    rates = spark.createDataFrame([("r", dt.date(2016, 1, 1), 200, 0), ("r", dt.date(2018, 1, 1), 150, -50)], "series_key string, effective_date date, target_bp bigint, change_bp bigint")
    index = tx.build_index(articles, True, ("the", "reserve"))
    asked = ["bank", "the", "reserve", "S&P 500", "the", "zzz"]
    forms = [cx.news_rate_context(articles, index, rates, asked, 2, phrases=p) for p in (None, ph.build_phrases(articles))]
    rows = [sorted(map(str, f.select(sorted(f.columns)).collect())) for f in forms]
    assert rows[0] == rows[1] and rows[0]


def corpus(spark, n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    weights = [1 / (i + 1) for i in range(len(words))]
    day = dt.date(2016, 1, 1)
    rows = [(i, rng.choice("xyz"), "", "", " ".join(rng.choices(words, weights, k=rng.randint(0, 60))), day + dt.timedelta(days=rng.randint(0, 400))) for i in range(n)]
    rows += [(n + i, "copy", "", "", rows[7][4], rows[i % n][5]) for i in range(20)]  # ties
    rows.append((n + 50, "x", "", "", "bal bal bal", None))
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(25)] + [(90, "bal"), (91, "unknown words"), (92, ""), (93, rows[7][4])]
    return spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame(asked, "query_id int, query string")


@pytest.fixture(scope="module")
def searched(spark):
    rows, asked = corpus(spark, 600, 3)
    index = tx.build_index(rows, False)
    return rows, asked, index, pr.build_blocks(index, rows, 16)


@pytest.mark.parametrize("k,start,end", [(5, None, None), (2, "2016-03-01", "2016-05-20"), (400, None, "2016-02-01"), (2, "2017-01-01", "2016-01-01")])
def test_pruned_rows_are_those_of_the_full_search(searched, k, start, end):
    rows, asked, index, blocks = searched
    full = tx.retrieve(rows, index, asked, k, start, end)
    best = pr.pruned_retrieve(rows, blocks, asked, k, start, end)
    key = lambda df: sorted((r.query_id, r.rank, r.article_id, r.score) for r in df.collect())
    assert key(best) == key(full)


def test_few_postings_are_read(searched):
    _, asked, index, blocks = searched
    one = pr.pruning(blocks, asked, 3).first()
    assert one.probed + one.heavy + one.light < 0.7 * one.postings
    assert one.rows_left < tx.bm25(index, asked).count() * 0.7


def test_pruned_search_of_nothing(spark):
    rows, asked = corpus(spark, 10, 1)
    none = rows.where("article_id < 0")
    assert pr.pruned_retrieve(none, pr.build_blocks(tx.build_index(none, False), none), asked, 3).count() == 0
    index = pr.build_blocks(tx.build_index(rows, False), rows)
    assert pr.pruned_retrieve(rows, index, asked.where("query_id < 0"), 3).count() == 0
