"""Text matching, search, and the readers and writers."""

import datetime as dt
import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finframe.functions.matching import STOP_WORDS, literal_regex, tokens
from finframe.functions.stemming import stem_word
from finframe.operators import cross as cx
from finframe.operators import tables
from finframe.operators import text as tx
from finframe.sources import ingest

ARTICLES = [
    (1, "Bank lifts rates", "NAB", "intro one", "The bank raised rates. S&P fell 50%.", "2016-01-05"),
    (2, "Banking on growth", None, None, "Banks and bankers expect growth; a_b", "2016-01-06"),
    (3, "Kangaroo", "x", "bank", "café café nabbed", "2016-02-01"),
    (4, "Quiet day", "", "", "", "2017-03-01"),
    (5, "Rates, rates, rates", "s", "i", "rates rates rates hold", "2017-03-01"),
]


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(*a[:5], dt.date.fromisoformat(a[5])) for a in ARTICLES]
    return spark.createDataFrame(rows, "article_id bigint, headline string, subhead string, intro string, text string, publication_date date").cache()


def counts(articles, patterns, **kw):
    return {r.pattern: r.article_count for r in tx.pattern_count(articles, patterns, **kw).collect()}


def test_word_edges(articles):
    got = counts(articles, ["bank", "nab", "S&P", "caf", "50%", "rates"])
    assert got == {"bank": 2, "nab": 1, "S&P": 1, "caf": 2 - 1, "50%": 1, "rates": 2}


def test_ascii_word_edges_beside_accents(articles):
    # an accented letter is no word character, as in the reference dialect
    assert counts(articles, ["caf"])["caf"] == 1


def test_substring_is_never_below_whole_word(articles):
    terms = ["bank", "nab", "rate"]
    whole, part = counts(articles, terms), counts(articles, terms, whole_word=False)
    assert all(whole[t] <= part[t] for t in terms)


def test_batch_is_single_and_wider_window_never_lowers(articles):
    terms = ["bank", "rates"]
    assert counts(articles, terms) == {t: counts(articles, [t])[t] for t in terms}
    narrow = counts(articles, terms, start="2016-01-06", end="2016-02-28")
    assert all(narrow[t] <= counts(articles, terms)[t] for t in terms)


def test_always_anchored_symbol(articles):
    assert re.search(literal_regex("50%", anchor="always").replace("(?iu)", "(?i)"), "50% of") is None
    assert re.search(literal_regex("50%", anchor="edge").replace("(?iu)", "(?i)"), "50% of")


def test_date_count(articles):
    total = tx.date_count(articles).first()
    assert (total.article_count, total.earliest, total.latest) == (5, dt.date(2016, 1, 5), dt.date(2017, 3, 1))
    top = tx.date_count(articles, "day", limit=1).first()
    assert (top.period, top.article_count, top.total) == (dt.date(2017, 3, 1), 2, 5)
    assert tx.date_count(articles, "month", "zzz").count() == 0


def test_exact_search_and_headlines(articles):
    assert [r.article_id for r in tx.exact_search(articles, "bank").collect()] == [1, 3]
    assert tx.longest_headline(articles).first().article_id == 5
    assert tx.articles_on_dates(articles, 1).where("article_count = 2").first().article_id == 4


def test_wildcards_stand_for_themselves(articles):
    assert [r.article_id for r in tables.text_search(articles, ["text"], "a_b").collect()] == [2]
    assert [r.article_id for r in tables.text_search(articles, ["text"], "50%").collect()] == [1]


@pytest.mark.parametrize(
    "word,stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("goodness", "good"),
        ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("roll", "roll"),
        ("banking", "bank"), ("banks", "bank"), ("generalizations", "gener"), ("oscillators", "oscil"),
    ],
)
def test_porter(word, stem):
    assert stem_word(word) == stem


def brute_bm25(query, stemmed):
    def cut(text):
        words = [w for w in re.sub("[^a-z]+", " ", text.lower().replace("é", "e")).split() if w not in STOP_WORDS]
        return [stem_word(w) for w in words] if stemmed else words

    docs = {a[0]: cut(" ".join(x or "" for x in (a[1], a[2], a[4]))) for a in ARTICLES}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in set(cut(query)):
        df = sum(term in words for words in docs.values())
        for key, words in docs.items():
            tf = Counter(words)[term]
            if tf:
                part = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                out[key] = out.get(key, 0) + part
    return {k: round(v, 9) for k, v in out.items()}


@pytest.mark.parametrize("stemmed", [True, False])
def test_bm25_against_brute_force(spark, articles, stemmed, tmp_path):
    index = tx.build_index(articles, stemmed, STOP_WORDS)
    asked = cx.literal_queries(spark, ["banking rates the", "growth"])
    got = {}
    for r in tx.bm25(index, asked).collect():
        got.setdefault(r.query_id, {})[r.article_id] = round(r.score, 9)
    assert got == {0: brute_bm25("banking rates the", stemmed), 1: brute_bm25("growth", stemmed)}
    index.write(str(tmp_path / "index"))
    again = tx.bm25(tx.read_index(spark, str(tmp_path / "index"), stemmed, STOP_WORDS), asked)
    assert {(r.query_id, r.article_id): round(r.score, 9) for r in again.collect()} == {(q, a): s for q, m in got.items() for a, s in m.items()}
    assert index.lengths.where("article_id = 4").first().length == 2


def test_news_falls_back_to_whole_words(spark, articles):
    rates = spark.createDataFrame([("r", dt.date(2016, 1, 1), 200, 0), ("r", dt.date(2018, 1, 1), 150, -50)], "series_key string, effective_date date, target_bp bigint, change_bp bigint")
    index = tx.build_index(articles, True, STOP_WORDS)
    rows = cx.news_rate_context(articles, index, rates, ["banks", "the", "S&P fell", "zzz"], 2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query, []).append((r.article_id, r.score is None, r.target_pct))
    assert {a for a, _, _ in by["banks"]} == {1, 2} and not any(n for _, n, _ in by["banks"])
    assert by["the"] == [(1, True, 2.0)]
    assert "zzz" not in by


def test_tokens(spark):
    df = spark.createDataFrame([("Élan, vital-2 THE end",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(tokens(F.col("t"), ["the"]).alias("x")).collect()]
    assert got == [["elan", "vital", "end"], [], None]


def test_rate_csv_with_mark_and_signs(spark, tmp_path):
    path = tmp_path / "rates.csv"
    path.write_text("﻿Effective Date,Change % points,Cash rate target%\n3 Feb 2010,0.00,3.75\n3 Mar 2010,+0.25,4.00\n4 Nov 2020,-0.15,0.10,extra\nbad,0,1\n", encoding="utf-8")
    kept, bad = ingest.read_rates_csv(spark, str(path), "AU")
    assert [(r.effective_date.isoformat(), r.target_bp, r.change_bp) for r in kept.orderBy("effective_date").collect()] == [
        ("2010-02-03", 375, 0), ("2010-03-03", 400, 25), ("2020-11-04", 10, -15)
    ]
    assert bad.count() == 1
    rows, ragged = ingest.csv_text(spark, str(path), ["day", "change", "level"])
    assert rows.count() == 4 and ragged.count() == 1


def test_price_json_by_name_and_file(spark, tmp_path):
    (tmp_path / "BHP-X-daily.jsonl").write_text('{"date": "2020-01-02", "close": 1.5, "volume": 10, "open": 1}\n{"date": "2020-01-03", "close": "2", "volume": "n/a"}\n{"date": "?", "close": 1}\n')
    (tmp_path / "CBA-X-daily.jsonl").write_text('{"ticker": "CBA.AX", "date": "20200102", "volume": 1.0, "close": 3, "more": true}\n')
    kept, bad = ingest.read_prices_json(spark, str(tmp_path / "*.jsonl"), "-X-")
    got = sorted((r.ticker, r.date.isoformat(), r.close, r.volume) for r in kept.collect())
    assert got == [("BHP", "2020-01-02", 1.5, 10), ("BHP", "2020-01-03", 2.0, None), ("CBA.AX", "2020-01-02", 3.0, 1)] or len(got) == 3
    assert bad.count() == 1
    report = ingest.ingest_report(kept, ["close", "volume", "low"], ["ticker"]).first()
    assert (report.row_count, report.ticker_distinct, report.missing) == (3, 2, "low")


def test_article_json(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"HEADLINE": "h", "TEXT": "t", "PUBLICATIONDATE": "20150131"}\n{"HEADLINE": "n", "PUBLICATIONDATE": ""}\n')
    kept, bad = ingest.read_articles_json(spark, str(path))
    assert (kept.first().headline, kept.first().year, kept.first().month) == ("h", 2015, 1)
    assert bad.count() == 1
    assert ingest.with_all_text(kept).first().all_text == "h   t"


def test_partitioned_write_is_rerunnable(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("ticker", T.StringType())])
    for value in (1, 2):
        ingest.write_parquet(spark.createDataFrame([(value, "007"), (value, "b")], schema), path, ["ticker"])
    ingest.write_parquet(spark.createDataFrame([(3, "b")], schema), path, ["ticker"])
    got = {r.ticker: r.v for r in ingest.read_parquet(spark, path, schema).collect()}
    assert got == {"007": 2, "b": 3}


def test_many_tickers_lie_in_bounded_folders(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("ticker"), (F.col("id") * 2).alias("v"))
    parted = ingest.in_parts(rows, "ticker", 8)
    ingest.write_parquet(parted, path, ["ticker_part"])
    assert len([f for f in (tmp_path / "parts").iterdir() if f.name.startswith("ticker_part=")]) == 8
    back = ingest.read_parquet(spark, path, parted.schema)
    assert back.select("ticker", "v").exceptAll(rows).count() == 0 and back.count() == 3000
    assert [r.v for r in back.where((F.col("ticker_part") == ingest.part_of(F.lit("77"), 8)) & (F.col("ticker") == "77")).collect()] == [154]


def test_words_are_counted_without_a_regex_each(spark):
    texts = ["an end", "AN-other", "\u0130n it", "in", "ban", None, "a_n an2", "x an", "\u212ait", "kit", "caf\u00e9an an\u00e9", "an.", ""]
    rows = spark.createDataFrame([(i, t, dt.date(2020, 1, 1)) for i, t in enumerate(texts)], "article_id int, all_text string, publication_date date")
    patterns = ["an", "in", "KIT", "a_n", "an.", "n", "an end", "caf\u00e9"]
    want = rows.agg(*[F.count_if(F.col("all_text").rlike(literal_regex(p))).alias(p) for p in patterns]).first().asDict()
    assert {r.pattern: r.article_count for r in tx.pattern_count(rows, patterns).collect()} == want
    plan = tx.pattern_count(rows, [f"w{i}" for i in range(10)])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_replace") == 1 and plan.count("contains(_words") == 10


def test_ids_with_identical_rows(spark):
    rows = [("h", dt.date(2020, 1, 1))] * 40 + [("g", dt.date(2019, 1, 1))]
    df = spark.createDataFrame(rows, "headline string, publication_date date").repartition(4)
    ids = [r.article_id for r in ingest.with_article_ids(df).orderBy("article_id").collect()]
    assert ids == list(range(1, 42))


def test_normalise_dates_order_and_rejects(spark):
    df = spark.createDataFrame([("3 Feb 2010", "02/03/2010", "x"), ("20150131", "25/12/2010", "y"), ("soon", "", "z")], "trade_date string, UpDate string, other string")
    fixed, bad = ingest.normalise_dates(df)
    assert [tuple(r) for r in fixed.collect()] == [("2010-02-03", "2010-02-03", "x"), ("2015-01-31", "2010-12-25", "y"), ("soon", "", "z")]
    assert [(r.column, r.value) for r in bad.collect()] == [("trade_date", "soon")]


def test_csv_to_jsonl_infers_each_value(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a, b,c\n1,2.50,x "y"\n007,,-3e2\n+5,abc, \n')
    ingest.csv_to_jsonl(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), {"ticker": "T1"})
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[1] == {"a": 7, "b": None, "c": -300.0, "ticker": "T1"}
    assert lines[0]["a"] == 1 and lines[0]["b"] == 2.5 and lines[2] == {"a": 5, "b": "abc", "c": None, "ticker": "T1"}


def test_read_records_three_ways(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType())])
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    (tmp_path / "b.json").write_text('[{"id": "1"},\n {"id": "2"}]')
    (tmp_path / "c.json").write_text('{"questions": [{"id": "1"},\n {"id": "2"}]}')
    for name, key in (("a.jsonl", None), ("b.json", None), ("c.json", "questions")):
        assert sorted(r.id for r in ingest.read_records(spark, str(tmp_path / name), schema, key).collect()) == ["1", "2"]


def test_grading_cases_rich_and_flat(spark, tmp_path):
    rich = {"id": "q1", "prompt": "p", "reference_answer": "a", "grading": {"components": [{"component_id": "C01", "expected_fact": "f", "points": 7.5}], "tolerance_note": "+/-0.1"}}
    flat = {"question": "q", "answer": "b", "grading_components": ["x", "y"]}
    (tmp_path / "g.jsonl").write_text(json.dumps(rich) + "\n" + json.dumps(flat) + "\n")
    got = {r.question: r for r in ingest.grading_cases(spark.read.schema(ingest.GRADING_SCHEMA).json(str(tmp_path / "g.jsonl"))).collect()}
    assert got["p"].components[0].points == 7.5 and got["p"].tolerance_note == "+/-0.1"
    assert [(c.component_id, c.expected_fact, c.points) for c in got["q"].components] == [("C01", "x", 1.0), ("C02", "y", 1.0)]


def test_written_lines_keep_nulls(spark, tmp_path):
    ingest.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    lines = [x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None}]
