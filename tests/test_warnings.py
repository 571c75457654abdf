"""Warning texts, available days and the report of keys."""

import datetime as dt

from finframe.operators import align
from finframe.operators import text as tx


def test_moved_note_says_both_days(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 2), dt.date(2020, 1, 1)), (dt.date(2020, 1, 1), dt.date(2020, 1, 1)), (dt.date(2020, 1, 1), None)], "asked date, took date")
    got = [r.warning for r in align.with_moved_note(rows, "asked", "took").collect()]
    assert got == ["2020-01-02 is not in the series; took 2020-01-01 (previous)", None, None]


def test_a_miss_names_the_days_there_are(spark):
    series = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1), ("a", dt.date(2020, 1, 9), 2)], "k string, date date, x int")
    asked = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("b", dt.date(2020, 1, 6)), ("a", None)], "k string, day date")
    out = align.with_available(align.asof(asked, series, ["k"], "day", "date"), series, ["k"], "date")
    got = {(r.k, r.day): (r.status, r.available_start, r.available_end) for r in out.collect()}
    assert got["a", dt.date(2020, 1, 1)] == (align.DATE_OUTSIDE_COVERAGE, dt.date(2020, 1, 5), dt.date(2020, 1, 9))
    assert got["b", dt.date(2020, 1, 6)] == (align.UNKNOWN_TICKER, None, None)
    assert got["a", None][1:] == (dt.date(2020, 1, 5), dt.date(2020, 1, 9))


def test_key_report_lists_valid_keys_only_beside_unknown_ones(spark):
    known = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    report = lambda keys: sorted(map(tuple, align.key_report(spark.createDataFrame([(k,) for k in keys], "k string"), known, "k").collect()))
    assert report(["a", "z", "z"]) == [("a", "VALID"), ("b", "VALID"), ("z", "UNKNOWN_TICKER")]
    assert report(["a"]) == []


def test_search_notes(spark):
    rows = spark.createDataFrame([(1, "Banks", "", "", "growth", dt.date(2020, 1, 1))], "article_id bigint, headline string, subhead string, intro string, text string, publication_date date")
    asked = spark.createDataFrame([(1, "banking"), (2, "zzz"), (3, "")], "query_id int, query string")
    for stemmed, notes in ((True, {1: 1, 2: 2, 3: 2}), (False, {1: 1, 2: 1, 3: 1})):
        index = tx.build_index(rows, stemmed)
        assert {r.query_id: len(r.warnings) for r in tx.search_notes(index, asked, tx.bm25(index, asked)).collect()} == notes
