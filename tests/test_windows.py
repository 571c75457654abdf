"""Windows of request tables against brute force: hot keys, open and inverted bounds, unknown keys, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finframe.functions.matching import literal_regex
from finframe.operators import text as tx
from finframe.operators import windows as w

EPOCH = dt.date(1970, 1, 1)


def day(n):
    return EPOCH + dt.timedelta(days=n)


def series(seed, keys=3, span=400, first=-150):
    draw = random.Random(seed)
    rows = []
    for k in range(keys):
        for n in sorted(draw.sample(range(span), span // 2)):
            close = draw.choice([None, *range(1, 30)]) if draw.random() < 0.05 else draw.randrange(1, 30)
            high = None if close is None else close + draw.randrange(0, 3)
            rows.append((f"k{k}", day(first + n), high, None if close is None else max(1, close - draw.randrange(0, 3)), close, draw.randrange(0, 9)))
    return rows


def requests(seed, n=300, span=400, first=-150):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        key = draw.choice(["k0", "k0", "k0", "k1", "k2", "unknown"])  # k0 is hot
        start = draw.choice([None, *[day(first - 30 + draw.randrange(span + 60)) for _ in range(9)]])
        end = draw.choice([None, *[day((start or day(first)).toordinal() - EPOCH.toordinal() + draw.randrange(-10, 200)) for _ in range(9)]])
        out.append((i, key, start, end))
    return out


@pytest.fixture(scope="module")
def prices(spark):
    rows = series(1)
    return rows, spark.createDataFrame([(k, d, *map(lambda x: None if x is None else float(x), v[:3]), v[3]) for k, d, *v in rows], "ticker string, date date, high double, low double, close double, volume long")


@pytest.fixture(scope="module")
def asked(spark):
    rows = requests(2)
    return rows, spark.createDataFrame(rows, "id int, ticker string, start date, end date")


def inside(rows, key, start, end):
    return [r for r in rows if r[0] == key and (start is None or r[1] >= start) and (end is None or r[1] <= end)]


def status(rows, key, start, end, found):
    if not any(r[0] == key for r in rows):
        return "UNKNOWN_TICKER"
    if start and end and start > end:
        return "DATE_RANGE_INVALID"
    return "ok" if found else "NO_MATCHING_RECORDS"


@pytest.mark.parametrize(("direction", "n"), [("highest", 1), ("lowest", 3)])
def test_extremes(prices, asked, direction, n):
    rows, df = prices
    got = {}
    for r in w.extremes(asked[1], df, "close", direction=direction, n=n, carry=["volume"]).collect():
        got.setdefault(r.id, []).append((r["rank"], r.date, r.value, r.volume, r.status))
    for i, key, start, end in asked[0]:
        hits = sorted((r for r in inside(rows, key, start, end) if r[4] is not None), key=lambda r: (-r[4] if direction == "highest" else r[4], r[1]))[:n]
        said = status(rows, key, start, end, hits)
        want = [(k, r[1], r[4], r[5], said) for k, r in enumerate(hits, 1)] if said == "ok" else [(None, None, None, None, said)]
        assert sorted(got[i], key=str) == sorted(want, key=str), (key, start, end)


@pytest.mark.parametrize("basis", ["close", "intraday"])
def test_drawdowns(prices, asked, basis):
    rows, df = prices
    got = {r.id: r for r in w.drawdowns(asked[1], df, basis).collect()}
    assert len(got) == len(asked[0])
    for i, key, start, end in asked[0]:
        bars = [r for r in inside(rows, key, start, end) if r[4] is not None]
        peak, top, best = None, None, None
        for r in bars:
            p, t = (r[2], r[3]) if basis == "intraday" else (r[4], r[4])
            if peak is None or p > peak:
                peak, top = p, r[1]
            fall = t / peak - 1
            one = (fall, r[1], peak, top, t) if fall < 0 else (0.0, r[1], p, r[1], t)
            best = one if best is None or one[:2] < best[:2] else best
        said = status(rows, key, start, end, bars)
        assert got[i].status == said
        if said == "ok":
            back = next((r[1] for r in bars if r[1] > best[1] and r[4] >= best[2]), None)
            assert (got[i].trough_date, got[i].peak_price, got[i].peak_date, got[i].trough_price, got[i].recovery_date, got[i].records_used) == (best[1], best[2], best[3], best[4], back, len(bars))
            assert got[i].max_drawdown_pct == pytest.approx(best[0] * 100, abs=1e-4)


def decisions(seed):
    draw, rows = random.Random(seed), []
    for k in range(3):
        level = 200
        for n in sorted(draw.sample(range(400), 120)):
            change = draw.choice([0, 0, 25, 25, -25, -50, 50])
            level += change
            rows.append((f"k{k}", day(n - 150), level, change))
    return rows


@pytest.fixture(scope="module")
def rates(spark):
    rows = decisions(5)
    return rows, spark.createDataFrame(rows, "series_key string, effective_date date, target_bp long, change_bp long")


@pytest.mark.parametrize(("direction", "select"), [("tightening", "largest"), ("easing", "most_moves"), ("easing", "latest")])
def test_cycles(rates, asked, direction, select):
    rows, df = rates
    got = {r.id: r for r in w.rate_cycles(asked[1].withColumnRenamed("ticker", "series_key"), df, direction, select).collect()}
    for i, key, start, end in asked[0]:
        runs = []
        for r in inside(rows, key, start, end):
            if r[3]:
                if runs and (runs[-1][-1][3] > 0) == (r[3] > 0):
                    runs[-1].append(r)
                else:
                    runs.append([r])
        runs = [x for x in runs if (x[0][3] > 0) == (direction == "tightening")]
        said = status(rows, key, start, end, runs)
        assert got[i].status == said
        if said == "ok":
            order = {"largest": lambda x: (-abs(sum(r[3] for r in x)), x[0][1]), "most_moves": lambda x: (-len(x), x[0][1]), "latest": lambda x: -x[0][1].toordinal()}[select]
            best = min(runs, key=order)
            assert (got[i].move_count, got[i].start_date, got[i].end_date, got[i].cycles_found) == (len(best), best[0][1], best[-1][1], len(runs))
            assert (got[i].cumulative_pct, got[i].rate_before_pct, got[i].rate_after_pct) == (sum(r[3] for r in best) / 100, (best[0][2] - best[0][3]) / 100, best[-1][2] / 100)


def test_holds_levels_and_changes(rates, asked):
    rows, df = rates
    named = asked[1].withColumnRenamed("ticker", "series_key")
    holds = {r.id: r for r in w.longest_holds(named, df).collect()}
    lows = {r.id: r for r in w.rate_extremes(named, df, "lowest").collect()}
    sums = {r.id: r for r in w.rate_changes(named, df).collect()}
    for i, key, start, end in asked[0]:
        hit = inside(rows, key, start, end)
        moves = [r for r in hit if r[3]]
        gaps = sorted(((a[1] - b[1]).days * -1, b[1]) for b, a in zip(moves, moves[1:], strict=False))
        assert holds[i].status == status(rows, key, start, end, gaps) and sums[i].status == lows[i].status == status(rows, key, start, end, hit)
        if gaps and holds[i].status == "ok":
            assert (holds[i].gap_days, holds[i].start_date) == (-gaps[0][0], gaps[0][1])
        if sums[i].status == "ok":
            low = min(r[2] for r in hit)
            at = [r[1] for r in hit if r[2] == low]
            assert (lows[i].target_pct, lows[i].first_effective_date, lows[i].last_effective_date, lows[i].record_count, lows[i].records_used) == (low / 100, at[0], at[-1], len(at), len(hit))
            assert (sums[i].record_count, sums[i].increases, sums[i].rate_before_pct, sums[i].rate_after_pct) == (len(hit), sum(r[3] > 0 for r in hit), (hit[0][2] - hit[0][3]) / 100, hit[-1][2] / 100)


def test_a_window_is_cut_into_few_blocks_without_overlap(spark):
    draw = random.Random(3)
    rows = [("a", s, s + draw.randrange(0, 60_000)) for s in (draw.randrange(-40_000, 40_000) for _ in range(200))] + [("a", 0, 0), ("a", -1, 0), ("a", 5, 4)]
    cut = {}
    for r in w.pieces(spark.createDataFrame(rows, "k string, _s int, _e int"), "k").collect():
        cut.setdefault((r._s, r._e), []).append((r._at, r._at + 2**r._level))
    assert set(cut) == {(s, e) for _, s, e in rows if s <= e}
    for (s, e), blocks in cut.items():
        blocks.sort()
        assert blocks[0][0] == s and blocks[-1][1] == e + 1 and len(blocks) <= 2 * w.LEVELS
        assert all(a[1] == b[0] for a, b in zip(blocks, blocks[1:], strict=False))


def test_no_requests_and_no_rows(prices, asked):
    _, df = prices
    assert w.drawdowns(asked[1].limit(0), df).count() == 0
    assert {r.status for r in w.drawdowns(asked[1], df.limit(0)).collect()} == {"UNKNOWN_TICKER"}
    assert {r.status for r in w.extremes(asked[1], df.limit(0), "close").collect()} == {"UNKNOWN_TICKER"}


def test_pattern_tables_equal_the_pattern_list(spark):
    texts = ["The bank of S&P, re-opened.", "banks", "bank's", None, "BANK_a bank", "s&p s & p", "Kelvin Kelvin", "a.b (c)", "of S&P", "ſun sun", "İnk ink ınk"]
    rows = [(i, day(17000 + i), t, "", "", "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "article_id long, publication_date date, headline string, subhead string, intro string, text string")
    patterns = ["bank", "S&P", "of S&P", "&", "re-opened", "Kelvin", "a.b", "(c)", "sun", "nobody", "bank of", ".", "ink", "BANK_a"]
    table = spark.createDataFrame([(p,) for p in [*patterns, "bank", ""]], "pattern string").repartition(3)
    want = {r.pattern: (r.article_count, r.articles_in_window, r["rank"]) for r in tx.pattern_count(df, patterns).collect()}
    assert {r.pattern: (r.article_count, r.articles_in_window, r["rank"]) for r in tx.pattern_table_count(df, table).collect()} == want
    assert tx.pattern_table_count(df, table.limit(0)).count() == 0
    spans = spark.createDataFrame([(1, "bank", None, None), (2, "bank", day(17003), day(17009)), (3, "nobody", None, None), (4, "bank", day(9), day(3))], "id int, pattern string, start date, end date")
    got = {r.id: (r.article_count, r.earliest, r.status) for r in tx.date_counts(df, spans).collect()}
    assert got == {1: (3, day(17000), "ok"), 2: (1, day(17004), "ok"), 3: (0, None, "NO_MATCHING_RECORDS"), 4: (0, None, "DATE_RANGE_INVALID")}


def test_a_text_meets_all_its_patterns_at_once(spark):
    texts = ["the end of σς days", "THE END", "the İnn", "the inn", "thend", "no ΣΣ days", "King a", "king a", "an end, the end"]
    df = spark.createDataFrame([(i, t, dt.date(2020, 1, 1)) for i, t in enumerate(texts)], "article_id bigint, all_text string, publication_date date")
    asked = ["the end", "The Inn", "king A", "σσ days", "σς days", "(the)", "end of", ", the"]
    want = {(p, i) for p in asked for i in [r.article_id for r in df.where(F.col("all_text").rlike(literal_regex(p))).collect()]}
    hits = tx.pattern_hits(df, spark.createDataFrame([(p,) for p in asked], "pattern string"))
    assert sorted((r.pattern, r.article_id) for r in hits.collect()) == sorted(want)
    assert "collect_list(pattern" in hits._jdf.queryExecution().optimizedPlan().toString()
