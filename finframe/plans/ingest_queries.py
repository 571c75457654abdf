"""Queries of the readers, writers and checks.

Round trips write the raw form of a whole view to the shared folder and read it
back through the reader under test.
"""

from pyspark.sql import functions as F

from finframe.functions.scalars import shaped
from finframe.operators import checks, rates as rt
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.session import scratch_path
from finframe.sources import ingest, views

@query(
    "ingest_rates_csv",
    with_views(v.RATES, "SELECT series_key, CAST(effective_date AS VARCHAR) AS effective_date, target_bp, change_bp FROM rates"),
)
def _(spark, d):
    path = scratch_path(spark, "rates-csv")
    views.rates(spark, d).select(
        "series_key", F.date_format("effective_date", "d MMM yyyy").alias("Effective Date"), F.format_string("%+.2f", F.col("change_bp") / 100.0).alias("Change % points"),
        F.format_string("%.2f", F.col("target_bp") / 100.0).alias("Cash rate target%"),
    ).write.partitionBy("series_key").csv(path, header=True)
    kept, _ = ingest.read_rates_csv(spark, path)
    return shaped(kept)


_BAR_SQL = "SELECT ticker, CAST(date AS VARCHAR) AS date, open, high, low, close, {volume} AS volume FROM prices"


@query("ingest_prices_json", with_views(v.PRICES_WIDE, _BAR_SQL.format(volume="CASE WHEN volume % 10 <> 0 THEN volume END")))
def _(spark, d):
    path = scratch_path(spark, "prices-json")
    text = F.when(F.col("volume") % 10 == 0, "n/a").otherwise(F.col("volume").cast("string"))
    ingest.write_jsonl(views.prices_wide(spark, d).withColumn("volume", text).withColumn("date", F.col("date").cast("string")), path)
    kept, _ = ingest.read_prices_json(spark, path)
    return shaped(kept)


@query("ingest_prices_partitioned", with_views(v.PRICES_WIDE, _BAR_SQL.format(volume="volume")))
def _(spark, d):
    path = scratch_path(spark, "prices-parquet")
    # a ticker has a few rows here, so a folder each would cost more than the rows
    bars = ingest.in_parts(views.prices_wide(spark, d), "ticker")
    ingest.write_parquet(bars, path, ["ticker_part"])
    back = ingest.read_parquet(spark, path, bars.schema)
    return shaped(back.select("ticker", "date", "open", "high", "low", "close", "volume"))


def _read_articles(spark, d):
    path = scratch_path(spark, "articles-json")
    raw = views.articles_raw(spark, d)
    ingest.write_jsonl(
        raw.select(
            F.col("headline").alias("HEADLINE"), F.col("subhead").alias("SUBHEAD"), F.col("intro").alias("INTRO"), F.col("text").alias("TEXT"),
            F.lit("paper").alias("NEWSPAPER"), F.col("publication_date").alias("PUBLICATIONDATE"), F.col("article_id").cast("string").alias("DOC_ID"),
        ),
        path,
    )
    return ingest.read_articles_json(spark, path, ["DOC_ID"])


@query(
    "ingest_articles_json",
    with_views(v.ARTICLES, "SELECT CAST(article_id AS VARCHAR) AS doc_id, headline, subhead, intro, text, 'paper' AS newspaper, CAST(publication_date AS VARCHAR) AS publication_date, year(publication_date) AS year, month(publication_date) AS month FROM articles WHERE article_id % 97 <> 0"),
)
def _(spark, d):
    kept, _ = _read_articles(spark, d)
    return shaped(kept.withColumns({"year": F.col("year").cast("bigint"), "month": F.col("month").cast("bigint")}))


@query("ingest_rejects", with_views(v.ARTICLES, "SELECT CAST(article_id AS VARCHAR) AS doc_id, '' AS raw_date FROM articles WHERE article_id % 97 = 0"))
def _(spark, d):
    _, bad = _read_articles(spark, d)
    return bad.select("doc_id", "raw_date")


@query(
    "article_ids",
    with_views(v.ARTICLES, "SELECT article_id AS doc_id, row_number() OVER (ORDER BY publication_date, headline, articles.article_id) AS article_id FROM articles"),
)
def _(spark, d):
    rows = views.articles(spark, d).select(F.col("article_id").alias("doc_id"), "headline", "publication_date")
    return ingest.with_article_ids(rows, ["doc_id"]).select("doc_id", "article_id")


# Layouts the order days are written in, one per key in turn.
_FORMATS = ("yyyy-MM-dd", "d MMM yyyy", "yyyyMMdd", "d-MMM-yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def _text_dates(spark, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.lit("soon")
    for i, fmt in enumerate(_FORMATS):
        text = F.when(key % 8 == i, F.date_format(day, fmt)).otherwise(text)
    return views.table(spark, d, "orders").select(key, F.when(key % 8 == 7, "").otherwise(text).alias("order_date"))


_DATES = """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d')
  WHEN 3 THEN strftime(o_orderdate, '%-d-%b-%Y') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 6 THEN 'soon' ELSE '' END AS order_date FROM orders)"""


@query(
    "normalise_dates",
    _DATES + """ SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%d %b %Y'), try_strptime(order_date, '%Y%m%d'),
       try_strptime(order_date, '%d-%b-%Y'), try_strptime(order_date, '%m/%d/%Y'), try_strptime(order_date, '%d/%m/%Y')), '%Y-%m-%d'), order_date) AS order_date FROM t""",
)
def _(spark, d):
    fixed, _ = ingest.normalise_dates(_text_dates(spark, d))
    return fixed


@query("normalise_dates_rejects", _DATES + " SELECT 'order_date' AS \"column\", order_date AS value, count(*) AS n FROM t WHERE order_date = 'soon' GROUP BY 1, 2")
def _(spark, d):
    _, bad = ingest.normalise_dates(_text_dates(spark, d))
    return bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_report",
    with_views(v.PRICES_WIDE, "SELECT count(*) AS row_count, count(DISTINCT ticker) AS ticker_distinct, 0 AS close_nulls, count(*) FILTER (volume % 10 = 0) AS volume_nulls, count(*) AS note_nulls, 'note' AS missing FROM prices"),
)
def _(spark, d):
    bars = views.prices_wide(spark, d).withColumn("volume", F.when(F.col("volume") % 10 != 0, F.col("volume"))).withColumn("note", F.lit(None).cast("string"))
    return ingest.ingest_report(bars, ["close", "volume", "note"], ["ticker"])


# every bar of the panel answers a request written as a name, a full code or a bare code
@query(
    "resolve_tickers",
    with_views(v.PRICES_WIDE, "SELECT ticker || '-' || date AS request, CASE WHEN CAST(ticker AS BIGINT) % 4 = 3 THEN NULL ELSE 'T' || ticker || '.AX' END AS ticker FROM prices"),
)
def _(spark, d):
    bars = views.prices_wide(spark, d).select(F.col("ticker").alias("t"), "date")
    names = bars.select(F.concat(F.lit("Firm "), "t").alias("company"), F.concat(F.lit("T"), "t", F.lit(".AX")).alias("ticker")).distinct()
    form = F.col("t").cast("bigint") % 4
    asked = bars.select(
        F.concat_ws("-", "t", "date").alias("request"),
        F.when(form == 0, F.concat(F.lit(" firm "), "t")).when(form == 1, F.concat(F.lit("t"), "t", F.lit(".ax"))).when(form == 2, F.concat(F.lit("T"), "t")).otherwise("?").alias("name"),
    )
    return ingest.resolve_tickers(asked, ingest.ticker_aliases(names), "name").select("request", "ticker")


@query(
    "ingest_rates_reordered",
    with_views(v.RATES, "SELECT series_key, CAST(effective_date AS VARCHAR) AS effective_date, target_bp, change_bp FROM rates"),
)
def _(spark, d):
    path = scratch_path(spark, "rates-reordered")
    views.rates(spark, d).select(
        "series_key", F.format_string("%.2f", F.col("target_bp") / 100.0).alias("Cash rate target%"), F.lit("-").alias("Note"),
        F.date_format("effective_date", "d MMM yyyy").alias("Effective Date"), F.format_string("%+.2f", F.col("change_bp") / 100.0).alias("Change % points"),
    ).write.partitionBy("series_key").csv(path, header=True)
    kept, _ = ingest.read_rates_csv(spark, path)
    return shaped(kept)


# three orders of columns; the files of the series take one each
_ORDERS = (("Effective Date", "Change % points", "Cash rate target%"), ("Cash rate target%", "Effective Date", "Change % points"), ("Change % points", "Note", "Cash rate target%", "Effective Date"))
_ORDER_SQL = "CASE CAST(left(series_key, 1) AS INTEGER) % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"


def _ragged_files(spark, d):
    """The decision lines of every series, in one of three orders of columns, every fifth month's with a field too many."""
    path = scratch_path(spark, "rates-ragged")
    cell = {
        "Effective Date": F.date_format("effective_date", "d MMM yyyy"), "Change % points": F.format_string("%+.2f", F.col("change_bp") / 100.0),
        "Cash rate target%": F.format_string("%.2f", F.col("target_bp") / 100.0), "Note": F.lit('"a, b"')}
    order = F.substring("series_key", 1, 1).cast("int") % 3

    def by_order(texts):
        return F.when(order == 0, texts[0]).when(order == 1, texts[1]).otherwise(texts[2])

    rates = views.rates(spark, d)
    line = by_order([F.concat_ws(",", *[cell[n] for n in names]) for names in _ORDERS])
    line = F.when(F.month("effective_date") % 5 == 0, F.concat(line, F.lit(",surplus"))).otherwise(line)
    heads = rates.select("series_key").distinct().select("series_key", F.lit(0).alias("o"), by_order([F.lit(",".join(names)) for names in _ORDERS]).alias("value"))
    # a series has a line per month and one file, with its header on top
    lines = rates.select("series_key", F.lit(1).alias("o"), line.alias("value")).unionByName(heads)
    lines.repartition("series_key").sortWithinPartitions("series_key", "o").select("series_key", "value").write.partitionBy("series_key").text(path)
    return path


_D, _CH, _L = "strftime(effective_date, '%-d %b %Y')", "printf('%+.2f', change_bp / 100.0)", "printf('%.2f', target_bp / 100.0)"
_LINE_SQL = _ORDER_SQL.format(f"{_D} || ',' || {_CH} || ',' || {_L}", f"{_L} || ',' || {_D} || ',' || {_CH}", f"""{_CH} || ',"a, b",' || {_L} || ',' || {_D}""")


@query("ingest_ragged_lines", with_views(v.RATES, f"SELECT series_key, {_LINE_SQL} || ',surplus' AS line FROM rates WHERE month(effective_date) % 5 = 0"))
def _(spark, d):
    return ingest.rates_text(spark, _ragged_files(spark, d))[1]


@query("ingest_ragged_rows", with_views(v.RATES, "SELECT series_key, CAST(effective_date AS VARCHAR) AS effective_date, target_bp, change_bp FROM rates"))
def _(spark, d):
    return shaped(ingest.read_rates_csv(spark, _ragged_files(spark, d))[0])


@query("ingest_plain_parquet", with_views(v.RATES, "SELECT series_key, CAST(effective_date AS VARCHAR) AS effective_date, target_bp, change_bp FROM rates"))
def _(spark, d):
    path, rates = scratch_path(spark, "rates-parquet"), views.rates(spark, d)
    ingest.write_parquet(rates, path)
    return shaped(ingest.read_parquet(spark, path, rates.schema))


@query(
    "ingest_articles_partitioned",
    with_views(v.ARTICLES, "SELECT article_id, headline, text, CAST(year(publication_date) AS INTEGER) AS year, CAST(month(publication_date) AS INTEGER) AS month FROM articles WHERE year(publication_date) = 2016"),
)
def _(spark, d):
    path = scratch_path(spark, "articles-parquet")
    articles = views.articles(spark, d).select("article_id", "headline", "text", "year", "month")
    ingest.write_parquet(articles, path, ["year", "month"])
    # the year names folders, so only its files are read
    return ingest.read_parquet(spark, path, articles.schema).where("year = 2016").select("article_id", "headline", "text", "year", "month")


@query(
    "csv_to_json_lines",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, 'customers' AS source FROM customer",
)
def _(spark, d):
    source, target = scratch_path(spark, "customers-csv"), scratch_path(spark, "customers-jsonl")
    views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("segment"),
    ).write.csv(source, header=True)
    ingest.csv_to_jsonl(spark, source, target, {"source": "customers"})
    return spark.read.schema("id bigint, name string, balance double, segment string, source string").json(target)


def _records(spark, d, form):
    """Supplier names as JSON lines, or as the list under a key of one object per file."""
    path = scratch_path(spark, f"records-{form}") + (".jsonl" if form == "lines" else "")
    rows = views.table(spark, d, "supplier").select("s_suppkey", "s_name")
    if form == "lines":
        rows.write.json(path)
    else:
        item = F.struct("s_suppkey", "s_name")
        # at most a hundred records a file, however many there are
        per_file = rows.groupBy(F.expr("s_suppkey div 100").alias("k")).agg(F.collect_list(item).alias("items"))
        text = F.to_json(F.struct("items")) if form == "object" else F.to_json("items")
        per_file.select(text.alias("value"), "k").repartition("k").write.partitionBy("k").text(path)
    return path


def _record_query(form):
    @query(f"read_records_{form}", "SELECT s_suppkey, s_name FROM supplier")
    def _(spark, d):
        from pyspark.sql.types import StructType

        found = ingest.read_records(spark, _records(spark, d, form), StructType.fromDDL("s_suppkey bigint, s_name string"), "items" if form == "object" else None)
        return found.select("s_suppkey", "s_name")


for _form in ("lines", "object", "list"):
    _record_query(_form)


@query(
    "grading_cases_shapes",
    with_views(v.QA, """SELECT id, prompt AS question, target AS reference_answer, unnest(range(1, 1 + len(components))) AS place, unnest(components) AS fact, CAST(CASE WHEN number % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS points FROM qa"""),
)
def _(spark, d):
    qa = views.qa(spark, d)
    rich = F.col("number") % 2 == 0
    parts = F.transform("components", lambda c, i: F.struct(F.format_string("K%d", i).alias("component_id"), c.alias("expected_fact"), F.lit(2.0).alias("points")))
    rows = qa.select(
        "id", F.lit(None).cast("string").alias("difficulty"), F.when(rich, F.col("prompt")).alias("prompt"), F.when(~rich, F.col("prompt")).alias("question"),
        F.when(rich, F.col("target")).alias("reference_answer"), F.when(~rich, F.col("target")).alias("answer"),
        F.when(rich, F.struct(parts.alias("components"), F.lit("note").alias("tolerance_note"))).alias("grading"), F.when(~rich, F.col("components")).alias("grading_components"),
    )
    cases = ingest.grading_cases(rows).select("id", "question", "reference_answer", F.posexplode("components").alias("i", "c"))
    return cases.select("id", "question", "reference_answer", (F.col("i") + 1).cast("bigint").alias("place"), F.col("c.expected_fact").alias("fact"), F.col("c.points").alias("points"))


@query(
    "evidence",
    with_views(
        v.RATES,
        """SELECT series_key, 'rates' AS dataset, 'counts by sign' AS method, count(*) AS records_used, min(effective_date) || ' to ' || max(effective_date) AS coverage, 'percent' AS unit FROM rates GROUP BY 1""",
    ),
)
def _(spark, d):
    summary = rt.change_summary(views.rates(spark, d))
    out = checks.with_evidence(summary, "rates", "counts by sign", F.col("record_count"), F.col("window_start"), F.col("window_end"), {"unit": "percent"})
    return out.select("series_key", "evidence.dataset", "evidence.method", "evidence.records_used", "evidence.coverage", F.element_at("evidence.notes", "unit").alias("unit"))
