"""Queries of the record curation."""

from pyspark.sql import functions as F

from finframe.operators import curate as op
from finframe.operators.ordering import row_numbers
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views

# conversation turns as records; the shortest turns repeat their prompt so that copies exist
_RECORDS = """, raw AS (SELECT row_number() OVER (ORDER BY id) AS row_index, id AS qid, CASE WHEN number % 3 = 0 THEN task ELSE prompt END AS question, task, CASE WHEN number % 50 = 7 THEN NULL ELSE target END AS target, group_key, components FROM qa),
records AS (SELECT *, coalesce(qid, '') AS id FROM raw WHERE target IS NOT NULL)"""


def _raw(spark, d):
    number = F.col("number")
    # question ids are unique, so the index is one per row
    return row_numbers(views.qa(spark, d), [F.col("id")], name="row_index").select(
        "row_index", F.col("id").alias("qid"), F.when(number % 3 == 0, F.col("task")).otherwise(F.col("prompt")).alias("question"), "task",
        F.when(number % 50 != 7, F.col("target")).alias("target"), "group_key", "components",
    )


def _mapped(spark, d):
    rows = op.canonical_records(_raw(spark, d), "conversations", "row_index", "target", ["question"], "task", components="components", group="group_key", meta=["qid"])
    return rows


def _records(spark, d):
    """Records with the question id as their id, so the row order is total."""
    good = _mapped(spark, d).where(F.col("reject").isNull()).drop("reject")
    return good.withColumn("id", F.element_at("meta", "qid"))


@query(
    "canonical_records",
    with_views(
        v.QA,
        _RECORDS + """ SELECT substr(sha256('"conversations"' || chr(31) || row_index || chr(31) || CAST(to_json(target) AS VARCHAR)), 1, 16) AS id, task, target, question, group_key, row_index, qid
        FROM raw WHERE target IS NOT NULL""",
    ),
)
def _(spark, d):
    out = _mapped(spark, d).where(F.col("reject").isNull())
    return out.select("id", "task", "target", F.element_at("inputs", "question").alias("question"), "group_key", "row_index", F.element_at("meta", "qid").alias("qid"))


@query("canonical_rejects", with_views(v.QA, _RECORDS + " SELECT row_index, qid, 'missing target' AS reject FROM raw WHERE target IS NULL"))
def _(spark, d):
    return _mapped(spark, d).where(F.col("reject").isNotNull()).select("row_index", F.element_at("meta", "qid").alias("qid"), "reject")


@query(
    "structural_rejects",
    with_views(v.QA, """, r AS (SELECT id, CASE WHEN number % 7 = 0 THEN '' ELSE task END AS task, CASE WHEN number % 11 = 0 THEN '  ' ELSE target END AS target FROM qa)
    SELECT id, CASE WHEN task = '' THEN 'empty task' ELSE 'empty target' END AS reason FROM r WHERE task = '' OR trim(target) = ''"""),
)
def _(spark, d):
    number = F.col("number")
    rows = views.qa(spark, d).select(
        "id", F.when(number % 7 == 0, "").otherwise(F.col("task")).alias("task"), F.when(number % 11 == 0, "  ").otherwise(F.col("target")).alias("target"),
        F.create_map(F.lit("question"), F.col("prompt")).alias("inputs"),
    )
    return op.structural_rejects(rows).select("id", "reason")


@query(
    "dedupe_inputs",
    with_views(v.QA, _RECORDS + """, k AS (SELECT question, min(row_index) AS row_index, arg_min(id, row_index) AS id, count(*) AS copies FROM records GROUP BY 1) SELECT id, question, row_index, copies FROM k"""),
)
def _(spark, d):
    return op.dedupe_inputs(_records(spark, d)).select("id", F.element_at("inputs", "question").alias("question"), "row_index", "copies")


_SPLIT = _RECORDS + """, g AS (SELECT group_key, row_number() OVER (ORDER BY sha256('7:' || group_key)) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT group_key FROM records)),
split AS (SELECT records.*, CASE WHEN rank <= floor(n * 0.7) THEN 'train' WHEN rank <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM records JOIN g USING (group_key))"""


def _split(spark, d):
    return op.group_split(_records(spark, d), (0.7, 0.15, 0.15), seed=7)


@query("group_split", with_views(v.QA, _SPLIT + " SELECT id, group_key, split FROM split"))
def _(spark, d):
    return _split(spark, d).select("id", "group_key", "split")


@query("split_leakage", with_views(v.QA, _SPLIT + " SELECT group_key, count(DISTINCT split) AS splits FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1"))
def _(spark, d):
    return op.split_leaks(_split(spark, d))


@query("split_summary", with_views(v.QA, _SPLIT + " SELECT split, task, count(*) AS n, count(DISTINCT group_key) AS groups FROM split GROUP BY 1, 2"))
def _(spark, d):
    return op.split_summary(_split(spark, d))


_TEMPLATE = "QUESTION: {question}\nANSWER:"


@query(
    "render_messages",
    with_views(v.QA, _RECORDS + """ SELECT id, task, 'system' AS role_1, 'Answer from the facts.' AS content_1, 'user' AS role_2, 'QUESTION: ' || question || chr(10) || 'ANSWER:' AS content_2, 'assistant' AS role_3, target AS content_3 FROM records"""),
)
def _(spark, d):
    out = op.render_messages(_records(spark, d), _TEMPLATE, "Answer from the facts.")
    turns = [F.element_at("messages", i)[f].alias(f"{f}_{i}") for i in (1, 2, 3) for f in ("role", "content")]
    return out.select("id", "task", *turns)


@query(
    "prompts_only",
    with_views(v.QA, _RECORDS + " SELECT id, 1 AS turns, 'QUESTION: ' || question || chr(10) || 'ANSWER:' AS prompt FROM records ORDER BY id LIMIT 20"),
)
def _(spark, d):
    out = op.prompts_only(op.render_messages(_records(spark, d), _TEMPLATE), 20)
    return out.select("id", F.size("messages").alias("turns"), F.element_at("messages", 1)["content"].alias("prompt"))


_LENGTHS = _SPLIT + """, chars AS (SELECT split, length('QUESTION: ' || question || chr(10) || 'ANSWER:') + length(target) AS c FROM split),
lens AS (SELECT split, 'total' AS kind, c // 4 AS length FROM chars UNION ALL SELECT split, 'prompt', c // 5 FROM chars),
placed AS (SELECT split, kind, list(length ORDER BY length) AS ls, count(*) AS n FROM lens GROUP BY 1, 2),
report AS (SELECT split, kind, ls[CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, ls[CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1] AS p95, ls[n] AS max, n FROM placed)"""


def _report(spark, d):
    return op.length_report(op.render_messages(_split(spark, d), _TEMPLATE))


@query("length_report", with_views(v.QA, _LENGTHS + " SELECT * FROM report"))
def _(spark, d):
    return _report(spark, d)


@query(
    "suggested_length",
    with_views(v.QA, _LENGTHS + """ SELECT max(p95) AS p95, coalesce((SELECT min(b) FROM unnest([256, 512, 768, 1024, 1536, 2048, 4096]) t(b) WHERE b >= (SELECT max(p95) FROM report WHERE kind = 'total')), max(p95)) AS suggested FROM report WHERE kind = 'total'"""),
)
def _(spark, d):
    return op.suggested_length(_report(spark, d))
