"""Queries of the answer scoring."""

from pyspark.sql import functions as F

from finframe.functions.scalars import preview
from finframe.operators import scoring as op
from finframe.plans import sqlviews as v
from finframe.plans.base import query, with_views
from finframe.sources import views

_JOINED = ", answers AS (SELECT p.label, p.step, p.seconds, p.prediction, qa.* FROM predictions p JOIN qa USING (id))"


def _answers(spark, d):
    return op.with_records(views.predictions(spark, d), views.qa(spark, d))


_NORM = "regexp_replace(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '\\.+$', ''), '\\s+', ' ', 'g')"


@query(
    "score_exact",
    with_views(v.PREDICTIONS, f"{_JOINED} SELECT label, id, CAST({_NORM.format('prediction')} = {_NORM.format('target')} AS DOUBLE) AS exact_match FROM answers"),
)
def _(spark, d):
    return _answers(spark, d).select("label", "id", op.exact_match(F.col("prediction"), F.col("target")).alias("exact_match"))


# dates in the text are full month names here, so one format and ISO cover them
_COMPONENTS = _JOINED + r""", parts AS (SELECT label, step, id, task, trim(prediction) AS prediction, trim(c) AS c FROM (SELECT *, unnest(components) AS c FROM answers)),
nums AS (SELECT *, regexp_extract_all(c, '-?\d+(?:\.\d+)?') AS own, regexp_extract_all(prediction, '-?\d+(?:\.\d+)?') AS theirs,
  list_transform(regexp_extract_all(prediction, '\d{4}-\d{2}-\d{2}|\d{1,2} \w+ \d{4}|\w+ \d{1,2}, \d{4}'), lambda x: coalesce(try_strptime(x, '%d %B %Y'), try_strptime(x, '%Y-%m-%d'))) AS days FROM parts),
hits AS (SELECT *, (contains(lower(prediction), lower(c)) OR coalesce(list_contains(days, try_strptime(c, '%Y-%m-%d')), false)
  OR (len(own) = 1 AND coalesce(len(list_filter(theirs, lambda n: abs(CAST(n AS DOUBLE) - TRY_CAST(own[1] AS DOUBLE)) <= 0.0)) > 0, false))) AS hit FROM nums),
comp AS (SELECT label, step, id, task, round(count(*) FILTER (hit) / count(*), 6) AS component_recall, CAST(bool_and(hit) AS DOUBLE) AS all_components, CAST(count(*) AS DOUBLE) AS n_components FROM hits GROUP BY 1, 2, 3, 4)"""


def _components(spark, d):
    return op.component_scores(_answers(spark, d))


@query("score_components", with_views(v.PREDICTIONS, _COMPONENTS + " SELECT label, id, component_recall, all_components, n_components FROM comp"))
def _(spark, d):
    return _components(spark, d).select("label", "id", F.round("component_recall", 6).alias("component_recall"), "all_components", "n_components")


def _sql_list(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


_HEALTH = _JOINED + rf""", nums AS (SELECT *, list_distinct(regexp_extract_all(prediction, '-?\d+(?:\.\d+)?')) AS used, list_distinct(regexp_extract_all(prompt || ' ' || group_key || ' 2015', '-?\d+(?:\.\d+)?')) AS known FROM answers),
health AS (SELECT label, step, id, task,
  CAST(len(list_filter({_sql_list(op.HEDGES)}, lambda p: contains(lower(prediction), p))) > 0 AS DOUBLE) AS hedge_rate,
  CAST(len(list_filter({_sql_list(op.PREAMBLES)}, lambda p: starts_with(lower(prediction), p) OR contains(lower(prediction), '. ' || p))) > 0 AS DOUBLE) AS preamble_rate,
  CAST(length(prediction) > 400 AS DOUBLE) AS over_length_rate, CAST(length(prediction) AS DOUBLE) AS answer_chars,
  CAST(len(list_filter(used, lambda u: NOT list_contains(known, u) AND len(list_filter(known, lambda k: abs(CAST(k AS DOUBLE) - CAST(u AS DOUBLE)) < 1e-9)) = 0)) > 0 AS DOUBLE) AS hallucinated_number_rate FROM nums)"""
_HEALTH_COLUMNS = ["hedge_rate", "preamble_rate", "over_length_rate", "answer_chars", "hallucinated_number_rate"]


def _health(spark, d):
    return op.format_health(_answers(spark, d), F.concat_ws(" ", "prompt", "group_key", F.lit("2015")))


@query("score_format_health", with_views(v.PREDICTIONS, _HEALTH + f" SELECT label, id, {', '.join(_HEALTH_COLUMNS)} FROM health"))
def _(spark, d):
    return _health(spark, d).select("label", "id", *_HEALTH_COLUMNS)


_WORDS = r"list_filter(string_split(regexp_replace(replace(trim(lower({0}), ' ' || chr(9) || chr(10) || chr(13)), ',', ''), '\s+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(
    "score_token_f1",
    with_views(
        v.PREDICTIONS,
        _JOINED + f""", t AS (SELECT label, id, unnest({_WORDS.format('prediction')}) AS w, 1 AS p, 0 AS r FROM answers UNION ALL SELECT label, id, unnest({_WORDS.format('target')}), 0, 1 FROM answers),
        c AS (SELECT label, id, w, sum(p) AS p, sum(r) AS r FROM t GROUP BY 1, 2, 3)
        SELECT label, id, round(2 * sum(least(p, r)) / (sum(p) + sum(r)), 6) AS token_f1 FROM c GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    return op.token_f1(_answers(spark, d), ["label", "id"]).withColumn("token_f1", F.round("token_f1", 6))


_FACTS = _JOINED + r""", parts AS (SELECT label, id, prediction, trim(c) AS c FROM (SELECT *, unnest(components) AS c FROM answers)),
nums AS (SELECT *, TRY_CAST(regexp_replace(regexp_replace(c, '%+$|,', '', 'g'), '^\++', '') AS DOUBLE) AS target,
  list_transform(regexp_extract_all(prediction, '-?\d[\d,]*\.?\d*'), lambda n: TRY_CAST(replace(n, ',', '') AS DOUBLE)) AS theirs FROM parts),
hits AS (SELECT *, c <> '' AND CASE WHEN target IS NULL THEN contains(lower(prediction), lower(c)) ELSE len(list_filter(theirs, lambda n: abs(n - target) <= greatest(0.02, abs(target) * 0.005))) > 0 END AS hit FROM nums)"""


@query(
    "score_fact_recall",
    with_views(v.PREDICTIONS, _FACTS + " SELECT label, id, round(count(*) FILTER (hit) / count(*), 6) AS fact_recall, bool_and(hit) AS correct, count(*) AS n_facts FROM hits GROUP BY 1, 2"),
)
def _(spark, d):
    return op.fact_recall(_answers(spark, d)).select("label", "id", F.round("fact_recall", 6).alias("fact_recall"), "correct", "n_facts")


@query(
    "score_expected_strings",
    with_views(v.PREDICTIONS, _JOINED + " SELECT label, id, round(len(list_filter(components, lambda c: contains(lower(prediction), lower(c)))) / len(components), 3) AS share FROM answers"),
)
def _(spark, d):
    return _answers(spark, d).select("label", "id", op.expected_strings(F.col("components"), F.col("prediction")).alias("share"))


# each question's words play the calls; some answers miss a call or change an argument
@query(
    "score_calls",
    with_views(
        v.PREDICTIONS,
        _JOINED + """ SELECT label, id, CAST(CASE WHEN label = 'base' AND number % 2 = 1 THEN 0 WHEN label = 'step-100' AND number % 3 <> 0 THEN 0 ELSE 1 END AS BIGINT) AS score FROM answers""",
    ),
)
def _(spark, d):
    rows = _answers(spark, d)
    number, label = F.col("number"), F.col("label")
    call = lambda name, value: F.struct(name.alias("name"), F.create_map(F.lit("day"), value).alias("args"))
    wanted = F.array(call(F.col("task"), number.cast("string")))
    # one variant calls something else first for odd numbers, another gets an argument wrong
    first = F.when((label == "base") & (number % 2 == 1), F.lit("other")).otherwise(F.col("task"))
    value = F.when((label == "step-100") & (number % 3 != 0), F.lit("none")).otherwise(number.cast("string"))
    actual = F.array(call(first, value), call(F.lit("extra"), F.lit("x")))
    return rows.select("label", "id", op.calls_match(F.array("task"), wanted, actual).alias("score"))


_ABSENT = _FACTS.replace("parts AS (SELECT label, id,", "parts AS (SELECT label, id, number,").split("hits AS")[0] + r"""absent AS (SELECT label, id, c, CASE WHEN c = '' THEN true
  WHEN try_strptime(c, '%Y-%m-%d') IS NOT NULL THEN NOT (contains(lower(prediction), c) OR contains(lower(prediction), lower(strftime(try_strptime(c, '%Y-%m-%d'), '%d %b %Y'))) OR contains(lower(prediction), lower(strftime(try_strptime(c, '%Y-%m-%d'), '%d %B %Y'))))
  WHEN target IS NOT NULL THEN len(list_filter(theirs, lambda n: abs(n - target) <= greatest(0.02, abs(target) * 0.005, CASE WHEN number % 2 = 0 THEN 0.5 ELSE 0 END))) = 0 ELSE false END AS absent FROM nums)"""


@query("score_provably_absent", with_views(v.PREDICTIONS, _ABSENT + " SELECT label, id, c AS fact, absent, count(*) AS n FROM absent GROUP BY ALL"))
def _(spark, d):
    note = F.when(F.col("number") % 2 == 0, "values allow +/-0.5 points").otherwise("exact values")
    rows = _answers(spark, d).select("label", "id", "prediction", "number", F.explode("components").alias("fact"))
    out = rows.select("label", "id", F.trim("fact").alias("fact"), op.provably_absent(F.col("fact"), F.col("prediction"), note).alias("absent"))
    return out.groupBy("label", "id", "fact", "absent").agg(F.count(F.lit(1)).alias("n"))


_SLICED = _HEALTH + "," + _COMPONENTS[len(_JOINED) + 1 :].replace("nums AS", "cnums AS").replace("FROM nums", "FROM cnums") + """, scores AS (SELECT comp.*, preamble_rate, hallucinated_number_rate FROM comp JOIN health USING (label, id)),
sliced AS (SELECT label, step, 'all' AS slice_field, 'all' AS slice, component_recall, preamble_rate, hallucinated_number_rate FROM scores UNION ALL SELECT label, step, 'task', task, component_recall, preamble_rate, hallucinated_number_rate FROM scores),
means AS (UNPIVOT (SELECT label, step, slice_field, slice, round(avg(component_recall), 4) AS component_recall, round(avg(preamble_rate), 4) AS preamble_rate, round(avg(hallucinated_number_rate), 4) AS hallucinated_number_rate FROM sliced GROUP BY 1, 2, 3, 4)
  ON component_recall, preamble_rate, hallucinated_number_rate INTO NAME metric VALUE value)"""
_METRICS = ["component_recall", "preamble_rate", "hallucinated_number_rate"]


def _means(spark, d):
    rows = op.component_scores(_health(spark, d)).withColumn("component_recall", F.round("component_recall", 6))
    return op.mean_metrics(rows, _METRICS, ["task"])


@query("score_slices", with_views(v.PREDICTIONS, _SLICED + " SELECT * FROM means"))
def _(spark, d):
    return _means(spark, d)


_GUARDRAILS = {"preamble_rate": {"max": 0.5}, "component_recall": {"min": 0.2}}


@query(
    "select_variant",
    with_views(
        v.PREDICTIONS,
        _SLICED + """, wide AS (SELECT label, step, max(value) FILTER (metric = 'component_recall') AS primary_value, max(value) FILTER (metric = 'preamble_rate') AS pre FROM means WHERE slice_field = 'all' GROUP BY 1, 2),
        ok AS (SELECT * FROM wide WHERE label <> 'base' AND pre <= 0.5 AND primary_value >= 0.2)
        SELECT label, step, primary_value, (SELECT primary_value FROM wide WHERE label = 'base') AS base_value, round(primary_value - (SELECT primary_value FROM wide WHERE label = 'base'), 4) AS improvement,
          primary_value > (SELECT primary_value FROM wide WHERE label = 'base') AS beat_base FROM ok WHERE (SELECT max(primary_value) FROM ok) - primary_value <= 0.005 ORDER BY step, label LIMIT 1""",
    ),
)
def _(spark, d):
    return op.select_variant(_means(spark, d).where(F.col("slice_field") == "all"), "component_recall", _GUARDRAILS)


@query(
    "variant_violations",
    with_views(
        v.PREDICTIONS,
        _SLICED + " SELECT label, step, metric, value FROM means WHERE slice_field = 'all' AND ((metric = 'preamble_rate' AND value > 0.5) OR (metric = 'component_recall' AND value < 0.2))",
    ),
)
def _(spark, d):
    return op.candidate_violations(_means(spark, d).where(F.col("slice_field") == "all"), _GUARDRAILS)


_CASES = _JOINED + """, points AS (SELECT label, id, task, seconds, (task = 'rate' OR contains(lower(prediction), lower(c))) AS matched, 10.0 / len(components) AS points FROM (SELECT *, unnest(components) AS c FROM answers)),
cases AS (SELECT label, id, task, max(seconds) AS seconds, CAST(sum(points) AS DOUBLE) AS possible, round(CAST(sum(CASE WHEN matched THEN points ELSE 0 END) AS DOUBLE) * CASE WHEN max(seconds) > 300 THEN 0 WHEN max(seconds) > 60 THEN 0.8 ELSE 1 END, 4) AS earned FROM points GROUP BY 1, 2, 3)"""


def _cases(spark, d):
    rows = _answers(spark, d).select("label", "id", "task", "seconds", "prediction", (F.lit(10.0) / F.size("components")).alias("points"), F.explode("components").alias("fact"))
    matched = (F.col("task") == "rate") | F.contains(F.lower("prediction"), F.lower("fact"))
    out = op.score_cases(rows.withColumn("matched", matched), ["label", "id", "task"])
    return out.withColumns({"earned": F.round("earned", 4), "possible": F.round("possible", 4)})


@query("score_cases", with_views(v.PREDICTIONS, _CASES + " SELECT label, id, task, seconds, round(possible, 4) AS possible, earned FROM cases"))
def _(spark, d):
    return _cases(spark, d)


@query(
    "score_report",
    with_views(
        v.PREDICTIONS,
        _CASES + """ SELECT label, task, round(sum(earned), 4) AS earned, round(sum(round(possible, 4)), 4) AS possible, round(sum(earned) / sum(round(possible, 4)) * 100, 2) AS score_pct,
        count(*) FILTER (earned = round(possible, 4)) AS perfect, count(*) FILTER (seconds > 60) AS slow, count(*) AS cases FROM cases GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    return op.score_report(_cases(spark, d), ["label", "task"])


@query(
    "score_answers_by_id_or_text",
    with_views(
        v.PREDICTIONS,
        """, rec AS (SELECT CASE WHEN number % 2 = 0 THEN id END AS id, CASE WHEN number % 2 = 1 THEN prompt END AS question, target AS answer, CAST(number AS DOUBLE) AS seconds FROM qa WHERE number % 5 <> 0),
        by_id AS (SELECT id, min((answer, seconds)) AS a FROM rec WHERE id IS NOT NULL GROUP BY 1), by_q AS (SELECT question, min((answer, seconds)) AS b FROM rec WHERE question IS NOT NULL GROUP BY 1)
        SELECT qa.id, coalesce(a, b)[1] AS answer, coalesce(a, b)[2] AS seconds FROM qa LEFT JOIN by_id USING (id) LEFT JOIN by_q ON by_q.question = qa.prompt""",
    ),
)
def _(spark, d):
    qa, number = views.qa(spark, d), F.col("number")
    recorded = qa.where(number % 5 != 0).select(
        F.when(number % 2 == 0, F.col("id")).alias("id"), F.when(number % 2 == 1, F.col("prompt")).alias("question"), F.col("target").alias("answer"), number.cast("double").alias("seconds")
    )
    return op.answers_for_cases(qa.select("id", F.col("prompt").alias("question")), recorded).select("id", "answer", "seconds")


# predictions for records that do not exist keep their row
@query(
    "score_unmatched",
    with_views(
        v.PREDICTIONS,
        """, asked AS (SELECT label, CASE WHEN seconds % 7 = 0 THEN 'gone-' || id ELSE id END AS id FROM predictions)
        SELECT label, asked.id, task, qa.id IS NOT NULL AS matched FROM asked LEFT JOIN qa ON qa.id = asked.id""",
    ),
)
def _(spark, d):
    moved = views.predictions(spark, d).withColumn("id", F.when(F.col("seconds") % 7 == 0, F.concat(F.lit("gone-"), "id")).otherwise(F.col("id")))
    return op.with_records(moved, views.qa(spark, d), keep_unmatched=True).select("label", "id", "task", F.col("target").isNotNull().alias("matched"))


@query("answer_previews", with_views(v.QA, """ SELECT id, CASE WHEN length(target) <= 200 THEN target ELSE left(target, 200) || '... (truncated, ' || length(target) || ' chars total)' END AS shown FROM qa"""))
def _(spark, d):
    return views.qa(spark, d).select("id", preview(F.col("target"), 200).alias("shown"))
