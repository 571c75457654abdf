"""Scoring answers: row scores, slices, variant selection and the score report.

``answers`` hold one row per (label, step, id) with ``prediction`` next to the
record's ``target``, ``components`` and ``inputs``.  All row scores but the
token overlap are column expressions without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.scalars import (
    ANSWER_DATE_FORMATS,
    DATE_IN_TEXT,
    GROUPED_NUMBER,
    PLAIN_NUMBER,
    any_of,
    normalised,
)

# Phrases that mark hedging.
HEDGES = (
    "approximately", "roughly", "around about", "it seems", "i think",
    "probably", "may have", "might have", "appears to be", "estimated",
)
# Phrases that mark a preamble.
PREAMBLES = (
    "i will", "i need to", "let me", "first, i", "the user is asking",
    "to answer this", "i'll use", "based on my search",
)
# Date layouts of the absence check.
DAY_FORMATS = ("yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy")
MONTH_FORMATS = ("MMM yyyy", "MMMM yyyy", "yyyy-MM")
# Fixed value: how a tolerance note states a margin.
TOLERANCE_NOTE = r"[+\-]/?-?\s*(\d+(?:\.\d+)?)"

SLOW_SECONDS, TIMEOUT_SECONDS = 60.0, 300.0


def with_records(predictions: DataFrame, records: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Predictions next to their records; without ``keep_unmatched`` unknown ids leave."""
    return predictions.join(records, "id", "left" if keep_unmatched else "inner")


def exact_match(prediction: Column, target: Column, normalise: bool = True) -> Column:
    same = normalised(prediction) == normalised(target) if normalise else prediction == target
    return same.cast("double")


def _numbers(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("double"))


def _date_of(text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in ANSWER_DATE_FORMATS])


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once per row, not once per place it is used in."""
    return F.transform(F.array(value), use)[0]


def component_hits(components: Column, prediction: Column, tolerance: float = 0.0) -> Column:
    """Per component: contained, or the same date, or its one number within the tolerance."""
    clean = F.trim(prediction)
    dates = F.transform(F.regexp_extract_all(clean, F.lit(DATE_IN_TEXT), F.lit(0)), _date_of)
    answer = F.struct(F.lower(clean).alias("text"), dates.alias("dates"), _numbers(clean, PLAIN_NUMBER).alias("numbers"))

    def fact(component: Column) -> Column:
        text = F.trim(component)
        own = _numbers(text, PLAIN_NUMBER)
        # every date layout has a year of four digits
        day = F.when(text.rlike(r"\d{4}"), _date_of(text))
        return F.struct(F.lower(text).alias("text"), day.alias("day"), F.when(F.size(own) == 1, F.element_at(own, 1)).alias("number"))

    def hit(f: Column, a: Column) -> Column:
        same_date = F.when(f["day"].isNotNull(), F.array_contains(a["dates"], f["day"]))
        close = F.when(f["number"].isNotNull(), F.exists(a["numbers"], lambda n: F.abs(n - f["number"]) <= tolerance))
        return F.coalesce(F.contains(a["text"], f["text"]), F.lit(False)) | F.coalesce(same_date, F.lit(False)) | F.coalesce(close, F.lit(False))

    return _bound(answer, lambda a: F.transform(components, lambda c: _bound(fact(c), lambda f: hit(f, a))))


def component_scores(answers: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Recall, all-found flag and count; rows without components leave."""
    rows = answers.where(F.size("components") > 0).withColumn("_hits", component_hits(F.col("components"), F.col("prediction"), tolerance))
    found, total = F.size(F.filter("_hits", lambda h: h)), F.size("_hits")
    return rows.withColumns(
        {
            "component_recall": found / total,
            "all_components": (found == total).cast("double"),
            "n_components": total.cast("double"),
        }
    ).drop("_hits")


def invented_numbers(prediction: Column, given: Column) -> Column:
    """Numbers of the answer that equal no number of the given text."""
    used = F.array_distinct(F.regexp_extract_all(prediction, F.lit(PLAIN_NUMBER), F.lit(0)))
    known = F.array_distinct(F.regexp_extract_all(given, F.lit(PLAIN_NUMBER), F.lit(0)))
    values = F.transform(known, lambda n: n.cast("double"))
    new = F.array_except(used, known)
    return F.filter(new, lambda n: ~F.exists(values, lambda k: F.abs(k - n.cast("double")) < 1e-9))


def format_health(answers: DataFrame, given: Column, max_chars: int = 400) -> DataFrame:
    """Hedging, preamble, over-length and invented-number flags, and the answer length."""
    text = F.col("prediction")
    low = F.lower(text)
    hedged = any_of([F.contains(low, F.lit(p)) for p in HEDGES])
    opened = any_of([F.startswith(low, F.lit(p)) | F.contains(low, F.lit(f". {p}")) for p in PREAMBLES])
    return answers.withColumns(
        {
            "hedge_rate": hedged.cast("double"),
            "preamble_rate": opened.cast("double"),
            "over_length_rate": (F.length(text) > max_chars).cast("double"),
            "answer_chars": F.length(text).cast("double"),
            "hallucinated_number_rate": (F.size(invented_numbers(text, given)) > 0).cast("double"),
        }
    )


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), ",", ""), r"\s+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _alone(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_alone``: no other row has these keys, so what is counted within the row is final."""
    return answers.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy(*reversed(keys))) == 1)


def _each(words: Column, **fields: Column) -> Column:
    """The words as ``w`` of structs, all with the same further fields."""
    return F.transform(words, lambda x: F.struct(x.alias("w"), *[c.alias(n) for n, c in fields.items()]))


def _overlap(ours: Column, gold: Column) -> Column:
    """Words that two texts share, with multiplicity, from one pass over the sorted words of both."""
    tagged = F.concat(_each(ours, own=F.lit(1)), _each(gold, own=F.lit(0)))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("p"), F.lit(0).alias("r"), F.lit(0).alias("both"))

    def met(a: Column, t: Column) -> Column:
        same = a["w"] == t["w"]
        p, r = F.when(same, a["p"]).otherwise(0) + t["own"], F.when(same, a["r"]).otherwise(0) + 1 - t["own"]
        # words of the answer come after the same words of the target, so each pairs off with one of those at most
        return F.struct(t["w"].alias("w"), p.alias("p"), r.alias("r"), (a["both"] + ((t["own"] == 1) & (p <= r)).cast("int")).alias("both"))

    return F.aggregate(F.sort_array(tagged), start, met, lambda a: a["both"])


def token_f1(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token overlap with multiplicity, as ``keys, token_f1``; rows of the same keys count as one text.

    A row whose keys no other row has is counted within itself and moves as one
    row of numbers; the words of all others are grouped.
    """
    rows = _alone(answers.select(*keys, _words(F.col("prediction")).alias("_ours"), _words(F.col("target")).alias("_gold")), keys)
    ours, gold = F.coalesce("_ours", F.array().cast("array<string>")), F.coalesce("_gold", F.array().cast("array<string>"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("w"), F.size(ours).alias("p"), F.size(gold).alias("r"), _overlap(ours, gold).alias("both")))
    none = F.lit(None).cast("int")
    each = [_each(ours, p=F.lit(1), r=F.lit(0), both=none), _each(gold, p=F.lit(0), r=F.lit(1), both=none)]
    counts = rows.select(*keys, F.explode_outer(F.when(F.col("_alone"), whole).otherwise(F.concat(*each))).alias("t")).select(*keys, "t.*")
    counts = counts.groupBy(*keys, "w").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("both").alias("both"))
    sums = counts.groupBy(*keys).agg(F.sum(F.coalesce("both", F.least("p", "r"))).alias("both"), F.sum("p").alias("np"), F.sum("r").alias("nr"))
    # 2PR/(P+R) with P = both/np and R = both/nr
    return sums.select(*keys, F.coalesce(F.try_divide(2 * F.col("both"), F.col("np") + F.col("nr")), F.lit(0.0)).alias("token_f1"))


def _stated_number(text: Column) -> Column:
    """A fact as a number, without its percent sign, commas and plus; NULL when it is none."""
    plain = F.regexp_replace(F.regexp_replace(text, "%+$|,", ""), r"^\++", "")
    return F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), plain.try_cast("double"))


def fact_hits(facts: Column, answer: Column) -> Column:
    """Per fact: a number within ``max(0.02, 0.5 %)``, or the text itself."""
    given = F.struct(F.lower(answer).alias("text"), _numbers(answer, GROUPED_NUMBER).alias("numbers"))

    def stated(fact: Column) -> Column:
        text = F.trim(fact)
        return F.struct(text.alias("text"), F.lower(text).alias("low"), _stated_number(text).alias("number"))

    def hit(f: Column, a: Column) -> Column:
        near = F.exists(a["numbers"], lambda n: F.abs(n - f["number"]) <= F.greatest(F.lit(0.02), F.abs(f["number"]) * 0.005))
        return (f["text"] != "") & F.when(f["number"].isNotNull(), F.coalesce(near, F.lit(False))).otherwise(F.contains(a["text"], f["low"]))

    return _bound(given, lambda a: F.transform(facts, lambda x: _bound(stated(x), lambda f: hit(f, a))))


def fact_recall(answers: DataFrame) -> DataFrame:
    rows = answers.withColumn("_hits", fact_hits(F.col("components"), F.col("prediction")))
    found, total = F.size(F.filter("_hits", lambda h: h)), F.size("_hits")
    recall = F.when(total > 0, found / total).otherwise(0.0)
    return rows.withColumns({"fact_recall": recall, "correct": (total > 0) & (found == total), "n_facts": total.cast("bigint")}).drop("_hits")


def expected_strings(expected: Column, answer: Column) -> Column:
    """Share of the expected strings the answer holds; 1 when none is expected."""
    low = F.lower(answer)
    found = F.size(F.filter(expected, lambda e: F.contains(low, F.lower(e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.round(found / F.size(expected), 3))


def calls_match(expected: Column, expected_args: Column, actual: Column) -> Column:
    """1 when the expected call names lead the actual ones and every stated argument is equal.

    ``expected`` is ``ARRAY<STRING>``; ``expected_args`` and ``actual`` are
    ``ARRAY<STRUCT<name, args MAP>>``, compared position by position.
    """
    names = F.transform(actual, lambda c: c["name"])
    prefix = F.slice(names, 1, F.greatest(F.size(expected), F.lit(1))) == expected
    prefix = F.when(F.size(expected) == 0, True).otherwise(prefix)
    pairs = F.transform(expected_args, lambda e, i: F.struct(e.alias("want"), F.get(actual, i).alias("got")))

    def fits(pair: Column) -> Column:
        want, got = pair["want"], pair["got"]
        same = F.forall(F.map_entries(want["args"]), lambda kv: F.coalesce(F.element_at(got["args"], kv["key"]) == kv["value"], F.lit(False)))
        return F.coalesce(got["name"] == want["name"], F.lit(False)) & F.coalesce(same, F.lit(True))

    return (prefix & F.forall(pairs, fits)).cast("bigint")


def provably_absent(fact: Column, answer: Column, note: Column) -> Column:
    """True only where a date or number fact appears in the answer in no equal form."""
    text, low = F.trim(fact), F.lower(answer)
    day = F.coalesce(*[F.try_to_date(text, f) for f in DAY_FORMATS])
    month = F.coalesce(*[F.try_to_date(text, f) for f in MONTH_FORMATS])
    # two-digit days, as the variants are written out
    day_forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "dd MMM yyyy", "dd MMMM yyyy")]
    month_forms = [F.date_format(month, f) for f in ("MMM yyyy", "MMMM yyyy", "yyyy-MM")]
    target = _stated_number(text)
    stated = F.regexp_extract(F.coalesce(note, F.lit("")), TOLERANCE_NOTE, 1).try_cast("double")
    base = F.greatest(F.lit(0.02), F.abs(target) * 0.005)
    tolerance = F.greatest(base, F.coalesce(stated, F.lit(0.0)))
    near = F.exists(_numbers(answer, GROUPED_NUMBER), lambda n: F.abs(n - target) <= tolerance)
    return (
        F.when(text == "", True)
        .when(day.isNotNull(), ~any_of([F.contains(low, F.lower(f)) for f in day_forms]))
        .when(month.isNotNull(), ~any_of([F.contains(low, F.lower(f)) for f in month_forms]))
        .when(target.isNotNull(), ~F.coalesce(near, F.lit(False)))
        .otherwise(False)
    )


def earned_points(raw: Column, seconds: Column) -> Column:
    return F.when(seconds > TIMEOUT_SECONDS, 0.0).when(seconds > SLOW_SECONDS, raw * 0.8).otherwise(raw)


def score_cases(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``outcomes(keys, points, matched, seconds)`` per component to one earned score per case."""
    cases = outcomes.groupBy(*keys).agg(
        F.sum(F.when(F.col("matched"), F.col("points")).otherwise(0.0)).alias("_raw"), F.sum("points").alias("possible"), F.max("seconds").alias("seconds")
    )
    return cases.withColumn("earned", earned_points(F.col("_raw"), F.col("seconds"))).drop("_raw")


def score_report(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cases.groupBy(*by).agg(
        F.round(F.sum("earned"), 4).alias("earned"), F.round(F.sum("possible"), 4).alias("possible"),
        F.round(F.try_divide(F.sum("earned"), F.sum("possible")) * 100, 2).alias("score_pct"),
        F.count_if(F.col("earned") == F.col("possible")).alias("perfect"), F.count_if(F.col("seconds") > SLOW_SECONDS).alias("slow"),
        F.count(F.lit(1)).alias("cases"),
    )


def answers_for_cases(cases: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded answers matched by id, else by the exact question text.

    ``cases(id, question, …)``, ``recorded(id, question, answer, seconds)``; one
    recorded row per id and one per question is kept first, so nothing fans out.
    """
    fields = F.struct("answer", "seconds")
    by_id = recorded.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(fields).alias("_a"))
    by_text = recorded.where(F.col("question").isNotNull()).groupBy("question").agg(F.min(fields).alias("_b"))
    joined = cases.join(by_id, "id", "left").join(by_text, "question", "left")
    found = F.coalesce("_a", "_b")
    return joined.select(*cases.columns, found["answer"].alias("answer"), found["seconds"].alias("seconds"))


def mean_metrics(scores: DataFrame, metrics: Sequence[str], slices: Sequence[str], keys: Sequence[str] = ("label", "step")) -> DataFrame:
    """Means per variant over all rows and per value of each slice field, as long rows."""
    fields = F.array(F.struct(F.lit("all").alias("slice_field"), F.lit("all").alias("slice")), *[
        F.struct(F.lit(s).alias("slice_field"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("slice")) for s in slices
    ])
    wide = scores.select(*keys, *metrics, F.inline(fields)).groupBy(*keys, "slice_field", "slice").agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])
    return wide.unpivot([*keys, "slice_field", "slice"], list(metrics), "metric", "value").where(F.col("value").isNotNull())


def select_variant(
    metrics: DataFrame, primary: str, guardrails: Mapping[str, Mapping[str, float]], tie_tolerance: float = 0.005, base: str = "base"
) -> DataFrame:
    """The earliest step within the tolerance of the best that breaks no guardrail, against the base.

    ``metrics(label, step, metric, value)``.  A guardrail that was not measured
    counts as broken.  The number of variants is small and aggregated first.
    """
    wide = metrics.groupBy("label", "step").agg(
        F.max(F.when(F.col("metric") == primary, F.col("value"))).alias("primary_value"),
        *[F.max(F.when(F.col("metric") == g, F.col("value"))).alias(f"g{i}") for i, g in enumerate(guardrails)],
    )
    broken = F.lit(0)
    for i, rule in enumerate(guardrails.values()):
        value = F.col(f"g{i}")
        bad = value.isNull() | (value > rule.get("max", float("inf"))) | (value < rule.get("min", float("-inf")))
        broken = broken + bad.cast("int")
    wide = wide.select("label", "step", "primary_value", broken.cast("bigint").alias("violations"))
    eligible = wide.where((F.col("label") != base) & (F.col("violations") == 0) & F.col("primary_value").isNotNull())
    best = eligible.agg(F.max("primary_value").alias("b")).scalar()
    base_value = wide.where(F.col("label") == base).agg(F.max("primary_value").alias("b")).scalar()
    chosen = eligible.where(best - F.col("primary_value") <= tie_tolerance).agg(F.min_by(F.struct("label", "step", "primary_value"), F.struct("step", "label")).alias("c"))
    return chosen.select("c.*", base_value.alias("base_value")).withColumn("improvement", F.round(F.col("primary_value") - F.col("base_value"), 4)).withColumn(
        "beat_base", F.col("primary_value") > F.col("base_value")
    )


def candidate_violations(metrics: DataFrame, guardrails: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Every variant and guardrail that fails, with the measured value."""
    items = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit(float(r.get("min", "-inf"))).alias("lowest"), F.lit(float(r.get("max", "inf"))).alias("highest"))
        for n, r in guardrails.items()
    ])
    wanted = metrics.select("label", "step").distinct().select("label", "step", F.inline(items))
    joined = wanted.join(metrics.select("label", "step", "metric", "value"), ["label", "step", "metric"], "left")
    bad = F.col("value").isNull() | (F.col("value") > F.col("highest")) | (F.col("value") < F.col("lowest"))
    return joined.where(bad).select("label", "step", "metric", "value")
