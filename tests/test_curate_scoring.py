"""Record curation, scoring and corpus rules on small tables."""

import pytest
from pyspark.sql import functions as F

from finframe.operators import corpus, curate
from finframe.operators import scoring as sc


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, f"q{i % 40}", "t" if i % 2 else "u", f"answer {i}", f"g{i % 11}") for i in range(60)]
    raw = spark.createDataFrame(rows, "i int, question string, task string, target string, grp string")
    return curate.canonical_records(raw, "src", "i", "target", ["question"], "task", group="grp", meta=["task"]).cache()


def test_canonical_records(spark, records):
    assert records.where("reject is not null").count() == 0
    assert records.select("id").distinct().count() == 60
    raw = spark.createDataFrame([(1, None, "t"), (2, "q", None)], "i int, question string, target string")
    got = {r.row_index: (r.reject, r.task, r.group_key) for r in curate.canonical_records(raw, "s", "i", "target", ["question"]).collect()}
    assert got[1][0] == "no input field" and got[2] == ("missing target", "default", "row:2")


def test_dedupe_keeps_the_first(records):
    kept = curate.dedupe_inputs(records.drop("reject"))
    assert kept.count() == 40
    assert sorted(r.row_index for r in kept.collect()) == list(range(40))


@pytest.mark.parametrize("fractions", [(0.8, 0.1, 0.1), (0.7, 0.15, 0.15), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)])
def test_group_split(records, fractions):
    split = curate.group_split(records, fractions, seed=3)
    assert curate.split_leaks(split).count() == 0
    sizes = {r.split: r.n for r in split.select("split", "group_key").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    want = {"train": int(11 * fractions[0]), "val": int(11 * fractions[1])}
    want["test"] = 11 - sum(want.values())
    assert sizes == {k: v for k, v in want.items() if v}


def test_fractions_must_add_up(records):
    with pytest.raises(ValueError):
        curate.group_split(records, (0.5, 0.1, 0.1))


def test_leak_is_found(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "val")], "group_key string, split string")
    assert [r.group_key for r in curate.split_leaks(rows).collect()] == ["a"]


def test_missing_template_key(records):
    strict = curate.render_messages(records, "{question} {context}")
    with pytest.raises(Exception, match="context"):
        strict.collect()
    loose = curate.render_messages(records, "{question} {context}!", strict=False, gold=False).first()
    assert loose.messages[0].content.endswith(" !") and len(loose.messages) == 1


def test_lengths_use_the_nearest_rank(spark):
    rows = spark.createDataFrame([("s", "x" * (4 * i)) for i in range(1, 21)], "split string, t string")
    messages = rows.select("split", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"))
    report = curate.length_report(messages)
    r = report.where("kind = 'total'").first()
    ordered = list(range(1, 21))
    assert (r.p50, r.p95, r["max"]) == (ordered[round(0.5 * 19)], ordered[round(0.95 * 19)], 20)
    assert curate.suggested_length(report).first().suggested == 256


def answers(spark, rows):
    return spark.createDataFrame(rows, "id int, prediction string, target string, components array<string>, inputs string")


def test_exact_match_normalises(spark):
    df = answers(spark, [(1, " The  Rate. ", "the rate", [], ""), (2, "a", "b", [], "")])
    got = [r.x for r in df.select(sc.exact_match(F.col("prediction"), F.col("target")).alias("x")).collect()]
    assert got == [1.0, 0.0]


def test_components_by_text_date_and_number(spark):
    df = answers(spark, [
        (1, "The rate was 0.10% on 4 November 2020", "", ["0.1", "2020-11-04", "rate", "9"], ""),
        (2, "Nov 4, 2020", "", ["4 Nov 2020"], ""),
        (3, "x", "", [], ""),
    ])
    got = {r.id: r for r in sc.component_scores(df).collect()}
    assert set(got) == {1, 2}
    assert (got[1].component_recall, got[1].all_components, got[1].n_components) == (0.75, 0.0, 4.0)
    assert got[2].all_components == 1.0
    near = sc.component_scores(answers(spark, [(1, "it is 5.31", "", ["5.3"], "")]), tolerance=0.02).first()
    assert near.component_recall == 1.0


def test_health(spark):
    df = answers(spark, [
        (1, "I will say approximately 16.0", "", [], "value 16"),
        (2, "It is 17.", "", [], "value 16"),
        (3, "Fine. Let me see", "", [], ""),
        (4, "x" * 401, "", [], ""),
    ])
    got = {r.id: r for r in sc.format_health(df, F.col("inputs")).collect()}
    assert (got[1].hedge_rate, got[1].preamble_rate, got[1].hallucinated_number_rate) == (1.0, 1.0, 0.0)
    assert got[2].hallucinated_number_rate == 1.0 and got[3].preamble_rate == 1.0
    assert got[4].over_length_rate == 1.0 and got[4].answer_chars == 401.0


def test_token_f1(spark):
    df = answers(spark, [(1, "a a b", "a b b c", [], ""), (2, "", "a", [], ""), (3, "x", "y", [], ""), (4, "Same, words", "same words", [], "")])
    got = {r.id: round(r.token_f1, 6) for r in sc.token_f1(df, ["id"]).collect()}
    assert got == {1: round(4 / 7, 6), 2: 0.0, 3: 0.0, 4: 1.0}


def test_facts_and_strings(spark):
    df = answers(spark, [(1, "It rose 1,234.5 to +12%", "", ["1,234", "12%", "rose", "2f"], ""), (2, "no", "", [], "")])
    got = {r.id: (r.fact_recall, r.correct) for r in sc.fact_recall(df).collect()}
    assert got == {1: (0.75, False), 2: (0.0, False)}
    shares = {r.id: r.x for r in df.select("id", sc.expected_strings(F.col("components"), F.col("prediction")).alias("x")).collect()}
    assert shares == {1: 0.75, 2: 1.0}


def test_calls(spark):
    schema = "id int, names array<string>, args array<struct<name:string,args:map<string,string>>>, actual array<struct<name:string,args:map<string,string>>>"
    call = lambda n, **a: (n, a)
    df = spark.createDataFrame(
        [
            (1, ["f"], [call("f", x="1")], [call("f", x="1", y="2"), call("g")]),
            (2, ["f"], [call("f", x="1")], [call("f", x="2")]),
            (3, ["f", "g"], [], [call("f")]),
            (4, [], [], []),
            (5, ["f"], [call("f"), call("g")], [call("f")]),
        ],
        schema,
    )
    got = {r.id: r.s for r in df.select("id", sc.calls_match(F.col("names"), F.col("args"), F.col("actual")).alias("s")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}


@pytest.mark.parametrize(
    "fact,answer,note,absent",
    [
        ("2024-01-05", "on 05 Jan 2024", None, False), ("2024-01-05", "on 6 Jan 2024", None, True), ("Jan 2024", "in 2024-01", None, False), ("Jan 2024", "in 2023", None, True),
        ("5.30%", "about 5.31", None, False), ("5.30%", "about 5.5", None, True), ("5.30%", "about 5.5", "allow +/-0.5", False), ("the bank", "nothing", None, False), ("", "x", None, True),
    ],
)
def test_provably_absent(spark, fact, answer, note, absent):
    df = spark.createDataFrame([(fact, answer, note)], "f string, a string, n string")
    assert df.select(sc.provably_absent(F.col("f"), F.col("a"), F.col("n")).alias("x")).first().x is absent


def test_points_by_latency_and_report(spark):
    rows = [(1, 5.0, True, 10.0), (1, 5.0, True, 10.0), (2, 10.0, True, 61.0), (3, 10.0, True, 301.0), (4, 10.0, False, 1.0)]
    cases = sc.score_cases(spark.createDataFrame(rows, "id int, points double, matched boolean, seconds double"), ["id"])
    assert {r.id: r.earned for r in cases.collect()} == {1: 10.0, 2: 8.0, 3: 0.0, 4: 0.0}
    r = sc.score_report(cases).first()
    assert (r.earned, r.possible, r.score_pct, r.perfect, r.slow, r.cases) == (18.0, 40.0, 45.0, 1, 2, 4)


def test_variant_choice(spark):
    rows = [
        ("base", 0, "recall", 0.5), ("base", 0, "bad", 0.0),
        ("s1", 1, "recall", 0.798), ("s1", 1, "bad", 0.1), ("s2", 2, "recall", 0.8), ("s2", 2, "bad", 0.1),
        ("s3", 3, "recall", 0.99), ("s3", 3, "bad", 0.9), ("s4", 4, "recall", 0.99),
    ]
    metrics = spark.createDataFrame(rows, "label string, step bigint, metric string, value double")
    r = sc.select_variant(metrics, "recall", {"bad": {"max": 0.5}}).first()
    assert (r.label, r.improvement, r.beat_base) == ("s1", 0.298, True)
    assert sc.select_variant(metrics, "recall", {"bad": {"max": 0.5}}, tie_tolerance=0.0).first().label == "s2"
    failed = sorted((v.label, v.value) for v in sc.candidate_violations(metrics, {"bad": {"max": 0.5}}).collect())
    assert failed == [("s3", 0.9), ("s4", None)]


def test_points_add_up_to_ten(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b", "c"],), (["x"] * 7,)], "facts array<string>")
    for r in df.select(corpus.split_points(F.col("facts")).alias("c")).collect():
        assert sum(round(c.points * 100) for c in r.c) == 1000


def test_unworded_case_is_left_out(spark):
    rows = spark.createDataFrame([("A", 1.0), ("B", None)], "t string, v double")
    found = corpus.cases(rows, corpus.said("FF-x-y-", F.col("t")), corpus.said("ask ", F.col("t")), [corpus.said("is ", F.col("v"))], ["prices"], "q")
    built = corpus.build_records(found).collect()
    assert [r.id for r in built] == ["FF-x-y-A"] and built[0].template_family == "FF-x-y"
    assert corpus.unrendered(found).first().skipped == 1
