r"""Quality rules: base statistics of each text and robust multivariate outliers.

Every text gets counts of words, symbols, repeated lines and repeated word
windows, and a vector of transformed statistics in whole thousandths.  For each
language and source a minimum-covariance-determinant estimate is worked out:
from the coordinates' medians and median deviations, concentration steps take
the share ``KEEP`` of rows with the smallest Mahalanobis distances and estimate
the centre and the covariance anew from them.  A row is rejected when its final
distance passes ``CUT``.

The steps need counts and sums only.  Distances are put into narrow classes on a
logarithmic scale; each group and class sums its whole-number vectors exactly
(so no order of addition matters), and the classes are summed up from the
nearest until they hold the wanted share.  A group of any size therefore crosses
the shuffle as one row per task and class.  The estimates are one row per group;
the join back lets Spark choose by their size.

Defined results: a null text has no words and counts 0.  ``base_failed`` rows are
not kept and take no part in the estimates.  A group of
any size has its own estimate.  A floor under each coordinate's
deviation keeps a coordinate without spread, as in small groups, from rejecting
what barely differs.  Where half of a group or more is junk of one kind (so a
group of one or two rows with one of junk), the estimate cannot tell which is
junk.
Null languages and sources are groups of their own.  Repeated rows are judged
each.  Columns of the input are kept, but for those that clash with the outputs
or the steps (``f_word``, ``m_0`` ...) or begin with an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.llm.columns import without
from finframe.session import checkpointed

SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?;:\"'()[]{}=/\\_~^@+-"

#: Transformed statistics in thousandths, as SQL that Spark and other engines read alike.
FEATURES = {
    "f_word": "round(1000 * ln(cast(word_chars as double) / n_words))",
    "f_symbol": "round(1000 * ln(1 + 100 * cast(n_symbols as double) / n_words))",
    "f_capital": "round(1000 * ln(1 + 100 * cast(n_capitals as double) / word_chars))",
    "f_mark": "round(1000 * ln(1 + 100 * cast(n_marks as double) / word_chars))",
    "f_repeat": "round(1000 * ln(1 + 100 * cast(n_repeat_words as double) / n_words))",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "base_failed")
#: Least standard deviation of each, in thousandths.
FLOOR = {"f_word": 40.0, "f_symbol": 250.0, "f_capital": 200.0, "f_mark": 250.0, "f_repeat": 400.0}
#: Documents are clean within this squared distance: about eleven deviations, as clean statistics have long tails.
CUT = 120.0
#: Half of the rows, so that junk of nearly half of a group does not enter the estimate.
KEEP = 0.5
#: 0.5 quantile of chi-squared with five degrees: brings the estimate to the scale of normal data.
MIDDLE = 4.351
STEPS = 5
LEAST = 1
CLASSES = 64  # per doubling of the squared distance


def _internal() -> list[str]:
    """Names of the columns that hold steps of the estimate."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    return ["d2", "scale", "n", *FEATURES, *[f"{x}_{i}" for x in "zmsw" for i in range(d)], *[f"{x}_{i}_{j}" for x in "lpc" for i, j in pairs]]


def _less(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks, base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_words", F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": _less(text, SYMBOLS).cast("long"), "n_capitals": _less(text, CAPITALS).cast("long"), "n_marks": _less(text, MARKS).cast("long"),
        "_lines": lines,
    })
    last = F.col("n_words").cast("int") - 3
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(last >= 1, window).otherwise(F.array().cast("array<bigint>")),
    }).drop("_lines", "_words")
    # only texts that hold a window twice pay for sorting windows with their places
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    count = F.size("_placed")
    behind = F.slice("_placed", 2, count)
    twice = F.zip_with(
        F.zip_with(F.col("_placed"), behind, lambda a, b: F.struct(a.alias("a"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("next"))),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_placed", 1, count - 1)),
        lambda x, before: F.when(x["next"] | F.coalesce(x["a"]["h"] == before["h"], F.lit(False)), x["a"]["i"]))
    hit = F.array_compact(twice)
    covered = F.size(F.array_distinct(F.flatten(F.array(hit, F.transform(hit, lambda i: i + 1), F.transform(hit, lambda i: i + 2)))))
    out = out.withColumn("n_repeat_words", F.when(F.col("_placed").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("_placed")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vectors(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f: F.when(~F.col("base_failed"), F.expr(sql).cast("long")) for f, sql in FEATURES.items()})


def _medians(rows: DataFrame, keys: list[str], what: dict[str, Column]) -> DataFrame:
    """Exact lower medians of whole numbers per group, from counts of the values."""
    cells = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("f"), c.alias("v")) for n, c in what.items()])).alias("_e"))
    cells = cells.groupBy(*keys, F.col("_e.f").alias("_f"), F.col("_e.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys, "_f")
    cells = cells.withColumn("_upto", F.sum("_n").over(run.orderBy("_v"))).withColumn("_all", F.sum("_n").over(run))
    mid = cells.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*keys, "_f").agg(F.min("_v").alias("_m"))
    return mid.groupBy(*keys).agg(*[F.max(F.when(F.col("_f") == n, F.col("_m"))).alias(n) for n in what])


def _join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    named = reduce(lambda d, k: d.withColumnRenamed(k, f"_g_{k}"), keys, groups)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return rows.join(named, on, "left").drop(*[f"_g_{k}" for k in keys])


def factor_sql() -> list[dict[str, str]]:
    """SQL of the Cholesky factor ``l_i_j`` of the covariance ``c_i_j``, in steps that use earlier ones only."""
    d, steps = len(FEATURES), []
    for j in range(d):
        square = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        steps.append({f"l_{j}_{j}": f"sqrt(greatest(c_{j}_{j}{square}, w_{j} / 100))"})
        if j + 1 < d:
            steps.append({f"l_{i}_{j}": "(c_{0}_{1}{2}) / l_{1}_{1}".format(i, j, "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))) for i in range(j + 1, d)})
    return steps


def distance_sql() -> list[dict[str, str]]:
    """SQL of the squared Mahalanobis distance ``d2`` from the centre ``m_i`` and the factor."""
    steps = []
    for i, f in enumerate(FEATURES):
        steps.append({f"z_{i}": "({0} - m_{1}{2}) / l_{1}_{1}".format(f, i, "".join(f" - l_{i}_{k} * z_{k}" for k in range(i)))})
    steps.append({"d2": " + ".join(f"z_{i} * z_{i}" for i in range(len(FEATURES)))})
    return steps


def _with(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    return reduce(lambda d, s: d.withColumns({n: F.expr(e) for n, e in s.items()}), steps, df)


#: The class of a squared distance; 0 up to 2**-10.
CLASS_SQL = f"cast(floor({CLASSES} * (10 + log2(greatest(d2, 0.0009765625)))) as bigint)"


def _factors(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Centres and factors from exact sums ``n, s_i, p_i_j``; ``scale`` brings the squared distance to normal data."""
    d = len(FEATURES)
    centre = {f"m_{i}": F.col(f"s_{i}").cast("double") / F.col("n") for i in range(d)}
    floors = {f"w_{i}": F.lit(FLOOR[f] ** 2) for i, f in enumerate(FEATURES)}
    cov = {}
    for i in range(d):
        for j in range(i + 1):
            c = F.col(f"p_{i}_{j}").cast("double") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")
            cov[f"c_{i}_{j}"] = c + F.lit(FLOOR[list(FEATURES)[i]] ** 2) if i == j else c
    out = _with(moments.withColumns(centre | floors).withColumns(cov), factor_sql())
    return out.select(*keys, *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centres at the medians, factors from median deviations, coordinates taken as unrelated."""
    d, names = len(FEATURES), list(FEATURES)
    mid = checkpointed(_medians(rows, keys, {f: F.col(f) for f in names}))
    off = _join(rows, reduce(lambda x, f: x.withColumnRenamed(f, f"_m_{f}"), names, mid), keys)
    mad = _medians(off, keys, {f: F.abs(F.col(f) - F.col(f"_m_{f}")) for f in names})
    both = _join(mid, reduce(lambda x, f: x.withColumnRenamed(f, f"_d_{f}"), names, mad), keys)
    spread = [F.sqrt(F.pow(1.4826 * F.col(f"_d_{f}"), 2) + FLOOR[f] ** 2) for f in names]
    return both.select(
        *keys, *[F.col(f).cast("double").alias(f"m_{i}") for i, f in enumerate(names)],
        *[(spread[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(d) for j in range(i + 1)])


def estimates(rows: DataFrame, keys: list[str], *, keep: float = KEEP, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """``keys, m_i, l_i_j, scale`` per group of at least ``least`` rows.

    ``rows`` holds the vectors of rows that passed the base rules.
    """
    d, names = len(FEATURES), list(FEATURES)
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(f).alias(f"s_{i}") for i, f in enumerate(names)] + [
        F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)]
    cols = ["n", *[f"s_{i}" for i in range(d)], *[f"p_{i}_{j}" for i in range(d) for j in range(i + 1)]]
    now = checkpointed(_start(rows, keys))
    for step in range(steps + 1):
        classed = _with(_join(rows, now, keys), distance_sql()).withColumn("_class", F.expr(CLASS_SQL))
        cells = classed.groupBy(*keys, "_class").agg(*sums)
        run = Window.partitionBy(*keys)
        grown = cells.select(*keys, "_class", F.col("n").alias("_own"), F.sum("n").over(run).alias("_all"), *[F.sum(c).over(run.orderBy("_class")).alias(c) for c in cols])
        near = grown.where((F.col("n") - F.col("_own") < keep * F.col("_all")) & (F.col("n") >= keep * F.col("_all")) & (F.col("_all") >= least))
        if step == steps:
            # the share's own distance against the one that normal data would have there
            reach = near.select(*keys, (F.pow(F.lit(2.0), (F.col("_class") + 1) / CLASSES - 10) / MIDDLE).alias("scale"))
            return _join(reach, now, keys)
        now = checkpointed(_factors(near, keys))


def judge(
    docs: DataFrame, *, text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), cut: float = CUT,
    keep: float = KEEP, steps: int = STEPS, least: int = LEAST, carry_text: bool = False,
) -> DataFrame:
    """The rows with their statistics, ``distance`` (squared, null without an estimate) and ``kept``.

    The texts are left out, and so not written between the steps, unless ``carry_text``.
    """
    keys = list(group_cols)
    docs = without(docs, [*COUNTS, "distance", "kept", *_internal()], [text_col, *keys])
    rows = _vectors(statistics(docs, text_col=text_col))
    rows = checkpointed(rows if carry_text else rows.drop(text_col))
    fit = rows.where(~F.col("base_failed")).select(*keys, *FEATURES)
    found = estimates(fit, keys, keep=keep, steps=steps, least=least)
    judged = _with(_join(rows, checkpointed(found), keys), distance_sql())
    judged = judged.withColumn("distance", F.col("d2") / F.greatest(F.col("scale"), F.lit(1.0)))
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cut, F.lit(False)))
    return judged.drop(*_internal())
