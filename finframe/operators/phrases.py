"""Whole-word phrases from an index of positions.

A text is a row of runs of word characters with gaps between them.  The index
has one row per run: its place, and the ends of the gaps beside it.  A phrase is
runs with gaps as well, so it stands where its runs follow one another with
equal gaps; no text is read for that.  The answer equals ``literal_regex``.

Three kinds of phrases or texts need more than the index, and are set apart:
phrases with other letters than ASCII, or with a long gap, are looked up by their
runs and confirmed on the few texts found; phrases without a run, or with a
letter that case-blind matching takes for a plain one, are tested on every text;
and texts with such a letter are tested against every phrase.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.functions.matching import literal_regex_of
from finframe.operators.text import DAY, all_text, in_dates
from finframe.session import checkpointed

RUN = "[A-Za-z0-9_]+"
ALIKE = "[\u0130\u0131\u017f\u212a]"  # letters that case-blind matching takes for plain ones
GAP = 16  # characters of a gap that are compared; one more is kept, so a longer gap is never equal


@dataclass(frozen=True)
class PhraseIndex:
    """Places of all runs, with what a search needs beside them; written tables."""

    places: DataFrame  # run, article_id, place, before, after; all of an article in one file, each file sorted by run
    runs: DataFrame  # run, places: how often it stands
    alike: DataFrame  # article_id, text: texts that hold a letter of ALIKE
    rows: DataFrame  # article_id, headline, publication_date

    def write(self, path: str) -> None:
        for name in ("places", "runs", "alike", "rows"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_phrases(spark, path: str) -> PhraseIndex:
    """An index that ``PhraseIndex.write`` left at a path."""
    return PhraseIndex(*[spark.read.parquet(f"{path}/{n}") for n in ("places", "runs", "alike", "rows")])


def _cut(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per run: ``place`` from 0, the gap before and the gap after it."""
    split = rows.select(*keep, F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("_r"), F.split(text, RUN, -1).alias("_g"))
    out = split.select(*keep, F.size("_r").alias("_n"), F.col("_g"), F.posexplode("_r").alias("place", "run"))
    return out.withColumns({"run": F.lower("run"), "before": F.col("_g")[F.col("place")], "after": F.col("_g")[F.col("place") + 1]}).drop("_g")


def build_phrases(articles: DataFrame) -> PhraseIndex:
    """Places in the whole searched text of every article."""
    texts = articles.select("article_id", all_text(articles).alias("text")).repartition("article_id")
    kept = {"before": F.right("before", F.lit(GAP + 1)), "after": F.left("after", F.lit(GAP + 1))}
    places = _cut(texts, "text", "article_id").withColumns(kept).drop("_n")
    # a frequent run spreads over files with the articles, and no place moves
    places = checkpointed(places.sortWithinPartitions("run", "article_id", "place"))
    runs = checkpointed(places.groupBy("run").agg(F.count(F.lit(1)).alias("places")))
    alike = checkpointed(articles.select("article_id", all_text(articles).alias("text")).where(F.col("text").rlike(ALIKE)))
    return PhraseIndex(places, runs, alike, checkpointed(articles.select("article_id", "headline", DAY)))


def _fits(part: str, near: str) -> Column:
    """Whether the gaps beside a place are those of the phrase's run."""
    first, last = F.col(f"{part}.first"), F.col(f"{part}.last")
    left = F.when(first, F.endswith(F.col(f"{near}.before"), F.col(f"{part}.before"))).otherwise(True)
    right = F.when(last, F.startswith(F.col(f"{near}.after"), F.col(f"{part}.after"))).otherwise(F.col(f"{near}.after") == F.col(f"{part}.after"))
    return F.col(f"{part}.loose") | (left & right)


def phrase_hits(articles: DataFrame, index: PhraseIndex, phrases: DataFrame | Sequence[str]) -> DataFrame:
    """``pattern, article_id``: the articles that hold each phrase as whole words.

    ``phrases`` is a table with a column ``pattern``, or a list, whose runs then
    limit the scan of the index.  A phrase starts from its rarest run; its other
    runs are asked at the places where they must stand.  Of ``articles`` only
    texts to be confirmed are read.
    """
    places = index.places
    if not isinstance(phrases, DataFrame):
        listed = F.array(*[F.lit(p) for p in phrases]).cast("array<string>")
        phrases = index.runs.sparkSession.range(1).select(F.explode(listed).alias("pattern"))
        wanted = sorted({r.run for r in _cut(phrases, "pattern").select("run").collect()})  # runs of the given list
        places = places.where(F.col("run").isin(wanted))
    asked = checkpointed(phrases.where(F.col("pattern") != "").select("pattern").distinct())
    everywhere = ~F.col("pattern").rlike(RUN) | F.col("pattern").rlike(ALIKE)
    parts = _cut(asked.where(~everywhere), "pattern", "pattern")
    long = F.length("before") > GAP, F.length("after") > GAP
    every = Window.partitionBy("pattern")  # the runs of one phrase
    parts = parts.withColumn("loose", F.bool_or(F.col("pattern").rlike("[^\\x00-\\x7F]") | long[0] | long[1]).over(every))
    parts = parts.withColumns({"first": F.col("place") == 0, "last": F.col("place") == F.col("_n") - 1})
    counted = parts.join(index.runs, "run", "left")
    parts = checkpointed(counted.withColumn("_at", F.row_number().over(every.orderBy(F.coalesce("places", F.lit(0)), "place"))).drop("places"))

    start = parts.where(F.col("_at") == 1).alias("p").join(places.alias("t"), (F.col("p.run") == F.col("t.run")) & _fits("p", "t"))
    start = start.select("p.pattern", "p.loose", "p._n", "t.article_id", (F.col("t.place") - F.col("p.place")).alias("start"))
    start = start.where(F.col("start") >= 0)
    single, longer = start.where(F.col("_n") == 1), start.where(F.col("_n") > 1)
    rest = parts.where(F.col("_at") > 1).drop("_n")
    due = checkpointed(longer.select("pattern", "article_id", "start").join(rest, "pattern").withColumn("place", F.col("start") + F.col("place")))
    on = (F.col("p.run") == F.col("t.run")) & (F.col("p.article_id") == F.col("t.article_id")) & (F.col("p.place") == F.col("t.place"))
    # where the due places are too many to travel, the others do: those of asked runs only
    near = places.join(rest.select("run").distinct(), "run", "left_semi")
    met = due.alias("p").join(near.alias("t"), on & _fits("p", "t")).select("p.pattern", "p.article_id", "p.start")
    met = met.groupBy("pattern", "article_id", "start").agg(F.count(F.lit(1)).alias("_met"))
    full = met.join(parts.where(F.col("_at") == 1).select("pattern", "loose", "_n"), "pattern").where(F.col("_met") == F.col("_n") - 1)
    found = checkpointed(single.select("pattern", "article_id", "loose").unionByName(full.select("pattern", "article_id", "loose")).distinct())

    hits = found.where(~F.col("loose")).select("pattern", "article_id")
    matches = F.regexp_like("_text", literal_regex_of(F.col("pattern")))
    unsure = found.where("loose").select("pattern", "article_id")
    texts = articles.select("article_id", all_text(articles).alias("_text"))
    # the texts are read only where something is left to be confirmed
    if not unsure.isEmpty():
        hits = hits.unionByName(unsure.join(texts, "article_id").where(matches).select("pattern", "article_id"))
    rare = asked.where(everywhere)
    for kind, rows, kinds in (("e", texts, rare), ("a", index.alike.withColumnRenamed("text", "_text"), asked)):
        if kinds.isEmpty() or (kind == "a" and rows.isEmpty()):
            continue
        held = kinds.agg(F.collect_list("pattern").alias("p")).scalar()  # phrases only, one list
        fitting = F.filter("_held", lambda p: F.regexp_like("_text", literal_regex_of(p)))
        hits = hits.unionByName(rows.withColumn("_held", held).select("article_id", F.explode(fitting).alias("pattern")))
    return hits.distinct()


def phrase_search(
    articles: DataFrame, index: PhraseIndex, phrases: DataFrame | Sequence[str], limit: int | None = None,
    start: str | None = None, end: str | None = None, excerpt: int = 400,
) -> DataFrame:
    """``pattern, rank`` and the articles that hold each phrase, by date, headline and id.

    Ranked from the index alone; texts are read for the rows shown.
    """
    held = phrase_hits(articles, index, phrases).join(in_dates(index.rows, start, end), "article_id")
    place = Window.partitionBy("pattern").orderBy(DAY, "headline", "article_id")
    shown = held.withColumn("rank", F.row_number().over(place).cast("bigint"))
    shown = shown if limit is None else shown.where(F.col("rank") <= limit)
    texts = articles.select("article_id", "subhead", F.substring(F.coalesce("text", F.lit("")), 1, excerpt).alias("excerpt"))
    return shown.join(texts, "article_id")
