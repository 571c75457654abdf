"""URL rules by host-suffix and path-prefix expressions.

A rule names a host and a path; it fits a URL of that host or a subdomain of it
whose path starts with the rule's path.  The longest fitting rule (host and
path together) decides; among equally long ones the longer host, then ``block``.

Each URL is expanded into expressions: every suffix of its host at a dot,
combined with the empty path and every prefix of its path that ends in a slash.
A rule's expression is its host with its path up to the last slash.  Both sides
meet by equality on the first 32 bits of a digest; the full digest and the rest
of the rule's path confirm the match.  Only depths that occur among the rules
are expanded, so a URL with thousands of dots and slashes stays cheap.

Work is done once per distinct URL.  Rules are never forced into memory: the
size of the table decides how Spark joins it.

Defined results: a null URL, or one without ``://``, has empty host and path and
fits only rules with both empty.  A null in a rule's host or path is empty; other
verdicts than ``block`` allow.  Repeated pages get a row each, repeated rules
count once, an empty table of rules gives the default.  Other columns are
kept, but for those that clash with the outputs or begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finframe.llm.columns import without

DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to the next of ``/?#``, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rules(rules: DataFrame) -> DataFrame:
    empty = F.lit("")
    named = rules.select(F.coalesce("host", empty).alias("_host"), F.coalesce("path", empty).alias("_path"), (F.col("verdict") == "block").alias("_block"))
    named = named.groupBy("_host", "_path").agg(F.coalesce(F.max("_block"), F.lit(False)).alias("_block"))
    folder = F.regexp_extract("_path", r"(?s)^(.*/)", 1)
    return named.withColumns({
        "_dots": F.size(F.split("_host", r"\.", -1)), "_slashes": F.length("_path") - F.length(F.translate("_path", "/", "")),
        "_digest": digest(F.col("_host"), folder),
    })


def digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, folder).cast("binary"), 256)


def short(full: Column) -> Column:
    """The first 32 bits of a digest as a number."""
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def _expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``_url, _path, _expr_digest`` for the depths that the rules have."""
    depths = rules.agg(F.collect_set("_dots").alias("_d"), F.collect_set("_slashes").alias("_s"))  # as many numbers as there are depths
    urls = urls.withColumns({"_d": depths.select("_d").scalar(), "_s": depths.select("_s").scalar()})
    labels = F.split("_host", r"\.", -1)
    hosts = F.transform(
        F.filter("_d", lambda n: n <= F.size("_labels")),
        lambda n: F.array_join(F.slice("_labels", F.size("_labels") - n + 1, n), "."),
    )
    folders = F.transform(F.filter("_s", lambda n: n <= F.size("_parts") - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice("_parts", 1, n), "/"), F.lit("/"))))
    spread = urls.withColumns({"_labels": labels, "_parts": F.split("_path", "/", -1)})
    spread = spread.withColumn("_h", F.explode(hosts)).withColumn("_f", F.explode(folders))
    return spread.select("_url", "_path", digest(F.col("_h"), F.col("_f")).alias("_expr"))


def match(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (null: none fits) and ``verdict``.

    ``rules`` has the columns host, path and verdict.
    """
    known = _rules(rules)
    pages = without(pages, ["host", "path", "rule", "verdict"], [url_col])
    urls = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    # what has no host is the same to every rule: one empty URL stands for it
    urls = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    met = _expressions(urls, known).withColumn("_key", short(F.col("_expr"))).join(
        known.select(F.col("_digest"), F.col("_host").alias("_rule_host"), F.col("_path").alias("_rule_path"), "_block", short(F.col("_digest")).alias("_key")), "_key")
    met = met.where((F.col("_expr") == F.col("_digest")) & F.col("_path").startswith(F.col("_rule_path")))
    order = F.struct(F.length("_rule_host") + F.length("_rule_path"), F.length("_rule_host"), "_block", "_rule_host", "_rule_path")
    best = met.groupBy("_url").agg(F.max(order).alias("_best")).select(
        "_url", F.concat(F.col("_best._rule_host"), F.col("_best._rule_path")).alias("rule"), F.when(F.col("_best._block"), "block").otherwise("allow").alias("_said"))
    rest = known.where((F.col("_host") == "") & (F.col("_path") == "")).agg(F.max("_block").alias("_b"))
    blank = F.when(rest.scalar().isNotNull() & F.col(url_col).isNull(), F.when(rest.scalar(), "block").otherwise("allow"))
    shaped = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    joined = shaped.join(best, shaped[url_col] == best["_url"], "left").drop("_url")
    return joined.withColumns({
        "rule": F.coalesce("rule", F.when(blank.isNotNull(), F.lit(""))), "verdict": F.coalesce("_said", blank, F.lit(default)),
    }).drop("_said")
