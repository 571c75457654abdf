"""The registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finframe.llm import bpe, chat, collocations, crosstok, nearest, neardup, packing, pii, quality, shards, tokencount, topk, urls
from finframe.llm.oracles import ORACLES  # noqa: F401 - part of this module's interface
from finframe.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shards.assign(rows, key="doc_id", shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), WORD_BPE)
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests need each conversation's text in one row, so this query, unlike the operator, gathers it."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    windows = chat.windows(turns)
    back = windows.select(
        "conv_id", "start", F.length("text").cast("long").alias("_chars"), chat.read_back(F.col("text"), F.col("n_repeated")).alias("_turns"),
        chat.under_loss(F.col("text"), F.col("loss")).alias("_loss"))
    parts = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "_turns", "_loss"))).alias("_w"), F.sum("_chars").alias("formatted_chars"))
    turns_back = F.flatten(F.transform("_w", lambda w: w["_turns"]))
    loss = F.array_join(F.transform("_w", lambda w: w["_loss"]), "")
    flat = F.array_join(F.transform(turns_back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parts.select(
        "conv_id", F.size(turns_back).cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS r(host, path, verdict)")
    return urls.match(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files written from the table; the manifest tells the documents apart."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "flat")
    tokencount.write_flat(docs, folder, BYTE_BPE)
    counted = tokencount.count_tokens(spark, folder).withColumn("part", tokencount.part_of(F.col("file")))
    named = tokencount.manifest(docs).join(counted, ["part", "doc"], "full_outer")
    lost = F.raise_error(F.lit("the flat files and the documents do not match")).cast("long")
    return named.select("doc_id", F.coalesce("n_tokens", lost).alias("n_tokens"), "part", "doc", "start", "closed")


def op10_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE).drop("text")
    rows = bpe.decode(encoded, BYTE_BPE)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crosstok.link_figures(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), top=2000)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {f.__name__: f for f in (
    op1_ring_shards, op2_pack_sequences, op3_near_duplicates, op4_quality_rules, op5_chat_windows,
    op6_url_rules, op7_top_k, op8_personal_data, op9_token_counts, op10_encode_decode,
    op11_token_links, op12_collocations, op13_nearest,
)}
