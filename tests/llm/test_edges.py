"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from finframe.llm import bpe, chat, neardup, packing, pii, quality, shards, tokencount, topk, urls
from finframe.session import scratch_path

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "one", "a b c d", "it's 'S I'LL 12½² \x1c a\t\n\nb", "İstanbul ΑΣ. naïve ﬁ", "x" * 3000 + " y", "日本語 テスト" * 50,
    "...!!!'s", "a\x85b\xa0c\r\nd", " lead", "trail \n", "\x00\x01 z", "don't_stop _ a_b", "🙂🙂 👍🏽 x " * 200, "<|endoftext|>" * 40, "\n" * 2000 + "x" + " " * 3000,
    "one", "word " * 30000, "<|startoftext|>ab <|endoftext|>",
]


def docs(spark, texts=ODD, extra=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    return df.selectExpr("*", *extra.split(",")) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def got(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


# sharding

def test_shards_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(7,)] * 6 + [(8,)], "doc_id long").selectExpr("*", "'x' shard", "1 _turn", "2 slot")
    rows = shards.assign(df, shards=5).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(5)]
    assert len(rows) == 12 and max(sizes) - min(sizes) <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


@pytest.mark.parametrize("n", [0, 1, 3, 8, 9])
def test_fewer_rows_than_shards(spark, n):
    rows = shards.assign(spark.range(n).withColumnRenamed("id", "doc_id"), shards=8).collect()
    assert len(rows) == n
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_slack_keeps_more_keys_at_home_and_growth_moves_few(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    tight = shards.assign(keys, shards=8)
    loose = shards.assign(keys, shards=8, slack=0.25)
    home = {name: df.where("shard = home_shard").count() for name, df in (("tight", tight), ("loose", loose))}
    assert home["loose"] > home["tight"] > 4000 * 0.8
    assert max(r["count"] for r in loose.groupBy("shard").count().collect()) <= math.ceil(4000 * 1.25 / 8)
    grown = shards.assign(keys, shards=9).select("doc_id", F.col("shard").alias("later"))
    moved = tight.join(grown, "doc_id").where("shard <> later").count()
    assert moved < 4000 * 0.35  # a ninth must move; a plain modulus moves eight ninths


# packing

def test_pieces_of_odd_texts(spark):
    rows = packing.token_pieces(docs(spark), WORD_BPE).withColumn("crc", F.crc32("ids")).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.crc) for r in rows} == brute.pieces(list(enumerate(ODD)))


def test_packing_edges(spark):
    sizes = [None, -3, 0, 1, 4096, 5000, 4095, 2048, 2048, 1]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k int, length int").selectExpr("*", "'q' offset", "3 _row")
    rows = packing.pack(df).collect()
    assert sorted(r.k for r in rows) == list(range(10))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, max(0, r.length or 0)))
    assert all(sum(n for _, n in p) <= 4096 or len(p) == 1 for p in by.values())
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.token_pieces(empty(spark), WORD_BPE).count() == 0


def test_lanes_and_rounds_fill_well(spark):
    df = spark.range(3000).select("id", (1 + F.pmod(F.xxhash64("id"), F.lit(1500))).alias("length"))
    rows = packing.pack(df, lane_rows=500).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= math.ceil(total / 4096 * 1.02)
    ids = packing.sequences(packing.pack(packing.token_pieces(docs(spark, ["a b", "c"]), WORD_BPE))).collect()
    assert [len(r.ids) for r in ids] == [20]


# near duplicates

def near_cases():
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    return [None, "", " \n", "a b", "A\tB", "a b c", base, base.upper(), base + " tail", " ".join([*words[:30], "new", *words[30:]]), base, "one two three four five", "one two three four five six"]


def test_near_duplicates_edges(spark):
    texts = near_cases()
    df = neardup.near_duplicates(docs(spark, texts, "1 kept,2 n,3 _row"))
    assert got(df, "doc_id", "n_shingles", "component_id", "kept") == brute.groups(list(enumerate(texts)))
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_first_row_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, ""), (None, None)], "doc_id long, text string").coalesce(1)
    rows = neardup.near_duplicates(df).collect()
    assert sum(r.first_row for r in rows) == 3 and len(rows) == 5
    assert [r.doc_id for r in rows if r.first_row and r.n_shingles] == [1]


def test_links_through_a_chain_and_far_leaders(spark):
    # every text shares most of its words with its neighbours only, so links run along the chain
    words = [f"v{i}" for i in range(260)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 160, 12)]
    df = neardup.near_duplicates(docs(spark, texts))
    assert got(df, "doc_id", "n_shingles", "component_id", "kept") == brute.groups(list(enumerate(texts)))


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    # copies with more and more words replaced: many share buckets, few link
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), i % 18):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    want = brute.groups(list(enumerate(texts)))
    assert len({c for _, c, _ in want.values()}) > 10
    for block in (512, 8):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert got(neardup.near_duplicates(docs(spark, texts)), "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_copies_in_buckets_led_by_longer_texts(spark):
    # a passage and its near copy come after longer texts that quote it, so every bucket they share is led by a text of another size
    words = [f"p{i}" for i in range(204)]
    quotes = [" ".join([*(f"q{i}_{j}" for j in range(30)), *words, *(f"q{i}_{j}" for j in range(30, 72))]) for i in range(400)]
    texts = [*quotes, " ".join(words), " ".join([*words[:100], "changed", *words[101:]])]
    want = brute.groups(list(enumerate(texts)))
    assert want[400][1] == want[401][1] == 400
    df = neardup.near_duplicates(docs(spark, texts).coalesce(1).orderBy("doc_id"))
    assert got(df, "doc_id", "n_shingles", "component_id", "kept") == want


def test_documents_in_another_order_at_the_second_reading(spark):
    texts = near_cases() * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    assert got(neardup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute.groups(list(enumerate(texts)))


def test_group_rows_grow_with_the_rows_of_a_bucket(spark):
    # one stray row beside a large component, and a component beside many small ones
    rows = spark.range(20_000).selectExpr("1L AS _bucket", "0 AS _band", "id AS _row", "300L AS n", "IF(id = 7, 7L, 0L) AS comp")
    groups = neardup._groups(rows)
    assert groups.count() < 20_100
    sides = {(r._group, r._side) for r in groups.select("_group", "_side").distinct().collect()}
    assert len({g for g, _ in sides}) * 2 == len(sides)
    mixed = spark.range(300).selectExpr("1L AS _bucket", "0 AS _band", "id AS _row", f"{neardup.HEAVY // 20}L AS n", "IF(id < 200, 0L, id) AS comp")
    held = {}
    for r in neardup._groups(mixed).collect():
        held.setdefault(r._group, []).append((r._row, r._side))
    met = {(min(a, b), max(a, b)) for g in held.values() for a, s in g for b, t in g if a != b and (t < 0 or s != t)}
    assert {(a, b) for a in range(300) for b in range(max(a + 1, 200), 300)} <= met
    assert max(map(len, held.values())) < 120  # heavy texts come in small groups


def test_posterior_bound():
    looks = neardup.fewest_matches(75, 1e-5, 200, 40)
    assert list(looks) == [40, 80, 120, 160, 200] and list(neardup.fewest_matches())[-1] == neardup.BANDS * neardup.ROWS
    shares = [m / n for n, m in looks.items()]
    assert shares == sorted(shares) and shares[-1] < 0.75


def test_components_of_a_long_path(spark):
    links = spark.range(64).selectExpr("id a", "id + 1 b")
    assert {r.comp for r in neardup.components(links).collect()} == {0}
    assert neardup.components(links.limit(0)).count() == 0


# quality

def test_quality_edges(spark):
    texts = [*ODD, "same line\n" * 4, "a b c a b c", "aa bb cc dd"]
    df = docs(spark, texts, "null lang,'s' source,1 n_words,'k' kept,2 m_0,3 scale,4 _words")
    rows = quality.judge(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == {i: brute.base(t) for i, t in enumerate(texts)}
    assert all(r.kept == (not r.base_failed) and r.distance is None for r in rows)  # one row past the base rules is its own centre
    assert quality.judge(df.limit(0)).count() == 0


def test_outliers_go_and_clean_documents_stay(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 400))), None if i % 2 else "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "$#%" for _ in range(100)), None if i % 2 else "en", "s") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = got(quality.judge(df), "doc_id", "kept")
    assert all(kept[i] == (i < 1000,) for i in kept)


def judged_groups(spark, sizes):
    """Rejected ids of groups of (clean, junk) rows, junk ids from 1000 on in each group."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    rows = []
    for g, (clean, junk) in enumerate(sizes):
        rows += [(i, " ".join(word() for _ in range(rng.randint(60, 400))), "en", f"s{g}") for i in range(clean)]
        rows += [(1000 + i, " ".join(word() + "$#%" for _ in range(100)), "en", f"s{g}") for i in range(junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {(r.source, r.doc_id) for r in quality.judge(df).where("not kept").collect()}
    return gone, {(source, i) for i, _, _, source in rows if i >= 1000}


def test_junk_of_up_to_two_fifths_goes(spark):
    gone, junk = judged_groups(spark, [(74, 26), (60, 40)])
    assert gone == junk


def test_junk_in_small_groups_goes(spark):
    gone, junk = judged_groups(spark, [(8, 2), (9, 1), (3, 1), (10, 0)])
    assert gone == junk


# chat

def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read(df):
    back = df.select("conv_id", "start", chat.read_back(F.col("text"), F.col("n_repeated")).alias("t"), chat.under_loss(F.col("text"), F.col("loss")).alias("l"))
    out = {}
    for r in sorted(back.collect(), key=lambda r: r.start):
        said, loss = out.setdefault(r.conv_id, ([], []))
        said += [tuple(t) for t in r.t]
        loss.append(r.l)
    return {k: (said, "".join(loss)) for k, (said, loss) in out.items()}


def test_chat_round_trip_of_control_strings(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\|turn|>x<|end|>", "<|turn|>", "[\\\\INST]", "<s><s>", "a < b [c] <| |>", "", "\\", "<<SYS>>\n<</SYS>>", "x" * 9000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(1, None, "tool\n<|end|>\\n", None), (None, 0, None, "free"), (None, 0, None, "free")]
    got = read(chat.windows(turns(spark, rows)))
    assert got[1] == ([*[(r, t) for _, _, r, t in rows[:10]], ("tool\n<|end|>\\n", "")], "".join(nasty[1::2]))
    assert got[None] == ([("", "free"), ("", "free")], "")
    text = chat.windows(turns(spark, rows)).agg(F.concat_ws("", F.collect_list("text"))).collect()[0][0]
    assert "[INST]" not in text and "</s>" not in text
    assert chat.windows(turns(spark, rows).limit(0)).count() == 0


def test_windows_keep_budget_system_and_limited_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"t{i} " * (5 + i % 40)) for i in range(1, 120)]
    got = sorted(chat.windows(turns(spark, rows), budget=300, history_tokens=60).collect(), key=lambda r: r.start)
    assert len(got) > 5 and all(r.tokens <= 300 for r in got)
    assert all("<|turn|>system\nbe brief" in r.text for r in got)
    assert all(1 <= r.n_repeated <= 3 for r in got[1:]) and got[0].n_repeated == 0
    assert any(r.n_repeated > 1 for r in got)
    assert read(chat.windows(turns(spark, rows), budget=300, history_tokens=60))[1][1] == "".join(t for _, _, r, t in rows if r == "assistant")


# urls

def test_url_edges(spark):
    made = [None, "", "no scheme", "://", "http://NET/", "http://x.net", "http://x.net/", "http://a.example.net/en/?q#f", "https://example.net/ende", "http://notexample.com/de/",
            "http://example.com:80/de/", "http://www.Example.COM/de/x", "http://a.org/fr/b?c", "x://y://org/fr/", "http://" + "a." * 300 + "net/" + "b/" * 300, "http://net/\nx"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*made, made[4]])], "page_id long, url string, host string")
    rules = spark.createDataFrame([("net", "/", "block"), ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr", None)], "host string, path string, verdict string")
    want = {0: None, 1: None, 2: None, 3: None, 4: "net/", 5: None, 6: "net/", 7: "example.net/en/", 8: "net/", 9: None, 10: None, 11: "example.com/de/", 12: "org/fr", 13: None, 14: "net/", 15: "net/", 16: "net/"}
    rows = urls.match(pages, rules).collect()
    assert {r.page_id: r.rule for r in rows} == want
    assert all(r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow") for r in rows)
    assert {r.verdict for r in urls.match(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert urls.match(pages.limit(0), rules).count() == 0


# top-k

def top_of(rows, asked, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in asked:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i is None, i or 0, i) for i, v in whole.items() if i != q)[:k]
        want += [(q, n + 1, i, -s) for n, (s, *_, i) in enumerate(scored)]
    return sorted(want, key=str)


def top_rows(df, asked, k, **more):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id").isin(*asked), k=k, **more).collect()), key=str)


def test_top_k_ties_and_unfit_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [200000.0, 0.0]),
            (8, [0.25]), (9, []), (10, [-1.0, -1.0]), (11, [1.0, 0.5]), (12, [2.0, 0.0]), (None, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert top_rows(df, [0, 3, 9], 4, row_block=3) == top_of(rows, [0, 9], 4)
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_top_k_of_large_components(spark):
    three = [(0, [0.5, 1.0]), (2, [1.0, 2.0]), (50, [200000.0, 1.0])]
    df = spark.createDataFrame(three, "vec_id long, embedding array<double>")
    assert top_rows(df, [0, 50], 5) == top_of(three, [0, 50], 5)
    # products beyond 2**53 and near 2**63, exact to the last unit
    rows = [(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6 + 1 / 256, 1.0]), (3, [-1e6, 0.0]), (4, [5e7, -1.0]), (5, [5e7, -1.0]), (6, [1e8, 7.0]), (7, [0.0, 1e9]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert top_rows(df, [0, 3, 8], 4, row_block=2) == top_of(rows, [0, 3, 8], 4)


@pytest.mark.parametrize("large", [1e30, 1e307])
def test_top_k_raises_where_a_score_does_not_fit(spark, large):
    df = spark.createDataFrame([(0, [1.0]), (1, [large])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit|too large"):
        topk.top_k(df, F.col("vec_id") == 0).collect()


# personal data

def test_personal_data_patterns(spark):
    texts = [None, "", "a@b.co c@d", "x.y+z@mail.example.com.", "a@b.com_x@y.zz", "a@b@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
             "4111  1111 1111 1111", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+49 (030) 123-4567. +1 +12345678", "+++1 (487) 555-7209", "é 4929348385146306 ü a@é.de b@c.de", "9" * 5000, "1 " * 20000,
             "a" * 60000 + "@b.cd", "my iban DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    found = {r.doc_id: r for r in pii.find(docs(spark, texts, "'x' spans,1 _words")).collect()}
    for i, t in enumerate(texts):
        spans = [(s.kind, s.start, s.end) for s in found[i].spans]
        assert [s for s in spans if s[0] in pii.BASE] == brute.base_spans(t or ""), t
    assert [s.kind for s in found[16].spans] == ["iban"] and [s.kind for s in found[17].spans] == []
    assert [s.kind for s in found[18].spans] == ["secret"] and not found[19].spans
    clean = pii.find(docs(spark, texts)).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    clean = {r.doc_id: r.text for r in clean.collect()}
    assert clean[0] is None and clean[3] == "<EMAIL>." and clean[12] == "é <CARD> ü a@é.de <EMAIL>"
    assert pii.find(empty(spark)).count() == 0


def test_account_numbers_before_capitals_and_numbers(spark):
    want = {
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": [(5, 32)], "DE89370400440532013000 2024": [(0, 22)], "GB82WEST12345698765432 OK": [(0, 22)],
        "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 FR14 2004 1010 0505 0001 3M02 606 X": [(0, 27), (28, 55), (56, 89)],
        "REF AB12 KONTO NR DE89370400440532013000": [(18, 40)], "DE88370400440532013000 2024": [], "DE89370400440532013000X": [],
        "XX57 1234 5678 9012 345 THEN": [(0, 23)], "NO93 8601 1117 947 A": [(0, 18)],
    }
    rows = pii.find(docs(spark, list(want))).collect()
    assert {list(want)[r.doc_id]: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in rows} == want


# token counts

def test_documents_across_blocks(spark):
    df = docs(spark)
    folder = scratch_path(spark, "flat-test")
    tokencount.write_flat(df, folder, BYTE_BPE)
    tok = brute.tokenizer("byte_bpe_50k.json")
    tok.encode_special_tokens = True
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    for block in (2, 16, 1 << 20):
        counted = tokencount.count_tokens(spark, folder, block=block).withColumn("part", tokencount.part_of(F.col("file")))
        assert {k: v for k, (v,) in got(tokencount.manifest(df).join(counted, ["part", "doc"]), "doc_id", "n_tokens").items()} == want


def test_open_end_and_no_separator(spark, tmp_path):
    sep = (50256).to_bytes(2, "big")
    for name, data in (("a", b"\0\1\0\2" + sep + b"\0\3"), ("b", b"\0\1" * 5), ("c", b""), ("d", sep + sep)):
        (tmp_path / name).write_bytes(data)
    rows = tokencount.count_tokens(spark, str(tmp_path), block=4).collect()
    assert sorted((r.file[-1], r.doc, r.start, r.n_tokens, r.closed) for r in rows) == [
        ("a", 0, 0, 2, True), ("a", 1, 3, 1, False), ("b", 0, 0, 5, False), ("d", 0, 0, 0, True), ("d", 1, 1, 0, True)]


# byte pairs

def test_encode_decode_of_odd_texts(spark):
    rows = bpe.decode(bpe.encode(docs(spark, ODD, "1 ids,'x' decoded"), BYTE_BPE), BYTE_BPE).collect()
    tok = brute.tokenizer("byte_bpe_50k.json")
    assert {r.doc_id: r.ids for r in rows} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD)}
    assert all(r.decoded == (ODD[r.doc_id] or "") for r in rows)
    assert bpe.encode(empty(spark), BYTE_BPE).count() == 0


def test_chunks_are_shared_and_joins_repaired():
    coder = bpe.ChunkCoder(BYTE_BPE)
    passage = " ".join(f"word{i % 97}x{i}" for i in range(600))
    texts = [f"{head} {passage} {tail}" for head, tail in (("a", "b"), ("longer head", "tail"), ("", ""))]
    first = set(coder._chunks(texts[0]))
    assert len(first & set(coder._chunks(texts[1]))) >= len(first) - 3
    assert coder.encode_all(texts) == [coder.ids.library(t) for t in texts]
    assert any(c[0] != " " for c in coder._chunks(texts[0])[1:])  # cuts fall inside words, too


def test_an_id_beyond_16_bits_is_an_error():
    assert tokencount.narrowed(np.array([1, 65535], np.uint32)) == b"\x00\x01\xff\xff" and tokencount.narrowed(np.array([], np.uint32)) == b""
    with pytest.raises(OverflowError):
        tokencount.narrowed(np.array([65536], np.uint32))
