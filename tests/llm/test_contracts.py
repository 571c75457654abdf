"""Every numbered query against brute force, over the whole of the smallest tables."""

import math
from collections import defaultdict

import brute
import harness
import pyarrow.parquet as pq
import pytest

from finframe.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"


def rows(name, *columns):
    return list(zip(*(c.to_pylist() for c in pq.read_table(f"{SF_DIR}/{name}.parquet", columns=list(columns)).columns), strict=True))


@pytest.fixture(scope="module")
def docs():
    return rows("documents", "doc_id", "text")


def by_id(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    con = harness.oracle_connection(SF_DIR)
    assert harness.difference(harness.spark_rows(Q.QUERIES[name](spark, SF_DIR)), harness.oracle_rows(con, Q.ORACLES[name])) is None


def test_shards_hold_the_law_of_rows(spark, docs):
    got = Q.op1_ring_shards(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    texts = dict(docs)
    import zlib

    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_packing_covers_every_piece_with_few_sequences(spark, docs):
    got = Q.op2_pack_sequences(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == brute.pieces(docs)
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(full) <= math.ceil(sum(r.length for r in got) / 4096 * 1.05) + 1


def test_near_duplicates_equal_exact_groups(spark, docs):
    got = by_id(Q.op3_near_duplicates(spark, SF_DIR), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.groups(docs)


def test_quality_base(spark, docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = Q.op4_quality_rules(spark, SF_DIR).collect()
    assert {r.doc_id: tuple(r[n] for n in names) for r in got} == {i: brute.base(t) for i, t in docs}
    assert not any(r.kept and r.base_failed for r in got)


def test_chat_reads_back(spark):
    turns = rows("conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = by_id(Q.op5_chat_windows(spark, SF_DIR), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.conversations(turns)


def test_personal_data_base(spark, docs):
    got = {r.doc_id: r for r in Q.op8_personal_data(spark, SF_DIR).collect()}
    for i, text in docs:
        want = brute.base_spans(text or "")
        r = got[i]
        assert r.base_sha256 == brute.sha(brute.listed(want))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in want) for kind in ("email", "ip", "card", "phone"))
        assert set(brute.listed(want).split(",")) - {""} <= set(r.spans.split(","))


def test_token_counts(spark, docs):
    tok = brute.tokenizer("byte_bpe_50k.json")
    tok.encode_special_tokens = True
    got = by_id(Q.op9_token_counts(spark, SF_DIR), "doc_id", "n_tokens", "closed")
    assert got == {i: (len(tok.encode(t or "", add_special_tokens=False).ids), True) for i, t in docs}


def test_encode_decode(spark, docs):
    got = by_id(Q.op10_encode_decode(spark, SF_DIR), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == brute.encoded(docs)


def test_token_links(spark, docs):
    got = by_id(Q.op11_token_links(spark, SF_DIR), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
    assert got == brute.token_links(docs)


def test_collocations(spark):
    got = defaultdict(list)
    for r in sorted(Q.op12_collocations(spark, SF_DIR).collect(), key=lambda r: (r.lang, r["rank"])):
        got[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == brute.collocations(rows("documents", "lang", "text"))


def test_nearest(spark):
    got = {(r.query_id, r["rank"]): [(r.vec_id, r.score)] for r in Q.op13_nearest(spark, SF_DIR).collect()}
    assert got == brute.nearest(rows("embeddings", "vec_id", "embedding"), lambda i: i % 20 == 0)
