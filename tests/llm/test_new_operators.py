"""Token links, collocations and nearest neighbours: odd rows, ties, hot values, their inner steps."""

import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_edges import ODD

from finframe.llm import collocations, crosstok, nearest

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
MORE = [*ODD, "▁x", "a ▁ b", " ", "   ", " x ", "tail ", "a  b   c", "<s>a</s><unk> <0x41>", "﻿a​b c　d", "é é", "naïve café 😀" * 30, "x " * 70_000, "y" * 5000 + " " * 5000]


def documents(spark, texts, n=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(n, "doc_id")


# token links

def figures(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 3000, crosstok.BLOCK])
def test_links_of_odd_texts(spark, block):
    df = documents(spark, MORE).selectExpr("*", "1 n_a", "'x' groups", "2 `_block`", "3 `_id`")
    out = crosstok.link_figures(df, BYTE_BPE, PIECE_BPE, block=block)
    assert figures(out) == brute.token_links(list(enumerate(MORE)))


def test_links_of_no_rows_and_of_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.link_figures(none, BYTE_BPE, PIECE_BPE).collect() == []
    same = spark.createDataFrame([(1, "over the top"), (1, "over the top"), (None, "over"), (None, None)], "doc_id long, text string")
    out = sorted((r.doc_id is None, r.n_a, r.n_links) for r in crosstok.link_figures(same, BYTE_BPE, PIECE_BPE).collect())
    want = brute.token_links([(1, "over the top"), (2, "over")])
    assert out == sorted([(False, want[1][0], want[1][3])] * 2 + [(True, want[2][0], want[2][3]), (True, 0, 0)])


def test_aligned_rows_hold_links_groups_and_other_columns(spark):
    texts = ["The quick brown fox, unbelievably.", "", None, "naïve 😀"]
    df = documents(spark, texts).selectExpr("*", "doc_id + 1 AS extra", "'x' AS a_ids")
    byte, piece = crosstok.byte_ids(BYTE_BPE, False), crosstok.pieces(PIECE_BPE)
    for r in crosstok.align(df, BYTE_BPE, PIECE_BPE).collect():
        assert r.extra == r.doc_id + 1
        a = np.r_[0, np.cumsum([byte.width[i] for i in r.a_ids])].astype(int)
        b = np.r_[0, np.cumsum([piece.width[i] for i in r.b_ids])].astype(int)
        links = {(i, r.link_indices[k]): r.link_bytes[k] for i in range(len(r.a_ids)) for k in range(r.link_indptr[i], r.link_indptr[i + 1])}
        want = {(i, j): min(a[i + 1], b[j + 1]) - max(a[i], b[j]) for i in range(len(r.a_ids)) for j in range(len(r.b_ids)) if a[i] < b[j + 1] and b[j] < a[i + 1]}
        assert links == want
        ends = sorted(set(a[1:]) & set(b[1:]))
        assert list(r.a_group) == [sum(c < e for c in ends) for e in a[1:]] and list(r.b_group) == [sum(c < e for c in ends) for e in b[1:]]


def test_row_products_equal_dense_products():
    draw = np.random.default_rng(3)
    for rows, mid, columns in ((0, 3, 4), (7, 5, 9), (40, 30, 20), (5, 0, 3)):
        x, y = draw.random((rows, mid)) < 0.3, draw.random((mid, columns)) < 0.3
        sparse = [crosstok.Incidence(np.r_[0, np.cumsum(m.sum(1))], np.nonzero(m)[1], m.shape[1]) for m in (x, y)]
        got = np.zeros((rows, columns), int)
        for i, j, v in crosstok.row_products(*sparse, rows=3):
            got[i, j] += v
        assert (got == x.astype(int) @ y.astype(int)).all()
        back = sparse[1].transposed()
        assert (np.diff(back.indptr) == y.sum(0)).all() and back.columns == mid


def test_group_links_equal_pairs_in_groups():
    block = crosstok.aligner(BYTE_BPE, PIECE_BPE).block(["unbelievable antidisestablishmentarianism 😀😀", "", "x"])
    pairs = [(i, j) for part in block.group_links(2) for i, j in zip(part[0].tolist(), part[1].tolist(), strict=True)]
    assert sorted(pairs) == [(i, j) for i, g in enumerate(block.a_group) for j, h in enumerate(block.b_group) if g == h]
    assert block.group_link_counts().sum() == len(pairs)


def test_texts_are_cut_only_where_no_piece_reaches_across():
    piece = crosstok.pieces(PIECE_BPE)
    assert piece.cuttable
    draw = random.Random(5)
    for _ in range(60):
        text = "".join(draw.choice(["a", "the", " ", "  ", "\n", "é", "▁", ".", "tion", " in"]) for _ in range(draw.randrange(1, 80)))
        for most in (1, 3, 10):
            assert piece.encode_all([text], most)[0].tolist() == piece.model.encode(text)


# collocations

def ranked(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.lang, r["rank"])):
        out[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    return dict(out)


def corpus(seed, rows):
    draw = random.Random(seed)
    made = []
    for _ in range(rows):
        words = draw.choices(["a", "B", "c", "Dd", "é", "É", "x y", "Z"], [5, 4, 3, 2, 2, 1, 1, 1], k=draw.randrange(0, 40))
        made.append((draw.choice(["en", "fr", None, "und"]), "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " -"]) for w in words)))
    return made


@pytest.mark.parametrize(("seed", "least", "absorb"), [(1, 3, 100), (2, 2, 80), (3, 5, 60)])
def test_collocations_of_random_texts(spark, seed, least, absorb):
    made = [*corpus(seed, 120), ("en", None), ("en", ""), ("de", " \t\n"), ("en", "q " * 500), ("en", "one two three four five six. " * 6)]
    df = spark.createDataFrame(made, "lang string, text string").repartition(4).selectExpr("*", "1 `_lang`", "2 n", "'x' phrase")
    got = ranked(collocations.collocations(df, least=least, top=50, absorb=absorb))
    assert got == brute.collocations(made, least=least, top=50, absorb=absorb)


def test_small_portions_and_a_full_bitmap_change_nothing(spark):
    made = corpus(9, 80)
    df = spark.createDataFrame(made, "lang string, text string").repartition(3)
    want = {(lang, w): n for lang, w, n in _phrases(made, 3)}
    for portion, bits in ((40, 26), (1 << 20, 15)):
        got = {(r.lang, tuple(r.words)): r.f for r in collocations.phrase_counts(df, least=3, portion=portion, bits=bits).collect()}
        assert got == want


def _phrases(made, least):
    f, n = Counter(), Counter()
    for lang, text in made:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    return [(lang, w, c) for (lang, w), c in f.items() if c >= least] + [(lang, (), c) for lang, c in n.items() if c]


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", [], 9 * big), ("en", ["a"], big), ("en", ["b"], 2 * big), ("en", ["a", "b"], big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words array<string>, f long")).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 1000 * (big - 1) * 9 * big // (big * 2 * big))]


# nearest neighbours

def neighbours(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id, r["rank"]].append((r.vec_id, r.score))
    return {key: sorted(v, key=str) for key, v in out.items()}


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def test_odd_vectors_and_ties(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]),
        (None, [1.0, 0.0]), (None, [2.0]), (-20, [-3.0, 1e-300]), (40, [2.0, -0.0, 4.0]), (41, [1e150, -1e150]), (42, [1.0] * 1500),
    ]
    df = vectors(spark, rows).selectExpr("*", "1 AS score", "2 AS `_row`", "'x' AS query_id")
    for k in (1, 3, 20):
        assert neighbours(nearest.nearest(df, F.col("vec_id") % 20 == 0, k=k)) == brute.nearest(rows, lambda i: i % 20 == 0, k)


def test_few_candidates_and_none(spark):
    assert nearest.nearest(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest.nearest(vectors(spark, [(1, [1.0]), (2, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("kind", ["float", "double"])
def test_hot_and_near_vectors_in_several_blocks(spark, kind):
    draw = np.random.default_rng(1)
    hot = draw.standard_normal(16)
    rows = []
    for i in range(900):
        v = hot if i % 3 == 0 else hot + draw.standard_normal(16) * 1e-4 if i % 3 == 1 else draw.standard_normal(16) * draw.choice([1e-3, 1, 50])
        rows.append((i, [float(np.float32(x)) for x in v]))
    df = vectors(spark, rows, kind)
    want = brute.nearest(rows, lambda i: i % 20 == 0)
    assert neighbours(nearest.nearest(df, F.col("vec_id") % 20 == 0, query_block=10)) == want
    assert neighbours(nearest.nearest(df, F.col("vec_id") % 20 == 0)) == want


def test_bounds_hold_for_every_pair():
    draw = np.random.default_rng(2)
    for dims in (1, 7, 64, 1500):
        q, c = draw.standard_normal((30, dims)) * draw.choice([1e-9, 1, 1e6], (30, 1)), draw.standard_normal((40, dims)) * draw.choice([1e-9, 1, 1e6], (40, 1))
        low, high = nearest.tile_bounds(nearest.Coded(q), nearest.Coded(c))
        true = [[math.fsum(x * y) for y in c] for x in q]
        assert (low <= true).all() and (true <= high).all()
        if dims == 64:
            assert ((high - low) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])).max() < 0.05
