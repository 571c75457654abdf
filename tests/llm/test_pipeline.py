"""The pipeline against its stages done one by one outside Spark."""

import math
import re
from collections import defaultdict

import brute
import harness
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from finframe.llm import pii
from finframe.llm.oracles import ORACLES
from finframe.session import checkpointed

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def want():
    """The documents after each of the first three stages, as {doc_id: text}."""
    docs = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).columns), strict=True))
    verdicts = harness.oracle_connection(SF_DIR).execute(f"SELECT doc_id, kept FROM ({ORACLES['op4_quality_rules']})").fetchall()
    good = {i: docs[i] for i, kept in verdicts if kept}
    first = {i: good[i] for i, (_, _, kept) in brute.groups(list(good.items())).items() if kept}
    clean = {}
    for i, text in first.items():
        spans = brute.base_spans(text)
        spans += [("secret", *m.span()) for m in re.finditer(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", text)
                  if re.search(rf"(?:^|[^a-z0-9])(?:{pii.WORDS['secret']})", text[max(0, m.start() - pii.NEAR) : m.start()].lower())]
        out, at = "", 0
        for kind, start, end in sorted(spans, key=lambda s: s[1]):
            out += text[at:start] + f"<{kind.upper()}>"
            at = end
        clean[i] = out + text[at:]
    return good, first, clean


def test_stages_one_by_one(spark, want):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        found = stage(spark, docs, SF_DIR)
        assert found.columns == COLUMNS, name
        rows = {r.doc_id: r for r in found.collect()}
        assert {i: r.text for i, r in rows.items()} == expected, name
        assert all(r.n_chars == len(r.text) for r in rows.values()) or name != "personal_data"
        docs = checkpointed(found)  # each stage works on what its predecessor kept


def test_run(spark, want):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.pieces(list(want[2].items()))
    packed = defaultdict(list)
    for r in rows:
        packed[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 4096 for p in packed.values())
    assert len(packed) <= math.ceil(sum(r.length for r in rows) / 4096 * 1.05) + 1


def test_stages_take_odd_documents(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "a b " * 60, "en", "s", 240), (4, "mail me a@b.co " + "x" * 5000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        kept = start
        for _, stage in corpus_pipeline.STAGES[1:3]:
            kept = checkpointed(stage(spark, kept, SF_DIR))
        out = corpus_pipeline.STAGES[3][1](spark, kept, SF_DIR)
        assert out.count() >= kept.count() == (0 if start is not docs else kept.count())
        assert corpus_pipeline.STAGES[0][1](spark, start, SF_DIR).count() == 0
    assert kept.where(F.col("text").contains("a@b.co")).count() == 0


def test_shuffled_copies_lose_no_text(spark):
    rows = [(i, f"text {i % 200} " + " ".join(f"w{i % 200}_{k}" for k in range(30)), "en", "s", 5) for i in range(400)]
    rows += [(900, rows[3][1], "en", "s", 5)] * 3 + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    texts = [r.text for r in kept if r.text]
    assert len(texts) == len(set(texts)) == 200 and sum(r.text is None for r in kept) == 2
    assert {r.doc_id for r in kept if r.text} == set(range(200))
