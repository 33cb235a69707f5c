"""Operator 8 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import common, queries, suffix  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(docs, texts):
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for i, h in enumerate(hit) if h and (not i or not hit[i - 1]))
        out.append((d, len(t), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(t, hit) if not h)).hexdigest()))
    return sorted(out, key=str)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = sorted(map(tuple, queries.op8_suffix_dedup(spark, SF).collect()), key=str)
    assert got == brute(docs, 200) and sum(x[2] for x in got) > 0


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 300)
    monkeypatch.setattr(suffix, "COLLECTION", 7)
    rng = random.Random(5)
    base = "".join(rng.choice("abcé") for _ in range(400))
    docs = [(1, None), (2, ""), (3, "short"), (4, base), (5, "x" + base[50:180] + "y" + base[170:300]), (6, "z" * 90), (6, "z" * 90), (None, base[:70] + "é" + base[100:160]), (8, "abab" * 40), (9, base[200:229]), (9, base[200:230])]
    docs += [(10 + i, "".join(rng.choice("ab") for _ in range(rng.randrange(20, 200)))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_hash", F.lit("x")).repartition(3)
    for length, anchor in ((30, 20), (12, 12), (12, 7)):
        got = suffix.remove_repeats(df, length, anchor).collect()
        assert sorted([(r.doc_id, r._n_bytes, r._n_removed, len(r._spans), r._kept_sha256) for r in got], key=str) == brute(docs, length)
        assert all(hashlib.sha256(bytes(r._kept)).hexdigest() == r._kept_sha256 for r in got)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_common_prefixes():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 3, (50, 12)).astype(np.uint16)
    for column, found in suffix.columns_sorted(symbols, 6, 7):
        strings = [tuple(s[column : column + 6]) for s in symbols]
        n = Counter(strings)
        assert sorted(found) == [i for i, s in enumerate(strings) if n[s] > 1 and len(s) == 6]


@pytest.fixture
def small_batches(spark):
    """Groups are held against HOT when they go over the end of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_anchors_and_long_texts(spark, small_batches, monkeypatch):
    monkeypatch.setattr(suffix, "COLLECTION", 50)
    monkeypatch.setattr(suffix, "HOT", 20)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    rng = random.Random(6)
    some = lambda n, of="abcdefgh": "".join(rng.choice(of) for _ in range(n))
    passage = some(90)
    # a passage of very many documents, within differing neighbours, and texts of many segments that repeat in and over them
    docs = [(i, some(30 + i % 7) + passage + some(30)) for i in range(120)] + [(i, passage[:60]) for i in range(120, 150)]
    long = some(3000)
    docs += [(200, long), (201, some(11) + long[650:1500] + long[650:760]), (202, some(2000, "ab")), (203, some(2500) + "é" * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for length, anchor in ((30, 20), (40, 13)):
        got = suffix.remove_repeats(df, length, anchor).collect()
        assert sorted([(r.doc_id, r._n_bytes, r._n_removed, len(r._spans), r._kept_sha256) for r in got], key=str) == brute(docs, length)


def test_hot_windows_are_reached(spark, small_batches, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 20)
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh") for _ in range(90))
    docs = [(i, f"{i:040d}" + passage + f"{i:040d}") for i in range(200)]
    seen = []
    monkeypatch.setattr(suffix, "repeated", lambda rows, keyer, later, i, t, *a: (seen.append(rows.count()) if t == "_windows" else None) or common.repeated(rows, keyer, later, i, t, *a))
    got = suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 30, 20).collect()
    assert seen[0] > 0 and sorted([(r.doc_id, r._n_bytes, r._n_removed, len(r._spans), r._kept_sha256) for r in got], key=str) == brute(docs, 30)
