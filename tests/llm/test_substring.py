"""Operator 10 against brute force."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import common, queries, substring  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(docs, width):
    """docs: distinct (doc_id, text); rows of equal id are told apart by `order`."""
    seen, words = defaultdict(list), {}
    for key, text in docs:
        words[key] = w = (text or "").encode().split()
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])].append((key, i))
    hit = {k: [False] * len(w) for k, w in words.items()}
    for places in seen.values():
        for key, i in sorted(places)[1:]:
            hit[key][i : i + width] = [True] * width
    out = {}
    for k, w in words.items():
        kept = [x for x, h in zip(w, hit[k]) if not h]
        out[k] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = brute(docs, 20)
    rows = queries.op10_substring_dedup(spark, SF).collect()
    assert {r.doc_id: tuple(r[1:]) for r in rows} == want and len(rows) == len(docs)
    assert sum(r.n_removed for r in rows) > 0


def test_small_chunks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 40)
    long = "p q r s t " * 300
    docs = [(1, "a b c d"), (2, "x a b c d y"), (3, None), (4, ""), (5, "a b"), (6, "z z z z z z"), (7, long), (8, long), (9, "É é b c d")]
    df = spark.createDataFrame([*docs, (2, "x a b c d y")], "doc_id long, text string").withColumn("_at", F.lit(1)).withColumn("_id", F.lit("k")).repartition(3)
    want = brute(docs, 3)
    out = substring.remove_repeats(df, width=3)
    rows = out.collect()
    assert len(rows) == 10 and "_id" in out.columns
    for r in rows:
        assert (r._n_words, r._n_removed, r._kept_sha256) == want[r.doc_id], r.doc_id
        if not r._n_removed:
            assert r.text == dict(docs)[r.doc_id]
        assert sum(s["end"] - s["start"] for s in r._spans) == r._n_removed
    assert substring.remove_repeats(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert {r.doc_id: r._n_removed for r in substring.remove_repeats(nulls, width=3).collect()} == {None: 3, 1: 0}


def test_answers_of_copies_part(spark, monkeypatch):
    """Chunks that begin with one text, and hold nothing else, do not send all their answers to one task."""
    caught = []
    monkeypatch.setattr(common, "stored", lambda df, *_, **__: caught.append(df) or df)
    monkeypatch.setattr(common, "MEET_ENTRIES", 50, raising=False)
    copy = "one text that a third of all rows hold"
    for ids in (range(200), [None] * 200):
        df = spark.createDataFrame([(i, copy) for i in ids], "doc_id long, text string").repartition(5)
        found = common.repeated(df, lambda data, off: substring.window_keys(data, off, 3), False, chunk=2 * len(copy))
        sizes = [r["count"] for r in caught.pop().groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes), sizes
        for r in found.collect():
            assert {int(x) for x in common.np.concatenate([common.np.frombuffer(b, "<i4") for b in r._at])} == set(range(len(copy.split()) - 2))


def test_many_buckets_in_few_tasks(spark, monkeypatch):
    """Chunks meet in many buckets, of which a task takes several one after the other."""
    monkeypatch.setattr(common, "MOST_TASKS", 3)
    monkeypatch.setattr(common, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(common, "CHUNK_BYTES", 20000)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    assert common.n_buckets(docs, "text") > 50
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    rows = substring.remove_repeats(docs.repartition(3)).collect()
    assert {r.doc_id: (r._n_words, r._n_removed, r._kept_sha256) for r in rows} == want


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://driver:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
