"""Operator 7's order of tokens: what many sets share stands last, so that lists stay short; results as by brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("strandlake.llm")
from strandlake.llm import jaccard  # noqa: E402

sys.path.insert(0, str(Path(__file__).parent))
from test_jaccard import brute  # noqa: E402


def test_frequent_tokens_stand_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", 2)
    sets = {k: sorted({16, 160 + 16 * (k // 2), 3200 + 16 * k} | ({48} if k < 3 else set()) | ({2**64 - 16} if k % 2 else set())) for k in range(8)}
    reps = spark.createDataFrame([(k, bytearray(np.array(v, np.uint64).tobytes())) for k, v in sets.items()], "_k long, _shared binary")
    for r in jaccard.by_frequency(reps).collect():
        own = np.frombuffer(r._shared, np.uint64)
        assert (own[1:] > own[:-1]).all()
        held = lambda t: sum(t in v for v in sets.values())
        assert sorted((int(x) >> 60, (int(x) & (2**60 - 1)) << 4) for x in own) == sorted((int(np.ceil(np.log2(max(held(t) / 2, 1)))), t) for t in sets[r._k])
        assert int(own[-1]) >> 60 == 2 and int(own[-1]) & (2**60 - 1) == 1


def test_passage_in_all_documents(spark, monkeypatch):
    """A passage that every document has: its shingles are in no prefix of a document that has enough of its own."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(20))
    docs = []
    for g in range(60):
        own = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(2):
            w = list(own)
            w[rng.randrange(60)] = f"v{len(docs)}"
            docs.append((len(docs), " ".join(w) + " " + passage))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    longest = []
    of = jaccard.postings

    def seen(*a):
        lists = of(*a)
        longest.append(max(r["count"] for r in lists.groupBy("_token").count().collect()))
        return lists

    monkeypatch.setattr(jaccard, "postings", seen)
    got = jaccard.labelled(df, 3, 9, 10, links=True).collect()
    assert sorted((r._id, r._n, r._component_id, r._n_links) for r in got) == sorted(brute(docs, 3, 9, 10))
    assert longest == [2]
