"""Operator 7 against brute force."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import common, jaccard, queries  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def sets(text, width):
    w = lower((text or "").encode()).split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1))))


def brute(docs, width, num, den):
    """docs: (id, text); returns (id, size, smallest id of the component, number of links) of each row."""
    s = [sets(t, width) for _, t in docs]
    up, links = list(range(len(docs))), [0] * len(docs)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and den * both >= num * (len(s[i]) + len(s[j]) - both):
                up[top(i)] = top(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s[i]), least.get(top(i)), links[i]) for i, (d, _) in enumerate(docs)]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = sorted(map(tuple, queries.op7_ngram_jaccard(spark, SF).collect()))
    assert got == sorted(brute(docs, 3, 9, 10))
    assert any(a != c for a, _, c, _ in got) and max(r[3] for r in got) > 1


def test_random_near_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 2000)
    rng = random.Random(3)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(400)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(None, docs[0][1]), (900, None), (901, ""), (902, " "), (903, "one"), (904, "One"), (905, "one two"), (5, docs[5][1]), (5, docs[5][1])]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_n", F.lit("x")).repartition(3)
    for width, num, den, long_list, block in ((3, 9, 10, 64, 512), (5, 4, 5, 3, 4), (2, 1, 2, 1, 512)):
        monkeypatch.setattr(jaccard, "LINK_BLOCK", block)
        monkeypatch.setattr(jaccard, "SHARE", 2)
        monkeypatch.setattr(jaccard, "BLOCK_BYTES", 400 * block)
        want = brute(docs, width, num, den)
        got = jaccard.labelled(df, width, num, den, long_list=long_list, block=block, links=True).collect()
        assert sorted((r._id is None, r._id or 0, r._n, r._component_id, r._n_links) for r in got) == sorted((d is None, d or 0, n, c, k) for d, n, c, k in want)
    clash = ("_doc", "_row_id", "_row_hash", "_copy", "_stays", "_mark_id", "_component", "_id", "_hash")
    kept = jaccard.drop_near_duplicates(df.withColumns({c: F.lit("x") for c in clash})).collect()
    assert all(r[c] == "x" for r in kept for c in clash)
    comps = {(d, c) for d, _, c, _ in brute(docs, 5, 4, 5)}
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in comps})
    assert jaccard.drop_near_duplicates(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    """All rows of sf0.01: sets, components and links."""
    duckdb = pytest.importorskip("duckdb")
    names = ("doc_id", "n_shingles", "component_id", "n_links")
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = c.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op7_ngram_jaccard']})").fetchall()
    got = [tuple(r[x] for x in names) for r in queries.op7_ngram_jaccard(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(want) and sum(r[3] for r in want) > 100
