"""The pipeline stage by stage against brute force, and the operators' SQL."""

import re
from collections import defaultdict

import duckdb
import pytest

pytest.importorskip("strandlake.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from strandlake.llm import queries  # noqa: E402
from strandlake.llm.common import stored, table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        if name != "mixing":
            assert docs.columns == names and len(rows) == len({r.doc_id for r in rows})
            assert {r.doc_id for r in rows} <= set(before)
        kept[name] = {r.doc_id: r.text for r in rows}
        if name == "near_duplicates":
            sets = {i: shingles(t) for i, t in before.items()}
            up = {i: i for i in before}

            def top(i):
                return i if up[i] == i else top(up[i])

            for i in before:
                for j in before:
                    both = len(sets[i] & sets[j])
                    if j < i and both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((top(i), top(j)))
                        up[b] = a
            assert set(kept[name]) == {top(i) for i in before}
        if name == "passages":
            seen, hit = set(), defaultdict(set)
            for i in sorted(before):
                w = re.findall(r"[^\x20\x09-\x0D]+", before[i] or "")
                for x in range(len(w) - 19):
                    g = tuple(w[x : x + 20])
                    if g in seen:
                        hit[i] |= set(range(x, x + 20))
                    seen.add(g)
            for i, t in kept[name].items():
                w = re.findall(r"[^\x20\x09-\x0D]+", before[i] or "")
                assert t == (" ".join(x for n, x in enumerate(w) if n not in hit[i]) if hit[i] else before[i])
            assert all(r.n_chars == len(r.text) for r in rows)
    assert len(kept["benchmark"]) < len(kept["passages"]) <= len(kept["near_duplicates"]) < len(kept["toxicity"])
    assert set(kept["mixing"]) <= set(kept["benchmark"])
    at = [r.position for r in rows]
    assert at == sorted(at)
    assert sum(r.taken for r in rows) == pytest.approx(sum(len((t or "").split()) for t in kept["benchmark"].values()), rel=0.01)


def test_stages_on_edges(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, clashing columns and empty tables pass every stage."""
    from pyspark.sql import functions as F

    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "some words here", None, None), (3, "some words here", None, None), (None, "other words " * 30, "en", "a"), (4, "other words " * 30, "en", None)]
    for name, kind in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    clash = ("_id", "_doc", "_k", "_hash", "_copy", "_row_id", "_order", "_source", "_at", "_toxicity", "_spans", "_words", "n_hit")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in clash if c not in ("_at", "_toxicity", "_spans", "_words")})
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        got = docs.collect()
        ids = [r.doc_id for r in got]
        assert all(r[c] == "x" for r in got for c in docs.columns if c in clash), name
        if name == "toxicity":
            assert len(got) == len(rows)
        elif name != "mixing":
            # of the repeated rows one stays; the null id's text is that of id 4
            assert sorted(ids, key=str) == [1, 2, 3, 4], name
    assert set(ids) == {3, 4}
