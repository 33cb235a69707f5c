"""Operators 3 and 4 against brute force and an exact round trip."""

import hashlib
import math

import pytest
import zstandard
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import queries, topk, warc  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def roles(pages):
    last = {}
    for i, h in pages:
        if len((h or "").encode()) >= 1000:
            last[h] = i if last.get(h) is None else max(last[h], i if i is not None else last[h])
    out = []
    for i, h in pages:
        b = (h or "").encode()
        to = last.get(h)
        again = to is not None and i != to
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_warc_query(spark):
    pages = [(r.page_id, r.html) for r in table(spark, SF, "pages").collect()]
    assert sorted(map(tuple, queries.op3_warc(spark, SF).collect()), key=str) == roles(pages)


@pytest.mark.parametrize("tasks", [1, 16])
def test_every_archive_has_a_dictionary(spark, tmp_path, tasks):
    """Of whatever size an archive is, its first frame holds a dictionary that its records need."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").repartition(tasks)
    done = warc.write(pages.select("page_id", "url", "html"), f"file://{tmp_path}/warc").collect()
    assert sum(r._records for r in done) == pages.count() and len(done) >= tasks
    plain = zstandard.ZstdDecompressor()
    for r in done:
        raw = open(r._archive, "rb").read()
        n = int.from_bytes(raw[4:8], "little")
        assert raw[:4] == warc.DICTIONARY_FRAME and n >= 256
        first = raw[8 + n :]
        own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n])).decompressobj().decompress(first)
        assert own.startswith(b"WARC/1.1")
        with pytest.raises(zstandard.ZstdError):
            plain.decompressobj().decompress(first)


def test_dictionary_of_little():
    for records in ([b"one record"], [b"x" * 100] * 3, [b"", b"a"]):
        raw = warc.archive(records, 1 << 20, 1 << 15, 3)
        assert int.from_bytes(raw[4:8], "little") >= 1


def test_roles_pass_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a" * 2000), (2, "a" * 2000)], "page_id long, html string").withColumns({c: F.lit("x") for c in ("_d", "_last", "_n", "_id", "_page")})
    out = warc.roles(df)
    assert out.filter("_d = 'x' and _last = 'x' and _n = 'x' and _id = 'x' and _page = 'x'").count() == 2
    assert sorted((r.page_id, r._type, r._refers_to) for r in out.collect()) == [(1, "revisit", 2), (2, "response", None)]


def test_warc_edges(spark):
    big = "<p>é\r\n\r\n" * 400
    pages = [(1, None), (2, ""), (3, big), (4, big), (4, big), (None, big), (5, "x" * 5000), (6, "y" * 999), (7, "y" * 999), (None, "z" * 2000)]
    df = spark.createDataFrame([(i, f"http://a/\n{i}", h, "x") for i, h in pages], "page_id long, url string, html string, _digest string")
    out = warc.round_trip(df, archive_bytes=6000).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out], key=str) == roles(pages)
    text = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, h in pages}
    assert all(bytes(r.payload) == text[r.payload_digest] for r in out if r.record_type == "response")
    assert warc.round_trip(df.limit(0)).count() == 0


def brute(rows, k=20, every=20):
    v = {}
    use = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in use:
        if q % every == 0 and q not in v:
            v[q] = sorted([(-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q and len(a) == len(b)])[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(v[q])]
    return sorted(out)


def test_topk_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, queries.op4_exact_topk(spark, SF).collect())) == brute(rows)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, nan]), (4, [inf, 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (20, [-1.5, 0.01]), (40, [2.0, 2.0, 2.0]), (None, [9.0, 9.0]), (60, [-2.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").union(spark.createDataFrame([(7, [None, 1.0])], "vec_id long, embedding array<float>")).withColumn("_id", F.lit(1))
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, k=3, block=2, query_block=2, step=1).collect())) == brute(rows, 3)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_slices_of_ordered_ids(spark):
    """Blocks that begin at multiples of their size do not share a slice."""
    rows = spark.range(0, 65536, 1, 1).select(F.col("id").alias("_id"), F.array(F.lit(1.0)).alias("_v"))
    slices = [r._slice for r in topk.packed(rows, 1024, 16).select("_slice").collect()]
    assert len(slices) >= 60 and len(set(slices)) > 8


def test_topk_groups_grow(spark, monkeypatch):
    """A task's part of queries and candidates stays bounded as the table grows, and the parts together are the whole search."""
    monkeypatch.setattr(topk, "QUERY_VALUES", 400)
    monkeypatch.setattr(topk, "CANDIDATE_VALUES", 800)
    df = spark.range(0, 4000, 1, 4).select(F.col("id").alias("vec_id"), F.array(*(((F.col("id") * p) % 101 - 50) / 64.0 for p in (3, 7, 11, 13))).alias("embedding"))
    is_query = F.col("vec_id") % 20 == 0
    queries, candidates = topk.dealt(df, is_query, 64.0, 40, 20, None, None, "vec_id", "embedding")
    for rows, ids, most, total in ((queries, "_q_ids", 200, 200 * 20), (candidates, "_ids", 600, 4000 * 2)):
        sizes = [r.n // 8 for r in rows.groupBy("_group", "_slice").agg(F.sum(F.octet_length(ids)).alias("n")).collect()]
        assert max(sizes) <= most and sum(sizes) == total
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, topk.search(df, is_query, k=3, block=40, query_block=20).collect())) == brute(rows, 3)
