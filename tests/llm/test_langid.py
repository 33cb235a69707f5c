"""Operator 11: held-out accuracy, sizes by plain compression, and defined cases."""

import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import langid, queries  # noqa: E402
from strandlake.llm.common import crc_mod, table  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = queries.op11_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and {r.lang_pred for r in rows} <= {*lang.values(), "und"}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 200 and np.mean(held) > 0.97


def test_sizes_are_those_of_plain_compression():
    """Every size is that of independent frames with the raw dictionary, all of which decode to the text."""
    words = [("x", b" alpha beta gamma delta "), ("y", b" uno dos tres cuatro ")]
    coders, text = langid.compressors(words), b" gamma beta alpha delta gamma alpha " * 9
    sizes = langid.encoded_sizes(text, coders, 100)
    for (_, d), c, n in zip(words, coders, sizes):
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        parts = [c.compress(text[i : i + 100]) for i in range(0, len(text), 100)]
        assert sum(map(len, parts)) == n and b"".join(plain.decompress(p, max_output_size=100) for p in parts) == text
    assert sizes[0] < sizes[1]


def test_judged():
    assert langid.judged(np.array([10, 10, 12]), 0.01) == (0, pytest.approx(1 / 2.25), 0.0, True)
    best, score, margin, rejected = langid.judged(np.array([100, 50]), 0.01)
    assert (best, margin, rejected) == (1, 0.5, False) and score > 0.999
    assert langid.judged(np.array([7]), 0.01) == (0, 1.0, 1.0, False)
    assert langid.judged(np.array([1000, 995]), 0.01)[3]


def test_edges(spark):
    rows = [(1, "the house and the garden are green", "en"), (2, "das haus und der garten sind grün", "de"), (3, None, "en"), (4, "", "de"), (5, "123 456 !?", "en"), (6, "THE GARDEN and the house", None), (7, "der garten und das haus " * 50_000, "de"), (7, "der garten und das haus " * 50_000, "de"), (None, "the house and the garden", "en"), (8, "русский", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("_lang", "_hash", "_text", "row", "found")})
    learnt = langid.train(df, F.lit(True))
    assert [x for x, _ in learnt] == ["de", "en"] and b" garten " in learnt[0][1]
    out = {r.doc_id: r for r in langid.predict(df, learnt).collect()}
    assert {i: r._lang for i, r in out.items() if i != 8} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", 7: "de", None: "en"}
    assert out[8]._lang in ("de", "en") and out[8]._rejected and out[3]._score == 0 and out[3]._rejected and out[7].row == "x"
    assert langid.predict(df, learnt).count() == len(rows) and langid.accepted(langid.predict(df, learnt), ["de"]).count() == 3
    assert langid.train(df.limit(0), F.lit(True)) == [] and langid.train(df, F.lit(False)) == []
    assert {r._lang for r in langid.predict(df, []).collect()} == {"und"}
    assert langid.predict(df.limit(0), learnt).count() == 0
    alone = langid.predict(df, langid.train(df.filter("lang = 'en'"), F.lit(True)))
    assert {r._lang for r in alone.collect()} == {"en", "und"}


def test_sample_is_bounded_and_takes_copies_once(spark):
    rows = [(n, f"same words again {n if n % 3 else 0}", "a" if n % 4 else "b") for n in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, sizes = langid.sampled(df, crc_mod(F.col("doc_id"), 4) != 2, 50, 10, "text", "lang")
    got = sample.groupBy("_lang").agg(F.count("*").alias("n"), F.max(F.length("_passage")).alias("long")).collect()
    assert {r._lang for r in got} == {"a", "b"} and all(30 <= r.n <= 50 and r.long == 10 for r in got)
    assert sum(sizes.values()) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in rows)
