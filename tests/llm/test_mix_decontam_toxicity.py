"""Operators 5, 6 and 9 against brute force and held-out labels, with nulls, empty tables, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import decontam, mixing, queries, toxicity  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [(1, None, "a"), (2, "", None), (3, "x y  z", "a"), (3, "x y  z", "a"), (4, "\t\n", "b"), (None, "one\x0btwo", None), (5, "É w " * 400, "b")]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def wanted_targets(size):
    total, left, out = sum(size.values()), {}, {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda x: (x is None, x)))}
    left, rest = dict(weight), total
    while left:
        level = rest / sum(left.values())
        full = [s for s in left if 3 * size[s] < left[s] * level]
        if not full:
            return out | {s: w * level for s, w in left.items()}
        for s in full:
            out[s] = 3 * size[s]
            rest -= out[s]
            del left[s]
    return out


def check_mix(rows, docs):
    size = defaultdict(int)
    for i, t, s in docs:
        size[s] += len(WORDS.findall((t or "").encode()))
    want = wanted_targets(size) if sum(size.values()) else {}
    source, taken = {i: s for i, _, s in docs}, defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in size:
        assert taken[s] == pytest.approx(want[s], abs=1)


def test_mix_query(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect()]
    rows = queries.op5_curriculum_mix(spark, SF).collect()
    check_mix(rows, docs)
    assert rows == queries.op5_curriculum_mix(spark, SF).collect()
    at = [r.first_position for r in rows if r.first_position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_mix_edges(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, source string").withColumn("size", F.lit("other")).withColumn("_taken", F.lit(1))
    out = mixing.mix(docs)
    check_mix(out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")).collect(), EDGE)
    assert "size" in out.columns
    clash = docs.withColumns({c: F.lit(c) for c in ("_order", "_start", "_b", "_source", "_bucket", "_upto", "_id", "_of", "_slot", "position", "copy", "taken", "target")})
    got = mixing.training_order(mixing.mix(clash))
    assert got.filter(" and ".join(f"{c} = '{c}'" for c in clash.columns[5:])).count() == got.count() > 0
    assert mixing.training_order(mixing.mix(docs.limit(0))).count() == 0


def test_inverse_of_schedule(spark):
    for knots in mixing.SCHEDULES:
        at = [r[0] for r in spark.range(0, 101).select(mixing.time_of(F.col("id") / 100.0, knots)).collect()]
        for i, t in enumerate(at):
            done, total = 0.0, mixing.integrals(knots)[-1]
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                to = min(max(t, t0), t1)
                done += (to - t0) * (w0 + w0 + (w1 - w0) * (to - t0) / (t1 - t0)) / 2
            assert done / total == pytest.approx(i / 100, abs=1e-9)


def brute_hits(text, items, width=13):
    w = TERMS.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        x = TERMS.findall(lower(t or ""))
        grams = [x[i : i + width] for i in range(max(1, len(x) - width + 1))] if x else []
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontam_edges(spark):
    items = [(1, "Alpha beta-gamma"), (2, None), (3, "..."), (10, " ".join(f"w{i}" for i in range(20))), (11, "gamma GAMMA gamma"), (12, "É é")]
    texts = [None, "", "!!", "xx ALPHA, beta gamma gamma gamma gamma yy", " ".join(f"W{i}" for i in range(3, 25)), "é É é", "alpha beta", "ALPHA beta gamma " * 3]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 0):
        out = decontam.decontaminate(df.withColumns({c: F.lit("x") for c in ("_id", "_k", "_text_hash", "_key", "start", "_words")}), bench, broadcast_windows=limit)
        assert out.filter("_id = 'x' and _k = 'x' and _text_hash = 'x' and _key = 'x' and start = 'x' and _words = 'x'").count() == len(docs)
        got = out.select("doc_id", "text", "_n_words", "_n_hit", F.size("_items"), F.sha2(F.array_join("_items", ","), 256), "_contaminated").collect()
        assert len(got) == len(docs)
        for r in got:
            assert tuple(r[2:]) == brute_hits(r.text, items), r
    assert decontam.decontaminate(df, bench.limit(0)).filter("_contaminated").count() == 0
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    kept = {r.text for r in decontam.remove_spans(df, bench).collect()}
    assert "xx yy" in kept


def test_decontam_query(spark):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    grams = {}
    for item, t in items:
        x = TERMS.findall(lower(t))
        for i in range(max(1, len(x) - 12)):
            grams.setdefault(tuple(x[i : i + 13]), set()).add(str(item))
    rows = queries.op6_decontaminate(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        w, hit, found = TERMS.findall(lower(text[r.doc_id] or "")), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def auc(score, label):
    ranked = sorted(zip(score, label))
    good = bad = pairs = 0
    for _, y in ranked:
        if y:
            good, pairs = good + 1, pairs + bad
        else:
            bad += 1
    return pairs / (good * bad)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = queries.op9_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert auc([r.score for r in held], [label[r.doc_id] for r in held]) > 0.75
    flagged = [label[r.doc_id] for r in held if r.predicted]
    assert sum(flagged) / len(flagged) > 0.95 and sum(flagged) > 0.5 * sum(label[r.doc_id] for r in held)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, source string").withColumn("score", F.lit("x"))
    model = toxicity.train(docs, spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int"), min_df=1)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(EDGE) and len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == len(EDGE) - 0


def pairs(n, seed, share, company):
    """Either of two terms is toxic unless both are there; about `share` of the texts have one. Others are toxic by chance."""
    rng = np.random.default_rng(seed)
    found, label = [], []
    for _ in range(n):
        a = rng.random() < share
        b = rng.random() < 0.5 if a or share == 0.5 else rng.random() < share / 2 / (1 - share)
        found.append(np.array(sorted({*([3] if a else []), *([9] if b else []), *rng.integers(20, 20 + 8 * company, company)})))
        label.append(float(a != b) if a or b or share == 0.5 else float(rng.random() < 0.5))
    return found, np.array(label)


@pytest.mark.parametrize(("share", "company"), [(0.5, 5), (0.5, 60), (0.05, 5)])
def test_pairs_beyond_linear(share, company):
    """With the defaults of production, terms that say nothing alone interact, frequent or rare, in short texts and long ones."""

    def right(model):
        found, label = pairs(2000, 2, share, company)
        first = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        has = np.array([3 in x or 9 in x for x in found])
        logits = model.logits(model.slot[np.concatenate(found)], first)
        return ((logits > 0) == label)[has].mean(), np.logaddexp(0, np.where(label > 0, -1, 1) * logits).mean()

    got, plain = (right(toxicity.fit(*pairs(4000, 1, share, company), bits=10, **more)) for more in ({}, {"factors": 0}))
    assert got[0] > 0.95 and plain[0] < 0.75 and got[1] < plain[1]


def test_toxicity_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(i, f"good{i % 7} words here") for i in range(40)] + [(1, "bad other text")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)], "doc_id long, toxic int")
    a, b = (toxicity.train(d, labels, min_df=1) for d in (docs, docs.repartition(3)))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_no_words_in_the_shuffle_of_windows(spark):
    """Beyond the broadcast, an exchange of windows holds hashes and places; words travel once for each document that is hit."""
    docs, bench = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "benchmark")
    found = decontam.hits(docs, bench, broadcast_windows=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Join Inner" in x and "_window" in x)
    below = next(x for x in lines[at + 1 :] if "Project" in x)
    assert "_window" in below and "_words" not in below.split("AS _window")[1] and below.count("_words") == below.split("AS _window")[0].count("_words")
    names = ("doc_id", "_n_words", "_n_hit", "_items", "_contaminated")
    both = [sorted((tuple(map(str, (r[c] for c in names))) for r in decontam.decontaminate(docs, bench, broadcast_windows=n).collect())) for n in (0, 1 << 20)]
    assert both[0] == both[1] and any(r[4] == "True" for r in both[0])
