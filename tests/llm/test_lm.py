"""Operator 1: counts against brute force, the model against its gradient, its sum of probabilities and held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import lm, queries  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.01"


def words(t):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()).split() + [None]


def brute(docs):
    rest = lambda i: zlib.crc32(str(i).encode()) % 5 if i is not None else None
    c = Counter(w for i, t in docs if rest(i) not in (1, None) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, rest(i) == 1, len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in docs]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows = queries.op1_lm_score(spark, SF).collect()
    same([tuple(r)[:6] for r in rows], brute(docs))
    held = [r for r in rows if r.held_out]
    assert all(r.score < 0 for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "A b\tC"), (3, "A b\tC"), (4, "ünï \x0b codé"), (6, "word " * 500), (7, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_score", F.lit("x"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    for top in (0, 2, 1000):
        out = lm.score(df, rest != 1, top_words=top, share=1.0, rounds=1)
        rows = out.withColumn("held", rest == 1).collect()
        same([(r.doc_id, r.held, r._n_tokens, r._n_known, r._train_tokens, r._base_score) for r in rows], brute(docs))
    one, two = (r._score for r in rows if r.doc_id == 3)
    assert one == pytest.approx(two, rel=1e-6)
    empty = lm.score(df, rest > 9).collect()
    assert all(math.isfinite(r._score) and r._n_known == 0 and r._train_tokens == 0 for r in empty)
    assert lm.score(df.limit(0), rest != 1).count() == 0


def made(seed=0, n=700):
    rng = np.random.default_rng(seed)
    ids, ends = [], []
    while len(ids) < n:
        for _ in range(rng.integers(1, 60)):
            ids.append(int(rng.integers(0, 12)))
        ids.append(-1)
        ends.append(len(ids))
    return np.array(ids), np.array(ends)


def test_gradient():
    ids, ends = made()
    model = lm.fit(ids, ends, side=4, epochs=1, batch=64)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    before, target, first, _ = model.laid_out(ids[:160], ends[ends <= 160] if ends[ends <= 160].size and ends[ends <= 160][-1] == 160 else np.append(ends[ends < 160], 160))
    live = np.ones(160, bool)
    _, grads = model.step(before, target, first, live)
    rng = np.random.default_rng(1)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            old, loss = model.p[name][at], []
            for e in (1e-4, -1e-4):
                model.p[name][at] = old + e
                loss.append(-model.forward(before, target, first)[0].mean())
            model.p[name][at] = old
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=5e-2, abs=1e-4), name


def test_probabilities_and_windows():
    ids, ends = made()
    model = lm.fit(ids, ends, side=4, epochs=2, batch=64)
    # all continuations of a text sum to one
    prefix = [3, 7, 1, 0, 2]
    total = 0.0
    known = np.flatnonzero(model.unit > 1)
    base = model.score(np.array([*prefix, -1]), np.array([6]))[0]
    for i in [*known.tolist(), 40000, None]:
        x = np.array([*prefix, -1 if i is None else i])
        before, target, first, more = model.laid_out(np.append(x, [0] * 10), np.array([6, 16]))
        logp = model.forward(before, target, first)[0][5] / math.log(10)
        total += 10**logp
        if i is None:
            assert model.forward(before, target, first)[0][:6].sum() / math.log(10) == pytest.approx(base, rel=1e-5)
    assert total == pytest.approx(1, rel=1e-4)
    assert (10 ** model.rest[model.unit == 1]).sum() == pytest.approx(1)
    # a text's score depends neither on the texts around it nor on the batches
    whole = model.score(ids, ends)
    assert model.score(ids, ends, batch=64) == pytest.approx(whole, rel=1e-4)
    for n in range(5):
        own = ids[(ends[n - 1] if n else 0) : ends[n]]
        assert model.score(own, np.array([len(own)]))[0] == pytest.approx(whole[n], rel=1e-4)


def test_learns_from_all_parts(spark):
    """What is learnt from grows with the texts: ids that stand in one partition only change the model, and more so with rounds."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    held = F.when(rest == 1, F.col("_score"))

    def quality(**more):
        return lm.score(docs.repartition(4, "doc_id"), rest != 1, **more).agg(F.sum(held)).first()[0]

    warm, some, every = quality(rounds=0, warm_ids=20000), quality(rounds=1, share=0.3, warm_ids=20000), quality(rounds=2, share=1.0, warm_ids=20000)
    assert warm < some < every


def test_learns_from_every_id_by_default(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").repartition(4, "doc_id")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5

    def scores(**more):
        return {r.doc_id: r._score for r in lm.score(docs, rest != 1, warm_ids=20000, warm_epochs=1, **more).collect()}

    default, whole, part = scores(), scores(share=1.0, rounds=1), scores(share=0.1, rounds=1)
    assert default == pytest.approx(whole, rel=1e-6)
    assert default != pytest.approx(part, rel=1e-6)


def test_windows_are_blocks_with_the_one_before():
    x = np.arange(3 * lm.STRIDE * 2.0).reshape(-1, 2)
    w = lm.Model.windows(x)
    assert w.shape == (2, 2 * lm.STRIDE, 2) and (w[0] == x[: 2 * lm.STRIDE]).all() and (w[1] == x[lm.STRIDE :]).all()


def test_packed_ids_come_back(spark):
    import pyarrow as pa

    texts = [[5, 65535, 0], [], [7]]
    ids, ends = lm.unpacked(pa.array([np.array(x, "<u2").tobytes() for x in texts], pa.binary()))
    assert ids.tolist() == [5, 65535, 0, -1, -1, 7, -1] and ends.tolist() == [4, 5, 7]


def test_columns_of_any_name_pass(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_doc", "_row", "_ids", "_others", "_learns", "_text", "_r", "_word")})
    out = lm.score(df, F.lit(True), rounds=0)
    assert out.filter(" and ".join(f"{c} = 'x'" for c in df.columns[2:])).count() == 2 and "text" not in out.columns


def test_words_are_split_once_by_a_worker(monkeypatch):
    from strandlake.llm.common import LOWER, word_spans

    asked, real = [], lm.coder(open(lm.VOCABULARY, "rb").read())

    class Counting:
        def encode_to_numpy(self, lines, **more):
            asked.append(lines)
            return real.encode_to_numpy(lines, **more)

        encode_single_token = staticmethod(real.encode_single_token)

    vocabulary = b"of this test"
    monkeypatch.setattr(lm, "coder", lambda _: Counting())

    def ids(*texts):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
        got = lm.subwords(data, *word_spans(data, off), vocabulary)[-2:]
        want = [i for x in texts for i in [*(k for w in LOWER[np.frombuffer(x.encode(), np.uint8)].tobytes().split() for k in real.encode(" " + w.decode())), -1]]
        assert got[0].tolist() == want and got[1][-1] == len(want)

    ids("Some words, sOme more", "", "ünknown words,")
    ids("words, some", "more")
    assert len(asked) == 1 and sorted(asked[0].splitlines()) == [" more", " some", " words,", " ünknown"]
    ids("brandnew words,")
    assert asked[1:] == [" brandnew\n"]
    monkeypatch.setattr(lm, "KEPT_WORDS", 3)
    for _ in range(2):
        ids("some more words,", "ünknown brandnew")
    assert len(asked) > 2


def test_high_logits_are_capped():
    ids, ends = made()
    model = lm.fit(ids, ends, side=4, epochs=1, batch=64)
    before, target, first, _ = model.laid_out(ids[:64], np.append(ends[ends < 64], 64))
    for name, by in (("c", 300), ("m", 300), ("q", 3000)):
        had = model.p[name].copy()
        model.p[name] *= by
        got = model.forward(before, target, first)[0]
        assert not np.isnan(got).any()
        assert got == pytest.approx(model.forward(before, target, first, capped=True)[0], rel=1e-6), name
        model.p[name][...] = had
    assert model.forward(before, target, first)[0] == pytest.approx(model.forward(before, target, first, capped=True)[0], rel=1e-6)


def test_model_is_plain_attention():
    """Each probability, worked out position by position from the parameters as they are."""
    ids, ends = made(n=200)
    model = lm.fit(ids, ends, side=4, epochs=2, batch=64)
    p = model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    before, target, first, _ = model.laid_out(ids[:96], np.append(ends[ends < 96], 96))
    got = model.forward(before, target, first)[0]
    x = p["e"][before]
    for i in range(96):
        near = range(max(first[i], i // lm.STRIDE * lm.STRIDE - lm.STRIDE), i + 1)
        a = np.exp([x[i] @ p["q"] @ (x[j] @ p["k"]) / math.sqrt(model.d) + p["far"][i - j] for j in near])
        o = (a / a.sum()) @ (x[list(near)] @ p["v"])
        h = np.append(np.maximum(np.append(x[i], o) @ p["w"] + p["b"], 0), 1)
        c = model.classes[target[i]]
        own = slice(model.edges[c], model.edges[c + 1])
        of_c, of_m = np.exp(h @ p["c"]), np.exp(p["m"] @ h)
        assert got[i] == pytest.approx(math.log(of_c[c] / of_c.sum() * of_m[target[i]] / of_m[own].sum()), rel=1e-6), i


def test_classes_are_as_large_as_their_units_are_rare():
    """A position's logits, of classes and of its class's members, are fewer than with classes of one size, and no unit is left out."""
    share = 1 / np.arange(1, 1601)
    share /= share.sum()
    edges = lm.runs(share)
    width = np.diff(edges)
    assert edges[0] == 0 and edges[-1] == 1600 and (width > 0).all() and width[0] < width[-1]
    assert len(width) + (np.add.reduceat(share, edges[:-1]) * width).sum() < 0.75 * 80
    for n in (1, 3, 16):
        edges = lm.runs(np.full(n, 1 / n))
        assert edges[0] == 0 and edges[-1] == n and (np.diff(edges) > 0).all()


def test_low_logits_are_no_zeros():
    ids, ends = made()
    model = lm.fit(ids, ends, side=4, epochs=1, batch=64)
    before, target, first, _ = model.laid_out(ids[:64], np.append(ends[ends < 64], 64))
    want = model.forward(before, target, first)[0]
    model.p["c"][-1] -= 500
    model.p["m"][:, -1] -= 500
    assert model.forward(before, target, first)[0] == pytest.approx(want, abs=1e-3)
