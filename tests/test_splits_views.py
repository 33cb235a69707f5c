"""Components against union-find, leaks, and training views: reruns, spans, fixed rows, defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import splits, views


def union_find(rows):
    up = {r: r for r, _, _ in rows if r is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for r, kind, key in rows:
        if r is not None and key is not None:
            a, b = sorted((root(r), root(first.setdefault((kind, key), r))))
            up[b] = a
    return {r: root(r) for r in up}


def keys(spark, rows):
    return spark.createDataFrame(rows, "record long, kind string, key string")


@pytest.mark.parametrize("hot", [1, 100_000])
def test_components(spark, monkeypatch, hot):
    # a key of a third of all rows, a long chain, pairs by chance, nulls, repeats; hot keys looked up by broadcast and not
    monkeypatch.setattr(splits, "HOT_ROWS", hot)
    rng = random.Random(3)
    rows = [(i, "a", "common") for i in range(0, 300, 3)] + [(1001 + i, "a", f"c{i}") for i in range(60)] + [(1000 + i, "a", f"c{i}") for i in range(60)]
    rows += [(rng.randrange(2000, 2200), rng.choice("ab"), str(rng.randrange(120))) for _ in range(150)] + [(None, "a", "common"), (5, "a", None), (0, "a", "common")]
    got = {r.record: r.component for r in splits.components(keys(spark, rows)).collect()}
    assert got == union_find(rows)


def test_components_of_none_and_of_single_records(spark):
    none = keys(spark, [])
    assert splits.components(none).count() == 0
    single = splits.components(none, spark.createDataFrame([(4,), (4,), (None,)], "record long")).collect()
    assert [tuple(r) for r in single] == [(4, 4)]


def test_leaks(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (3, "b", None)]
    split = spark.createDataFrame([(1, "build"), (2, "stress"), (3, "stress")], "record long, split string")
    got = {(r.kind, r.left, r.right): (r["keys"], r.shared) for r in splits.shared(keys(spark, rows), split, ("a", "b")).collect()}
    assert got["a", "build", "stress"] == (2, 1) and got["a", "build", "validation"] == (1, 0) and got["b", "build", "stress"] == (0, 0) and len(got) == 6


def test_views(spark):
    rows = [(i, "*" + "C" * (i % 40) + "[Si](C)(Cl)O*", "train" if i % 3 else "valid") for i in range(200)] + [(900, None, "train"), (901, "", "train"), (None, "*CC*", "train"), (902, "*C*", None)]
    found = spark.createDataFrame(rows, "id long, smiles string, split string")
    made = views.views(found, "id", "smiles", "s", share=0.2, span_share=1.0)
    got = {(r.record_id, r.view): r for r in made.collect()}
    again = {(r.record_id, r.view): r for r in views.views(found.repartition(7), "id", "smiles", "s", share=0.2, span_share=1.0).collect()}
    assert got == again
    later = {(r.record_id, r.view): r for r in views.views(found, "id", "smiles", "s", epoch=1, share=0.2, span_share=1.0).collect()}
    assert any(got[k].input != later[k].input for k in got if k[1] == "token_mask") and all(got[k] == later[k] for k in got if k[1] == "plain")
    for i, text, split in rows:
        text = text or ""
        assert got[i, "plain"].input == text == got[i, "plain"].target
        if split != "train":
            assert (i, "token_mask") not in got and (i, "span_dropout") not in got
            continue
        n = len(text) - 3 * text.count("[Si]") - text.count("Cl")
        left = got[i, "span_dropout"].input
        whole = n // 12 + (n % 12 >= 3)
        length = len(left) - 3 * left.count("[Si]") - left.count("Cl")
        assert length == n - 3 * whole, (text, left)
    masks = sum(got[i, "token_mask"].input.count("[MASK]") for i, _, s in rows if s == "train")
    assert 0.15 < masks / made.filter("view = 'plain' and split = 'train'").select(F.sum(F.size(views.tokens(F.col("target"))))).first()[0] < 0.25


def test_a_span_is_shorter_than_its_block(spark):
    with pytest.raises(ValueError):
        views.without_spans(F.array(), F.lit(1), "s", 0.1, 12, 12)
