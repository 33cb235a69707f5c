"""Failure codes, scans, drift, written outputs and prompts by hand; retrieval against brute force."""

import random

from pyspark.sql import functions as F

from strandlake.operators import anchors, fragments, periodic, validation, views
from strandlake.operators.anchors import Anchor

R = fragments.Rule
ETHER = R("ether", "ether", "g", 1, "[#6:1][OX2:2][#6:3]", ("left", "oxygen", "right"), "oxygen")
NITRILE = R("nitrile", "nitrile", "g", 1, "[CX2:1]#[NX1:2]", ("carbon", "nitrogen"), "carbon")
DOUBLE = R("double", "double", "g", 1, "[#6:1]=[#6:2]", ("one", "two"), groups=(("one", "two"),))


def test_failure_codes(spark):
    want = {
        "[R]C*": {"PARSER_FAILED": 1}, "": {"PARSER_FAILED": 1}, None: {"PARSER_FAILED": 1}, "*CC": {"STANDARDIZATION_FAILED": 1}, "**": {"GRAPH_CONSTRUCTION_FAILED": 1}, "*=CC*": {"PERIODIC_EXPANSION_FAILED": 1},
        "*CC.C*": {"PERIODIC_EXPANSION_FAILED": 1}, "*CC*": {"NO_FRAGMENT_MATCHED": 1}, "*CC(*)C#N": {"ANCHOR_NOT_FOUND": 1}, "*C=C*": {"ANCHOR_NOT_UNIQUE": 1}, "*CC(C#N)C(C#N)O*": {"ANCHOR_NOT_FOUND": 2}, "*CCO*": {}, "*OCC*": {},
    }
    assert {c for x in want.values() for c in x} < set(validation.CODES)
    rows = periodic.chains(fragments.molecules(spark.createDataFrame([(s,) for s in want], "smiles string")))
    found = anchors.anchored(rows, (ETHER, NITRILE, DOUBLE), {"ether": Anchor("atom", ("oxygen",)), "double": Anchor("bond", ("one", "two"))})
    got = {s: {} for s in want}
    for r in validation.failure_codes(rows, found).collect():
        got[r.smiles][r.code] = r.failures
    assert got == want
    assert validation.failure_codes(rows.limit(0), found.limit(0)).count() == 0


def test_codes_of_instances(spark):
    # seen and never owned; owned twice; two anchors under one key
    schema = "smiles string, fragment_id string, instance_key string, anchor_key string, anchor_offset int, tied boolean"
    rows = [("a", "f", "k", "x", 1, False), ("b", "f", "k", "x", 0, False), ("b", "f", "k", "x", 0, False), ("c", "f", "k", "x", 0, False), ("c", "f", "k", "y", 1, False)]
    chains = spark.createDataFrame([(s, None) for s in "abc"], "smiles string, reason string")
    got = sorted(tuple(r) for r in validation.failure_codes(chains, spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "WRONG_OWNER", 1), ("b", "DUPLICATE_INSTANCE", 1), ("c", "CANONICAL_KEY_ERROR", 1)]


def test_scan_quality(spark):
    schema = "smiles string, fragment_id string, instance_key string"
    truth = [("a", "f", "1"), ("a", "f", "2"), ("b", "f", "1"), ("b", "g", "1")]
    found = [("a", "f", "1"), ("a", "f", "1"), ("a", "f", "3"), ("b", "f", "1")]
    made = [spark.createDataFrame(x, schema) for x in (found, truth)]
    got = {r.fragment_id: tuple(r)[1:] for r in validation.scan_quality(*made).collect()}
    assert got == {"f": (3, 3, 0.25, 1 / 3, 2 / 3), "g": (0, 1, 0.0, 0.0, 0.0)}
    assert validation.scan_quality(made[0].limit(0), made[1].limit(0)).count() == 0


def test_drift_and_grade(spark):
    schema = "fragment_id string, records long"
    a, b = spark.createDataFrame([("f", 5), ("g", 2)], schema), spark.createDataFrame([("f", 1), ("h", 2)], schema)
    got = {r.fragment_id: (r.inside_share, r.outside_share, r.drift) for r in validation.drift(a, b, 10, 4).collect()}
    assert got == {"f": (0.5, 0.25, -0.25), "g": (0.2, 0.0, -0.2), "h": (0.0, 0.5, 0.5)}
    assert {r.drift for r in validation.drift(a, b, 0, 0).collect()} == {0.0}
    rows = spark.createDataFrame([(0.85, 0.98, 0.01), (0.85, 0.98, 0.02), (0.7, 0.99, 0.0), (0.69, 1.0, 0.0), (0.9, 0.97, 0.0)], "c double, a double, d double")
    assert [r[0] for r in rows.select(validation.outside_grade(F.col("c"), F.col("a"), F.col("d"))).collect()] == ["Green", "Yellow", "Yellow", "Red", "Red"]


def test_outputs(spark):
    rows = [("*CCO*", "*CCO*"), ("*CCO*", "*OCC*"), ("*CCO*", "O(*)CC*"), ("*CCO*", "*COC*"), ("*CCO*", "*CCO"), ("*CCO*", "*CC(O*"), ("*CCO*", None), (None, "*CCO*"), (None, None), ("*CC", "*CC"), ("bad", "bad")]
    got = {r.bucket: r for r in validation.output_report(spark.createDataFrame(rows, "t string, o string"), "t", "o", F.lit("all")).collect()}["all"]
    n = len(rows)
    assert (got.outputs, got.exact_match, got.parse_validity) == (n, 3 / n, 7 / n) and abs(got.invalid_rate - 4 / n) < 1e-12
    # three spellings of the unit and the equal half unit; the same chain cut elsewhere is another unit; stars count in texts that can't be read too
    assert (got.canonical_match, got.two_attachment_validity) == (4 / n, 6 / n)


def ranked(queries, candidates):
    own, before, negatives = [], [], []
    of = dict(candidates)
    for q, v in queries:
        if q not in of:
            continue
        score = {c: sum(x * y for x, y in zip(v, w)) for c, w in candidates}
        order = sorted(score, key=lambda c: (-score[c], c))
        own.append(score[q])
        before.append(order.index(q))
        negatives += [s for c, s in score.items() if c != q]
    n = len(own)
    return (n, sum(b < 1 for b in before) / n, sum(b < 5 for b in before) / n, sum(own) / n, sum(negatives) / len(negatives))


def test_retrieval(spark):
    rng = random.Random(5)
    candidates = [(i, [rng.randrange(-3, 4) for _ in range(6)]) for i in range(150)] + [(i, [1, 0, 0, 0, 0, 0]) for i in range(200, 220)]
    queries = [(i, [x + rng.randrange(-2, 3) for x in v]) for i, v in candidates if i % 3 == 0] + [(999, [1] * 6)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, vector array<long>")
    want = ranked(queries, candidates)
    for block, size in ((256, 4096), (7, 13)):
        got = validation.retrieval(frame([*queries, (3000, None), (None, [1] * 6)]), frame([*candidates, (None, [1] * 6), (4000, None)]), block, size).first()
        assert tuple(got)[:3] == want[:3] and all(abs(a - b) < 1e-9 for a, b in zip(got[3:], want[3:]))
    assert tuple(validation.retrieval(frame([]), frame(candidates)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(validation.retrieval(frame(queries), frame([])).first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_prompts(spark):
    rows = spark.createDataFrame([("plain", "*CC*", "*CC*"), ("token_mask", "*[MASK]*", "*CC*"), (None, None, None)], "view string, input string, target string")
    got = [(r.prompt, r.completion) for r in views.prompts(rows).collect()]
    assert got == [("<polymer_smiles>\n*CC*\n</polymer_smiles>", "*CC*<|endoftext|>"), ("<polymer_view_smiles>\n*[MASK]*\n</polymer_view_smiles>", "*CC*<|endoftext|>"), ("<polymer_view_smiles>\n\n</polymer_view_smiles>", "<|endoftext|>")]
    text = spark.range(1).select(views.described(F.lit("FG_AMIDE"), F.lit("amide"), F.lit(None), F.lit("carbonyl connected to nitrogen"))).first()[0]
    assert text == "<fragment_description>\nid: FG_AMIDE\nname: amide\ncategory: \ndescription: carbonyl connected to nitrogen\n</fragment_description>"
