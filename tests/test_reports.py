"""Audit, summaries, sinks and the constraints of rules on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from strandlake.operators import fragments, metrics, reports, rules

R = fragments.Rule
ETHER = ("[C:1][O:2][C:3]", ("left", "oxygen", "right"), "oxygen")


def hits(spark, strings, **constraints):
    rule = R("x", "x", "x", 1, "[*:1][C:2]([F:3])([F:4])[F:5]", ("attached_carbon", "trifluoromethyl_carbon", "a", "b", "c"), "trifluoromethyl_carbon", constraints=constraints)
    assert not fragments.problems([rule])
    found = fragments.molecules(spark.createDataFrame([(s,) for s in strings], "smiles string"))
    return {r["smiles"] for r in fragments.levels(found, [rule]).filter("size(normalized) > 0").collect()}


def test_constraints(spark):
    """Each key, with a role or a list of roles; expectations by hand."""
    strings = ["CC(F)(F)F", "FC(F)C(F)(F)F", "CC(=O)C(F)(F)F", "CS(=O)(=O)C(F)(F)F", "OC(F)(F)F", "FC(F)(F)F"]
    assert hits(spark, strings) == set(strings)
    assert hits(spark, strings, exclude_perfluoroalkyl_chain=True) == {"CC(F)(F)F", "CC(=O)C(F)(F)F", "CS(=O)(=O)C(F)(F)F", "OC(F)(F)F", "FC(F)(F)F"}
    assert hits(spark, strings, exclude_perfluoroalkyl_chain=False) == set(strings)
    assert hits(spark, strings, exclude_atom_role_adjacent_to_carbonyl="trifluoromethyl_carbon") == set(strings) - {"CC(=O)C(F)(F)F"}
    assert hits(spark, strings, exclude_atom_role_adjacent_to_sulfonyl=["attached_carbon", "trifluoromethyl_carbon"]) == set(strings) - {"CS(=O)(=O)C(F)(F)F"}
    assert hits(spark, strings, exclude_atom_role_with_oxygen_neighbor=["trifluoromethyl_carbon"]) == set(strings) - {"OC(F)(F)F"}
    assert hits(spark, strings, exact_fluorine_count=3) == set(strings) - {"FC(F)(F)F"}
    assert hits(spark, strings, exact_fluorine_count=2, fluorine_count_atom_role="attached_carbon") == {"FC(F)C(F)(F)F"}


def test_faults_of_constraints():
    faults = fragments.problems([R("x", "", "", 1, *ETHER, constraints={"odd": 1}), R("y", "", "", 1, *ETHER, constraints={"exclude_atom_role_with_oxygen_neighbor": ["nobody"]})])
    assert faults == [("x", "unknown_constraint"), ("y", "constraint_role_unknown")]


def test_derived_views_have_zero_rows(spark, tmp_path):
    one = {"fragment_id": "a", "fragment_name": "ether", "category": "c", "atom_roles": {"1": "l", "2": "o", "3": "r"}, "anchor_rule": {"anchor_role": "o"}, "match_rule": {"type": "smarts", "pattern": "[C:1][O:2][C:3]"}}
    view = {"fragment_id": "b", "fragment_name": "view", "category": "c", "match_rule": {"type": "derived_view"}}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([one, view]))
    loaded = fragments.load_rules(str(path))
    found = fragments.molecules(spark.createDataFrame([("COC",)], "smiles string"))
    got = {r.fragment_id: r.raw_matches for r in fragments.statistics(fragments.levels(found, loaded), spark, loaded).collect()}
    assert got["a"] > 0 and got["b"] == 0


def test_selection(spark):
    rows = spark.createDataFrame([("a", "x", 60, 1.0), ("b", "x", 60, 0.9), ("c", "x", 60, None), ("d", "x", 1, 1.0)], "fragment_id string, category string, records long, anchor double")
    got = {r.fragment_id: (r.accepted, r.status, r.threshold_count) for r in rules.selected(rows, 20000, anchor="anchor").collect()}
    assert got == {"a": (False, "rejected_low_frequency", 80)} | {k: (False, "rejected_low_frequency", 80) for k in "bcd"}
    got = {r.fragment_id: r.accepted for r in rules.selected(rows, 10000, anchor="anchor").collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}
    assert [r.accepted for r in rules.selected(rows.filter("fragment_id = 'd'"), 0).collect()] == [False]


def test_references_keep_missing_ones(spark):
    known = spark.createDataFrame([("FG_AMIDE", 1234, 0.25)], "fragment_id string, records long, ratio double")
    got = {r.fragment_id: r.refs for r in reports.references(spark, known).collect()}
    assert len(got) == 31 and got["fragment_001"] == ["FG_AMIDE 1,234/25.0%", "COMP_AROMATIC_AMIDE_N -", "COMP_AROMATIC_AMIDE_C -"] and got["fragment_010"] == []


def test_labels_and_summaries(spark):
    df = spark.createDataFrame([(None, None, None), (True, ["a", "b"], 3), (False, [], 4)], "b boolean, l array<string>, n int")
    got = df.select(*(reports.labelled(F.col(c), dict(df.dtypes)[c]).alias(c) for c in df.columns)).collect()
    assert [tuple(r) for r in got] == [("unknown",) * 3, ("true", "a,b", "3"), ("false", "none", "4")]
    assert tuple(reports.summary(df, "n").first()) == (3.5, 3.5, 4, {3: 1, 4: 1})
    assert tuple(reports.summary(df.limit(0), "n").first()) == (0.0, 0.0, 0, {})
    errors = spark.createDataFrame([("",), ("x",), ("",)], "errors string")
    assert tuple(reports.validation(errors).first()) == (3, 2, 1, pytest.approx(2 / 3))
    assert tuple(reports.validation(errors.limit(0)).first()) == (0, 0, 0, 0.0)
    assert tuple(reports.rolled_up(spark.createDataFrame([(3, 1, 256), (4, 0, 512)], "samples int, failures int, recommended int")).first()) == (7, 1, 512)
    assert spark.range(1).select(reports.doubled_backslashes(F.lit("a\\b")), reports.cell_json(F.array(F.lit("é"), F.lit('"')))).first()[:] == ("a\\\\b", '["é","\\""]')


def test_failures_of_streams(spark):
    a = spark.createDataFrame([("g", "r", "x")] * 3 + [("g", "r", "y")], "stage string, reason string, text string")
    b = spark.createDataFrame([("f", "z")], "stage string, text string")
    rows = {(r.stage, r.reason): (r.n, r.examples) for r in reports.failure_counts(reports.failures(a, b), "text", most=1).collect()}
    assert rows == {("g", "r"): (4, ["x"]), ("f", None): (1, ["z"])}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b|<", "rejected"), (None, "core")], "name string, status string")
    text = reports.write_json({"z": 1, "a": ["é"]}, str(tmp_path / "x.json"))
    assert text == '{\n  "a": [\n    "é"\n  ],\n  "z": 1\n}\n' == (tmp_path / "x.json").read_text(encoding="utf-8")
    assert "| b\\|< | rejected |" in reports.markdown("T", {"rules": rows})
    page = reports.page("T & U", {"rules": rows})
    assert "b|&lt;" in page and '<span class="badge warn">rejected</span>' in page and "T &amp; U" in page
    with pytest.raises(ValueError):
        reports.markdown("T", {"rules": rows}, most=1)


def test_boundaries_and_ownership(spark):
    cases = {(0,): "internal", (-1, 0): "cross_left", (0, 1): "cross_right", (-1, 0, 1): "cross_both", (1,): "multi_period", (0, 1, 2): "multi_period", (-2, 1): "cross_both"}
    df = spark.createDataFrame([(list(k), v) for k, v in cases.items()], "offsets array<int>, want string")
    assert df.filter(metrics.boundary(F.col("offsets")) != F.col("want")).count() == 0
    assert [r.anchor_offset for r in metrics.owned(spark.createDataFrame([(0,), (1,), (-1,)], "anchor_offset int")).collect()] == [0]


def test_nulls_and_empty_tables_have_figures(spark):
    from strandlake.operators import graphs, rules

    views = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "z"), ("b", "z")], "record string, key string")
    same = metrics.stability(views, views, "record", "key").first()
    assert (same.records, same.presence_consistency, same.key_jaccard, same.count_consistency, same.new_key_rate) == (3, 1.0, 1.0, 1.0, 0.0)
    other = metrics.stability(views, views.filter("record = 'a'"), "record", "key").first()
    assert other.records == 3 and other.presence_consistency == pytest.approx(1 / 3) and other.count_consistency == pytest.approx(1 / 3)
    rows = spark.createDataFrame([("a", None), ("b", "x"), ("b", None)], "record string, label string")
    assert {r.record: (r.x, r.y) for r in metrics.presence(rows, "record", "label", ["x", "y"]).collect()} == {"a": (0, 0), "b": (1, 0)}
    none = spark.createDataFrame([], "record_id long, fragment_id string")
    got = rules.coverage_summary(spark.createDataFrame([], "doc_id long"), none).first()
    assert (got.records, got.covered, got.type_total, got.median_types) == (0, 0, 0, 0.0)
    found = spark.createDataFrame([("s", "m", 2, 1)], "smiles string, motif string, atom_count int, occurrences long")
    assert graphs.mined(found, 0, 1).first().share == 0.0
