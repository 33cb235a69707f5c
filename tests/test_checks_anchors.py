"""Rule tables with each fault, roles of a match, examples, anchors of all kinds against hand-worked chains, rules that are not active."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import anchors, fragments, periodic, rule_checks
from strandlake.operators.anchors import Anchor

SCHEMA = (
    "fragment_id string, fragment_name string, version string, category string, semantic_tags array<string>, match_type string, pattern string, atom_roles map<string,string>, anchor_type string,"
    " anchor_role string, ownership_rule string, periodic_radius int, allow_boundary_crossing boolean, enable_cut_shift_scan boolean, max_cut_shift int, dedup_key_fields array<string>,"
    " exclusive_group string, priority int, allow_child_fragments boolean, parent_fragment_ids array<string>, problem string"
)
GOOD = {
    "fragment_id": "ok", "fragment_name": "n", "version": "1", "category": "c", "semantic_tags": [], "match_type": "smarts", "pattern": "[#6:1][OX2:2]", "atom_roles": {"1": "carbon", "2": "oxygen"}, "anchor_type": "atom",
    "anchor_role": "oxygen", "ownership_rule": "anchor_in_RU0", "periodic_radius": 1, "allow_boundary_crossing": True, "enable_cut_shift_scan": True, "max_cut_shift": 2, "dedup_key_fields": ["fragment_id"],
    "exclusive_group": "g", "priority": 1, "allow_child_fragments": True, "parent_fragment_ids": None, "problem": "clash",
}
BAD = {
    "unknown_match_type": {"match_type": "sql"}, "pattern_does_not_compile": {"pattern": "[#6:1"}, "map_ids_differ_from_roles": {"pattern": "[#6:1][OX2:3]"}, "anchor_role_not_in_roles": {"anchor_role": "sulfur"},
    "unknown_anchor_type": {"anchor_type": "angle"}, "unknown_ownership_rule": {"ownership_rule": "first"}, "periodic_radius_negative": {"periodic_radius": -1, "allow_boundary_crossing": False},
    "periodic_radius_too_large": {"periodic_radius": 3}, "boundary_crossing_requires_radius_ge_1": {"periodic_radius": 0}, "max_cut_shift_negative": {"max_cut_shift": -1},
    "unknown_dedup_key_field": {"dedup_key_fields": ["fragment_id", "colour"]}, "unknown_parent": {"parent_fragment_ids": ["ok", None, "nowhere"]}, "missing_field:pattern": {"pattern": None}, "missing_field:priority": {"priority": None},
    "missing_field:atom_roles": {"atom_roles": None}, "missing_field:dedup_key_fields": {"dedup_key_fields": None},
}


def table(spark, rows):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**GOOD, **r}[n] for n in names) for r in rows], SCHEMA)


def test_each_fault_alone(spark):
    rows = [{}, {"fragment_id": "child", "parent_fragment_ids": ["ok", "ok"]}, {"fragment_id": "self", "parent_fragment_ids": ["self"]}, {"fragment_id": "ring", "match_type": "rdkit_ring", "pattern": None, "atom_roles": None, "anchor_role": None}]
    rows += [{**change, "fragment_id": problem} for problem, change in BAD.items()] + [{"fragment_id": "twice"}, {"fragment_id": "twice"}, {"fragment_id": None}, {"fragment_id": None}]
    rules = table(spark, rows)
    got = sorted((r.fragment_id or "", r.problem) for r in rule_checks.faults(rules).collect())
    want = sorted([(p, p) for p in BAD] + [("self", "own_parent")] + [("twice", "duplicate_fragment_id")] * 2 + [("", "missing_field:fragment_id")] * 2)
    assert got == want
    assert sorted(r.fragment_id for r in rule_checks.valid(rules).collect()) == ["child", "ok", "ring"]
    shares = {r.problem: (r.rules, r.failures, r.valid_rate) for r in rule_checks.validity(rules).collect()}
    assert shares["any"] == (len(rows), len(rows) - 3, 3 / len(rows)) and shares["duplicate_fragment_id"][1] == 2 and shares["unknown_parent"][1] == 1


def test_no_rules(spark):
    none = table(spark, [])
    assert rule_checks.faults(none).count() == 0 and rule_checks.valid(none).count() == 0
    assert [tuple(r) for r in rule_checks.validity(none).collect()] == [("any", 0, 0, 0.0)]


def test_roles_of_a_match(spark):
    rows = spark.createDataFrame([({"2": "b", "1": "a", "3": "far"}, [7, 9]), ({"1": "x", "2": "x"}, [4, 5]), ({}, [1]), (None, [1])], "r map<string,string>, m array<int>")
    assert [r[0] for r in rows.select(rule_checks.roles_of(F.col("r"), F.col("m"))).collect()] == [{"a": 7, "b": 9}, {"x": 5}, {}, None]


R = fragments.Rule
ETHER = R("ether", "ether", "g", 1, "[#6:1][OX2:2][#6:3]", ("left", "oxygen", "right"), "oxygen")
DOUBLE = R("double", "double", "g", 1, "[#6:1]=[#6:2]", ("one", "two"), groups=(("one", "two"),))
SINGLE = R("single", "single", "g", 1, "[#6;!$(C=*):1]-[#6;!$(C=*):2]", ("one", "two"), groups=(("one", "two"),))
RING = R("ring", "ring", "g", 1, ring_size=6)
RULES = (ETHER, DOUBLE, SINGLE, RING)
ANCHORS = {"ether": Anchor("atom_set", ("left", "oxygen", "right")), "double": Anchor("bond", ("one", "two")), "single": Anchor("bond", ("one", "two")), "ring": Anchor("ring")}


def test_examples(spark):
    rows = [("ether", "*COC*", True), ("ether", "*COC*", False), ("ether", "*CC*", False), ("ether", "*CC*", True), ("ether", None, True), ("ether", "[R]", False), ("nothing", "*COC*", False), ("nothing", "*COC*", True), ("ether", "*CC*", True)]
    got = rule_checks.example_failures(spark.createDataFrame(rows, "fragment_id string, smiles string, expected boolean"), (ETHER,)).collect()
    assert sorted((r.fragment_id, r.smiles or "", r.expected, r.matches) for r in got) == [("ether", "", True, 0), ("ether", "*CC*", True, 0), ("ether", "*CC*", True, 0), ("ether", "*COC*", False, 1), ("nothing", "*COC*", True, 0)]


# unit: fragment -> number of anchors that the unit owns; a bond of the chain belongs to one unit even where a cut parts it
OWNED = {
    "*CCO*": {"ether": 1, "single": 1}, "*COC*": {"ether": 1, "single": 1}, "*OCC*": {"ether": 1, "single": 1}, "*C*": {"single": 1}, "*CC*": {"single": 2}, "*C=C*": {"double": 1}, "*=CC=*": {"double": 1},
    "*c1ccc(cc1)*": {"ring": 1}, "*CC(*)c1ccccc1": {"ring": 1}, "*OCCOCC*": {"ether": 2, "single": 2}, "*O*": {},
}


@pytest.fixture(scope="module")
def chains(spark):
    return periodic.chains(fragments.molecules(spark.createDataFrame([(s,) for s in [*OWNED, "*CC", "", None]], "smiles string"))).cache()


def test_every_anchor_has_one_owner(chains):
    rows = anchors.anchored(chains, RULES, ANCHORS)
    got = {}
    for r in anchors.owned(rows).collect():
        if r.fragment_id != "single" or "1" not in r.smiles:
            got.setdefault(r.smiles, {}).setdefault(r.fragment_id, []).append(r)
    assert {s: {f: len(x) for f, x in d.items()} for s, d in got.items()} == {s: d for s, d in OWNED.items() if d}
    one = got["*=CC=*"]["double"][0]
    assert len(one.anchor_atoms) == 2 and one.tied and one.boundary in ("cross_left", "cross_right")
    assert len(got["*c1ccc(cc1)*"]["ring"][0].anchor_atoms) == 6 and got["*c1ccc(cc1)*"]["ring"][0].boundary == "internal"
    # spellings and cuts of one chain have the same class, other surroundings another
    of = lambda s, f: {r.anchor_class for r in got[s][f]}
    assert of("*CCO*", "ether") == of("*COC*", "ether") == of("*OCC*", "ether") == of("*OCCOCC*", "ether")
    assert of("*C=C*", "double") == of("*=CC=*", "double") and of("*CC*", "single") == of("*C*", "single") != of("*CCO*", "single")
    assert of("*c1ccc(cc1)*", "ring") != of("*CC(*)c1ccccc1", "ring")
    # a wider expansion shows more and owns the same
    wide = anchors.owned(anchors.anchored(chains, RULES, ANCHORS, 2))
    assert sorted((r.smiles, r.anchor_key) for r in wide.collect()) == sorted((r.smiles, r.anchor_key) for r in anchors.owned(rows).collect())


def test_figures_and_cuts(spark, chains):
    rows = anchors.anchored(chains, RULES, {f: a for f, a in ANCHORS.items() if f != "ring"})
    got = {r.fragment_id: r for r in anchors.figures(rows).collect()}
    assert got["ring"].anchor_success == 0.0 and got["ring"].owned == 0 and got["ether"].anchor_success == 1.0 and got["ether"].anchor_conflict == 0.0
    assert got["double"].anchor_uniqueness == 0.0
    # an anchor of the carbon alone is shared by the ethers on its two sides
    both = R("both", "both", "g", 1, "[OX2:1][#6:2]", ("oxygen", "carbon"), roles=("oxygen", "carbon"))
    unit = periodic.chains(fragments.molecules(spark.createDataFrame([("*OC*",)], "smiles string")))
    assert anchors.figures(anchors.anchored(unit, (both,), {"both": Anchor("atom", ("carbon",))})).first().anchor_conflict == 1.0
    named = periodic.primitive(chains).select("smiles", "primitive_hash")
    stable = anchors.cut_stability(anchors.owned(rows).join(named, "smiles").filter("smiles in ('*CCO*', '*COC*', '*OCC*')"), "primitive_hash")
    assert sorted((r.fragment_id, r.chains, r.cut_shift_anchor_stability) for r in stable.collect()) == [("ether", 1, 1.0), ("single", 1, 1.0)]
    twice = anchors.cut_stability(anchors.owned(rows).join(named, "smiles").filter("smiles in ('*CCO*', '*OCCOCC*')"), "primitive_hash")
    assert {r.cut_shift_anchor_stability for r in twice.collect()} == {0.0}


def test_faults_of_anchors(chains):
    bad = {"ether": Anchor("bond", ("left",)), "double": Anchor("ring"), "ring": Anchor("atom", ("one",)), "single": Anchor("bond", ("one", "one")), "none": Anchor("atom", ("one",))}
    want = [("ether", "number_of_roles"), ("double", "ring_anchor_without_ring"), ("ring", "ring_without_ring_anchor"), ("single", "repeated_role"), ("none", "unknown_fragment")]
    assert anchors.problems(RULES, bad) == want
    assert anchors.problems(RULES, {"ether": Anchor("angle"), "double": Anchor("bond", ("one", "three"))}) == [("ether", "unknown_anchor_type"), ("double", "unknown_role")]
    with pytest.raises(ValueError, match="number_of_roles"):
        anchors.anchored(chains, RULES, bad)
    assert anchors.anchored(chains.limit(0), RULES, ANCHORS).count() == 0


def test_hits_of_inactive_rules(spark):
    nitrile = R("nitrile", "nitrile", "g", 1, "[CX2:1]#[NX1:2]", ("carbon", "nitrogen"), "carbon")
    inactive = tuple(R(r.fragment_id, r.name, r.category, r.priority, r.pattern, r.atom_roles, r.anchor, r.ring_size, roles=r.roles, groups=r.groups, status="rejected") for r in (ETHER, RING, DOUBLE))
    rows = spark.createDataFrame([("*CC*",), ("*COC*",), ("*CC(*)OC#N",), ("*c1ccc(cc1)OC*",), ("*C=COC*",), ("[R]",), (None,)], "smiles string")
    found = fragments.uncovered_hits(fragments.molecules(rows), (nitrile, *inactive))
    # the cyanate has the active rule, and an ether besides, so it is no uncovered record
    assert {r.smiles: r.hits for r in found.collect()} == {"*CC*": [], "*COC*": ["ether"], "*c1ccc(cc1)OC*": ["ether", "ring"], "*C=COC*": ["double", "ether"]}
    assert [tuple(r) for r in fragments.inactive_hits(found).collect()] == [("ether", 3), ("double", 1), ("ring", 1)]
    assert [tuple(r) for r in fragments.inactive_hits(found, 2).collect()] == [("ether", 3), ("double", 1)]
    assert fragments.uncovered_hits(fragments.molecules(rows.limit(0)), (nitrile, *inactive)).count() == 0


def test_ring_summary(spark):
    rows = spark.createDataFrame([("*c1ccc(cc1)Cc1ccc(*)cc1",), ("*C1CCC2CCCCC2C1*",), ("*CC*",)], "smiles string")
    got = {(r.key, r.label): (r.records, r.rings) for r in fragments.ring_summary(fragments.ring_attributes(fragments.molecules(rows))).collect()}
    assert got["record_count", "all"] == got["ring_count", "all"] == (2, 4)
    assert got["aromaticity", "fully_aromatic"] == got["ring_aromatic_atom_count", "6"] == (1, 2) and got["polycyclic", "true"] == got["polycyclic_connection_count", "2"] == (1, 2)
    assert len({k for k, _ in got}) == 18
    none = fragments.ring_summary(fragments.ring_attributes(fragments.molecules(rows.limit(0)))).collect()
    assert sorted(tuple(r) for r in none) == [("record_count", "all", 0, 0), ("ring_count", "all", 0, 0)]
