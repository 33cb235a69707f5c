"""Patterns, rules and periods on hand-checked strings."""

import random

import pytest

from strandlake.functions import chem, patterns
from strandlake.operators import fragments, graphs, periods
from strandlake.operators.core_rules import CORE, LADDERS
from strandlake.operators.seed_rules import SEED

CASES = {
    # string: fragment number -> (raw, normalized, resolved)
    "CC(=O)NC": {1: (1, 1, 1), 13: (2, 0, 0), 14: (1, 1, 0), 23: (1, 0, 0)},
    "CC(=O)OC": {3: (1, 1, 1), 14: (1, 1, 0)},
    "CC(=O)C": {14: (1, 1, 1)},
    "COC": {4: (1, 1, 1)},
    "*OCC*": {4: (1, 1, 1)},
    "*N1C(=O)c2ccccc2C1=O": {1: (2, 2, 0), 2: (1, 1, 1), 13: (3, 0, 0), 14: (2, 2, 0), 18: (1, 1, 1), 19: (1, 1, 1)},
    "CNC(=O)NC": {1: (2, 2, 0), 7: (1, 1, 1), 13: (4, 0, 0), 14: (1, 1, 0), 23: (2, 0, 0)},
    "CC(F)(F)F": {25: (3, 3, 0), 26: (1, 1, 1)},
    "CC(=O)O": {12: (1, 1, 0), 14: (1, 1, 0), 15: (1, 1, 1)},
    "CNC": {13: (2, 1, 0), 23: (1, 1, 1)},
    "*C#N": {11: (1, 1, 1)},
    "*C=C*": {21: (1, 1, 1)},
    "c1ccc(cc1)N=Nc1ccccc1": {19: (2, 2, 2), 24: (1, 1, 1)},
    "CS(=O)(=O)C": {9: (1, 1, 1)},
    "C[Si](C)(O*)*": {30: (1, 1, 1)},
    "C1CCC1": {16: (1, 1, 1)},
    "": {},
    "[R]C*": {},
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(s,) for s in [*CASES, None]], "smiles string")
    return fragments.molecules(rows).cache()


def test_levels(found):
    got = {}
    for r in fragments.levels(found, CORE).collect():
        n = tuple(len(r[c]) for c in ("raw", "normalized", "resolved"))
        if any(n):
            got.setdefault(r["smiles"], {})[int(r["fragment_id"][-3:])] = n
    assert got == {s: c for s, c in CASES.items() if c}


def test_environments(found):
    got = {(r["smiles"], int(r["fragment_id"][-3:])): (r["environment"], r["neighbour_signature"]) for r in fragments.attributes(found, CORE, LADDERS).collect()}
    want = {
        ("CC(=O)C", 14): ("ketone_like", "C_aliphatic,C_aliphatic"),
        ("COC", 4): ("dialkyl_ether", "C_aliphatic,C_aliphatic"),
        ("*OCC*", 4): ("boundary_alkyl_ether", "*,C_aliphatic"),
        ("CC(F)(F)F", 26): ("attached_to_aliphatic_carbon", "C_aliphatic,F,F,F"),
        ("CC(=O)O", 15): ("aliphatic_carboxylic_acid", "C_aliphatic,O,O"),
        ("CNC", 23): ("secondary_amine_linker", "C_aliphatic,C_aliphatic"),
        ("*C#N", 11): ("boundary_nitrile", "*,N"),
        ("*C=C*", 21): ("vinylene", "*,C_aliphatic"),
        ("c1ccc(cc1)N=Nc1ccccc1", 24): ("diaryl_azo", "C_aromatic,N"),
        ("CS(=O)(=O)C", 9): ("sulfone", "C_aliphatic,C_aliphatic,O,O"),
        ("C[Si](C)(O*)*", 30): ("boundary_silicon", "*,C_aliphatic,C_aliphatic,O"),
    }
    assert got == want


def test_rings(found):
    got = {(r["smiles"], r["ring_size"]): r for r in fragments.ring_attributes(found).collect()}
    five = got["*N1C(=O)c2ccccc2C1=O", 5]
    assert (five["hetero_atom_signature"], five["ring_aromaticity_class"], five["polycyclic"], five["attachment_count"]) == ("N", "partially_aromatic", True, 1)
    assert five["polycyclic_connection_topology"] == "1,2" and five["exocyclic_substituent_count"] == 3
    assert got["C1CCC1", 4]["external_connection_topology"] == "none"


def test_statistics_have_every_rule(spark, found):
    rows = fragments.levels(found, CORE)
    got = {r["fragment_id"]: r for r in fragments.statistics(rows, spark, CORE).collect()}
    assert len(got) == 31 and got["fragment_014"]["raw_matches"] == 7 and got["fragment_031"]["raw_records"] == 0
    assert [r[0] for r in fragments.uncovered(rows).collect()] == []
    assert fragments.levels(found.limit(0), CORE).count() == 0


@pytest.mark.parametrize("text", ["[NX3:1][CX3:2](=[OX1:3]", "", "C(", "[Qq]", "C1CC", "[#99]"])
def test_broken_patterns(text):
    with pytest.raises(ValueError):
        patterns.read(text)


def test_problems():
    R = fragments.Rule
    assert fragments.problems(CORE) == []
    bad = [R("a", "", "", 1, "[C:1]", ("x",), "y"), R("a", "", "", 1, "[C:1", ("x",), "x"), R("b", "", "", 1, "[C:1]", ("x",), "x", covered_by=(("z", ("x",)),), status="odd")]
    assert {why for _, why in fragments.problems(bad)} == {"duplicate_id", "anchor_not_in_roles", "pattern_does_not_compile", "unknown_covering_rule", "unknown_status"}


@pytest.mark.parametrize("text", ["*CC(=O)O*", "*C1C2CC(C1)C2*", "*c1ccc(-c2ccc(*)cc2)cc1", "*[N+](C)(C)C*", "c1cc[nH]c1", "C12C3C4C1C5C2C3C45"])
def test_written_reads_back(text):
    g = chem.parse(text)
    again = chem.parse(chem.written(g))
    assert chem.class_key(again) == chem.class_key(g) and chem.written(again) == chem.written(g)


def test_periods():
    row, windows, found = chem.periods(chem.parse("*CC(=O)O*"))
    assert (windows, found) == (5, ["*C(=O)CO*", "*CC(=O)O*", "*COC(=O)*"])
    assert chem.written(chem.parse("*CC(=O)OCC(=O)OCC(=O)O*")) == row
    for text in ("CC", "*C", "*(C)C*", "**"):
        with pytest.raises(ValueError):
            chem.periods(chem.parse(text))


def test_seed_rules(spark):
    want = {  # string: rules and raw matches that it must have
        "CC(=O)Nc1ccccc1": {"FG_AMIDE": 1, "COMP_AROMATIC_AMIDE_N": 1, "RING_AROMATIC_6": 1, "SUB_METHYL": 1, "FG_SECONDARY_AMINE": 1},
        "C1OC1C": {"FG_EPOXY": 1, "FG_ETHER": 1},
        "C[N+](=O)[O-]": {"FG_NITRO": 1},
        "c1ccc2ccccc2c1": {"RING_FUSED_AROMATIC_ATOM": 6, "RING_AROMATIC_6": 2},
        "C1CCCCC1": {"RING_CYCLOALIPHATIC_6": 1, "LINK_METHYLENE": 6, "LINK_ALKYL": 6},
        "CC(C)(C)C": {"SUB_TERT_BUTYL": 1, "SUB_METHYL": 4},
        "*c1ccc(*)cc1": {"LINK_PHENYLENE_PARA": 1},
    }
    assert len(SEED) == 70 and fragments.problems(SEED) == []
    found = fragments.levels(fragments.molecules(spark.createDataFrame([(s,) for s in want], "smiles string")), SEED)
    got = {(r["smiles"], r["fragment_id"]): len(r["raw"]) for r in found.collect()}
    assert {(s, f): got[s, f] for s, x in want.items() for f in x} == {(s, f): n for s, x in want.items() for f, n in x.items()}


def test_motifs(spark):
    found = graphs.environments(spark.createDataFrame([("*CCO*",), ("CO",), ("[R]",), (None,)], "smiles string"))
    got = {(r["smiles"], r["motif"]): (r["atom_count"], r["occurrences"]) for r in found.collect()}
    assert got["CO", "CO"] == (2, 2) and got["*CCO*", "*CCO"] == (4, 1) and got["*CCO*", "CCO"] == (3, 1)
    rows = graphs.mined(found, 2, support=1)
    assert graphs.clusters(rows).filter("atom_count = 2").first()["motif_count"] == sum(r["atom_count"] == 2 for r in rows.collect())


def test_period_tables(spark):
    rows = spark.createDataFrame([("*CC(=O)O*",), ("*OCC(=O)*",), ("*CC*",), ("*C",), (None,), (None,)], "smiles string")
    found = periods.expanded(rows)
    assert sorted((r["smiles"], r["source_smiles"], r["sources"]) for r in periods.deduplicated(periods.candidates(found)).collect()) == [
        ("*C(=O)CO*", "*CC(=O)O*", 2), ("*CC(=O)O*", "*CC(=O)O*", 2), ("*CC*", "*CC*", 1), ("*COC(=O)*", "*CC(=O)O*", 2)]
    assert periods.failures(found).count() == 2
    assert {r["periods"]: r["sources"] for r in periods.per_source(found).collect()} == {0: 2, 1: 1, 3: 2}
    levels = fragments.levels(fragments.molecules(rows.dropna()), CORE)
    kept = periods.deduplicated(periods.candidates(found))
    ester = fragments.audit(levels, fragments.levels(fragments.molecules(kept), CORE), kept, spark, CORE).filter("fragment_id = 'fragment_003'").first()
    assert (ester["unit_records"], ester["period_records"], ester["period_sources"]) == (1, 2, 1)


def test_rules_from_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text("""[{"fragment_id": "a", "fragment_name": "amide", "category": "x", "match_rule": {"type": "smarts", "pattern": "[NX3:1][CX3:2](=[O:3])"}, "atom_roles": {"1": "n", "2": "c", "3": "o"},
      "anchor_rule": {"anchor_role": "c"}, "overlap_policy": {"priority": 3}}, {"fragment_id": "b", "fragment_name": "carbonyl", "category": "x", "match_rule": {"pattern": "[C:1]=[O:2]"}, "atom_roles": {"1": "c", "2": "o"}, "anchor_rule": {"anchor_role": "c"},
      "overlap_policy": {"instance_suppression": {"mode": "drop_if_anchor_covered_by_higher_priority", "anchor_role": "c", "covering_fragments": [{"fragment_id": "a", "anchor_role": "c"}]}}}]""")
    rules = fragments.load_rules(str(path))
    got = {r["fragment_id"]: (len(r["normalized"]), len(r["resolved"])) for r in fragments.levels(fragments.molecules(spark.createDataFrame([("CC(=O)NCC(=O)C",)], "smiles string")), rules).collect()}
    assert got == {"a": (1, 1), "b": (2, 1)}
    path.write_text(path.read_text().replace("drop_if_anchor_covered", "odd"))
    with pytest.raises(ValueError):
        fragments.load_rules(str(path))


@pytest.mark.parametrize("text, distinct", [("*C(C(F)(F)F)(C(F)(F)F)C(C(F)(F)F)(C(F)(F)F)C(C(F)(F)F)O*", 4), ("*CC(" + "C(F)(F)" * 11 + "F)*", 1), ("*CC(c1ccccc1)(c1ccccc1)C(c1ccccc1)(c1ccccc1)C*", 3), ("*CC(C(=O)OC(C)(C)C)C(C(C)(C)C)C(C(C)(C)C)(C(C)(C)C)C*", 5)])
def test_symmetric_units(text, distinct):
    """Units of many equal groups have a spelling, a class and every period, whatever the order of their atoms."""
    g = chem.parse(text)
    row, _, found = chem.periods(g)
    assert row and len(found) == distinct
    assert all(chem.written(chem.parse(x)) == x for x in [row, *found])
    rng = random.Random(3)
    for _ in range(3):
        to = rng.sample(range(len(g[0])), len(g[0]))
        atoms = [a for _, a in sorted(zip(to, g[0]))]
        again = atoms, sorted((min(to[a], to[b]), max(to[a], to[b]), o) for a, b, o in g[1])
        assert chem.class_key(again) == chem.class_key(g) and chem.written(again) == chem.written(g)
