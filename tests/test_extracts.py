"""Extractors on hand-checked strings: attachment points at the group, charges, classes and the main chain."""

import pytest

from strandlake.operators import extracts, fragments
from strandlake.operators.core_rules import CORE, LADDERS

CASES = {
    "*C=C*": ("fragment_021", {"alkene_h_pattern": "H1-H1", "alkene_dummy_attachment_count": "2", "alkene_carbon_substituent_count": "0", "mainchain_through_alkene": "true"}),
    "*C#C*": ("fragment_022", {"alkyne_environment": "mainchain_ethynylene", "mainchain_through_alkyne": "true", "alkyne_terminal_signature": "*,*"}),
    "*C(=O)*": ("fragment_014", {"carbonyl_environment": "boundary_carbonyl", "carbonyl_dummy_attachment_count": "2", "carbonyl_hydrogen_count": "0"}),
    "*N*": ("fragment_023", {"secondary_amine_linker_environment": "boundary_secondary_amine_linker", "secondary_amine_dummy_attachment_count": "2"}),
    "*[Si](Cl)(c1ccccc1)*": ("fragment_030", {"silicon_environment": "boundary_silicon", "silicon_halogen_attachment_count": "1", "silicon_dummy_attachment_count": "2", "silicon_is_silyl_aryl_like": "true", "silicon_is_silyl_alkyl_like": "false"}),
    "*P(=S)(*)C": ("fragment_031", {"phosphorus_environment": "thiophosphoryl_like", "phosphorus_has_phosphoryl": "false", "phosphorus_dummy_attachment_count": "2"}),
    "*CC(N=C=S)C*": ("fragment_027", {"thiocarbonyl_environment": "isothiocyanate_like", "thiocarbonyl_is_isothiocyanate_like": "true", "thiocarbonyl_connected_atom_class": "nitrogen"}),
    "*CC(ON(C)C)C*": ("fragment_028", {"n_o_environment": "alkoxyamine_like", "n_o_bond_order": "single", "n_o_oxygen_class": "alkoxy_oxygen", "n_o_nitrogen_class": "neutral_nitrogen"}),
    "*C(F)(Cl)C*": ("fragment_025", {"halogenated_carbon_halogen_count": "2", "halogenated_carbon_fluorine_count": "1"}),
    "*CC(C=O)C*": ("fragment_014", {"carbonyl_environment": "aldehyde_or_formyl", "carbonyl_neighbor_signature": "C_aliphatic,H"}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(x,) for x in [*CASES, None, "?", "", "*CC*"]], "smiles string")
    return fragments.molecules(rows).cache()


def test_attributes(found):
    got = {}
    for r in extracts.extracted(found, CORE, LADDERS).collect():
        got.setdefault((r.smiles, r.fragment_id), {x.name: x.value for x in r.attributes})
    for smiles, (fragment, want) in CASES.items():
        assert want.items() <= got[smiles, fragment].items(), smiles
    assert not {None, "?", "", "*CC*"} & {s for s, _ in got}


def test_every_value_is_defined(found):
    assert extracts.values(extracts.extracted(found, CORE, LADDERS)).filter("value is null").count() == 0


def test_main_chain(spark):
    # ring with unequal sides: the shorter one; a side group; one point; points that nothing joins
    rows = spark.createDataFrame([(x,) for x in ["*C1CC(CCC1)*", "*CC(CO)C*", "*CC", "*C.C*"]], "smiles string")
    got = {r.smiles: r.main_chain for r in extracts.with_main_chain(fragments.molecules(rows)).select("smiles", "main_chain").collect()}
    assert got["*C1CC(CCC1)*"] == [True, True, True, True, False, False, False, True]
    assert got["*CC(CO)C*"] == [True, True, True, False, False, True, True]
    assert got["*CC"] is None and got["*C.C*"] is None


def test_empty_table(spark):
    none = fragments.molecules(spark.createDataFrame([], "smiles string"))
    assert extracts.distribution(extracts.extracted(none, CORE, LADDERS)).count() == 0


def _rule(constraints, anchor="carbon"):
    return fragments.Rule("x", "x", "functional_group", 10, "[#6:1]=[#8:2]", ("carbon", "oxygen"), anchor, roles=("carbon",), constraints=constraints)


@pytest.mark.parametrize(
    "constraints, fault",
    [
        ({"not_smarts_overlap_anchor": ["[#7][#6]"]}, None),
        ({"not_smarts_overlap_anchor": "[#7][#6]"}, "constraint_value:not_smarts_overlap_anchor"),
        ({"not_smarts_overlap_match": ["[#6"]}, "constraint_value:not_smarts_overlap_match"),
        ({"required_atom_count": {"F": "3"}}, "constraint_value:required_atom_count"),
        ({"forbid_atom_count_gt": {"F": True}}, "constraint_value:forbid_atom_count_gt"),
        ({"anchor_neighbor_must_not_be": ["Xx"]}, "constraint_value:anchor_neighbor_must_not_be"),
        ({"match_must_be_internal": 1}, "constraint_value:match_must_be_internal"),
        ({"must_be_nice": True}, "unknown_constraint"),
    ],
)
def test_constraint_registry(constraints, fault):
    assert [why for _, why in fragments.problems([_rule(constraints)])] == ([fault] if fault else [])
    if fault:
        with pytest.raises(ValueError):
            fragments._passes(_rule(constraints), "m")


def test_constraint_of_an_anchor_needs_one():
    assert ("x", "constraint_without_anchor") in fragments.problems([_rule({"not_smarts_overlap_anchor": ["[#7]"]}, None)])


def test_constraints_on_strings(spark):
    rows = fragments.molecules(spark.createDataFrame([("*C(=O)C(=O)N*",), ("*C=O",), (None,)], "smiles string"))
    n = lambda c: {r.smiles: len(r.normalized) for r in fragments.levels(rows, [_rule(c)]).collect()}
    assert n({}) == {"*C(=O)C(=O)N*": 2, "*C=O": 1}
    assert n({"not_smarts_overlap_anchor": ["[#7][#6]"]}) == {"*C(=O)C(=O)N*": 1, "*C=O": 1}
    assert n({"not_smarts_overlap_match": ["[#0][#6]"]}) == {"*C(=O)C(=O)N*": 1, "*C=O": 0}
    assert n({"anchor_neighbor_must_not_be": ["*", "N"]}) == {"*C(=O)C(=O)N*": 0, "*C=O": 0}
    assert n({"not_smarts_overlap_match": [], "anchor_neighbor_must_not_be": [], "match_must_be_internal": False}) == {"*C(=O)C(=O)N*": 2, "*C=O": 1}
