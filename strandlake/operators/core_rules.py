"""The core fragment rules and the environments of their matches, as data."""

from __future__ import annotations

from .fragments import Rule


def _rule(number, name, category, priority, pattern, atom_roles, anchor, **more) -> Rule:
    return Rule(f"fragment_{number:03d}", name, category, priority, pattern, tuple(atom_roles.split()), anchor, **more)


def _ring(number, name, category, priority, size, kind="any") -> Rule:
    return Rule(f"fragment_{number:03d}", name, category, priority, ring_size=size, ring_filter=kind)


def _by(*pairs):
    return tuple((f"fragment_{n:03d}", tuple(roles.split())) for n, roles in pairs)


_C = "carbonyl_carbon"
# fixed values: patterns, roles by map number, keys, constraints and covering rules
CORE = (
    _rule(1, "amide", "functional_group", 40, "[NX3:1][CX3:2](=[O:3])", "amide_nitrogen carbonyl_carbon carbonyl_oxygen", _C, roles=("amide_nitrogen", _C), core=("amide_nitrogen", _C, "carbonyl_oxygen"), covered_by=_by((2, "imide_nitrogen carbonyl_carbon_1 carbonyl_oxygen_1"), (2, "imide_nitrogen carbonyl_carbon_2 carbonyl_oxygen_2"), (6, "urethane_nitrogen carbonyl_carbon carbonyl_oxygen"), (7, "urea_nitrogen_left carbonyl_carbon carbonyl_oxygen"), (7, "urea_nitrogen_right carbonyl_carbon carbonyl_oxygen"))),
    _rule(2, "imide", "functional_group", 70, "[*:1][CX3:2](=[O:3])[NX3:4][CX3:5](=[O:6])[*:7]", "connected_atom_left carbonyl_carbon_1 carbonyl_oxygen_1 imide_nitrogen carbonyl_carbon_2 carbonyl_oxygen_2 connected_atom_right", "imide_nitrogen"),
    _rule(3, "ester", "functional_group", 50, "[*:1][CX3:2](=[O:3])[OX2:4][*:5]", "connected_atom_left carbonyl_carbon carbonyl_oxygen ester_oxygen connected_atom_right", _C, core=(_C,), covered_by=_by((5, _C), (6, _C))),
    _rule(4, "ether", "functional_group", 30, "[$([#6;!$(C=O)]),$([#0]):1][OX2:2][$([#6;!$(C=O)]),$([#0]):3]", "ether_neighbor_left ether_oxygen ether_neighbor_right", "ether_oxygen"),
    _rule(5, "carbonate", "functional_group", 70, "[*:1][OX2:2][CX3:3](=[O:4])[OX2:5][*:6]", "connected_atom_left alkoxy_oxygen_1 carbonyl_carbon carbonyl_oxygen alkoxy_oxygen_2 connected_atom_right", _C),
    _rule(6, "urethane", "functional_group", 70, "[OX2:1][CX3:2](=[O:3])[NX3:4]", "alkoxy_oxygen carbonyl_carbon carbonyl_oxygen urethane_nitrogen", _C, roles=(_C, "alkoxy_oxygen", "urethane_nitrogen")),
    _rule(7, "urea", "functional_group", 70, "[NX3:1][CX3:2](=[O:3])[NX3:4]", "urea_nitrogen_left carbonyl_carbon carbonyl_oxygen urea_nitrogen_right", _C, roles=(_C,), groups=(("urea_nitrogen_left", "urea_nitrogen_right"),)),
    _rule(8, "thioether", "functional_group", 50, "[$([#6;!$(C=O)]),$([#0]):1]-[SX2:2]-[$([#6;!$(C=O)]),$([#0]):3]", "thioether_neighbor_left thioether_sulfur thioether_neighbor_right", "thioether_sulfur", roles=("thioether_sulfur",)),
    _rule(9, "sulfonyl_group", "functional_group", 80, "[*:1][SX4:2](=[O:3])(=[O:4])[*:5]", "connected_atom_left sulfonyl_sulfur sulfonyl_oxygen_1 sulfonyl_oxygen_2 connected_atom_right", "sulfonyl_sulfur"),
    _rule(10, "sulfinyl_group", "functional_group", 70, "[*:1][SX3:2](=[O:3])[*:4]", "connected_atom_left sulfinyl_sulfur sulfinyl_oxygen connected_atom_right", "sulfinyl_sulfur"),
    _rule(11, "nitrile", "functional_group", 50, "[*:1][CX2:2]#[NX1:3]", "connected_atom_left nitrile_carbon nitrile_nitrogen", "nitrile_carbon"),
    _rule(12, "hydroxyl", "functional_group", 30, "[*:1][OH:2]", "attached_atom hydroxyl_oxygen", "hydroxyl_oxygen", core=("hydroxyl_oxygen",), covered_by=_by((15, "hydroxyl_oxygen"))),
    _rule(13, "amine", "functional_group", 35, "[*:1][NX3:2]", "attached_atom amine_nitrogen", "amine_nitrogen", roles=("amine_nitrogen",), core=("amine_nitrogen",), covered_by=_by((23, "secondary_nitrogen")),
          constraints={"exclude_atom_role_adjacent_to_carbonyl": "amine_nitrogen", "exclude_atom_role_adjacent_to_sulfonyl": "amine_nitrogen", "exclude_atom_role_with_oxygen_neighbor": "amine_nitrogen"}),
    _rule(14, "carbonyl", "functional_group", 20, "[C:1](=[O:2])", "carbonyl_carbon carbonyl_oxygen", _C, roles=(_C,), core=(_C,), covered_by=_by((1, _C), (2, "carbonyl_carbon_1"), (2, "carbonyl_carbon_2"), (3, _C), (5, _C), (6, _C), (7, _C), (15, _C))),
    _rule(15, "carboxylic_acid", "functional_group", 75, "[*:1][C:2](=[O:3])[OH:4]", "connected_atom carbonyl_carbon carbonyl_oxygen hydroxyl_oxygen", _C, roles=(_C,)),
    _ring(16, "four_membered_ring", "ring_structure", 60, 4),
    _ring(17, "five_membered_aromatic_ring", "aromatic_ring", 50, 5, "aromatic"),
    _ring(18, "five_membered_not_fully_aromatic_ring", "ring_structure", 50, 5, "nonaromatic"),
    _ring(19, "six_membered_aromatic_ring", "aromatic_ring", 50, 6, "aromatic"),
    _ring(20, "six_membered_not_fully_aromatic_ring", "ring_structure", 50, 6, "nonaromatic"),
    _rule(21, "alkenylene_linkage", "mainchain_linker", 50, "[*:1][CX3:2]=!@[CX3:3][*:4]", "alkenylene_terminal_left alkene_carbon_1 alkene_carbon_2 alkenylene_terminal_right", "alkene_carbon_1", groups=(("alkene_carbon_1", "alkene_carbon_2"),)),
    _rule(22, "alkynylene_linkage", "mainchain_linker", 50, "[*:1][CX2:2]#[CX2:3][*:4]", "alkynylene_terminal_left alkyne_carbon_1 alkyne_carbon_2 alkynylene_terminal_right", "alkyne_carbon_1", groups=(("alkyne_carbon_1", "alkyne_carbon_2"),)),
    _rule(23, "secondary_amine_linker", "linker", 60, "[*:1][NH:2][*:3]", "left_attachment secondary_nitrogen right_attachment", "secondary_nitrogen", roles=("secondary_nitrogen",), constraints={"exclude_atom_role_adjacent_to_carbonyl": "secondary_nitrogen", "exclude_atom_role_adjacent_to_sulfonyl": "secondary_nitrogen"}),
    _rule(24, "azo_linker", "linker", 50, "[*:1][N:2]=[N:3][*:4]", "left_attachment azo_nitrogen_1 azo_nitrogen_2 right_attachment", "azo_nitrogen_1"),
    _rule(25, "halogen_substituent", "side_group", 40, "[#6:1]-[F,Cl,Br,I:2]", "substituted_carbon halogen_atom", "halogen_atom", roles=("substituted_carbon", "halogen_atom"), core=("substituted_carbon", "halogen_atom"), covered_by=_by(*((26, f"trifluoromethyl_carbon fluorine_atom_{i}") for i in (1, 2, 3)))),
    _rule(26, "trifluoromethyl", "side_group", 80, "[*:1][C:2]([F:3])([F:4])[F:5]", "connected_atom trifluoromethyl_carbon fluorine_atom_1 fluorine_atom_2 fluorine_atom_3", "trifluoromethyl_carbon", roles=("trifluoromethyl_carbon",), constraints={"exact_fluorine_count": 3}),
    _rule(27, "thiocarbonyl_group", "functional_group", 65, "[#6:1]=[S:2]", "thiocarbonyl_carbon thiocarbonyl_sulfur", "thiocarbonyl_carbon", roles=("thiocarbonyl_carbon",)),
    _rule(28, "nitrogen_oxygen_bond_motif", "functional_group", 55, "[N:1]~[O:2]", "nitrogen_atom oxygen_atom", "nitrogen_atom", groups=(("nitrogen_atom", "oxygen_atom"),)),
    _rule(29, "sulfanyl_or_thiol_group", "functional_group", 35, "[*:1][SX2H1:2]", "attached_atom sulfanyl_sulfur", "sulfanyl_sulfur", roles=("sulfanyl_sulfur",)),
    _rule(30, "silicon_center", "inorganic_or_organometallic", 60, "[Si:1]", "silicon_atom", "silicon_atom", roles=("silicon_atom",)),
    _rule(31, "phosphorus_center", "inorganic_or_organometallic", 60, "[P:1]", "phosphorus_atom", "phosphorus_atom", roles=("phosphorus_atom",)),
)


def _ladder(role, *steps):
    return tuple((label, role, test) for label, test in steps)


def _two_carbons(role, name):
    return _ladder(role, (f"boundary_{name}", "$(*(~[#0])~[#0])"), (f"boundary_aryl_{name}", "$(*(~[#0])~[#6;a])"), (f"boundary_alkyl_{name}", "$(*(~[#0])~[#6;A])"), (f"boundary_{name}", "$(*~[#0])"), (f"diaryl_{name}", "$(*(~[#6;a])~[#6;a])"), (f"aryl_alkyl_{name}", "$(*~[#6;a])"), (f"dialkyl_{name}", "*"))


# fixed values: environments in the order they are tried
LADDERS = {
    "fragment_004": _two_carbons("ether_oxygen", "ether"),
    "fragment_008": _two_carbons("thioether_sulfur", "thioether"),
    "fragment_009": _ladder("sulfonyl_sulfur", ("sulfone", "D4;$(*(~[#6])(~[#6])(=[#8])=[#8])"), ("sulfonate_like", "$(*-[#8])"), ("sulfonamide_like", "$(*~[#7])"), ("sulfonyl_halide_like", "$(*~[F,Cl,Br,I])"), ("boundary_sulfonyl", "$(*~[#0])"), ("other_sulfonyl", "*")),
    "fragment_010": _ladder("sulfinyl_sulfur", ("boundary_sulfinyl", "$(*~[#0])"), ("sulfoxide", "D3;$(*(~[#6])(~[#6])=[#8])"), ("other_sulfinyl", "*")),
    "fragment_011": _ladder("nitrile_carbon", ("terminal_nitrile_unknown", "D1"), ("boundary_nitrile", "$(*~[#0])"), ("aromatic_nitrile", "$(*~[#6;a])"), ("aliphatic_nitrile", "$(*~[#6])"), ("heteroatom_attached_nitrile", "*")),
    "fragment_012": _ladder("attached_atom", ("phenolic_hydroxyl", "#6;a"), ("aliphatic_alcohol", "#6"), ("sulfur_oxoacid_hydroxyl", "#16"), ("phosphorus_oxoacid_hydroxyl", "#15"), ("nitrogen_hydroxyl", "#7"), ("silanol_like", "#14"), ("other_heteroatom_hydroxyl", "*")),
    "fragment_013": _ladder("amine_nitrogen", ("primary_ring", "H2,H3,D0,D1;R"), ("primary_nonring", "H2,H3,D0,D1"), ("secondary_ring", "H1;R"), ("secondary_nonring", "H1"), ("tertiary_ring", "R"), ("tertiary_nonring", "*")),
    "fragment_014": _ladder(_C, ("aldehyde_or_formyl", "!H0"), ("boundary_carbonyl", "$(*~[#0])"), ("acyl_heteroatom_residual", "$(*~[!#6;!#0;!#8]),$(*-[#8])"), ("ketone_like", "D3"), ("other_residual", "*")),
    "fragment_015": _ladder("connected_atom", ("boundary_carboxylic_acid", "#0"), ("aromatic_carboxylic_acid", "#6;a"), ("aliphatic_carboxylic_acid", "#6"), ("heteroatom_attached_carboxylic_acid", "*")),
    "fragment_021": _ladder("alkene_carbon_1", ("vinylene", "H2,$(*=!@[H2]),$([!H0]=!@[!H0])"), ("substituted_alkenylene", "!H0,$(*=!@[!H0])"), ("fully_substituted_alkenylene", "*")),
    "fragment_022": _ladder("alkyne_carbon_1", ("mainchain_ethynylene", "$([#6](~[#0])#[#6]~[#0])"), ("diaryl_ethynylene", "$([#6](~[#6;a])#[#6]~[#6;a])"), ("aryl_alkyl_ethynylene", "$([#6]~[#6;a]),$([#6]#[#6]~[#6;a])"), ("alkynylene_other", "*")),
    "fragment_023": _ladder("secondary_nitrogen", ("boundary_secondary_amine_linker", "$(*(~[#0])~[#0])"), ("ring_secondary_amine", "R"), ("secondary_amine_linker", "*")),
    "fragment_024": _ladder("azo_nitrogen_1", ("diaryl_azo", "$([#7](~[#6;a])=[#7]~[#6;a])"), ("boundary_azo", "$([#7]~[#0]),$([#7]=[#7]~[#0])"), ("non_diaryl_azo", "*")),
    "fragment_025": _ladder("halogen_atom", *((f"{x}_on_{kind}", f"{x};$(*-[#6;{test}])") for x in ("F", "Cl", "Br", "I") for kind, test in (("aromatic_carbon", "a"), ("aliphatic_carbon", "A")))),
    "fragment_026": _ladder("connected_atom", ("attached_to_boundary", "#0"), ("attached_to_aromatic_carbon", "#6;a"), ("attached_to_aliphatic_carbon", "#6"), ("attached_to_oxygen", "#8"), ("attached_to_nitrogen", "#7"), ("attached_to_sulfur", "#16"), ("attached_to_other_heteroatom", "*")),
    "fragment_027": _ladder("thiocarbonyl_carbon", ("isothiocyanate_like", "$(*=[#7])"), ("thiourea_like", "$(*(-[#7])-[#7])"), ("thioamide_like", "$(*-[#7])"), ("boundary_thiocarbonyl", "$(*~[#0])"), ("aryl_thiocarbonyl", "$(*~[#6;a])"), ("aliphatic_thiocarbonyl", "$(*~[#6])"), ("other_thiocarbonyl", "*")),
    "fragment_028": (("nitro_like", "nitrogen_atom", "+;$(*(~[#8])~[#8]);$(*=[#8])"), ("oxime_like", "oxygen_atom", "$(*-[#7]=[#6])"), ("hydroxylamine_like", "oxygen_atom", "!H0;$(*-[#7])"), ("alkoxyamine_like", "oxygen_atom", "$(*(-[#7])~[#6])"), ("aromatic_n_o", "nitrogen_atom", "a"), ("other_n_o", "nitrogen_atom", "*")),
    "fragment_029": _ladder("attached_atom", ("boundary_sulfanyl", "#0"), ("aromatic_sulfanyl", "#6;a"), ("aliphatic_sulfanyl", "#6"), ("heteroatom_sulfanyl", "*")),
    "fragment_030": _ladder("silicon_atom", ("boundary_silicon", "$(*~[#0])"), ("siloxane_like", "$(*~[#8]~[Si])"), ("halosilane_like", "$(*~[F,Cl,Br,I])"), ("siloxy_silicon", "$(*~[#8])"), ("aryl_silyl", "$(*~[#6;a])"), ("alkyl_silyl", "$(*~[#6])"), ("other_silicon", "*")),
    "fragment_031": _ladder("phosphorus_atom", ("phosphazene_like", "$(*=[#7])"), ("phosphate_like", "$(*(=[#8])(~[#8])~[#8])"), ("phosphoryl_like", "$(*=[#8])"), ("thiophosphoryl_like", "$(*=[#16])"), ("boundary_phosphorus", "$(*~[#0])"), ("organophosphorus", "$(*~[#6])"), ("other_phosphorus", "*")),
}
