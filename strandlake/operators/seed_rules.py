"""The seed rules of the general vocabulary, as data; their coverage decides which are accepted."""

from __future__ import annotations

from .fragments import Rule

# fixed values: id, name, category, pattern, roles by map number, anchor, parent, exclusive group, priority
_ROWS = (
    ("FG_CARBONYL", "carbonyl", "functional_group", "[CX3:1]=[OX1:2]", "carbonyl_carbon carbonyl_oxygen", "carbonyl_carbon", "", "carbonyl_family", 40),
    ("FG_AMIDE", "amide", "functional_group", "[NX3:1][CX3:2](=[OX1:3])", "amide_nitrogen carbonyl_carbon carbonyl_oxygen", "carbonyl_carbon", "FG_CARBONYL", "carbonyl_family", 80),
    ("FG_IMIDE", "imide", "functional_group", "[NX3:1]([CX3:2](=[OX1:3]))[CX3:4](=[OX1:5])", "imide_nitrogen carbonyl_carbon_a carbonyl_oxygen_a carbonyl_carbon_b carbonyl_oxygen_b", "imide_nitrogen", "FG_AMIDE", "carbonyl_family", 95),
    ("FG_ESTER", "ester", "functional_group", "[CX3:1](=[OX1:2])[OX2:3]", "carbonyl_carbon carbonyl_oxygen ester_oxygen", "carbonyl_carbon", "FG_CARBONYL", "carbonyl_family", 75),
    ("FG_CARBONATE", "carbonate", "functional_group", "[OX2:1][CX3:2](=[OX1:3])[OX2:4]", "alkoxy_oxygen_a carbonyl_carbon carbonyl_oxygen alkoxy_oxygen_b", "carbonyl_carbon", "FG_ESTER", "carbonyl_family", 90),
    ("FG_URETHANE", "urethane", "functional_group", "[NX3:1][CX3:2](=[OX1:3])[OX2:4]", "urethane_nitrogen carbonyl_carbon carbonyl_oxygen alkoxy_oxygen", "carbonyl_carbon", "FG_AMIDE", "carbonyl_family", 90),
    ("FG_UREA", "urea", "functional_group", "[NX3:1][CX3:2](=[OX1:3])[NX3:4]", "urea_nitrogen_a carbonyl_carbon carbonyl_oxygen urea_nitrogen_b", "carbonyl_carbon", "FG_AMIDE", "carbonyl_family", 90),
    ("FG_KETONE", "ketone", "functional_group", "[#6:1][CX3:2](=[OX1:3])[#6:4]", "carbon_substituent_a carbonyl_carbon carbonyl_oxygen carbon_substituent_b", "carbonyl_carbon", "FG_CARBONYL", "carbonyl_family", 70),
    ("FG_ALDEHYDE", "aldehyde", "functional_group", "[CX3H1:1](=[OX1:2])[#6:3]", "aldehyde_carbon carbonyl_oxygen carbon_substituent", "aldehyde_carbon", "FG_CARBONYL", "carbonyl_family", 70),
    ("FG_CARBOXYLIC_ACID", "carboxylic_acid", "functional_group", "[CX3:1](=[OX1:2])[OX2H1:3]", "carbonyl_carbon carbonyl_oxygen acid_oxygen", "carbonyl_carbon", "FG_CARBONYL", "carbonyl_family", 80),
    ("FG_CARBOXYLATE", "carboxylate", "functional_group", "[CX3:1](=[OX1:2])[O-:3]", "carbonyl_carbon carbonyl_oxygen anionic_oxygen", "carbonyl_carbon", "FG_CARBONYL", "ionic_family", 85),
    ("FG_ANHYDRIDE", "anhydride", "functional_group", "[CX3:1](=[OX1:2])[OX2:3][CX3:4](=[OX1:5])", "carbonyl_carbon_a carbonyl_oxygen_a bridging_oxygen carbonyl_carbon_b carbonyl_oxygen_b", "bridging_oxygen", "FG_ESTER", "carbonyl_family", 90),
    ("FG_THIOCARBONYL", "thiocarbonyl", "functional_group", "[CX3:1]=[SX1:2]", "thiocarbonyl_carbon thiocarbonyl_sulfur", "thiocarbonyl_carbon", "", "carbonyl_family", 65),
    ("FG_ETHER", "ether", "functional_group", "[OD2:1]([#6:2])[#6:3]", "ether_oxygen carbon_substituent_a carbon_substituent_b", "ether_oxygen", "", "oxygen_linkage_family", 55),
    ("FG_AROMATIC_ETHER", "aromatic_ether", "functional_group", "[c:1][OX2:2][c:3]", "aryl_carbon_a ether_oxygen aryl_carbon_b", "ether_oxygen", "FG_ETHER", "oxygen_linkage_family", 75),
    ("FG_THIOETHER", "thioether", "functional_group", "[SX2:1]([#6:2])[#6:3]", "thioether_sulfur carbon_substituent_a carbon_substituent_b", "thioether_sulfur", "", "sulfur_family", 60),
    ("FG_SULFONE", "sulfone", "functional_group", "[SX4:1](=[OX1:2])(=[OX1:3])([#6:4])[#6:5]", "sulfone_sulfur sulfone_oxygen_a sulfone_oxygen_b carbon_substituent_a carbon_substituent_b", "sulfone_sulfur", "", "sulfur_family", 90),
    ("FG_SULFOXIDE", "sulfoxide", "functional_group", "[SX3:1](=[OX1:2])([#6:3])[#6:4]", "sulfoxide_sulfur sulfoxide_oxygen carbon_substituent_a carbon_substituent_b", "sulfoxide_sulfur", "", "sulfur_family", 80),
    ("FG_SULFONATE", "sulfonate", "functional_group", "[SX4:1](=[OX1:2])(=[OX1:3])[O-:4]", "sulfonate_sulfur sulfonyl_oxygen_a sulfonyl_oxygen_b anionic_oxygen", "sulfonate_sulfur", "", "ionic_family", 90),
    ("FG_NITRILE", "nitrile", "functional_group", "[CX2:1]#[NX1:2]", "nitrile_carbon nitrile_nitrogen", "nitrile_carbon", "", "nitrogen_family", 70),
    ("FG_HYDROXYL", "hydroxyl", "functional_group", "[OX2H:1]", "hydroxyl_oxygen", "hydroxyl_oxygen", "", "oxygen_linkage_family", 60),
    ("FG_PRIMARY_AMINE", "primary_amine", "functional_group", "[NX3H2:1][#6:2]", "amine_nitrogen carbon_substituent", "amine_nitrogen", "", "nitrogen_family", 60),
    ("FG_SECONDARY_AMINE", "secondary_amine", "functional_group", "[NX3H1:1]([#6:2])[#6:3]", "amine_nitrogen carbon_substituent_a carbon_substituent_b", "amine_nitrogen", "", "nitrogen_family", 60),
    ("FG_TERTIARY_AMINE", "tertiary_amine", "functional_group", "[NX3H0:1]([#6:2])([#6:3])[#6:4]", "amine_nitrogen carbon_substituent_a carbon_substituent_b carbon_substituent_c", "amine_nitrogen", "", "nitrogen_family", 60),
    ("FG_QUATERNARY_AMMONIUM", "quaternary_ammonium", "functional_group", "[NX4+:1]([#6:2])([#6:3])([#6:4])[#6:5]", "ammonium_nitrogen carbon_substituent_a carbon_substituent_b carbon_substituent_c carbon_substituent_d", "ammonium_nitrogen", "", "ionic_family", 90),
    ("FG_NITRO", "nitro", "functional_group", "[NX3+:1](=[OX1:2])[O-:3]", "nitro_nitrogen nitro_oxygen_neutral nitro_oxygen_anion", "nitro_nitrogen", "", "nitrogen_family", 80),
    ("FG_AZO", "azo", "functional_group", "[NX2:1]=[NX2:2]", "azo_nitrogen_a azo_nitrogen_b", "azo_nitrogen_a", "", "nitrogen_family", 75),
    ("FG_ISOCYANATE", "isocyanate", "functional_group", "[NX2:1]=[CX2:2]=[OX1:3]", "isocyanate_nitrogen isocyanate_carbon isocyanate_oxygen", "isocyanate_carbon", "", "carbonyl_family", 75),
    ("FG_EPOXY", "epoxy", "functional_group", "[OX2r3:1]1[CX4r3:2][CX4r3:3]1", "epoxy_oxygen epoxy_carbon_a epoxy_carbon_b", "epoxy_oxygen", "", "oxygen_linkage_family", 80),
    ("FG_ACETAL", "acetal", "functional_group", "[CX4:1]([OX2:2])([OX2:3])([#6:4])[#6:5]", "acetal_carbon oxygen_a oxygen_b carbon_substituent_a carbon_substituent_b", "acetal_carbon", "", "oxygen_linkage_family", 70),
    ("FG_SILOXANE", "siloxane", "functional_group", "[Si:1][OX2:2][Si:3]", "silicon_a siloxane_oxygen silicon_b", "siloxane_oxygen", "", "silicon_family", 90),
    ("FG_SILANE", "silane", "functional_group", "[Si:1]([#6:2])([#6:3])[#6:4]", "silicon carbon_substituent_a carbon_substituent_b carbon_substituent_c", "silicon", "", "silicon_family", 70),
    ("FG_PHOSPHAZENE", "phosphazene", "functional_group", "[P:1]=[N:2]", "phosphorus phosphazene_nitrogen", "phosphorus", "", "phosphorus_family", 90),
    ("FG_PHOSPHATE", "phosphate", "functional_group", "[PX4:1](=[OX1:2])([OX2:3])([OX2:4])[OX2:5]", "phosphorus phosphoryl_oxygen oxygen_a oxygen_b oxygen_c", "phosphorus", "", "phosphorus_family", 80),
    ("SUB_HALOGEN", "halogen_substituent", "side_group", "[F,Cl,Br,I:1][#6:2]", "halogen attached_carbon", "halogen", "", "halogen_family", 40),
    ("SUB_FLUORO", "fluoro_substituent", "side_group", "[F:1][#6:2]", "fluorine attached_carbon", "fluorine", "SUB_HALOGEN", "halogen_family", 60),
    ("SUB_CHLORO", "chloro_substituent", "side_group", "[Cl:1][#6:2]", "chlorine attached_carbon", "chlorine", "SUB_HALOGEN", "halogen_family", 60),
    ("SUB_BROMO", "bromo_substituent", "side_group", "[Br:1][#6:2]", "bromine attached_carbon", "bromine", "SUB_HALOGEN", "halogen_family", 60),
    ("SUB_TRIFLUOROMETHYL", "trifluoromethyl", "side_group", "[CX4:1]([F:2])([F:3])([F:4])[#6:5]", "cf3_carbon fluorine_a fluorine_b fluorine_c attached_carbon", "cf3_carbon", "SUB_FLUORO", "halogen_family", 85),
    ("SUB_METHYL", "methyl", "side_group", "[CH3:1][#6:2]", "methyl_carbon attached_carbon", "methyl_carbon", "", "alkyl_side_group_family", 45),
    ("SUB_ETHYL", "ethyl", "side_group", "[CH3:1][CH2:2][#6:3]", "terminal_methyl methylene attached_carbon", "methylene", "SUB_METHYL", "alkyl_side_group_family", 55),
    ("SUB_ISOPROPYL", "isopropyl", "side_group", "[CH:1]([CH3:2])([CH3:3])[#6:4]", "branch_carbon methyl_a methyl_b attached_carbon", "branch_carbon", "", "alkyl_side_group_family", 60),
    ("SUB_TERT_BUTYL", "tert_butyl", "side_group", "[C:1]([CH3:2])([CH3:3])([CH3:4])[#6:5]", "quaternary_carbon methyl_a methyl_b methyl_c attached_carbon", "quaternary_carbon", "", "alkyl_side_group_family", 65),
    ("SUB_ALKOXY", "alkoxy_side_group", "side_group", "[OX2:1][CX4:2]", "alkoxy_oxygen alkyl_carbon", "alkoxy_oxygen", "FG_ETHER", "oxygen_linkage_family", 55),
    ("RING_AROMATIC_6", "aromatic_six_member_ring", "ring_structure", "[c:1]1[c:2][c:3][c:4][c:5][c:6]1", "aromatic_atom_1 aromatic_atom_2 aromatic_atom_3 aromatic_atom_4 aromatic_atom_5 aromatic_atom_6", "aromatic_atom_1", "", "ring_family", 50),
    ("RING_HETEROAROMATIC_5", "heteroaromatic_five_member_ring", "ring_structure", "[a:1]1[a:2][a:3][a:4][n,o,s:5]1", "aromatic_atom_1 aromatic_atom_2 aromatic_atom_3 aromatic_atom_4 heteroaromatic_atom", "heteroaromatic_atom", "", "ring_family", 70),
    ("RING_HETEROAROMATIC_6", "heteroaromatic_six_member_ring", "ring_structure", "[a:1]1[a:2][a:3][a:4][a:5][n,o,s:6]1", "aromatic_atom_1 aromatic_atom_2 aromatic_atom_3 aromatic_atom_4 aromatic_atom_5 heteroaromatic_atom", "heteroaromatic_atom", "", "ring_family", 70),
    ("RING_FUSED_AROMATIC_ATOM", "fused_aromatic_ring_atom", "ring_structure", "[cR2:1]([c:2])[c:3]", "fused_aromatic_atom neighbor_aromatic_atom_a neighbor_aromatic_atom_b", "fused_aromatic_atom", "", "ring_family", 65),
    ("RING_CYCLOALIPHATIC_5", "cycloaliphatic_five_member_ring", "ring_structure", "[CX4R:1]1[CX4R:2][CX4R:3][CX4R:4][CX4R:5]1", "ring_carbon_1 ring_carbon_2 ring_carbon_3 ring_carbon_4 ring_carbon_5", "ring_carbon_1", "", "ring_family", 55),
    ("RING_CYCLOALIPHATIC_6", "cycloaliphatic_six_member_ring", "ring_structure", "[CX4R:1]1[CX4R:2][CX4R:3][CX4R:4][CX4R:5][CX4R:6]1", "ring_carbon_1 ring_carbon_2 ring_carbon_3 ring_carbon_4 ring_carbon_5 ring_carbon_6", "ring_carbon_1", "", "ring_family", 55),
    ("RING_IMIDE", "imide_ring", "ring_structure", "[NX3r:1]([CX3r:2](=[OX1:3]))[CX3r:4](=[OX1:5])", "imide_ring_nitrogen carbonyl_carbon_a carbonyl_oxygen_a carbonyl_carbon_b carbonyl_oxygen_b", "imide_ring_nitrogen", "FG_IMIDE", "carbonyl_family", 100),
    ("RING_LACTONE", "lactone_ring", "ring_structure", "[OX2r:1][CX3r:2](=[OX1:3])", "ring_ester_oxygen ring_carbonyl_carbon carbonyl_oxygen", "ring_carbonyl_carbon", "FG_ESTER", "carbonyl_family", 85),
    ("RING_LACTAM", "lactam_ring", "ring_structure", "[NX3r:1][CX3r:2](=[OX1:3])", "ring_amide_nitrogen ring_carbonyl_carbon carbonyl_oxygen", "ring_carbonyl_carbon", "FG_AMIDE", "carbonyl_family", 85),
    ("LINK_ALKYL", "alkyl_linker", "mainchain_linker", "[CX4:1]-[CX4:2]", "alkyl_carbon_a alkyl_carbon_b", "alkyl_carbon_a", "", "mainchain_linker_family", 35),
    ("LINK_METHYLENE", "methylene_linker", "mainchain_linker", "[CH2:1]", "methylene_carbon", "methylene_carbon", "", "mainchain_linker_family", 30),
    ("LINK_VINYLENE", "vinylene_linker", "mainchain_linker", "[#6:1]=[#6:2]", "alkene_carbon_a alkene_carbon_b", "alkene_carbon_a", "", "mainchain_linker_family", 55),
    ("LINK_ETHYNYLENE", "ethynylene_linker", "mainchain_linker", "[#6:1]#[#6:2]", "alkyne_carbon_a alkyne_carbon_b", "alkyne_carbon_a", "", "mainchain_linker_family", 60),
    ("LINK_PHENYLENE_PARA", "para_phenylene_linkage", "mainchain_linker", "[c:1]1[cH:2][cH:3][c:4][cH:5][cH:6]1", "aryl_connection_a aryl_h_atom_2 aryl_h_atom_3 aryl_connection_b aryl_h_atom_5 aryl_h_atom_6", "aryl_connection_a", "RING_AROMATIC_6", "ring_family", 65),
    ("LINK_AROMATIC_CARBONYL", "aromatic_carbonyl_linkage", "mainchain_linker", "[c:1][CX3:2](=[OX1:3])[c:4]", "aryl_carbon_a carbonyl_carbon carbonyl_oxygen aryl_carbon_b", "carbonyl_carbon", "FG_KETONE", "carbonyl_family", 85),
    ("LINK_AROMATIC_SULFONE", "aromatic_sulfone_linkage", "mainchain_linker", "[c:1][SX4:2](=[OX1:3])(=[OX1:4])[c:5]", "aryl_carbon_a sulfone_sulfur oxygen_a oxygen_b aryl_carbon_b", "sulfone_sulfur", "FG_SULFONE", "sulfur_family", 95),
    ("LINK_AROMATIC_SULFIDE", "aromatic_sulfide_linkage", "mainchain_linker", "[c:1][SX2:2][c:3]", "aryl_carbon_a sulfide_sulfur aryl_carbon_b", "sulfide_sulfur", "FG_THIOETHER", "sulfur_family", 75),
    ("COMP_AROMATIC_AMIDE_N", "aromatic_amide_n_linkage", "composite_motif", "[c:1][NX3:2][CX3:3](=[OX1:4])", "aryl_carbon amide_nitrogen carbonyl_carbon carbonyl_oxygen", "carbonyl_carbon", "FG_AMIDE", "carbonyl_family", 95),
    ("COMP_AROMATIC_AMIDE_C", "aromatic_amide_c_linkage", "composite_motif", "[c:1][CX3:2](=[OX1:3])[NX3:4]", "aryl_carbon carbonyl_carbon carbonyl_oxygen amide_nitrogen", "carbonyl_carbon", "FG_AMIDE", "carbonyl_family", 95),
    ("COMP_AROMATIC_IMIDE", "aromatic_imide", "composite_motif", "[c:1][NX3:2]([CX3:3](=[OX1:4]))[CX3:5](=[OX1:6])", "aryl_carbon imide_nitrogen carbonyl_carbon_a carbonyl_oxygen_a carbonyl_carbon_b carbonyl_oxygen_b", "imide_nitrogen", "FG_IMIDE", "carbonyl_family", 105),
    ("COMP_FLUORINATED_AROMATIC", "fluorinated_aromatic", "composite_motif", "[F:1][c:2]", "fluorine aryl_carbon", "aryl_carbon", "SUB_FLUORO", "halogen_family", 80),
    ("COMP_BISPHENOL_A_BRIDGE", "bisphenol_a_bridge", "composite_motif", "[c:1][CX4:2]([CH3:3])([CH3:4])[c:5]", "aryl_carbon_a isopropylidene_carbon methyl_a methyl_b aryl_carbon_b", "isopropylidene_carbon", "", "alkyl_side_group_family", 85),
    ("COMP_PERFLUOROALKYL", "perfluoroalkyl_segment", "composite_motif", "[CX4:1]([F:2])([F:3])[CX4:4]([F:5])([F:6])", "fluorinated_carbon_a fluorine_a fluorine_b fluorinated_carbon_b fluorine_c fluorine_d", "fluorinated_carbon_a", "SUB_FLUORO", "halogen_family", 80),
    ("COMP_RIGID_ETHYNYL_AROMATIC", "rigid_ethynyl_aromatic_segment", "composite_motif", "[c:1][#6:2]#[#6:3][c:4]", "aryl_carbon_a alkyne_carbon_a alkyne_carbon_b aryl_carbon_b", "alkyne_carbon_a", "LINK_ETHYNYLENE", "mainchain_linker_family", 85),
    ("COMP_CONJUGATED_AROMATIC_PAIR", "conjugated_aromatic_pair", "composite_motif", "[c:1]-[c:2]", "aromatic_atom_a aromatic_atom_b", "aromatic_atom_a", "RING_AROMATIC_6", "ring_family", 45),
    ("COMP_POLYSILOXANE_SIDE", "polysiloxane_side_substituted", "composite_motif", "[Si:1]([#6:2])([#6:3])[OX2:4]", "silicon carbon_substituent_a carbon_substituent_b siloxane_oxygen", "silicon", "FG_SILOXANE", "silicon_family", 95),
)

SEED = tuple(Rule(f, name, category, priority, pattern, tuple(roles.split()), anchor) for f, name, category, pattern, roles, anchor, _, _, priority in _ROWS)
PARENTS = {r[0]: r[6] for r in _ROWS if r[6]}
GROUPS = {r[0]: r[7] for r in _ROWS if r[7]}
