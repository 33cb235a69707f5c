"""Queries of all core rules and their extractors over units of two groups in a chain, of splits by component and of training
views, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extracts, fragments, splits, stats, views
from ..operators.core_rules import CORE, LADDERS
from ..sources import poly
from .catalog import query, read

# for a group between carbons of a chain, as the operators give it for a single group, read against the definitions by eye: group, then
# rule:raw,normalized,resolved; so the SQL checks sums over units and groups, and guards against changes, but is no second matcher
_LEVELS = """
C(=O)N 01:1,1,1 13:2,0,0 14:1,1,0 23:1,0,0
C(=O)NC(=O) 01:2,2,0 02:1,1,1 13:2,0,0 14:2,2,0 23:1,0,0
C(=O)O 03:1,1,1 14:1,1,0
O 04:1,1,1
OC(=O)O 03:2,1,0 05:1,1,1 14:1,1,0
OC(=O)N 01:1,1,0 03:1,1,0 06:1,1,1 13:2,0,0 14:1,1,0 23:1,0,0
NC(=O)N 01:2,2,0 07:1,1,1 13:4,0,0 14:1,1,0 23:2,0,0
S 08:1,1,1
S(=O)(=O) 09:1,1,1
S(=O) 10:1,1,1
C(C#N) 11:1,1,1
C(O) 12:1,1,1
N 13:2,1,0 23:1,1,1
N(C) 13:3,1,1
C(N) 13:1,1,1
C(=O) 14:1,1,1
C(C(=O)O) 12:1,1,0 14:1,1,0 15:1,1,1
C1CC(C1) 16:1,1,1
c1ccc(s1) 17:1,1,1
C1CCC(C1) 18:1,1,1
c1ccc(cc1) 19:1,1,1
C1CCC(CC1) 20:1,1,1
C=C 21:1,1,1
C#C 22:1,1,1
N=N 24:1,1,1
C(Cl) 25:1,1,1
C(F)(F) 25:2,2,2
C(C(F)(F)F) 25:3,3,0 26:1,1,1
C(C(F)(F)C(F)(F)F) 25:5,5,2 26:1,1,1
C(=S) 27:1,1,1
C(=S)N 13:2,1,0 23:1,1,1 27:1,1,1
NC(=S)N 13:4,2,0 23:2,2,2 27:1,1,1
C(=NO) 12:1,1,1 28:1,1,1
C([N+](=O)[O-]) 13:2,0,0 28:2,2,2
C(S) 29:1,1,1
[Si](C)(C) 30:1,1,1
[Si](C)(C)O[Si](C)(C) 30:2,2,2
P(C) 31:1,1,1
OP(=O)(O)O 12:1,1,1 31:1,1,1
P(C)(=NC) 31:1,1,1
S(=O)(=O)N 09:1,1,1 13:2,0,0 23:1,0,0
S(=O)(=O)O 09:1,1,1
Oc1ccc(cc1) 04:1,1,1 19:1,1,1
c1ccc(cc1)N=Nc1ccc(cc1) 19:2,2,2 24:1,1,1
c1ccc(cc1)C#Cc1ccc(cc1) 19:2,2,2 22:1,1,1
C(c1ccc(cc1)O) 12:1,1,1 19:1,1,1
C(c1ccc(cc1)C#N) 11:1,1,1 19:1,1,1
C(c1ccc(cc1)F) 19:1,1,1 25:1,1,1
C(c1ccc(cc1)C(=O)O) 12:1,1,0 14:1,1,0 15:1,1,1 19:1,1,1
C(c1ccc(cc1)S) 19:1,1,1 29:1,1,1
C(C)=C 21:2,1,1
"""

# likewise: group, rule, resolved matches, whether the anchor lies on the main chain, values in the order of _NAMES
_FOUND = """
O 04 1 true dialkyl_ether C_aliphatic,C_aliphatic 0 2 0
S 08 1 true dialkyl_thioether C_aliphatic,C_aliphatic 0 2 0
S(=O)(=O) 09 1 true sulfone C_aliphatic,C_aliphatic 2 0 0 true
S(=O) 10 1 true sulfoxide C_aliphatic,C_aliphatic 2 0 0
C(C#N) 11 1 false aliphatic_nitrile C aliphatic_carbon false
C(O) 12 1 false aliphatic_alcohol C_aliphatic aliphatic_carbon false false true false
N 23 1 true secondary_amine_linker C_aliphatic,C_aliphatic false 0
N(C) 13 1 true tertiary_nonring tertiary 3 0 false false
C(N) 13 1 false primary_nonring primary 1 2 false false
C(=O) 14 1 true ketone_like C_aliphatic,C_aliphatic 0 0
C(C(=O)O) 15 1 false aliphatic_carboxylic_acid C_aliphatic aliphatic_carbon false
C=C 21 1 true vinylene H1-H1 2 2 0 unknown
C#C 22 1 true alkynylene_other C_aliphatic,C_aliphatic 0 0 unknown
N=N 24 1 true non_diaryl_azo C_aliphatic,C_aliphatic 0 0
C(Cl) 25 1 false Cl_on_aliphatic_carbon Cl aliphatic_carbon 1 0 false false false
C(F)(F) 25 2 false F_on_aliphatic_carbon F aliphatic_carbon 2 2 true false true
C(C(F)(F)F) 26 1 false attached_to_aliphatic_carbon C_aliphatic C_aliphatic,C_aliphatic false false
C(C(F)(F)C(F)(F)F) 25 2 false F_on_aliphatic_carbon F aliphatic_carbon 2 2 true false true
C(C(F)(F)C(F)(F)F) 26 1 false attached_to_aliphatic_carbon C_aliphatic C_aliphatic,C_aliphatic false true
C(=S) 27 1 true aliphatic_thiocarbonyl C_aliphatic,C_aliphatic aliphatic_carbon false false false 0
C(=S)N 23 1 true secondary_amine_linker C_aliphatic,C_aliphatic false 0
C(=S)N 27 1 true thioamide_like C_aliphatic,N mixed true false false 0
NC(=S)N 23 2 true secondary_amine_linker C_aliphatic,C_aliphatic false 0
NC(=S)N 27 1 true thiourea_like N,N nitrogen true true false 0
C(=NO) 12 1 false nitrogen_hydroxyl N nitrogen false false false true
C(=NO) 28 1 false oxime_like single imine_nitrogen hydroxyl_oxygen false true true false
C([N+](=O)[O-]) 28 1 false nitro_like double cationic_nitrogen neutral_oxygen true false false false
C([N+](=O)[O-]) 28 1 false nitro_like single cationic_nitrogen anionic_oxygen true false false false
C(S) 29 1 false aliphatic_sulfanyl aliphatic_carbon C_aliphatic false true 0
[Si](C)(C) 30 1 true alkyl_silyl C_aliphatic,C_aliphatic,C_aliphatic,C_aliphatic 4 0 0 0 false false true
[Si](C)(C)O[Si](C)(C) 30 2 true siloxane_like C_aliphatic,C_aliphatic,C_aliphatic,O 3 1 0 0 true false true
P(C) 31 1 true organophosphorus C_aliphatic,C_aliphatic,C_aliphatic 0 0 3 0 0 false false false
OP(=O)(O)O 12 1 false phosphorus_oxoacid_hydroxyl P phosphorus false false false true
OP(=O)(O)O 31 1 true phosphate_like O,O,O,O 4 0 0 0 0 true true false
P(C)(=NC) 31 1 true phosphazene_like C_aliphatic,C_aliphatic,C_aliphatic,N 0 1 3 0 0 false false true
S(=O)(=O)N 09 1 true sulfonamide_like C_aliphatic,N 1 1 0 false
S(=O)(=O)O 09 1 true sulfonate_like C_aliphatic,O 1 1 0 false
Oc1ccc(cc1) 04 1 true aryl_alkyl_ether C_aliphatic,C_aromatic 1 1 0
c1ccc(cc1)N=Nc1ccc(cc1) 24 1 true diaryl_azo C_aromatic,C_aromatic 2 0
c1ccc(cc1)C#Cc1ccc(cc1) 22 1 true diaryl_ethynylene C_aromatic,C_aromatic 0 2 unknown
C(c1ccc(cc1)O) 12 1 false phenolic_hydroxyl C_aromatic aromatic_carbon true true false false
C(c1ccc(cc1)C#N) 11 1 false aromatic_nitrile C aromatic_carbon true
C(c1ccc(cc1)F) 25 1 false F_on_aromatic_carbon F aromatic_carbon 1 1 true true false
C(c1ccc(cc1)C(=O)O) 15 1 false aromatic_carboxylic_acid C_aromatic aromatic_carbon true
C(c1ccc(cc1)S) 29 1 false aromatic_sulfanyl aromatic_carbon C_aromatic true false 0
C(C)=C 21 1 true substituted_alkenylene H0-H1 3 3 0 unknown
"""

# rule and the names of its attributes
_NAMES = """
04 ether_environment ether_neighbor_signature ether_aromatic_neighbor_count ether_aliphatic_neighbor_count ether_dummy_attachment_count
08 thioether_environment thioether_neighbor_signature thioether_aromatic_neighbor_count thioether_aliphatic_neighbor_count thioether_dummy_attachment_count
09 sulfonyl_environment sulfonyl_substituent_signature sulfonyl_carbon_attachment_count sulfonyl_hetero_attachment_count sulfonyl_boundary_attachment_count sulfonyl_is_sulfone
10 sulfinyl_environment sulfinyl_substituent_signature sulfinyl_carbon_attachment_count sulfinyl_hetero_attachment_count sulfinyl_boundary_attachment_count
11 nitrile_environment nitrile_attached_atom_symbol nitrile_attached_atom_class nitrile_attached_atom_aromatic
12 hydroxyl_environment hydroxyl_attached_atom_symbol hydroxyl_attached_atom_class hydroxyl_attached_atom_aromatic hydroxyl_is_phenolic hydroxyl_is_alcohol hydroxyl_is_heteroatom_bound
13 amine_environment amine_degree amine_heavy_neighbor_count amine_hydrogen_count amine_in_ring amine_aromatic
14 carbonyl_environment carbonyl_neighbor_signature carbonyl_hydrogen_count carbonyl_dummy_attachment_count
15 carboxylic_acid_environment carboxylic_acid_connected_atom_symbol carboxylic_acid_connected_atom_class carboxylic_acid_connected_atom_aromatic
21 alkene_substitution_class alkene_h_pattern alkene_external_neighbor_count alkene_carbon_substituent_count alkene_dummy_attachment_count mainchain_through_alkene
22 alkyne_environment alkyne_terminal_signature alkyne_dummy_attachment_count alkyne_aromatic_terminal_count mainchain_through_alkyne
23 secondary_amine_linker_environment secondary_amine_neighbor_signature secondary_amine_in_ring secondary_amine_dummy_attachment_count
24 azo_environment azo_neighbor_signature azo_aromatic_neighbor_count azo_dummy_attachment_count
25 halogen_environment halogen_element halogen_substituted_carbon_class halogenated_carbon_halogen_count halogenated_carbon_fluorine_count halogen_is_fluorine halogen_is_aromatic_substituent halogen_is_perfluoroalkyl_like
26 trifluoromethyl_attachment_class trifluoromethyl_attachment_atom_symbol trifluoromethyl_neighbor_signature trifluoromethyl_is_aromatic_substituent trifluoromethyl_is_perfluoroalkyl_terminal
27 thiocarbonyl_environment thiocarbonyl_neighbor_signature thiocarbonyl_connected_atom_class thiocarbonyl_is_thioamide_like thiocarbonyl_is_thiourea_like thiocarbonyl_is_isothiocyanate_like thiocarbonyl_dummy_attachment_count
28 n_o_environment n_o_bond_order n_o_nitrogen_class n_o_oxygen_class n_o_is_nitro_like n_o_is_oxime_like n_o_is_hydroxylamine_like n_o_is_alkoxyamine_like
29 sulfanyl_environment sulfanyl_attached_atom_class sulfanyl_neighbor_signature sulfanyl_is_aromatic sulfanyl_is_aliphatic sulfanyl_dummy_attachment_count
30 silicon_environment silicon_neighbor_signature silicon_carbon_attachment_count silicon_oxygen_attachment_count silicon_halogen_attachment_count silicon_dummy_attachment_count silicon_is_siloxane_like silicon_is_silyl_aryl_like silicon_is_silyl_alkyl_like
31 phosphorus_environment phosphorus_neighbor_signature phosphorus_oxygen_attachment_count phosphorus_nitrogen_attachment_count phosphorus_carbon_attachment_count phosphorus_halogen_attachment_count phosphorus_dummy_attachment_count phosphorus_has_phosphoryl phosphorus_is_phosphate_like phosphorus_is_phosphazene_like
"""


def _quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


_GROUPS = [r[0] for r in _rows(_LEVELS)]
_HELD = ", ".join(_quoted([r[0], *cell.replace(":", ",").split(",")]) for r in _rows(_LEVELS) for cell in r[1:])
_VALUES = ", ".join(_quoted([*r[:4], " ".join(r[4:])]) for r in _rows(_FOUND))
_LISTS = ", ".join(_quoted([r[0], " ".join(r[1:])]) for r in _rows(_NAMES))
_WIDE = f"""WITH g AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{g}')" for i, g in enumerate(_GROUPS))}) t(i, grp)),
    w AS (SELECT DISTINCT x.grp AS one, y.grp AS two, '*' || repeat('C', p_size % 6 + 1) || x.grp || repeat('C', (p_partkey % 5 + 2)::INT) || y.grp || repeat('C', (p_partkey % 7 + 1)::INT) || '*' AS smiles
        FROM part JOIN g x ON x.i = p_partkey % {len(_GROUPS)} JOIN g y ON y.i = p_partkey // {len(_GROUPS)} % {len(_GROUPS)}),
    b AS (SELECT smiles, one AS grp FROM w UNION ALL SELECT smiles, two FROM w)"""


def units(spark, sf_dir):
    return poly.wide_units(spark, sf_dir).select("smiles").distinct()


@query(f"{_WIDE} SELECT count(*) AS units, count(DISTINCT one) AS first_groups, count(DISTINCT two) AS second_groups, max(length(smiles))::INT AS longest FROM w")
def wide_units(spark, sf_dir):
    rows = poly.wide_units(spark, sf_dir).select("smiles", "first", "second").distinct()
    return rows.agg(F.count(F.lit(1)).alias("units"), F.count_distinct("first").alias("first_groups"), F.count_distinct("second").alias("second_groups"), F.max(F.length("smiles")).alias("longest"))


@query(f"""{_WIDE}, h AS (SELECT * FROM (VALUES {_HELD}) t(grp, f, a, b, c)), s AS (SELECT smiles, f, sum(a::INT) AS a, sum(b::INT) AS b, sum(h.c::INT) AS c FROM b JOIN h USING (grp) GROUP BY 1, 2)
    SELECT 'fragment_' || lpad(i::VARCHAR, 3, '0') AS fragment_id, count_if(a > 0)::BIGINT AS raw_records, coalesce(sum(a), 0)::BIGINT AS raw_matches, count_if(b > 0)::BIGINT AS normalized_records, coalesce(sum(b), 0)::BIGINT AS normalized_matches,
        count_if(c > 0)::BIGINT AS resolved_records, coalesce(sum(c), 0)::BIGINT AS resolved_matches, coalesce(max(c), 0)::INT AS resolved_max FROM range(1, 32) r(i) LEFT JOIN s ON f::INT = i GROUP BY i""")
def wide_fragment_levels(spark, sf_dir):
    rows = fragments.statistics(fragments.levels(fragments.molecules(units(spark, sf_dir)), CORE), spark, CORE)
    return rows.select("fragment_id", "raw_records", "raw_matches", "normalized_records", "normalized_matches", "resolved_records", "resolved_matches", "resolved_max")


_MATCHES = f"{_WIDE}, v AS (SELECT * FROM (VALUES {_VALUES}) t(grp, f, n, on_main, vals)), m AS (SELECT smiles, f, n::INT AS n, on_main, vals FROM b JOIN v USING (grp))"


@query(f"""{_MATCHES}, l AS (SELECT * FROM (VALUES {_LISTS}) t(f, names)), p AS (SELECT smiles, f, n, unnest(string_split(names, ' ')) AS name, unnest(string_split(vals, ' ')) AS value FROM m JOIN l USING (f))
    SELECT 'fragment_0' || f AS fragment_id, name, value, count(DISTINCT smiles) AS records, sum(n)::BIGINT AS matches FROM p GROUP BY ALL""")
def extractor_values(spark, sf_dir):
    return extracts.distribution(extracts.extracted(fragments.molecules(units(spark, sf_dir)), CORE, LADDERS))


@query(f"{_MATCHES} SELECT 'fragment_0' || f AS fragment_id, on_main = 'true' AS on_main_chain, count(DISTINCT smiles) AS records, sum(n)::BIGINT AS matches FROM m GROUP BY ALL")
def extractor_main_chain(spark, sf_dir):
    rows = extracts.extracted(fragments.molecules(units(spark, sf_dir)), CORE, LADDERS)
    per = rows.groupBy("smiles", "fragment_id", "on_main_chain").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("fragment_id", "on_main_chain").agg(F.count(F.lit(1)).alias("records"), F.sum("_n").alias("matches"))


_KEYS = """k AS (SELECT p_partkey AS record, 'price' AS kind, p_retailprice::VARCHAR AS key FROM part UNION ALL SELECT p_partkey, 'make', p_brand || '/' || p_type || '/' || p_size::VARCHAR FROM part),
    e AS (SELECT DISTINCT x.record AS a, y.record AS b FROM k x JOIN k y USING (kind, key)), r AS (SELECT DISTINCT record AS p, record AS q FROM k UNION SELECT r.p, e.b FROM r JOIN e ON r.q = e.a),
    o AS (SELECT p AS record, min(q) AS component FROM r GROUP BY p)"""
_BYTE = "('0x' || sha256('s1' || {}::VARCHAR)[1:2])::INT"
_SPLIT = f"CASE WHEN {_BYTE} < 179 THEN 'build' WHEN {_BYTE} < 218 THEN 'validation' ELSE 'stress' END"
_OF = _SPLIT.replace("{}", "component")


def _keys(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    make = F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))
    pairs = F.array(F.struct(F.lit("price").alias("kind"), F.col("p_retailprice").cast("string").alias("key")), F.struct(F.lit("make").alias("kind"), make.alias("key")))
    return part.select(F.col("p_partkey").alias("record"), F.inline(pairs))


@query(f"WITH RECURSIVE {_KEYS} SELECT record, component, {_OF} AS split FROM o")
def component_splits(spark, sf_dir):
    return splits.by_component(splits.components(_keys(spark, sf_dir)), "s1")


# a split by record leaks keys, one by component none
@query(f"""WITH RECURSIVE {_KEYS}, c AS (SELECT record, 'component' AS unit, {_OF} AS split FROM o UNION ALL SELECT record, 'record', {_SPLIT.replace("{}", "record")} FROM o),
    j AS (SELECT DISTINCT unit, kind, key, split FROM k JOIN c USING (record)), l AS (SELECT unit, kind, key, list(split) AS has FROM j GROUP BY ALL),
    p AS (SELECT * FROM (VALUES ('build', 'validation'), ('build', 'stress'), ('validation', 'stress')) t("left", "right"))
    SELECT unit, kind, "left", "right", count_if(list_contains(has, "left") OR list_contains(has, "right"))::BIGINT AS keys, count_if(list_contains(has, "left") AND list_contains(has, "right"))::BIGINT AS shared FROM l, p GROUP BY ALL""")
def split_leak_pairs(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    found = splits.components(keys)
    whole = splits.by_component(found, "s1")
    single = splits.by_component(found.withColumn("component", F.col("record")), "s1")
    of = lambda unit, rows: splits.shared(keys, rows, ("price", "make")).withColumn("unit", F.lit(unit))
    return of("component", whole).unionByName(of("record", single))


_DRAW = "('0x' || sha256('v1:0:{}:' || id::VARCHAR || ':' || {}::VARCHAR)[1:8])::BIGINT"


# tokens as rows: which are masked, which lie in the span of their block
@query(f"""{_WIDE}, x AS (SELECT min(p_partkey) AS id, smiles FROM (SELECT p_partkey, '*' || repeat('C', p_size % 6 + 1) || a.grp || repeat('C', (p_partkey % 5 + 2)::INT) || b.grp || repeat('C', (p_partkey % 7 + 1)::INT) || '*' AS smiles
        FROM part JOIN g a ON a.i = p_partkey % {len(_GROUPS)} JOIN g b ON b.i = p_partkey // {len(_GROUPS)} % {len(_GROUPS)}) GROUP BY smiles),
    y AS (SELECT *, regexp_extract_all(smiles, '\\[[^\\]]*\\]|Cl|Br|%[0-9][0-9]|.') AS toks, ('0x' || sha256('v1' || smiles)[1:2])::INT AS byte FROM x),
    z AS (SELECT id, smiles, byte, len(toks) AS n, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM y),
    q AS (SELECT *, i // 12 AS blk, least(12, n - i // 12 * 12) - 3 AS room FROM z),
    s AS (SELECT *, {_DRAW.format('mask', 'i')} < 644245094 AS hit, room >= 0 AND {_DRAW.format('span', 'blk')} < 1288490188 AND i % 12 - {_DRAW.format('start', 'blk')} % (greatest(room, 0) + 1) BETWEEN 0 AND 2 AS gone FROM q),
    t AS (SELECT id, smiles, CASE WHEN byte < 205 THEN 'train' WHEN byte < 230 THEN 'valid' ELSE 'test' END AS split, string_agg(CASE WHEN hit THEN '[MASK]' ELSE tok END, '' ORDER BY i) AS masks,
        coalesce(string_agg(CASE WHEN NOT gone THEN tok END, '' ORDER BY i), '') AS spans FROM s GROUP BY id, smiles, byte)
    SELECT id AS record_id, sha256(smiles) AS canonical_hash, split, 'plain' AS view, smiles AS input, smiles AS target FROM t
    UNION ALL SELECT id, sha256(smiles), split, 'token_mask', masks, smiles FROM t WHERE split = 'train' UNION ALL SELECT id, sha256(smiles), split, 'span_dropout', spans, smiles FROM t WHERE split = 'train'""")
def text_views(spark, sf_dir):
    rows = poly.wide_units(spark, sf_dir).groupBy("smiles").agg(F.min("p_partkey").alias("id"))
    return views.views(stats.hash_split(rows, F.col("smiles"), "v1"), "id", "smiles", "v1")


_CARBONYL = ("[#6:1]=[#8:2]", ("carbon", "oxygen"), "carbon")
#: One pattern under each type of constraint.
CONSTRAINED = (
    fragments.Rule("any", "carbonyl", "functional_group", 10, *_CARBONYL),
    fragments.Rule("anchor_in_no_amide", "carbonyl", "functional_group", 10, *_CARBONYL, constraints={"not_smarts_overlap_anchor": ["[#7;!+][#6]=[#8]"]}),
    fragments.Rule("match_meets_no_ester_oxygen", "carbonyl", "functional_group", 10, *_CARBONYL, constraints={"not_smarts_overlap_match": ["[#6](=[#8])[OX2][#6]", "[#6](=[#8])[OH]"]}),
    fragments.Rule("no_oxygen_beside", "ether", "functional_group", 10, "[#6:1][OX2:2][*:3]", ("left", "oxygen", "right"), "oxygen", constraints={"anchor_neighbor_must_not_be": ["P", "S", "N"], "match_must_be_internal": True}),
    fragments.Rule("three_fluorines", "fluorines", "side_group", 10, "[#6:1]([#9,#6:2])([#9,#6:3])[#9,#6:4]", ("carbon", "a", "b", "c"), "carbon", constraints={"required_atom_count": {"F": 3}}),
    fragments.Rule("no_third_fluorine", "fluorines", "side_group", 10, "[#6:1]([#9:2])[#9:3]", ("carbon", "a", "b"), "carbon", constraints={"forbid_atom_count_gt": {"F": 1}}),
)


# group, then for each rule the matches that pass
_PASS = """
C(=O)N any:1 match_meets_no_ester_oxygen:1
C(=O)NC(=O) any:2 match_meets_no_ester_oxygen:2
C(=O)O any:1 anchor_in_no_amide:1 no_oxygen_beside:1
O no_oxygen_beside:1
OC(=O)O any:1 anchor_in_no_amide:1 no_oxygen_beside:2
OC(=O)N any:1 no_oxygen_beside:1
NC(=O)N any:1 match_meets_no_ester_oxygen:1
C(=O) any:1 anchor_in_no_amide:1 match_meets_no_ester_oxygen:1
C(C(=O)O) any:1 anchor_in_no_amide:1
C(C(F)(F)F) three_fluorines:1
C(C(F)(F)C(F)(F)F) three_fluorines:1
Oc1ccc(cc1) no_oxygen_beside:1
C(c1ccc(cc1)C(=O)O) any:1 anchor_in_no_amide:1
"""
_PASSED = ", ".join(_quoted([r[0], *cell.split(":")]) for r in _rows(_PASS) for cell in r[1:])


@query(f"""{_WIDE}, h AS (SELECT * FROM (VALUES {_PASSED}) t(grp, f, n)), s AS (SELECT smiles, f, sum(n::INT) AS n FROM b JOIN h USING (grp) GROUP BY ALL)
    SELECT i AS fragment_id, count(smiles) AS records, coalesce(sum(n), 0)::BIGINT AS matches FROM (VALUES {', '.join(f"('{r.fragment_id}')" for r in CONSTRAINED)}) t(i) LEFT JOIN s ON f = i GROUP BY i""")
def constrained_levels(spark, sf_dir):
    rows = fragments.statistics(fragments.levels(fragments.molecules(units(spark, sf_dir)), CONSTRAINED), spark, CONSTRAINED)
    return rows.select("fragment_id", F.col("normalized_records").alias("records"), F.col("normalized_matches").alias("matches"))
