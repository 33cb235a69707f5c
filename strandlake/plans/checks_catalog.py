"""Queries of rule tables, anchors, rules that are not active and ring summaries, each with the SQL that checks it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import anchors, fragments, periodic, rule_checks
from ..operators.core_rules import CORE
from ..sources import poly
from .catalog import _UNITS, main_units, query
from .extract_catalog import _HELD, _WIDE, units
from .periodic_catalog import _OWNED, RULES, chains

# the rule table in SQL; `maps` are the numbers in a pattern that can be read
_TABLE = """t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 101 <> 0 THEN 'F' || (p_partkey - (p_partkey % 19 = 0)::INT)::VARCHAR END AS id, p_name, p_partkey % 7 >= 3 AS smarts, p_partkey % 7 = 2 AS odd_type,
        p_partkey % 5 AS pat, CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END + (p_partkey % 17 = 0)::INT AS given, CASE WHEN p_partkey % 29 = 0 THEN 'c' WHEN p_partkey % 31 <> 0 THEN 'a' END AS role,
        p_partkey % 9 - 2 AS radius FROM part),
    r AS (SELECT *, least(given, 3) AS roles, CASE pat WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 1 END AS maps FROM t),
    n AS (SELECT id, count(*) AS c FROM r WHERE id IS NOT NULL GROUP BY 1),
    par AS (SELECT id, 'F' || (k + 1)::VARCHAR AS parent FROM r WHERE k % 6 = 0 UNION ALL SELECT id, 'F' || k::VARCHAR FROM r WHERE k % 41 = 0),
    p AS (SELECT id, 'missing_field:fragment_id' AS problem FROM r WHERE id IS NULL UNION ALL SELECT id, 'missing_field:fragment_name' FROM r WHERE k % 23 = 0
        UNION ALL SELECT id, 'missing_field:pattern' FROM r WHERE smarts AND pat = 4 UNION ALL SELECT id, 'missing_field:anchor_role' FROM r WHERE smarts AND role IS NULL
        UNION ALL SELECT id, 'unknown_match_type' FROM r WHERE odd_type UNION ALL SELECT id, 'pattern_does_not_compile' FROM r WHERE smarts AND pat = 2
        UNION ALL SELECT id, 'map_ids_differ_from_roles' FROM r WHERE smarts AND maps <> roles UNION ALL SELECT id, 'anchor_role_not_in_roles' FROM r WHERE smarts AND role = 'c' AND roles < 3
        UNION ALL SELECT id, 'unknown_anchor_type' FROM r WHERE k % 13 = 0 UNION ALL SELECT id, 'unknown_ownership_rule' FROM r WHERE k % 37 = 0
        UNION ALL SELECT id, 'periodic_radius_negative' FROM r WHERE radius < 0 UNION ALL SELECT id, 'periodic_radius_too_large' FROM r WHERE radius > 2
        UNION ALL SELECT id, 'boundary_crossing_requires_radius_ge_1' FROM r WHERE radius = 0 AND k % 2 = 0 UNION ALL SELECT id, 'max_cut_shift_negative' FROM r WHERE k % 8 = 0
        UNION ALL SELECT id, 'unknown_dedup_key_field' FROM r WHERE k % 10 = 0 UNION ALL SELECT id, 'duplicate_fragment_id' FROM r JOIN n USING (id) WHERE c > 1
        UNION ALL SELECT id, 'own_parent' FROM par WHERE parent = id UNION ALL SELECT id, 'unknown_parent' FROM par WHERE parent NOT IN (SELECT id FROM n)),
    good AS (SELECT k, id FROM r WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM p WHERE id IS NOT NULL))"""


@query(f"WITH {_TABLE} SELECT id AS fragment_id, problem FROM p")
def fragment_rule_problems(spark, sf_dir):
    return rule_checks.faults(poly.rule_table(spark, sf_dir))


@query(f"WITH {_TABLE} SELECT id AS fragment_id FROM good")
def fragment_rules_valid(spark, sf_dir):
    return rule_checks.valid(poly.rule_table(spark, sf_dir)).select("fragment_id")


@query(f"""WITH {_TABLE}, a AS (SELECT count(*) AS rules FROM part), f AS (SELECT problem, count(*) AS failures FROM p GROUP BY 1 UNION ALL SELECT 'any', (SELECT rules FROM a) - count(*) FROM good)
    SELECT problem, rules, failures, (rules - failures) / rules::DOUBLE AS valid_rate FROM f, a""")
def rule_set_validity(spark, sf_dir):
    return rule_checks.validity(poly.rule_table(spark, sf_dir))


#: Rules that nothing suppresses, and those of them that are not active.
_INACTIVE = ("fragment_004", "fragment_011", "fragment_019", "fragment_021", "fragment_023")
SOME = tuple(replace(r, status="rejected" if r.fragment_id in _INACTIVE else r.status) for r in CORE if not r.covered_by)
_HITS = f"""{_WIDE}, h AS (SELECT grp, 'fragment_0' || f AS f, a::INT AS a, b::INT AS b FROM (VALUES {_HELD}) t(grp, f, a, b, c)), s AS (SELECT smiles, f, sum(a) AS a, sum(b) AS b FROM b JOIN h USING (grp) WHERE f IN ({', '.join(f"'{r.fragment_id}'" for r in SOME)}) GROUP BY 1, 2),
    o AS (SELECT smiles, f FROM s WHERE b > 0), x AS (SELECT smiles FROM w EXCEPT SELECT smiles FROM o WHERE f NOT IN {_INACTIVE}), y AS (SELECT smiles, list(f ORDER BY f) FILTER (f IS NOT NULL) AS hits FROM x LEFT JOIN o USING (smiles) GROUP BY 1)"""


def _uncovered(spark, sf_dir):
    return fragments.uncovered_hits(fragments.molecules(units(spark, sf_dir)), SOME)


@query(f"{_HITS} SELECT smiles, coalesce(array_to_string(hits, ', '), '') AS inactive_hits FROM y")
def uncovered_inactive(spark, sf_dir):
    return _uncovered(spark, sf_dir).select("smiles", F.array_join("hits", ", ").alias("inactive_hits"))


@query(f"{_HITS} SELECT f AS fragment_id, count(*) AS records FROM (SELECT unnest(hits) AS f FROM y) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def inactive_rule_hits(spark, sf_dir):
    return fragments.inactive_hits(_uncovered(spark, sf_dir))


# each unit is an example of a rule that its length picks; a unit of an odd length says that the rule should match
_PICK = ("fragment_008", "fragment_011", "fragment_016", "fragment_022")
EXAMPLED = tuple(r for r in CORE if r.fragment_id in _PICK)


@query(f"""{_HITS}, e AS (SELECT DISTINCT smiles, ['{"', '".join(_PICK)}'][(length(smiles) // 2 % {len(_PICK)} + 1)::INT] AS f, length(smiles) % 2 = 1 AS expected FROM w)
    SELECT f AS fragment_id, smiles, expected, coalesce(a, 0)::INT AS matches FROM e LEFT JOIN s USING (smiles, f) WHERE expected <> (coalesce(a, 0) > 0)""")
def rule_example_failures(spark, sf_dir):
    n = F.length("smiles")
    rule = F.get(F.array(*map(F.lit, _PICK)), F.floor(n / 2).cast("int") % len(_PICK))
    return rule_checks.example_failures(units(spark, sf_dir).select("smiles", rule.alias("fragment_id"), (n % 2 == 1).alias("expected")), EXAMPLED)


_A = anchors.Anchor
#: One anchor of each kind; those of a bond and of a set lie across two units where the linker is cut off.
ANCHORS = {"ether": _A("bond", ("oxygen", "right")), "thioether": _A("atom", ("sulfur",)), "ester": _A("atom_set", ("carbon", "bridge", "right")), "amide": _A("atom_set", ("carbon", "nitrogen")), "nitrile": _A("bond", ("nitrogen", "carbon")), "six_ring": _A("ring")}
_KINDS = "(VALUES ('ether', 'bond', 2), ('thioether', 'atom', 1), ('ester', 'atom_set', 3), ('amide', 'atom_set', 2), ('nitrile', 'bond', 2), ('six_ring', 'ring', 6)) k(fragment_id, anchor_type, atoms)"


def _anchored(spark, sf_dir):
    return anchors.anchored(chains(spark, sf_dir), RULES, ANCHORS)


# three units in a row show a match within a unit three times and one over an end twice; one unit owns it
@query(f"""{_UNITS} SELECT normalized AS smiles, fragment_id, anchor_type, atoms AS anchor_atoms, CASE way WHEN 'internal' THEN 3 ELSE 2 END::BIGINT AS seen, 1::BIGINT AS owned FROM u JOIN {_OWNED} USING (linker) JOIN {_KINDS} USING (fragment_id)""")
def composite_anchors(spark, sf_dir):
    rows = _anchored(spark, sf_dir).groupBy("smiles", "fragment_id", "anchor_type", F.size("anchor_atoms").alias("anchor_atoms"))
    return rows.agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("anchor_offset") == 0, 1)).alias("owned"))


# ties depend on what colours tell apart, so SQL leaves their share out
@query(f"""{_UNITS} SELECT fragment_id, sum(CASE way WHEN 'internal' THEN 3 ELSE 2 END)::BIGINT AS matches, count(*) AS owned, 1.0::DOUBLE AS anchor_success, count(*) / sum(CASE way WHEN 'internal' THEN 3 ELSE 2 END)::DOUBLE AS anchor_in_unit, 0.0::DOUBLE AS anchor_conflict
    FROM u JOIN {_OWNED} USING (linker) GROUP BY 1""")
def anchor_figures(spark, sf_dir):
    return anchors.figures(_anchored(spark, sf_dir)).select("fragment_id", "matches", "owned", "anchor_success", "anchor_in_unit", "anchor_conflict")


# only linkers of oxygen and sulfur are written in two ways
@query(f"""{_UNITS}, g AS (SELECT fragment_id, linker, n FROM u JOIN {_OWNED} USING (linker) GROUP BY ALL HAVING count(*) > 1) SELECT fragment_id, count(*) AS chains, 1.0::DOUBLE AS cut_shift_anchor_stability FROM g GROUP BY 1""")
def anchor_cut_stability(spark, sf_dir):
    rows = chains(spark, sf_dir)
    named = periodic.primitive(rows).select("smiles", "primitive_hash")
    return anchors.cut_stability(anchors.owned(anchors.anchored(rows, RULES, ANCHORS)).join(named, "smiles"), "primitive_hash")


# every ring of the plain units is the same benzene ring with one attachment point
@query(f"""{_UNITS}, b AS (SELECT count(*) AS records FROM u WHERE linker = 'c1ccc(cc1)') SELECT key, label, records, records AS rings FROM b, (VALUES ('record_count', 'all'), ('ring_count', 'all'), ('ring_atom_class', 'carbocycle'),
    ('hetero_atom_signature', 'none'), ('aromaticity', 'fully_aromatic'), ('ring_aromatic_atom_count', '6'), ('ring_aromaticity_class', 'fully_aromatic'), ('polycyclic', 'false'), ('external_connection_count', '2'), ('external_connection_topology', '1,4'),
    ('exocyclic_substituent_count', '2'), ('exocyclic_substituent_topology', '1,4'), ('polycyclic_connection_count', '0'), ('polycyclic_connection_topology', 'none'), ('substitution_count', '2'), ('substitution_topology', '1,4'),
    ('attachment_count', '1'), ('mainchain_through_ring', 'unknown')) k(key, label)""")
def ring_summary(spark, sf_dir):
    return fragments.ring_summary(fragments.ring_attributes(fragments.molecules(main_units(spark, sf_dir))))
