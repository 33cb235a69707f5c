"""Queries of endless chains, graph signatures and overlapping matches, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import attachments_normalised
from ..operators import dedup, fragments, overlap, periodic
from ..operators.seed_rules import GROUPS, PARENTS, SEED
from ..sources import poly
from .catalog import _STR, _UNITS, main_units, query, read

_RULE = fragments.Rule
#: Groups that a cut between two units parts, and two that it leaves whole.
RULES = (
    _RULE("ether", "ether", "functional_group", 30, "[#6;!$(C=O):1][OX2:2][#6;!$(C=O):3]", ("left", "oxygen", "right"), "oxygen"),
    _RULE("thioether", "thioether", "functional_group", 50, "[#6:1][SX2:2][#6:3]", ("left", "sulfur", "right"), "sulfur"),
    _RULE("ester", "ester", "functional_group", 50, "[CX3:1](=[OX1:2])[OX2:3][#6:4]", ("carbon", "oxygen", "bridge", "right"), "carbon"),
    _RULE("amide", "amide", "functional_group", 50, "[#6:1][CX3:2](=[OX1:3])[NX3:4][#6:5]", ("left", "carbon", "oxygen", "nitrogen", "right"), "carbon"),
    _RULE("nitrile", "nitrile", "functional_group", 50, "[CX2:1]#[NX1:2]", ("carbon", "nitrogen"), "carbon"),
    _RULE("six_ring", "six_membered_ring", "ring_structure", 50, ring_size=6),
)
# which rule a linker has, and across which end of the unit: a linker that comes first has its carbon in the unit before
_OWNED = """(VALUES ('O', 'ether', 'cross_right'), ('S', 'thioether', 'cross_right'), ('C(=O)O', 'ester', 'cross_right'), ('C(=O)N', 'amide', 'cross_right'),
    ('C(C#N)', 'nitrile', 'internal'), ('c1ccc(cc1)', 'six_ring', 'internal')) t(linker, fragment_id, way)"""
_FIRST = "normalized[2:2] IN ('O', 'S')"


def chains(spark, sf_dir):
    return periodic.chains(fragments.molecules(main_units(spark, sf_dir)))


@query(f"""{_UNITS} SELECT normalized AS smiles, fragment_id, CASE WHEN {_FIRST} THEN 'cross_left' ELSE way END AS boundary, 1 AS instances FROM u JOIN {_OWNED} USING (linker)""")
def centred_instances(spark, sf_dir):
    return periodic.centred(chains(spark, sf_dir), RULES).groupBy("smiles", "fragment_id", "boundary").agg(F.count(F.lit(1)).alias("instances"))


# a view has as many segments as the unit: three in a row lie in one only if the unit has three
@query(f"""{_UNITS} SELECT normalized AS smiles, fragment_id, way <> 'internal' AS by_scan, 1 AS instances FROM u JOIN {_OWNED} USING (linker) WHERE way = 'internal' OR linker IN ('C(=O)O') OR linker = 'C(=O)N' AND n >= 2 OR linker IN ('O', 'S') AND n >= 2""")
def cut_shift_scan(spark, sf_dir):
    rows = chains(spark, sf_dir)
    unit = periodic.centred(rows, RULES, 0)
    found = periodic.united(unit, periodic.scanned(rows, RULES, unit))
    return found.groupBy("smiles", "fragment_id", "by_scan").agg(F.count(F.lit(1)).alias("instances"))


# what is decided on each candidate of the shifted views when the centred expansion is known already: nothing is added
@query(f"""{_UNITS}, v AS (SELECT *, n + CASE linker WHEN '' THEN 0 WHEN 'C(=O)O' THEN 2 WHEN 'C(=O)N' THEN 2 ELSE 1 END AS m FROM u),
    o AS (SELECT *, CASE WHEN way = 'internal' THEN 1 WHEN fragment_id = 'amide' THEN 4 ELSE 3 END AS long FROM v JOIN {_OWNED} USING (linker)),
    p AS (SELECT normalized AS smiles, fragment_id, m, CASE WHEN way = 'internal' THEN m - 1 WHEN {_FIRST} THEN -1 WHEN fragment_id = 'amide' THEN m - 3 ELSE m - 2 END AS pos, long FROM o),
    y AS (SELECT *, unnest(range(1 - m, m)) AS shift FROM p),
    w AS (SELECT *, unnest([-1, 0, 1]) AS anchor_offset FROM y WHERE shift <> 0)
    SELECT fragment_id, anchor_offset, anchor_offset = 0 AS key_known, false AS added, count(*) AS candidates FROM w
    WHERE pos + m * anchor_offset >= shift AND pos + m * anchor_offset + long <= shift + m GROUP BY 1, 2""")
def cut_shift_decisions(spark, sf_dir):
    rows = chains(spark, sf_dir)
    found = periodic.scanned(rows, RULES, periodic.centred(rows, RULES))
    return found.groupBy("fragment_id", "anchor_offset", "key_known", "added").agg(F.count(F.lit(1)).alias("candidates"))


@query(f"""{_UNITS} SELECT normalized AS smiles, min(normalized) OVER (PARTITION BY linker, CASE WHEN linker = '' THEN 0 ELSE n END) AS first_of_class, CASE WHEN linker = '' THEN n ELSE 1 END AS repeats FROM u""")
def primitive_periods(spark, sf_dir):
    rows = periodic.primitive(chains(spark, sf_dir)).select("smiles", "primitive_hash", "repeats")
    first = rows.groupBy("primitive_hash").agg(F.min("smiles").alias("first_of_class"))
    return rows.join(first, "primitive_hash").select("smiles", "first_of_class", "repeats")


# the levels of dedup with graph signatures and endless chains: signatures name bonds by atom numbers, so a single-bonded chain
# with its hetero atom elsewhere has the same one
@query(f"""{_UNITS} SELECT count(DISTINCT normalized) AS level_2_unique, count(DISTINCT (linker, n)) AS level_3_unique, count(DISTINCT (linker, n)) AS level_4_unique, count(DISTINCT (linker, CASE WHEN linker = '' THEN 0 ELSE n END)) AS level_5_unique FROM u""")
def graph_level_funnel(spark, sf_dir):
    rows = periodic.primitive(periodic.oriented(chains(spark, sf_dir))).withColumn("signature", periodic.signature(F.col("nodes")))
    return rows.agg(*(F.count_distinct(c).alias(f"level_{k}_unique") for k, c in ((2, "smiles"), (3, "orientation_key"), (4, "signature"), (5, "primitive_hash"))))


_STATED = f"""{_STR}, t AS (SELECT DISTINCT normalized FROM c), a AS (SELECT *, length(normalized) - length(replace(normalized, '*', '')) AS stars FROM t)"""


# every distinct string, those that are no unit too
@query(f"""{_STATED} SELECT CASE WHEN reason IS NOT NULL THEN 'failed' WHEN regexp_full_match(normalized, '\\*C*\\*(\\.\\[Na\\+\\])?') THEN 'symmetric' ELSE 'chosen' END AS orientation, reason, count(*) AS strings
    FROM (SELECT *, CASE WHEN contains(normalized, '[R') OR contains(normalized, ',') THEN 'unreadable' WHEN stars <> 2 THEN 'attachment_count' END AS reason FROM a) GROUP BY 1, 2""")
def orientation_states(spark, sf_dir):
    text = dedup.by_string(poly.property_records(spark, sf_dir)).select(attachments_normalised(F.col("smiles")).alias("smiles")).distinct()
    rows = periodic.oriented(periodic.chains(fragments.molecules(text)))
    return rows.groupBy("orientation", "reason").agg(F.count(F.lit(1)).alias("strings"))


# atoms and bonds of each linker, atom numbers from its first atom on; the chain and the attachment points are added around
_GRAPH = f"""{_UNITS}, l AS (SELECT * FROM (VALUES ('', []::VARCHAR[], []::VARCHAR[], 0), ('O', ['O|8|0|0|2|0'], []::VARCHAR[], 1), ('S', ['S|16|0|0|2|0'], []::VARCHAR[], 1),
    ('C(=O)O', ['C|6|0|0|3|0', 'O|8|0|0|1|0', 'O|8|0|0|2|0'], ['0-1:DOUBLE:0', '0-2:SINGLE:0'], 3), ('C(=O)N', ['C|6|0|0|3|0', 'O|8|0|0|1|0', 'N|7|0|0|2|0'], ['0-1:DOUBLE:0', '0-2:SINGLE:0'], 3),
    ('C(C#N)', ['C|6|0|0|3|0', 'C|6|0|0|2|0', 'N|7|0|0|1|0'], ['0-1:SINGLE:0', '1-2:TRIPLE:0'], 3),
    ('c1ccc(cc1)', ['C|6|1|0|3|1', 'C|6|1|0|2|1', 'C|6|1|0|2|1', 'C|6|1|0|3|1', 'C|6|1|0|2|1', 'C|6|1|0|2|1'], ['0-1:AROMATIC:1', '1-2:AROMATIC:1', '2-3:AROMATIC:1', '3-4:AROMATIC:1', '4-5:AROMATIC:1', '0-5:AROMATIC:1'], 6)) t(linker, atoms, bonds, size)),
    e AS (SELECT normalized, n, linker, atoms, size, normalized[2:2] IN ('O', 'S') AS first,
        list_transform(bonds, lambda b: (split_part(split_part(b, ':', 1), '-', 1)::INT + n + 1)::VARCHAR || '-' || (split_part(split_part(b, ':', 1), '-', 2)::INT + n + 1)::VARCHAR || b[position(':' IN b):]) AS bonds,
        CASE linker WHEN 'C(=O)O' THEN n + 3 WHEN 'C(=O)N' THEN n + 3 WHEN 'c1ccc(cc1)' THEN n + 4 WHEN 'C(C#N)' THEN n + 1 WHEN '' THEN n ELSE n + 1 END AS last FROM u JOIN l USING (linker)),
    g AS (SELECT normalized, list_sort(list_concat(list_concat(['*|0|0|0|1|0', '*|0|0|0|1|0'], list_transform(range(n), lambda x: 'C|6|0|0|2|0')), atoms)) AS a,
        list_sort(list_concat(list_concat(list_transform(range(CASE WHEN linker = '' THEN n ELSE n + 1 END), lambda x: x::VARCHAR || '-' || (x + 1)::VARCHAR || ':SINGLE:0'), bonds), [last::VARCHAR || '-' || (n + size + 1)::VARCHAR || ':SINGLE:0'])) AS b FROM e)"""


@query(f"{_GRAPH} SELECT normalized AS smiles, sha256(array_to_string(a, ';') || '::' || array_to_string(b, ';')) AS signature FROM g")
def graph_signature(spark, sf_dir):
    return fragments.molecules(main_units(spark, sf_dir)).select("smiles", periodic.signature(F.col("nodes")).alias("signature"))


# lines of an order as matches: an order is a record, a line covers some places after its number
_SPANS = """c AS (SELECT l_orderkey AS record, 'f' || (l_partkey % 6)::VARCHAR AS fragment_id, 'k' || lpad(l_linenumber::VARCHAR, 2, '0') || '_' || l_partkey::VARCHAR AS key, l_linenumber AS lo, l_linenumber + l_quantity::INT % 4 AS hi,
        (10 * (l_suppkey % 3))::INT AS priority, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS grp FROM lineitem),
    o AS (SELECT *, 'f' || ((substr(fragment_id, 2)::INT + 1) % 6)::VARCHAR AS parent, substr(fragment_id, 2)::INT % 2 = 0 AS children, row_number() OVER (PARTITION BY record, grp ORDER BY priority DESC, hi - lo DESC, key) AS k FROM c)"""
_SHARED = "greatest(0, least(x.hi, o.hi) - greatest(x.lo, o.lo) + 1) / least(x.hi - x.lo + 1, o.hi - o.lo + 1)::DOUBLE"
_FOLD = f"""WITH RECURSIVE {_SPANS}, g AS (SELECT * FROM o WHERE grp IS NOT NULL),
    d AS (SELECT record, grp, k, fragment_id, key, 'kept' AS status, NULL::VARCHAR AS by_fragment, NULL::DOUBLE AS overlap, [{{'fragment_id': fragment_id, 'parent': parent, 'children': children, 'lo': lo, 'hi': hi}}] AS kept FROM g WHERE k = 1
        UNION ALL
        SELECT record, grp, k, fragment_id, key, CASE WHEN w IS NULL THEN 'kept' WHEN (w.parent = fragment_id AND children) OR (parent = w.fragment_id AND w.children) THEN 'presence_only' ELSE 'removed' END, w.fragment_id,
            greatest(0, least(w.hi, hi) - greatest(w.lo, lo) + 1) / least(w.hi - w.lo + 1, hi - lo + 1)::DOUBLE,
            CASE WHEN w IS NULL THEN list_append(kept, {{'fragment_id': fragment_id, 'parent': parent, 'children': children, 'lo': lo, 'hi': hi}}) ELSE kept END
        FROM (SELECT o.*, d.kept, list_filter(d.kept, lambda x: {_SHARED} >= 0.5)[1] AS w FROM d JOIN g o ON o.record = d.record AND o.grp = d.grp AND o.k = d.k + 1)),
    r AS (SELECT record, grp, fragment_id, key, status, by_fragment, overlap FROM d UNION ALL SELECT record, grp, fragment_id, key, 'kept', NULL, NULL FROM o WHERE grp IS NULL)"""


def spans(spark, sf_dir):
    number = F.col("l_linenumber").cast("int")
    kind = F.col("l_partkey") % 6
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record"), name(kind).alias("fragment_id"), F.concat(F.lit("k"), F.lpad(number.cast("string"), 2, "0"), F.lit("_"), F.col("l_partkey").cast("string")).alias("instance_key"), F.sequence(number, number + F.col("l_quantity").cast("int") % 4).alias("atoms"),
        (F.col("l_suppkey") % 3 * 10).cast("int").alias("priority"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("exclusive_group"), name((kind + 1) % 6).alias("parent_fragment_id"), (kind % 2 == 0).alias("allow_child_fragments"),
    )


@query(f"{_FOLD} SELECT record, grp AS exclusive_group, fragment_id, key AS instance_key, status, by_fragment FROM r")
def overlap_resolution(spark, sf_dir):
    return overlap.decided(spans(spark, sf_dir)).select("record", "exclusive_group", "fragment_id", "instance_key", "status", "by_fragment")


@query(f"{_FOLD} SELECT grp AS exclusive_group, fragment_id, by_fragment, status, count(*) AS instances, avg(overlap) AS mean_overlap FROM r WHERE status <> 'kept' GROUP BY ALL")
def overlap_conflicts(spark, sf_dir):
    return overlap.conflicts(overlap.decided(spans(spark, sf_dir)))


@query(f"{_FOLD} SELECT fragment_id, count(DISTINCT record) AS records FROM r WHERE status <> 'removed' GROUP BY 1")
def overlap_labels(spark, sf_dir):
    return overlap.labels(overlap.decided(spans(spark, sf_dir))).groupBy("fragment_id").agg(F.count(F.lit(1)).alias("records"))


@query(f"""WITH {_SPANS}, t AS (SELECT DISTINCT record, fragment_id, unnest(range(lo, hi + 1)) AS atom FROM c), n AS (SELECT record, fragment_id, count(*) AS size FROM t GROUP BY ALL),
    s AS (SELECT x.record, x.fragment_id AS a, y.fragment_id AS b, count(*) AS shared FROM t x JOIN t y ON x.record = y.record AND x.atom = y.atom AND x.fragment_id < y.fragment_id GROUP BY ALL),
    p AS (SELECT x.record, x.fragment_id AS a, y.fragment_id AS b, x.size AS n, y.size AS m FROM n x JOIN n y ON x.record = y.record AND x.fragment_id < y.fragment_id)
    SELECT a, b, count(*) AS records, sum(coalesce(shared, 0)) AS shared_atoms, avg(coalesce(shared, 0) / (n + m - coalesce(shared, 0))::DOUBLE) AS mean_jaccard, avg(coalesce(shared, 0) / least(n, m)::DOUBLE) AS mean_containment
    FROM p LEFT JOIN s USING (record, a, b) GROUP BY a, b""")
def atom_overlap(spark, sf_dir):
    return overlap.atoms_shared(spans(spark, sf_dir))


# seed rules on units, groups and parents of the rule set: which fragments give way to which
@query(f"""{_UNITS} SELECT fragment_id, by_fragment, status, count(*) AS instances FROM u JOIN (VALUES ('C(=O)O', 'FG_CARBONYL', 'FG_ESTER', 'presence_only'), ('C(=O)N', 'FG_CARBONYL', 'FG_AMIDE', 'presence_only')) t(linker, fragment_id, by_fragment, status) USING (linker) GROUP BY 1, 2, 3""")
def seed_carbonyl_conflicts(spark, sf_dir):
    matches = fragments.match_rows(fragments.levels(fragments.molecules(main_units(spark, sf_dir)), SEED), "normalized")
    rows = overlap.decided(overlap.of_rules(matches, SEED, GROUPS, PARENTS), "smiles")
    return rows.filter("exclusive_group = 'carbonyl_family' AND status <> 'kept'").groupBy("fragment_id", "by_fragment", "status").agg(F.count(F.lit(1)).alias("instances"))
