"""Fragment rules over repeat-unit graphs: raw matches, constraints, keep-first, suppression, attributes, statistics.

All of it happens within a record's row, as higher-order functions over its nodes: no exchange is needed before the counts.
Only the reading of strings into nodes and rings runs in Arrow batches. No number of matches is capped.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem, patterns

STATUSES = ("core", "derived_attribute", "deprecated_alias", "rejected")
RING_FILTERS = ("any", "carbocycle", "heterocycle", "polycyclic", "aromatic", "nonaromatic")
CONSTRAINTS = {
    "exclude_atom_role_adjacent_to_carbonyl": "!$(*~[#6]=[#8])",
    "exclude_atom_role_adjacent_to_sulfonyl": "!$(*~[#16](=[#8])=[#8])",
    "exclude_atom_role_with_oxygen_neighbor": "!$(*~[#8])",
}


#: Constraints by value: patterns whose atoms must not meet the anchor or the match, numbers of atoms in the match, elements beside the anchor.
CONSTRAINT_TYPES = {
    "not_smarts_overlap_anchor": "patterns",
    "not_smarts_overlap_match": "patterns",
    "required_atom_count": "counts",
    "forbid_atom_count_gt": "counts",
    "anchor_neighbor_must_not_be": "elements",
    "match_must_be_internal": "flag",
}
OF_ANCHOR = ("not_smarts_overlap_anchor", "anchor_neighbor_must_not_be")
KNOWN_CONSTRAINTS = {*CONSTRAINTS, *CONSTRAINT_TYPES, "exact_fluorine_count", "fluorine_count_atom_role", "exclude_perfluoroalkyl_chain"}


@dataclass(frozen=True)
class Rule:
    """A pattern with a role for each mapped atom, or a ring size with a filter.

    Equal keys are one match: `roles`, then each group of `groups` in ascending order; without either the anchor atom, for rings all atoms.
    `covered_by` has (fragment, roles) pairs: a match goes if the atoms of its `core` roles are those roles' atoms of one of theirs."""

    fragment_id: str
    name: str
    category: str
    priority: int
    pattern: str | None = None
    atom_roles: tuple[str, ...] = ()
    anchor: str | None = None
    ring_size: int | None = None
    ring_filter: str = "any"
    roles: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()
    constraints: dict = field(default_factory=dict, hash=False)
    core: tuple[str, ...] = ()
    covered_by: tuple[tuple[str, tuple[str, ...]], ...] = ()
    status: str = "core"
    derived: bool = False  # a view of other rules: it has no matches of its own

    def place(self, role: str) -> int:
        return patterns.read(self.pattern).maps.index(self.atom_roles.index(role) + 1)


def problems(rules) -> list[tuple[str, str]]:
    """(fragment_id, what is wrong) for each fault of a rule set; patterns are read, roles and covering rules looked up."""
    out, ids = [], [r.fragment_id for r in rules]
    for r in rules:
        bad = lambda why, r=r: out.append((r.fragment_id, why))
        if ids.count(r.fragment_id) > 1:
            bad("duplicate_id")
        if r.status not in STATUSES:
            bad("unknown_status")
        if r.derived:
            continue
        if r.ring_size is not None:
            if r.ring_filter not in RING_FILTERS:
                bad("unknown_ring_filter")
            continue
        try:
            maps = [m for m in patterns.read(r.pattern or "").maps if m]
        except ValueError:
            bad("pattern_does_not_compile")
            continue
        if sorted(maps) != list(range(1, len(r.atom_roles) + 1)):
            bad("map_ids_differ_from_roles")
        if r.anchor not in r.atom_roles and not (r.roles or r.groups):
            bad("anchor_not_in_roles")
        if not {*r.roles, *(x for g in r.groups for x in g), *r.core} <= set(r.atom_roles):
            bad("unknown_role")
        if any(f not in ids for f, _ in r.covered_by):
            bad("unknown_covering_rule")
        if not set(r.constraints) <= KNOWN_CONSTRAINTS:
            bad("unknown_constraint")
        named = [x for k in CONSTRAINTS if k in r.constraints for x in as_roles(r.constraints[k])]
        if "exact_fluorine_count" in r.constraints:
            named.append(r.constraints.get("fluorine_count_atom_role", "trifluoromethyl_carbon"))
        if not set(named) <= set(r.atom_roles):
            bad("constraint_role_unknown")
        if any(k in OF_ANCHOR for k in r.constraints) and r.anchor not in r.atom_roles:
            bad("constraint_without_anchor")
        for k, value in r.constraints.items():
            if k in CONSTRAINT_TYPES and not _fits(CONSTRAINT_TYPES[k], value):
                bad(f"constraint_value:{k}")
    return out


def _fits(kind: str, value) -> bool:
    """Whether a constraint's value is what its kind says; patterns have to be readable."""
    if kind == "flag":
        return isinstance(value, bool)
    if kind == "counts":
        return isinstance(value, dict) and all(isinstance(k, str) and isinstance(n, int) and not isinstance(n, bool) for k, n in value.items())
    if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
        return False
    if kind == "elements":
        return all(x in patterns.NUMBERS.values() for x in value)
    try:
        return all(patterns.read(x) for x in value)
    except ValueError:
        return False


def load_rules(path: str) -> list[Rule]:
    """Rules from a JSON file: a list of objects with match_rule, atom_roles by map number, anchor_rule, deduplication and overlap_policy.

    ValueError names the faults of a bad file and unknown modes of suppression."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    out = []
    for x in rows:
        m, policy, dedup = x["match_rule"], x.get("overlap_policy") or {}, x.get("deduplication") or {}
        derived = m.get("type") == "derived_view"
        roles = tuple((x.get("atom_roles") or {})[k] for k in sorted(x.get("atom_roles") or {}, key=int)) if m.get("type", "smarts") == "smarts" else ()
        gone, covered, core = policy.get("instance_suppression"), [], ()
        if gone:
            if gone["mode"] == "drop_if_anchor_covered_by_higher_priority":
                core = (gone["anchor_role"],)
                covered = [(c["fragment_id"], (c["anchor_role"],)) for c in gone["covering_fragments"]]
            elif gone["mode"] == "drop_if_core_atoms_covered_by_higher_priority":
                core = tuple(gone["core_atom_roles"])
                covered = [(c["fragment_id"], tuple(s)) for c in gone["covering_fragments"] for s in c.get("core_atom_role_sets") or [c["core_atom_roles"]]]
            else:
                raise ValueError(f"{x['fragment_id']}: unknown suppression mode {gone['mode']}")
        groups = [*dedup.get("unordered_role_groups", ()), *dedup.get("atom_set_role_groups", ())]
        out.append(Rule(x["fragment_id"], x["fragment_name"], x["category"], policy.get("priority", 50), m.get("pattern"), roles, (x.get("anchor_rule") or {}).get("anchor_role"), m.get("ring_size") if m.get("type") == "rdkit_ring" else None, m.get("ring_filter", "any"), tuple(dedup.get("roles", ())), tuple(tuple(g) for g in groups), m.get("constraints") or {}, core, tuple(covered), x.get("core_status", "core"), derived))
    faults = problems(out)
    if faults:
        raise ValueError("; ".join(f"{f}: {why}" for f, why in faults))
    return out


_NODE = "struct<atom_id:int,element:string,aromatic:boolean,charge:int,hydrogens:int,degree:int,ring_count:int,ring_sizes:array<int>,near:array<struct<to:int,bond:int,in_ring:boolean>>>"


def molecules(strings: DataFrame, column: str = "smiles") -> DataFrame:
    """(smiles, nodes, rings), one row per row of `strings`; nodes and rings are null where the string is null or can't be read."""
    near = pa.struct([("to", pa.int32()), ("bond", pa.int32()), ("in_ring", pa.bool_())])
    node = pa.struct([("atom_id", pa.int32()), ("element", pa.string()), ("aromatic", pa.bool_()), ("charge", pa.int32()), ("hydrogens", pa.int32()), ("degree", pa.int32()), ("ring_count", pa.int32()), ("ring_sizes", pa.list_(pa.int32())), ("near", pa.list_(near))])

    def parsed(it):
        for b in it:
            nodes, rings = [], []
            for text in b.column("smiles").to_pylist():
                g = chem.parse(text)
                if g is None:
                    nodes.append(None)
                    rings.append(None)
                    continue
                found, inside, next_to = chem.rings(g), chem.ring_bonds(len(g[0]), g[1]), chem.neighbours(len(g[0]), g[1])
                sizes = [[len(r) for r in found if i in r] for i in range(len(g[0]))]
                nodes.append([
                    {"atom_id": i, "element": a[0], "aromatic": a[1], "charge": a[2], "hydrogens": h, "degree": len(next_to[i]), "ring_count": len(sizes[i]), "ring_sizes": sizes[i], "near": [{"to": j, "bond": o, "in_ring": (min(i, j), max(i, j)) in inside} for j, o in next_to[i]]}
                    for i, (a, h) in enumerate(zip(g[0], chem.hydrogens(g)))
                ])
                rings.append(found)
            yield pa.record_batch([b.column("smiles"), pa.array(nodes, pa.list_(node)), pa.array(rings, pa.list_(pa.list_(pa.int32())))], names=["smiles", "nodes", "rings"])

    return strings.select(F.col(column).alias("smiles")).mapInArrow(parsed, f"smiles string, nodes array<{_NODE}>, rings array<array<int>>")


def _at(nodes: Column, i: Column) -> Column:
    return F.get(nodes, i)


def _raw(rule: Rule) -> str:
    """All matches of a rule in order, as an expression over nodes and rings."""
    if rule.derived:
        return "CAST(array() AS array<array<int>>)"
    if rule.ring_size is None:
        return patterns.matches(patterns.read(rule.pattern))
    test = {
        "any": "true",
        "carbocycle": "forall(r, i -> nodes[i].element = 'C')",
        "heterocycle": "exists(r, i -> nodes[i].element <> 'C')",
        "polycyclic": "exists(r, i -> nodes[i].ring_count > 1)",
        "aromatic": "forall(r, i -> nodes[i].aromatic)",
        "nonaromatic": "exists(r, i -> NOT nodes[i].aromatic)",
    }[rule.ring_filter]
    return f"filter(rings, r -> size(r) = {rule.ring_size} AND {test})"


def _roles_of(rule: Rule, roles, m: str) -> str:
    return f"array({', '.join(f'{m}[{rule.place(r)}]' for r in roles)})"


def _key(rule: Rule, m: str) -> str:
    if rule.derived or rule.ring_size is not None:
        return f"array_sort({m})"
    parts = [_roles_of(rule, rule.roles, m)] if rule.roles else []
    parts += [f"array_sort({_roles_of(rule, g, m)})" for g in rule.groups]
    return f"concat({', '.join(parts)})" if parts else _roles_of(rule, [rule.anchor], m)


def as_roles(value) -> tuple[str, ...]:
    """One role or a list of them."""
    return (value,) if isinstance(value, str) else tuple(value)


def _constrained(rule: Rule, name: str, value, m: str) -> list[str]:
    """The conditions that a constraint by value puts on a match."""
    x, e = patterns.name(), patterns.name()
    if name == "not_smarts_overlap_match":
        return [f"NOT exists({patterns.matches(patterns.read(p))}, {x} -> arrays_overlap({x}, {m}))" for p in value]
    if name == "match_must_be_internal":
        return [f"forall({m}, {x} -> nodes[{x}].element <> '*')"] if value else []
    if name in ("required_atom_count", "forbid_atom_count_gt"):
        sign = "=" if name == "required_atom_count" else "<="
        return [f"size(filter({m}, {x} -> nodes[{x}].element = '{element}')) {sign} {n}" for element, n in value.items()]
    anchor = f"{m}[{rule.place(rule.anchor)}]"
    if name == "not_smarts_overlap_anchor":
        return [f"NOT exists({patterns.matches(patterns.read(p))}, {x} -> array_contains({x}, {anchor}))" for p in value]
    unwanted = ", ".join(f"'{element}'" for element in value)
    return [f"NOT exists(nodes[{anchor}].near, {e} -> nodes[{e}.to].element IN ({unwanted}))"] if value else []


def _passes(rule: Rule, m: str) -> str:
    tests = ["true"]
    for name, value in rule.constraints.items():
        if name == "exact_fluorine_count":
            e, role = patterns.name(), rule.constraints.get("fluorine_count_atom_role", "trifluoromethyl_carbon")
            tests.append(f"size(filter(nodes[{m}[{rule.place(role)}]].near, {e} -> nodes[{e}.to].element = 'F')) = {int(value)}")
        elif name in CONSTRAINTS:
            tests += [patterns.holds(CONSTRAINTS[name], f"{m}[{rule.place(role)}]") for role in as_roles(value)]
        elif name == "exclude_perfluoroalkyl_chain":
            if value and "attached_carbon" in rule.atom_roles:
                tests.append(patterns.holds("!$(*~[#9])", f"{m}[{rule.place('attached_carbon')}]"))
        elif name in CONSTRAINT_TYPES:
            if not _fits(CONSTRAINT_TYPES[name], value):
                raise ValueError(f"{rule.fragment_id}: {name} can't have the value {value}")
            tests += _constrained(rule, name, value, m)
        elif name != "fluorine_count_atom_role":
            raise ValueError(f"{rule.fragment_id}: unknown constraint {name}")
    return " AND ".join(tests)


def matched(found: DataFrame, rules) -> DataFrame:
    """`found` with a column `_<fragment_id>` for each rule: array<struct<atoms, key, passes>>, the raw matches in order."""
    of = lambda r: F.expr(f"transform({_raw(r)}, m -> named_struct('atoms', m, 'key', {_key(r, 'm')}, 'passes', {_passes(r, 'm')}))")
    return found.filter("nodes is not null").withColumns({f"_{r.fragment_id}": of(r) for r in rules})


def _normalised(column: str) -> Column:
    """Matches that pass, of those with one key the first."""
    return F.expr(f"flatten(transform(array(filter(`{column}`, m -> m.passes)), x -> filter(x, (m, i) -> array_position(x.key, m.key) = i + 1)))")


def levels(found: DataFrame, rules, keep: tuple[str, ...] = ("smiles",), statuses: tuple[str, ...] = ("core",)) -> DataFrame:
    """(keep..., fragment_id, raw, normalized, resolved): a row for each record and rule of one of `statuses`, with the arrays of atoms at each level.

    Covering matches are the normalised ones, so suppression doesn't chain and priorities play no part."""
    by_id = {r.fragment_id: r for r in rules}
    rows = matched(found, rules)
    rows = rows.withColumns({f"n_{r.fragment_id}": _normalised(f"_{r.fragment_id}") for r in rules})
    out = []
    for r in rules:
        if r.status not in statuses:
            continue
        stays = f"`n_{r.fragment_id}`"
        if r.covered_by:
            covers = ", ".join(f"transform(`n_{f}`, c -> array_sort({_roles_of(by_id[f], roles, 'c.atoms')}))" for f, roles in r.covered_by)
            stays = f"filter({stays}, m -> NOT array_contains(concat({covers}), array_sort({_roles_of(r, r.core, 'm.atoms')})))"
        out.append(f"named_struct('id', '{r.fragment_id}', 'raw', `_{r.fragment_id}`, 'normal', `n_{r.fragment_id}`, 'rest', {stays})")
    # within a lambda the fields stay out of the generated code, which would outgrow what compiles
    row = "named_struct('fragment_id', x.id, 'raw', x.raw.atoms, 'normalized', x.normal.atoms, 'resolved', x.rest.atoms)"
    return rows.select(*keep, F.expr(f"inline(transform(array({', '.join(out)}), x -> {row}))"))


def match_rows(rows: DataFrame, level: str = "resolved") -> DataFrame:
    """(..., fragment_id, match_index, atoms): a row for each match of a level."""
    names = [c for c in rows.columns if c not in ("raw", "normalized", "resolved")]
    return rows.select(*names, F.posexplode(level).alias("match_index", "atoms"))


def statistics(rows: DataFrame, spark: SparkSession, rules) -> DataFrame:
    """For each active rule, records hit, matches, and the most and the mean of one record at each level; rules without a match too."""
    sums = []
    for level in ("raw", "normalized", "resolved"):
        n = F.size(level)
        sums += [F.count(F.when(n > 0, 1)).alias(f"{level}_records"), F.sum(n).cast("long").alias(f"{level}_matches"), F.max(n).alias(f"{level}_max")]
    counts = rows.groupBy("fragment_id").agg(*sums)
    ids = spark.createDataFrame([(r.fragment_id, r.name, r.category, r.priority) for r in rules if r.status == "core"], "fragment_id string, fragment_name string, category string, priority int")
    return ids.join(counts, "fragment_id", "left").fillna(0)


def uncovered(rows: DataFrame) -> DataFrame:
    """Records that no active rule hits."""
    return rows.groupBy("smiles").agg(F.sum(F.size("resolved")).alias("_n")).filter("_n = 0").select("smiles")


def uncovered_hits(found: DataFrame, rules) -> DataFrame:
    """(smiles, hits): records that no active rule hits, with the other rules that have a normalised match there, in order of their ids.

    `found` comes from `molecules`; unreadable strings are no records. A record's list has no more entries than there are rules."""
    active = F.col("fragment_id").isin(*(r.fragment_id for r in rules if r.status == "core"))
    rows = levels(found, rules, statuses=STATUSES)
    hit = F.collect_set(F.when(~active & (F.size("normalized") > 0), F.col("fragment_id")))
    per = rows.groupBy("smiles").agg(F.coalesce(F.sum(F.when(active, F.size("resolved"))), F.lit(0)).alias("_n"), F.array_sort(hit).alias("hits"))
    return per.filter("_n = 0").select("smiles", "hits")


def inactive_hits(rows: DataFrame, most: int = 8) -> DataFrame:
    """(fragment_id, records): the `most` inactive rules that hit most records of `uncovered_hits`, ties by id."""
    counts = rows.select(F.explode("hits").alias("fragment_id")).groupBy("fragment_id").agg(F.count(F.lit(1)).alias("records"))
    return counts.orderBy(F.desc("records"), "fragment_id").limit(most)


def audit(units: DataFrame, periods: DataFrame, sources: DataFrame, spark: SparkSession, rules) -> DataFrame:
    """Each active rule's records and resolved matches among units, and among periods with the sources these come from; zeros where none.

    `units` and `periods` are rows of `levels`, `sources` (smiles, source_smiles) says where a period comes from."""
    n = F.size("resolved")
    from_units = units.groupBy("fragment_id").agg(F.count(F.when(n > 0, 1)).alias("unit_records"), F.sum(n).cast("long").alias("unit_matches"))
    hit = periods.filter(n > 0).join(sources, "smiles")
    from_periods = hit.groupBy("fragment_id").agg(F.count(F.lit(1)).alias("period_records"), F.sum(n).cast("long").alias("period_matches"), F.count_distinct("source_smiles").alias("period_sources"))
    ids = spark.createDataFrame([(r.fragment_id, r.name, r.status) for r in rules if r.status == "core"], "fragment_id string, fragment_name string, core_status string")
    return ids.join(from_units, "fragment_id", "left").join(from_periods, "fragment_id", "left").fillna(0)


def distribution(rows: DataFrame, label: str) -> DataFrame:
    """Records and matches for each fragment and value of an attribute, commonest first."""
    return rows.groupBy("fragment_id", label).agg(F.count_distinct("smiles").alias("records"), F.count(F.lit(1)).alias("matches")).orderBy("fragment_id", F.desc("matches"), label)


def together(rows: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Records that any fragment of a group hits, each counted once, and the matches of all."""
    pairs = [F.struct(F.lit(name).alias("name"), F.col("fragment_id").isin(*ids).alias("of")) for name, ids in groups.items()]
    hit = rows.filter(F.size("resolved") > 0).select("smiles", F.size("resolved").alias("n"), F.explode(F.array(*pairs)).alias("g")).filter("g.of")
    return hit.groupBy(F.col("g.name").alias("name")).agg(F.count_distinct("smiles").alias("records"), F.sum("n").cast("long").alias("matches"))


def _label(n: Column) -> Column:
    return F.when(n["element"] != "C", n["element"]).when(n["aromatic"], "C_aromatic").otherwise("C_aliphatic")


def attributes(found: DataFrame, rules, ladders: dict, level: str = "resolved") -> DataFrame:
    """(smiles, fragment_id, match_index, environment, neighbour_signature, counts and flags of the anchor): a row for each match.

    `ladders` names for a fragment the environments as (label, role, atom test), the first that holds; rings have ring_attributes."""
    by_id = {r.fragment_id: r for r in rules if r.fragment_id in ladders}
    rows = match_rows(levels(found, rules, ("smiles", "nodes")), level).filter(F.col("fragment_id").isin(*by_id))
    nodes = F.col("nodes")
    environment, place = [], []
    for f, r in by_id.items():
        steps = " ".join(f"WHEN {patterns.holds(test, f'a[{r.place(role)}]')} THEN '{label}'" for label, role, test in ladders[f])
        environment.append(f"WHEN fragment_id = '{f}' THEN CASE {steps} END")
        place.append(f"WHEN fragment_id = '{f}' THEN {r.place(r.anchor)}")
    # within a lambda the ladders stay out of the generated code, which would outgrow what compiles
    environment = F.expr(f"transform(array(atoms), a -> CASE {' '.join(environment)} END)[0]")
    place = F.expr(f"CASE {' '.join(place)} END")
    anchor = _at(nodes, F.get("atoms", place))
    rows = rows.select("smiles", "fragment_id", "match_index", environment.alias("environment"), anchor.alias("_a"), F.transform(anchor["near"], lambda e: _at(nodes, e["to"])).alias("_near"), F.transform(anchor["near"], lambda e: F.struct(_at(nodes, e["to"]).alias("n"), e["bond"].alias("bond"))).alias("_bonds"))
    number = lambda test: F.size(F.filter("_near", test))
    # a carbonyl carbon's signature leaves out the oxygen of its double bond and has an H for each hydrogen
    of_carbonyl = F.col("fragment_id").isin(*(f for f, r in by_id.items() if r.name == "carbonyl"))
    others = F.transform(F.filter("_bonds", lambda x: ~(of_carbonyl & (x["n"]["element"] == "O") & (x["bond"] == 2))), lambda x: _label(x["n"]))
    hydrogens = F.array_repeat(F.lit("H"), F.when(of_carbonyl, F.col("_a.hydrogens")).otherwise(0))
    signature = F.array_join(F.array_sort(F.concat(others, hydrogens)), ",")
    return rows.select(
        "smiles", "fragment_id", "match_index", "environment", F.when(signature == "", "none").otherwise(signature).alias("neighbour_signature"),
        number(lambda n: (n["element"] == "C") & n["aromatic"]).alias("aromatic_carbons"), number(lambda n: (n["element"] == "C") & ~n["aromatic"]).alias("aliphatic_carbons"),
        number(lambda n: n["element"] == "*").alias("attachments"), number(lambda n: ~n["element"].isin("C", "*")).alias("heteroatoms"), number(lambda n: n["element"].isin("F", "Cl", "Br", "I")).alias("halogens"),
        F.col("_a.hydrogens").alias("hydrogens"), (F.col("_a.ring_count") > 0).alias("in_ring"), F.col("_a.aromatic").alias("aromatic"),
    )


def _topology(places: Column, size: Column) -> Column:
    """Places around a ring as `1,...`, the least over all beginnings and both directions; `none` and `mono` for fewer than two."""
    turned = lambda sign: F.transform(places, lambda a: F.array_sort(F.transform(places, lambda p: F.pmod((p - a) * sign, size) + 1)))
    least = F.array_join(F.array_min(F.concat(turned(1), turned(-1))), ",")
    return F.when(F.size(places) == 0, "none").when(F.size(places) == 1, "mono").otherwise(least)


def ring_attributes(found: DataFrame) -> DataFrame:
    """A row for each ring of the smallest set: size, kind, hetero atoms, aromaticity, fusion, substituents and attachment points."""
    nodes, ring = F.col("nodes"), F.col("ring")
    rows = found.filter("nodes is not null").select("smiles", "nodes", F.posexplode("rings").alias("ring_index", "ring"))
    hetero = F.array_sort(F.filter(F.transform(ring, lambda i: _at(nodes, i)["element"]), lambda e: e != "C"))
    aromatic = F.size(F.filter(ring, lambda i: _at(nodes, i)["aromatic"]))
    outside = lambda i, test: F.exists(_at(nodes, i)["near"], lambda e: ~F.array_contains(ring, e["to"]) & test(e))
    places = lambda test: F.transform(F.filter(F.transform(ring, lambda i, p: F.struct(i.alias("i"), p.alias("p"))), lambda x: test(x["i"])), lambda x: x["p"])
    external, exocyclic, fused = places(lambda i: outside(i, lambda e: F.lit(True))), places(lambda i: outside(i, lambda e: ~e["in_ring"])), places(lambda i: _at(nodes, i)["ring_count"] > 1)
    signs = F.transform(F.array_distinct(hetero), lambda e: F.concat(e, F.when(F.size(F.filter(hetero, lambda x: x == e)) > 1, F.size(F.filter(hetero, lambda x: x == e)).cast("string")).otherwise("")))
    points = F.aggregate(ring, F.lit(0), lambda n, i: n + F.size(F.filter(_at(nodes, i)["near"], lambda e: ~F.array_contains(ring, e["to"]) & (_at(nodes, e["to"])["element"] == "*"))))
    return rows.select(
        "smiles", "ring_index", F.size(ring).alias("ring_size"), F.when(F.size(hetero) > 0, "heterocycle").otherwise("carbocycle").alias("ring_atom_class"), F.size(hetero).alias("hetero_atom_count"), F.when(F.size(hetero) > 0, F.array_join(signs, ",")).otherwise("none").alias("hetero_atom_signature"),
        aromatic.alias("ring_aromatic_atom_count"), F.when(aromatic == F.size(ring), "fully_aromatic").when(aromatic == 0, "nonaromatic").otherwise("partially_aromatic").alias("ring_aromaticity_class"), F.exists(ring, lambda i: _at(nodes, i)["ring_count"] > 1).alias("polycyclic"),
        F.size(external).alias("external_connection_count"), _topology(external, F.size(ring)).alias("external_connection_topology"), F.size(exocyclic).alias("exocyclic_substituent_count"), _topology(exocyclic, F.size(ring)).alias("exocyclic_substituent_topology"), F.size(fused).alias("polycyclic_connection_count"), _topology(fused, F.size(ring)).alias("polycyclic_connection_topology"), points.alias("attachment_count"), F.when(points >= 2, "true").otherwise("unknown").alias("mainchain_through_ring"),
    )


# fixed values: the keys of a ring summary and the column of `ring_attributes` that each counts
RING_KEYS = {
    "ring_atom_class": "ring_atom_class", "hetero_atom_signature": "hetero_atom_signature", "aromaticity": "ring_aromaticity_class", "ring_aromatic_atom_count": "ring_aromatic_atom_count",
    "ring_aromaticity_class": "ring_aromaticity_class", "polycyclic": "polycyclic", "external_connection_count": "external_connection_count", "external_connection_topology": "external_connection_topology",
    "exocyclic_substituent_count": "exocyclic_substituent_count", "exocyclic_substituent_topology": "exocyclic_substituent_topology", "polycyclic_connection_count": "polycyclic_connection_count",
    "polycyclic_connection_topology": "polycyclic_connection_topology", "substitution_count": "exocyclic_substituent_count", "substitution_topology": "exocyclic_substituent_topology",
    "attachment_count": "attachment_count", "mainchain_through_ring": "mainchain_through_ring",
}


def ring_summary(rings: DataFrame, record: str = "smiles") -> DataFrame:
    """(key, label, records, rings): for each of RING_KEYS its values; `record_count` and `ring_count` have the label `all`.

    Null values are `unknown`. Records are counted by (key, label, record) first, so no label's records are gathered in one task;
    no rings give the two counts as zeros and nothing else."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), text(c).alias("label")) for k, c in RING_KEYS.items()), F.struct(F.lit("ring_count").alias("key"), F.lit("all").alias("label")))
    per = rings.select(F.col(record).alias("_r"), F.inline(pairs)).groupBy("key", "label", "_r").agg(F.count(F.lit(1)).alias("_n"))
    sums = per.groupBy("key", "label").agg(F.count(F.lit(1)).alias("records"), F.sum("_n").alias("rings"))
    zero = rings.sparkSession.createDataFrame([("ring_count", "all", 0, 0)], "key string, label string, records long, rings long")
    sums = sums.unionByName(zero).groupBy("key", "label").agg(F.sum("records").alias("records"), F.sum("rings").alias("rings"))
    both = sums.filter("key = 'ring_count'").select(F.lit("record_count").alias("key"), "label", "records", "rings")
    return sums.unionByName(both)
