"""What each fragment's extractor says of a match: counts around it, classes of its partners, flags two bonds away, the main chain.

Every attribute is an expression over a record's node array and one match's atoms, so a match's attributes arise in its row.
Main chain: an atom is on it if it lies on a shortest path between the two attachment points; distances are a fold over bonds.

Defined cases: null and unreadable strings have no match and so no row; a record without exactly two attachment points, or with
points that no path joins, has null for the main chain; repeated strings give rows each; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from . import fragments, periodic
from .fragments import Rule

#: The SQL of a value, given the rule; it calls the atoms of the match `a`.
Value = Callable[[Rule], str]
HALOGENS = "F,Cl,Br,I"


def _one_of(text: str) -> str:
    return f"CASE WHEN {text} THEN 'true' ELSE 'false' END"


def _label(n: str) -> str:
    return f"CASE WHEN {n}.element <> 'C' THEN {n}.element WHEN {n}.aromatic THEN 'C_aromatic' ELSE 'C_aliphatic' END"


def _each(array: str, value: Callable[[str], str]) -> str:
    n = patterns.name()
    return f"transform({array}, {n} -> {value(n)})"


def _joined(array: str) -> str:
    text = f"array_join(array_sort({array}), ',')"
    return f"coalesce(nullif({text}, ''), 'none')"


def around(*roles: str, leave: Callable[[str], str] | None = None) -> Value:
    """The nodes bound to the atoms of these roles and not among them; `leave(edge, node)` says which bonds do not count."""

    def nodes(r: Rule) -> str:
        atoms = f"array({', '.join(f'a[{r.place(x)}]' for x in roles)})"
        c, e, x = patterns.name(), patterns.name(), patterns.name()
        stays = f"NOT array_contains({atoms}, {e}.to)" + (f" AND NOT ({leave(e)})" if leave else "")
        return f"flatten(transform({atoms}, {c} -> transform(filter(nodes[{c}].near, {e} -> {stays}), {x} -> nodes[{x}.to])))"

    return nodes


def _double_oxygen(e: str) -> str:
    return f"{e}.bond = 2 AND nodes[{e}.to].element = 'O'"


def signature(near: Value, hydrogens_of: str | None = None) -> Value:
    def text(r):
        labels = _each(near(r), _label)
        more = f", array_repeat('H', nodes[a[{r.place(hydrogens_of)}]].hydrogens)" if hydrogens_of else ""
        return _joined(f"concat({labels}{more})")

    return text


def count(near: Value, test: str) -> Value:
    def number(r):
        n = patterns.name()
        return f"CAST(size(filter({near(r)}, {n} -> {patterns.atom_test(test, n)})) AS string)"

    return number


def test(role: str, body: str) -> Value:
    """Whether the atom of a role passes an atom test, which may reach over any number of bonds."""
    return lambda r: _one_of(patterns.holds(body, f"a[{r.place(role)}]"))


def field(role: str, expression: str) -> Value:
    """An expression over the node of a role, which it calls n."""

    def value(r):
        n = patterns.name()
        return f"CAST(transform(array(nodes[a[{r.place(role)}]]), {n} -> {expression.replace('n.', n + '.')})[0] AS string)"

    return value


def symbol(role: str) -> Value:
    return lambda r: _each(f"array(nodes[a[{r.place(role)}]])", _label) + "[0]"


def _class(n: str, hetero: dict[str, str], other: str) -> str:
    named = " ".join(f"WHEN {n}.element = '{k}' THEN '{v}'" for k, v in hetero.items())
    return f"CASE WHEN {n}.element = '*' THEN 'boundary' WHEN {n}.element = 'C' AND {n}.aromatic THEN 'aromatic_carbon' WHEN {n}.element = 'C' THEN 'aliphatic_carbon' {named} ELSE '{other}' END"


# fixed values: class names by element
_ACIDIC = {"S": "sulfur", "P": "phosphorus", "N": "nitrogen", "Si": "silicon"}
_ALL = {"N": "nitrogen", "O": "oxygen", "Si": "silicon", "P": "phosphorus", "S": "sulfur", "F": "halogen", "Cl": "halogen", "Br": "halogen", "I": "halogen"}


def kind(role: str, hetero: dict[str, str], other: str = "heteroatom") -> Value:
    return lambda r: _each(f"array(nodes[a[{r.place(role)}]])", lambda n: _class(n, hetero, other)) + "[0]"


def one_kind(near: Value) -> Value:
    """The class that all nodes share; mixed, or none for no node."""

    def value(r):
        x = patterns.name()
        classes = f"array_distinct({_each(near(r), lambda n: _class(n, _ALL, 'other_heteroatom'))})"
        return f"transform(array({classes}), {x} -> CASE size({x}) WHEN 0 THEN 'none' WHEN 1 THEN {x}[0] ELSE 'mixed' END)[0]"

    return value


def through(near: Value) -> Value:
    """true if two attachment points are bound to the group, else unknown."""

    def value(r):
        n = patterns.name()
        return f"CASE WHEN size(filter({near(r)}, {n} -> {n}.element = '*')) >= 2 THEN 'true' ELSE 'unknown' END"

    return value


def bond_order(first: str, second: str) -> Value:
    def value(r):
        e = patterns.name()
        order = f"filter(nodes[a[{r.place(first)}]].near, {e} -> {e}.to = a[{r.place(second)}])[0].bond"
        return f"element_at(array('single', 'double', 'triple', 'aromatic'), {order})"

    return value


def hydrogen_pattern(first: str, second: str) -> Value:
    def value(r):
        x, y = (f"nodes[a[{r.place(k)}]].hydrogens" for k in (first, second))
        return f"concat('H', least({x}, {y}), '-H', greatest({x}, {y}))"

    return value


def first_of(role: str, *steps: tuple[str, str]) -> Value:
    """The label of the first atom test that holds."""
    return lambda r: "CASE " + " ".join(f"WHEN {patterns.holds(body, f'a[{r.place(role)}]')} THEN '{label}'" for label, body in steps) + " END"


def _counts(near: Value, **tests: str) -> dict[str, Value]:
    return {name: count(near, body) for name, body in tests.items()}


_SULFONYL, _SULFINYL = (around(f"sulf{x}yl_sulfur", leave=_double_oxygen) for x in ("on", "in"))
_CARBONYL = around("carbonyl_carbon", leave=_double_oxygen)
_ALKENE, _ALKYNE, _AZO = around("alkene_carbon_1", "alkene_carbon_2"), around("alkyne_carbon_1", "alkyne_carbon_2"), around("azo_nitrogen_1", "azo_nitrogen_2")
_LINKER, _HALOGENATED, _SILICON, _PHOSPHORUS, _SULFANYL = (around(x) for x in ("secondary_nitrogen", "substituted_carbon", "silicon_atom", "phosphorus_atom", "sulfanyl_sulfur"))
_THIO = around("thiocarbonyl_carbon", leave=lambda e: f"{e}.to = a[1]")


def _two_sided(name: str, role: str) -> dict[str, Value]:
    near = around(role)
    return {f"{name}_neighbor_signature": signature(near)} | _counts(near, **{f"{name}_aromatic_neighbor_count": "#6;a", f"{name}_aliphatic_neighbor_count": "#6;A", f"{name}_dummy_attachment_count": "#0"})


def _substituents(name: str, near: Value) -> dict[str, Value]:
    return {f"{name}_substituent_signature": signature(near)} | _counts(near, **{f"{name}_carbon_attachment_count": "#6", f"{name}_hetero_attachment_count": "!#6;!#0", f"{name}_boundary_attachment_count": "#0"})


# fixed values: names of attributes; the first of each fragment is its environment, whose ladder is in core_rules
NAMES = {
    "fragment_004": ("ether_environment", _two_sided("ether", "ether_oxygen")),
    "fragment_008": ("thioether_environment", _two_sided("thioether", "thioether_sulfur")),
    "fragment_009": ("sulfonyl_environment", _substituents("sulfonyl", _SULFONYL) | {"sulfonyl_is_sulfone": test("sulfonyl_sulfur", "D4;$(*(~[#6])(~[#6])(=[#8])=[#8])")}),
    "fragment_010": ("sulfinyl_environment", _substituents("sulfinyl", _SULFINYL)),
    "fragment_011": ("nitrile_environment", {"nitrile_attached_atom_symbol": field("connected_atom_left", "n.element"), "nitrile_attached_atom_class": kind("connected_atom_left", {}), "nitrile_attached_atom_aromatic": field("connected_atom_left", "n.aromatic")}),
    "fragment_012": ("hydroxyl_environment", {
        "hydroxyl_attached_atom_symbol": symbol("attached_atom"), "hydroxyl_attached_atom_class": kind("attached_atom", _ACIDIC), "hydroxyl_attached_atom_aromatic": field("attached_atom", "n.aromatic"),
        "hydroxyl_is_phenolic": test("attached_atom", "#6;a"), "hydroxyl_is_alcohol": test("attached_atom", "#6;A"), "hydroxyl_is_heteroatom_bound": test("attached_atom", "!#6;!#0"),
    }),
    "fragment_013": ("amine_environment", {
        "amine_degree": first_of("amine_nitrogen", ("primary", "H2,H3,D0,D1"), ("secondary", "H1"), ("tertiary", "*")), "amine_heavy_neighbor_count": field("amine_nitrogen", "n.degree"),
        "amine_hydrogen_count": field("amine_nitrogen", "n.hydrogens"), "amine_in_ring": test("amine_nitrogen", "R"), "amine_aromatic": field("amine_nitrogen", "n.aromatic"),
    }),
    "fragment_014": ("carbonyl_environment", {"carbonyl_neighbor_signature": signature(_CARBONYL, "carbonyl_carbon"), "carbonyl_hydrogen_count": field("carbonyl_carbon", "n.hydrogens"), "carbonyl_dummy_attachment_count": count(_CARBONYL, "#0")}),
    "fragment_015": ("carboxylic_acid_environment", {"carboxylic_acid_connected_atom_symbol": symbol("connected_atom"), "carboxylic_acid_connected_atom_class": kind("connected_atom", {}), "carboxylic_acid_connected_atom_aromatic": field("connected_atom", "n.aromatic")}),
    "fragment_021": ("alkene_substitution_class", {"alkene_h_pattern": hydrogen_pattern("alkene_carbon_1", "alkene_carbon_2")}
        | _counts(_ALKENE, alkene_external_neighbor_count="*", alkene_carbon_substituent_count="!#0", alkene_dummy_attachment_count="#0") | {"mainchain_through_alkene": through(_ALKENE)}),
    "fragment_022": ("alkyne_environment", {"alkyne_terminal_signature": signature(_ALKYNE)} | _counts(_ALKYNE, alkyne_dummy_attachment_count="#0", alkyne_aromatic_terminal_count="#6;a") | {"mainchain_through_alkyne": through(_ALKYNE)}),
    "fragment_023": ("secondary_amine_linker_environment", {"secondary_amine_neighbor_signature": signature(_LINKER), "secondary_amine_in_ring": test("secondary_nitrogen", "R"), "secondary_amine_dummy_attachment_count": count(_LINKER, "#0")}),
    "fragment_024": ("azo_environment", {"azo_neighbor_signature": signature(_AZO)} | _counts(_AZO, azo_aromatic_neighbor_count="#6;a", azo_dummy_attachment_count="#0")),
    "fragment_025": ("halogen_environment", {"halogen_element": field("halogen_atom", "n.element"), "halogen_substituted_carbon_class": kind("substituted_carbon", {})}
        | _counts(_HALOGENATED, halogenated_carbon_halogen_count=HALOGENS, halogenated_carbon_fluorine_count="F")
        | {"halogen_is_fluorine": test("halogen_atom", "F"), "halogen_is_aromatic_substituent": test("substituted_carbon", "a"), "halogen_is_perfluoroalkyl_like": test("halogen_atom", f"F;$(*-[#6;A]~[{HALOGENS}])")}),
    "fragment_026": ("trifluoromethyl_attachment_class", {
        "trifluoromethyl_attachment_atom_symbol": symbol("connected_atom"), "trifluoromethyl_neighbor_signature": signature(lambda r: f"array(nodes[a[{r.place('connected_atom')}]], nodes[a[{r.place('trifluoromethyl_carbon')}]])"),
        "trifluoromethyl_is_aromatic_substituent": test("connected_atom", "#6;a"), "trifluoromethyl_is_perfluoroalkyl_terminal": test("connected_atom", "#6;$(*~[#9])"),
    }),
    "fragment_027": ("thiocarbonyl_environment", {
        "thiocarbonyl_neighbor_signature": signature(_THIO), "thiocarbonyl_connected_atom_class": one_kind(_THIO), "thiocarbonyl_is_thioamide_like": test("thiocarbonyl_carbon", "$(*-[#7])"),
        "thiocarbonyl_is_thiourea_like": test("thiocarbonyl_carbon", "$(*(-[#7])-[#7])"), "thiocarbonyl_is_isothiocyanate_like": test("thiocarbonyl_carbon", "$(*=[#7])"), "thiocarbonyl_dummy_attachment_count": count(_THIO, "#0"),
    }),
    "fragment_028": ("n_o_environment", {
        "n_o_bond_order": bond_order("nitrogen_atom", "oxygen_atom"), "n_o_nitrogen_class": first_of("nitrogen_atom", ("cationic_nitrogen", "+,+2"), ("aromatic_nitrogen", "a"), ("imine_nitrogen", "$(*=[#6])"), ("neutral_nitrogen", "*")),
        "n_o_oxygen_class": first_of("oxygen_atom", ("anionic_oxygen", "-,-2"), ("hydroxyl_oxygen", "!H0"), ("alkoxy_oxygen", "$(*~[#6])"), ("neutral_oxygen", "*")), "n_o_is_nitro_like": test("nitrogen_atom", "+;$(*(~[#8])~[#8]);$(*=[#8])"),
        "n_o_is_oxime_like": test("oxygen_atom", "$(*-[#7]=[#6])"), "n_o_is_hydroxylamine_like": test("oxygen_atom", "!H0;$(*-[#7])"), "n_o_is_alkoxyamine_like": test("oxygen_atom", "$(*(-[#7])~[#6])"),
    }),
    "fragment_029": ("sulfanyl_environment", {
        "sulfanyl_attached_atom_class": kind("attached_atom", _ALL, "other_heteroatom"), "sulfanyl_neighbor_signature": signature(_SULFANYL), "sulfanyl_is_aromatic": test("attached_atom", "#6;a"),
        "sulfanyl_is_aliphatic": test("attached_atom", "#6;A"), "sulfanyl_dummy_attachment_count": count(_SULFANYL, "#0"),
    }),
    "fragment_030": ("silicon_environment", {"silicon_neighbor_signature": signature(_SILICON)}
        | _counts(_SILICON, silicon_carbon_attachment_count="#6", silicon_oxygen_attachment_count="#8", silicon_halogen_attachment_count=HALOGENS, silicon_dummy_attachment_count="#0")
        | {"silicon_is_siloxane_like": test("silicon_atom", "$(*~[#8]~[Si])"), "silicon_is_silyl_aryl_like": test("silicon_atom", "$(*~[#6;a])"), "silicon_is_silyl_alkyl_like": test("silicon_atom", "$(*~[#6;A])")}),
    "fragment_031": ("phosphorus_environment", {"phosphorus_neighbor_signature": signature(_PHOSPHORUS)}
        | _counts(_PHOSPHORUS, phosphorus_oxygen_attachment_count="#8", phosphorus_nitrogen_attachment_count="#7", phosphorus_carbon_attachment_count="#6", phosphorus_halogen_attachment_count=HALOGENS, phosphorus_dummy_attachment_count="#0")
        | {"phosphorus_has_phosphoryl": test("phosphorus_atom", "$(*=[#8])"), "phosphorus_is_phosphate_like": test("phosphorus_atom", "$(*(=[#8])(~[#8])~[#8])"), "phosphorus_is_phosphazene_like": test("phosphorus_atom", "$(*=[#7])")}),
}


def with_main_chain(found: DataFrame) -> DataFrame:
    """`found` with `main_chain`: for each node whether it lies on a shortest path between the attachment points."""
    nodes = F.col("nodes")
    stars = F.transform(F.filter(nodes, lambda a: a["element"] == "*"), lambda a: a["atom_id"])
    rows = periodic.fixed(found, _one=F.get(stars, F.lit(0)), _two=F.get(stars, F.lit(1)), _stars=F.size(stars))
    step = lambda a, e: F.lit(1)
    rows = periodic.fixed(rows, _from=periodic.relaxed(nodes, F.col("_one"), step), _to=periodic.relaxed(nodes, F.col("_two"), step))
    whole = F.get("_from", F.col("_two"))
    on = F.zip_with("_from", "_to", lambda x, y: x.cast("long") + y == whole)
    joined = (F.col("_stars") == 2) & (whole < 2**31 - 1)
    return rows.withColumn("main_chain", F.when(joined, on)).drop("_one", "_two", "_stars", "_from", "_to")


def extracted(found: DataFrame, rules, ladders: dict, level: str = "resolved") -> DataFrame:
    """(smiles, fragment_id, match_index, on_main_chain, attributes: array<struct<name, value>>): a row for each match of a rule
    that has an extractor; on_main_chain says whether the anchor lies on the main chain. Values are texts."""
    by_id = {r.fragment_id: r for r in rules if r.fragment_id in NAMES}
    rows = fragments.match_rows(fragments.levels(with_main_chain(found), rules, ("smiles", "nodes", "main_chain")), level)
    rows = rows.filter(F.col("fragment_id").isin(*by_id))
    cases, places = [], []
    for f, r in by_id.items():
        environment, more = NAMES[f]
        steps = " ".join(f"WHEN {patterns.holds(body, f'a[{r.place(role)}]')} THEN '{label}'" for label, role, body in ladders[f])
        pairs = [f"named_struct('name', '{environment}', 'value', CASE {steps} END)", *(f"named_struct('name', '{k}', 'value', {v(r)})" for k, v in more.items())]
        cases.append(f"WHEN fragment_id = '{f}' THEN array({', '.join(pairs)})")
        places.append(f"WHEN fragment_id = '{f}' THEN {r.place(r.anchor)}")
    # within a lambda the expressions stay out of the generated code, which would outgrow what compiles
    attributes = F.expr(f"transform(array(atoms), a -> CASE {' '.join(cases)} END)[0]")
    on = F.expr(f"get(main_chain, get(atoms, CASE {' '.join(places)} END))")
    return rows.select("smiles", "fragment_id", "match_index", on.alias("on_main_chain"), attributes.alias("attributes"))


def values(rows: DataFrame) -> DataFrame:
    """A row for each attribute of a match: (smiles, fragment_id, match_index, name, value)."""
    return rows.select("smiles", "fragment_id", "match_index", F.inline("attributes"))


def distribution(rows: DataFrame) -> DataFrame:
    """Records and matches by fragment, attribute and value; counted over the matches of a record first."""
    per = values(rows).groupBy("smiles", "fragment_id", "name", "value").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("fragment_id", "name", "value").agg(F.count(F.lit(1)).alias("records"), F.sum("_n").alias("matches"))
