"""Repeat units as endless chains: centred expansion, shifted cuts, primitive periods, orientation and graph signatures.

All of it is expressions over a record's node array (`fragments.molecules`): units in a row are a sequence of offsets times
nodes, distances are a fold over bonds, colours a fold over rounds. Nothing is exchanged but the keys of instances where the
shifted cuts are held against the centred expansion.

Heavy atoms are numbered without the attachment points: `canonical_atom_id` 0..n-1 in the order of the string. An atom of the
chain is (canonical_atom_id, unit_offset).

Defined cases: null and unreadable strings, and such without exactly two attachment points of one bond each, of the same
bond type and on atoms that are joined through the unit, have a reason and no chain; repeated strings are records of their
own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_hash
from . import fragments
from .metrics import boundary

#: Bonds that a colour looks at around an atom.
ROUNDS = 16
#: Instances of a record: where each atom of a match lies.
_PLACES = "array<struct<canonical_atom_id:int,unit_offset:int>>"
# fixed values: symbols in the order of atomic numbers, attachment points first
_ELEMENTS = "* H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi".split()
_BOND_NAMES = ("SINGLE", "DOUBLE", "TRIPLE", "AROMATIC")


def _get(array, i) -> Column:
    return F.get(array, i)


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with columns that are worked out once.

    They come out of a generator, through which the optimizer puts no expression into another: without that, a fold would work
    its input out again for each element."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*rest, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def signature(nodes: Column) -> Column:
    """SHA-256 of sorted atoms and sorted bonds; bonds name atoms by their place in the string, so spellings differ. Null: null."""
    number = F.create_map(*(F.lit(x) for i, e in enumerate(_ELEMENTS) for x in (e, str(i))))
    flag = lambda c: c.cast("int").cast("string")
    atom = F.transform(nodes, lambda a: F.concat_ws("|", a["element"], F.coalesce(F.try_element_at(number, a["element"]), a["element"]), flag(a["aromatic"]), a["charge"].cast("string"), F.size(a["near"]).cast("string"), flag(a["ring_count"] > 0)))
    kind = F.array(*map(F.lit, _BOND_NAMES))
    bond = F.flatten(F.transform(nodes, lambda a: F.transform(F.filter(a["near"], lambda e: e["to"] > a["atom_id"]), lambda e: F.concat(a["atom_id"].cast("string"), F.lit("-"), e["to"].cast("string"), F.lit(":"), _get(kind, e["bond"] - 1), F.lit(":"), flag(e["bond"] == 4)))))
    return stable_hash(F.concat(F.array_join(F.array_sort(atom), ";"), F.lit("::"), F.array_join(F.array_sort(bond), ";")))


def relaxed(atoms: Column, start: Column, weight) -> Column:
    """Least cost from atom `start` to each; weight(atom, edge) is the cost of coming to an atom from an edge's other end.

    As many rounds as there are atoms; what can't be reached stays at the largest int."""
    far = F.lit(2**31 - 1)
    begin = F.transform(atoms, lambda a, i: F.when(i == start, 0).otherwise(far))

    def round_(cost, _):
        via = lambda a, e: F.when(_get(cost, e["to"]) == far, far).otherwise(_get(cost, e["to"]) + weight(a, e))
        return F.transform(atoms, lambda a, i: F.least(_get(cost, i), F.coalesce(F.array_min(F.transform(a["near"], lambda e: via(a, e))), far)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(atoms), F.lit(1))), begin, round_)


def chains(found: DataFrame) -> DataFrame:
    """`found` with `reason` (null where there is a chain), the unit's `atoms` without attachment points, its ends and its segments.

    Columns: atoms with near (to: number of an atom, step: -1, 0 or 1 unit on), left and right (ends), `segment` for each atom:
    how many bonds that part the unit lie between it and the left end, and `segments`, their number. A bond parts the unit if it
    lies on its path from end to end and in no ring; side groups and rings are in one segment with their atom of the path."""
    nodes = F.col("nodes")
    stars = F.transform(F.filter(nodes, lambda a: a["element"] == "*"), lambda a: a["atom_id"])
    rows = fixed(found, _one=_get(stars, F.lit(0)), _two=_get(stars, F.lit(1)), _stars=F.size(stars))
    one, two = F.col("_one"), F.col("_two")
    edge = lambda s: _get(_get(nodes, s)["near"], F.lit(0))
    number = lambda x: (x - (x > one).cast("int") - (x > two).cast("int")).cast("int")
    degree = lambda s: F.size(_get(nodes, s)["near"])
    reason = F.when(nodes.isNull(), "unreadable").when(F.col("_stars") != 2, "attachment_count").when((degree(one) != 1) | (degree(two) != 1), "attachment_degree").when(edge(one)["to"] == two, "no_atom").when(edge(one)["bond"] != edge(two)["bond"], "attachment_bonds")
    rows = fixed(rows, reason=reason, left=number(edge(one)["to"]), right=number(edge(two)["to"]))
    to = lambda e: F.when(e["to"] == one, F.col("right")).when(e["to"] == two, F.col("left")).otherwise(number(e["to"])).cast("int")
    step = lambda e: F.when(e["to"] == one, -1).when(e["to"] == two, 1).otherwise(0)
    near = lambda a: F.transform(a["near"], lambda e: F.struct(to(e).alias("to"), step(e).alias("step"), e["bond"].alias("bond"), e["in_ring"].alias("in_ring")))
    heavy = F.filter(F.when(F.col("reason").isNull(), nodes), lambda a: a["element"] != "*")
    atoms = F.transform(heavy, lambda a, i: F.struct(i.alias("id"), a["element"].alias("element"), a["aromatic"].alias("aromatic"), a["charge"].alias("charge"), a["hydrogens"].alias("hydrogens"), a["degree"].alias("degree"), a["ring_count"].alias("ring_count"), a["ring_sizes"].alias("ring_sizes"), near(a).alias("near")))
    rows = fixed(rows, atoms=atoms, unit_rings=F.transform("rings", lambda r: F.transform(r, number)))
    inside = lambda w: lambda a, e: F.when(e["step"] == 0, w(a, e)).otherwise(F.lit(1 << 20))  # noqa: E731  # within the unit only
    one_each = inside(lambda a, e: F.lit(1))
    rows = fixed(rows, _from=relaxed(F.col("atoms"), F.col("left"), one_each), _to=relaxed(F.col("atoms"), F.col("right"), one_each))
    rows = fixed(rows, _length=_get("_from", F.col("right")))
    on = lambda i: _get("_from", i) + _get("_to", i) == F.col("_length")
    parts = inside(lambda a, e: (~e["in_ring"] & on(a["id"]) & on(e["to"]) & (_get("_from", a["id"]) != _get("_from", e["to"]))).cast("int"))
    joined = F.when(F.col("reason").isNull() & (F.col("_length") >= 1 << 20), "ends_not_joined").otherwise(F.col("reason"))
    rows = fixed(rows, reason=joined, segment=relaxed(F.col("atoms"), F.col("left"), parts))
    rows = fixed(rows, segments=_get("segment", F.col("right")) + 1)
    rows = fixed(rows, **{c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("atoms", "unit_rings", "left", "right", "segment", "segments")})
    return rows.drop("_one", "_two", "_stars", "_from", "_to", "_length")


def failures(rows: DataFrame) -> DataFrame:
    """Records of `chains` that have none, by stage and reason."""
    return rows.filter("reason is not null").select(F.lit("boundary").alias("stage"), "smiles", "reason")


def _node(a: Column, number: Column, offset: Column, near: Column, segment: Column) -> Column:
    """A node as patterns read it, with its place in the chain."""
    same = ("element", "aromatic", "charge", "hydrogens", "degree", "ring_count", "ring_sizes")
    return F.struct(number.cast("int").alias("atom_id"), *(a[c].alias(c) for c in same), near.alias("near"), a["id"].cast("int").alias("canonical_atom_id"), offset.cast("int").alias("unit_offset"), segment.cast("int").alias("segment"))


def _ends(first: Column, last: Column, one: Column, two: Column) -> Column:
    """Two attachment points, numbered `one` and `two`, on the nodes `first` and `last`: what a chain is cut off with."""
    edge = lambda x: F.array(F.struct(x.cast("int").alias("to"), F.lit(1).alias("bond"), F.lit(False).alias("in_ring")))
    star = lambda number, x: F.struct(number.cast("int").alias("atom_id"), F.lit("*").alias("element"), F.lit(False).alias("aromatic"), F.lit(0).alias("charge"), F.lit(0).alias("hydrogens"), F.lit(1).alias("degree"), F.lit(0).alias("ring_count"), F.array().cast("array<int>").alias("ring_sizes"), edge(x).alias("near"), F.lit(None).cast("int").alias("canonical_atom_id"), F.lit(None).cast("int").alias("unit_offset"), F.lit(None).cast("int").alias("segment"))
    return F.array(star(one, first), star(two, last))


def expanded(rows: DataFrame, radius: int = 1, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """(keep..., nodes, rings) of units -radius..radius of each chain in a row; `rows` come from `chains`.

    Node (offset + radius) * n + canonical id; the outermost bonds end in attachment points without a place."""
    atoms, n, r = F.col("atoms"), F.size("atoms"), radius
    last = (2 * r + 1) * n

    def edges(a, k):
        target = lambda e: F.when(k + e["step"] < -r, last).when(k + e["step"] > r, last + 1).otherwise((k + e["step"] + r) * n + e["to"])
        return F.transform(a["near"], lambda e: F.struct(target(e).cast("int").alias("to"), e["bond"].alias("bond"), e["in_ring"].alias("in_ring")))

    offsets = F.sequence(F.lit(-r), F.lit(r))
    nodes = F.flatten(F.transform(offsets, lambda k: F.transform(atoms, lambda a: _node(a, (k + r) * n + a["id"], k, edges(a, k), _get("segment", a["id"])))))
    rings = F.flatten(F.transform(offsets, lambda k: F.transform("unit_rings", lambda x: F.transform(x, lambda i: ((k + r) * n + i).cast("int")))))
    whole = F.concat(nodes, _ends(F.col("left"), 2 * r * n + F.col("right"), last, last + 1))
    return fixed(rows.filter("reason is null").drop("nodes", "rings"), nodes=whole, rings=rings).select(*keep, "segments", "nodes", "rings")


def instances(rows: DataFrame, rules, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """(keep..., fragment_id, places, anchor_atom, anchor_offset, boundary, instance_key): every normalised match among nodes with places.

    The anchor is the rule's, for rings and rules without one the atom of the least canonical id. Matches that reach an end of the chain are none. The
    key names atoms by canonical id and by their offset from the anchor's unit, so equal matches of other units share it."""
    by_id = {r.fragment_id: r for r in rules}
    found = fragments.match_rows(fragments.levels(rows, rules, (*keep, "nodes")), "normalized")
    places = F.transform("atoms", lambda i: F.struct(_get("nodes", i)["canonical_atom_id"].alias("canonical_atom_id"), _get("nodes", i)["unit_offset"].alias("unit_offset")))
    found = fixed(found, places=places.cast(_PLACES)).filter(~F.exists("places", lambda p: p["unit_offset"].isNull()))
    anchored = [f"WHEN fragment_id = '{f}' THEN get(places, {r.place(r.anchor)})" for f, r in by_id.items() if r.ring_size is None and not r.derived and r.anchor in r.atom_roles]
    anchor = F.expr(f"CASE {' '.join(anchored)} ELSE array_min(places) END" if anchored else "array_min(places)")
    found = fixed(found, _a=anchor)
    own = F.transform("places", lambda p: F.struct(p["canonical_atom_id"].alias("c"), (p["unit_offset"] - F.col("_a.unit_offset")).alias("o")))
    found = fixed(found, _own=F.array_sort(own))
    found = fixed(found, boundary=boundary(F.transform("_own", lambda p: p["o"])))
    atoms = F.array_join(F.transform("_own", lambda p: F.concat(p["c"].cast("string"), F.lit("@"), p["o"].cast("string"))), ",")
    key = F.concat_ws("|", "fragment_id", F.col("_a.canonical_atom_id").cast("string"), "boundary", atoms)
    return found.select(*keep, "fragment_id", "places", F.col("_a.canonical_atom_id").alias("anchor_atom"), F.col("_a.unit_offset").alias("anchor_offset"), "boundary", key.alias("instance_key"))


def centred(rows: DataFrame, rules, radius: int = 1, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """Instances of the centred expansion that the unit itself owns, each key of a record once."""
    return instances(expanded(rows, radius, keep), rules, keep).filter("anchor_offset = 0").dropDuplicates([*keep, "instance_key"])


def shifted(rows: DataFrame, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """(keep..., shift, nodes, rings): the unit as other cuts of the chain show it, a row for each shift but 0.

    A view begins `shift` segments on and has as many as the unit; its nodes know their place in the chain."""
    wide = expanded(rows, 1, keep).withColumn("shift", F.explode(F.expr("filter(sequence(1 - segments, segments - 1), s -> s <> 0)")))
    at = lambda a: a["unit_offset"] * F.col("segments") + a["segment"]
    inside = F.filter("nodes", lambda a: a["unit_offset"].isNotNull() & (at(a) >= F.col("shift")) & (at(a) < F.col("shift") + F.col("segments")))
    wide = fixed(wide, _in=inside)
    wide = fixed(wide, _ids=F.transform("_in", lambda a: a["atom_id"]))
    n = F.size("_in")
    place = lambda x: (F.array_position("_ids", x) - 1).cast("int")
    outer = lambda e: at(_get("nodes", e["to"]))
    # the two bonds that are cut: one to a place before the view, the other beyond it; ends of the chain have no place
    before = lambda a, e: F.coalesce(outer(e) < F.col("shift"), a["unit_offset"] < 0)
    target = lambda a, e: F.when(F.array_contains("_ids", e["to"]), place(e["to"])).when(before(a, e), n).otherwise(n + 1)
    near = lambda a: F.transform(a["near"], lambda e: F.struct(target(a, e).cast("int").alias("to"), e["bond"].alias("bond"), e["in_ring"].alias("in_ring")))
    wide = fixed(wide, _view=F.transform("_in", lambda a, i: a.withField("atom_id", i.cast("int")).withField("near", near(a))))
    holder = lambda star: F.transform(F.filter("_view", lambda a: F.exists(a["near"], lambda e: e["to"] == star)), lambda a: a["atom_id"])
    view = F.concat("_view", _ends(_get(holder(n), F.lit(0)), _get(holder(n + 1), F.lit(0)), n, n + 1))
    rings = F.transform(F.filter("rings", lambda r: F.forall(r, lambda i: F.array_contains("_ids", i))), lambda r: F.transform(r, place))
    return fixed(wide, _nodes=view, _rings=rings).select(*keep, "shift", F.col("_nodes").alias("nodes"), F.col("_rings").alias("rings"))


def scanned(rows: DataFrame, rules, known: DataFrame, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """Candidates of all shifted views, mapped back into the chain, with what becomes of each.

    Columns besides those of `instances`: shift, type_known (the record has the fragment among `known`), key_known, added. A
    candidate is added if its anchor lies in the unit itself and its key is new; a new type alone adds nothing."""
    found = instances(shifted(rows, keep), rules, (*keep, "shift"))
    types = known.select(*keep, "fragment_id").distinct().withColumn("_type", F.lit(True))
    keys = known.select(*keep, "instance_key").distinct().withColumn("_key", F.lit(True))
    # keys are of the unit's own instances, so those of other units' matches tell nothing
    out = found.join(types, [*keep, "fragment_id"], "left").join(keys, [*keep, "instance_key"], "left")
    out = out.withColumn("type_known", F.col("_type").isNotNull()).withColumn("key_known", F.col("_key").isNotNull() & (F.col("anchor_offset") == 0)).drop("_type", "_key")
    return out.withColumn("added", (F.col("anchor_offset") == 0) & ~F.col("key_known"))


def united(known: DataFrame, scan: DataFrame, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """Known instances with those that the scan adds, each key of a record once; `by_scan` says which are the scan's."""
    names = [*keep, "fragment_id", "anchor_atom", "boundary", "instance_key"]
    more = scan.filter("added").select(*names).dropDuplicates([*keep, "instance_key"]).withColumn("by_scan", F.lit(True))
    return known.select(*names).withColumn("by_scan", F.lit(False)).unionByName(more)


def _coloured(atoms: Column, first, rounds) -> Column:
    """Colours of atoms after some rounds: each time a hash of an atom's colour and the sorted ones of its neighbours and bonds."""

    def round_(colour, _):
        return F.transform(atoms, lambda a, i: F.xxhash64(_get(colour, i), F.array_sort(F.transform(a["near"], lambda e: F.xxhash64(_get(colour, e["to"]), e["bond"])))))

    return F.aggregate(F.sequence(F.lit(1), rounds), F.transform(atoms, first), round_)


def colours(atoms: Column) -> Column:
    """A hash for each atom of a chain of its surroundings of ROUNDS bonds."""
    return _coloured(atoms, lambda a: F.xxhash64(a["element"], a["aromatic"], a["charge"], a["hydrogens"]), F.lit(ROUNDS))


def primitive(rows: DataFrame) -> DataFrame:
    """`rows` of `chains` with the hash of the endless chain: `primitive_hash`, `primitive_segments`, `repeats` of them in the unit.

    Atoms are coloured by their surroundings of ROUNDS bonds in the chain; a segment's label is its sorted colours. The labels'
    smallest period, read from the place and in the direction that gives the least array, is the chain. Chains whose atoms
    colours can't tell apart count as one."""
    out = fixed(rows.filter("reason is null"), _colour=colours(F.col("atoms")))
    out = fixed(out, _label=F.transform(F.sequence(F.lit(0), F.col("segments") - 1), lambda k: F.xxhash64(F.array_sort(F.filter("_colour", lambda c, i: _get("segment", i) == k)))))
    m = F.col("segments")
    places = F.sequence(F.lit(0), m - 1)
    fits = lambda p: (m % p == 0) & F.forall(places, lambda i: _get("_label", i) == _get("_label", (i + p) % m))
    out = fixed(out, primitive_segments=F.array_min(F.filter(F.sequence(F.lit(1), m), fits)))
    p = F.col("primitive_segments")
    turns = lambda labels: F.transform(F.sequence(F.lit(0), p - 1), lambda r: F.transform(F.sequence(F.lit(0), p - 1), lambda i: _get(labels, (r + i) % p)))
    out = fixed(out, _turned=F.reverse(F.slice("_label", 1, p)))
    out = fixed(out, _least=F.array_min(F.concat(turns(F.col("_label")), turns(F.col("_turned")))))
    key = stable_hash(F.array_join(F.transform("_least", lambda x: x.cast("string")), ","))
    return fixed(out, primitive_hash=key, repeats=(m / p).cast("int")).drop("_colour", "_label", "_turned", "_least")


def oriented(rows: DataFrame, given: Column | None = None) -> DataFrame:
    """`rows` of `chains` with `orientation`, `first_is_left` and `orientation_key`.

    Both directions of a unit are encoded, the attachment points marked as left and right; the smaller encoding is the key.
    orientation: `given` where that condition says whether the first point is the left one, `symmetric` where both encodings are
    equal, `chosen`, or `failed` with the reason of the chain. A symmetric unit's first point is its left one."""
    stars = F.transform(F.filter("nodes", lambda a: a["element"] == "*"), lambda a: a["atom_id"])
    out = fixed(rows, _stars=F.when(F.col("reason").isNull(), stars))
    mark = lambda a, left: F.when(a["element"] != "*", "").when(a["atom_id"] == _get("_stars", F.lit(0 if left else 1)), "left").otherwise("right")
    nodes, rounds = F.when(F.col("reason").isNull(), F.col("nodes")), F.greatest(F.size("nodes"), F.lit(1))
    coloured = lambda left: _coloured(nodes, lambda a: F.xxhash64(a["element"], a["aromatic"], a["charge"], a["hydrogens"], mark(a, left)), rounds)
    encoding = lambda left: stable_hash(F.array_join(F.transform(F.array_sort(coloured(left)), lambda c: c.cast("string")), ","))
    said = F.lit(None).cast("boolean") if given is None else given
    out = fixed(out, _first=encoding(True), _second=encoding(False), _given=F.when(F.col("reason").isNull(), said))
    first = F.coalesce(F.col("_given"), F.col("_first") <= F.col("_second"))
    state = F.when(F.col("reason").isNotNull(), "failed").when(F.col("_given").isNotNull(), "given").when(F.col("_first") == F.col("_second"), "symmetric").otherwise("chosen")
    return fixed(out, orientation=state, first_is_left=first, orientation_key=F.when(first, F.col("_first")).otherwise(F.col("_second"))).drop("_stars", "_first", "_second", "_given")


def roles_given(text: Column) -> Column:
    """Whether the first attachment point of a string is numbered 1 and the other 2 (true), the other way round (false), or neither (null)."""
    marks = F.regexp_extract_all(text, F.lit(r"\[\*:(\d+)\]"), F.lit(1))
    return F.when(marks == F.array(F.lit("1"), F.lit("2")), True).when(marks == F.array(F.lit("2"), F.lit("1")), False)
