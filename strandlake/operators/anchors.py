"""Anchors of one atom, a bond, a ring or a set of atoms, each with one representative that says which unit owns the match.

A rule's anchor names roles of its match, for rings all atoms. The representative is the least atom by (rank, canonical atom,
offset): ranks are hashes of an atom's surroundings in the endless chain, so they don't hang on how the unit is written or cut.
A match has the same representative from whichever unit it is seen, and exactly one unit has it.

Defined cases: units without a chain have no matches; atoms that ranks can't tell apart are tied, and the canonical number
decides; a match with several members in different units is owned once; fragments without an anchor have none (null) and are
owned by no unit; repeated strings are records of their own only where `keep` tells them apart; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import periodic
from .metrics import _share, boundary
from .periodic import fixed

_MEMBERS = "array<struct<rank:bigint,canonical_atom_id:int,unit_offset:int>>"


@dataclass(frozen=True)
class Anchor:
    kind: str  # atom, bond, ring or atom_set
    roles: tuple[str, ...] = ()


def problems(rules, anchors: dict[str, Anchor]) -> list[tuple[str, str]]:
    """(fragment_id, what is wrong) for each fault of `anchors`."""
    by_id, out = {r.fragment_id: r for r in rules}, []
    for f, a in anchors.items():
        r, n = by_id.get(f), len(a.roles)
        if r is None:
            out.append((f, "unknown_fragment"))
        elif a.kind not in ("atom", "bond", "ring", "atom_set"):
            out.append((f, "unknown_anchor_type"))
        elif (a.kind == "ring") != (r.ring_size is not None):
            out.append((f, "ring_anchor_without_ring" if a.kind == "ring" else "ring_without_ring_anchor"))
        elif not {"atom": n == 1, "bond": n == 2, "ring": n == 0, "atom_set": n >= 2}[a.kind]:
            out.append((f, "number_of_roles"))
        elif not set(a.roles) <= set(r.atom_roles):
            out.append((f, "unknown_role"))
        elif len(set(a.roles)) < n:
            out.append((f, "repeated_role"))
    return out


def anchored(chains: DataFrame, rules, anchors: dict[str, Anchor], radius: int = 1, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """(keep..., fragment_id, instance_key, anchor_type, anchor_atoms, anchor_atom, anchor_offset, tied, boundary, anchor_key, anchor_class).

    A row for each match in units -radius..radius of the `periodic.chains`. `anchor_atoms` are the members as (canonical_atom_id,
    unit_offset), offsets from the representative's unit; `tied`: another member has the representative's rank; `anchor_key` names
    the anchor within the record, `anchor_class` is the same for all spellings and cuts of a chain."""
    faults = problems(rules, anchors)
    if faults:
        raise ValueError("; ".join(f"{f}: {why}" for f, why in faults))
    rows = fixed(chains.filter("reason is null"), _rank=periodic.colours(F.col("atoms")))
    found = periodic.instances(periodic.expanded(rows, radius, (*keep, "_rank")), rules, (*keep, "_rank")).drop("anchor_atom", "anchor_offset", "boundary")
    by_id = {r.fragment_id: r for r in rules}
    places = {f: ", ".join(f"places[{by_id[f].place(x)}]" for x in a.roles) for f, a in anchors.items()}
    of = [f"WHEN '{f}' THEN {f'array({p})' if p else 'places'}" for f, p in places.items()]
    kind = [f"WHEN '{f}' THEN '{a.kind}'" for f, a in anchors.items()]
    none = f"CAST(NULL AS {periodic._PLACES})"
    found = fixed(found, _set=F.expr(f"CASE fragment_id {' '.join(of)} ELSE {none} END" if of else none), anchor_type=F.expr(f"CASE fragment_id {' '.join(kind)} END" if kind else "CAST(NULL AS string)"))
    member = F.transform("_set", lambda p: F.struct(F.get("_rank", p["canonical_atom_id"]).alias("rank"), p["canonical_atom_id"], p["unit_offset"]))
    found = fixed(found, _sorted=F.array_sort(member.cast(_MEMBERS)))
    first = F.get("_sorted", F.lit(0))
    found = fixed(found, anchor_atom=first["canonical_atom_id"], anchor_offset=first["unit_offset"], tied=F.size(F.filter("_sorted", lambda x: x["rank"] == first["rank"])) > 1)
    atoms = F.transform("_sorted", lambda x: F.struct(x["canonical_atom_id"].alias("canonical_atom_id"), (x["unit_offset"] - F.col("anchor_offset")).alias("unit_offset")))
    found = fixed(found, anchor_atoms=atoms, _ranks=F.transform("_sorted", lambda x: x["rank"]))
    named = F.array_join(F.transform("anchor_atoms", lambda p: F.concat(p["canonical_atom_id"].cast("string"), F.lit("@"), p["unit_offset"].cast("string"))), ",")
    has = F.col("_set").isNotNull()
    return found.select(
        *keep, "fragment_id", "instance_key", "anchor_type", "anchor_atoms", "anchor_atom", "anchor_offset", F.when(has, F.col("tied")).alias("tied"),
        F.when(has, boundary(F.transform("anchor_atoms", lambda p: p["unit_offset"]))).alias("boundary"),
        F.when(has, F.concat_ws("|", "fragment_id", "anchor_type", named)).alias("anchor_key"), F.when(has, F.xxhash64("fragment_id", "_ranks")).alias("anchor_class"),
    )


def owned(rows: DataFrame, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """Matches whose representative lies in the unit itself, each instance of a record once."""
    return rows.filter("anchor_offset = 0").dropDuplicates([*keep, "instance_key"])


def figures(rows: DataFrame, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """For each fragment: matches and the shares that have an anchor, an untied one, and one in the unit itself; of the owned
    instances the share whose anchor another instance of the record and fragment has too."""
    n = F.count(F.lit(1))
    per = rows.groupBy("fragment_id").agg(n.alias("matches"), F.count("anchor_key").alias("_a"), F.count(F.when(~F.col("tied"), 1)).alias("_u"), F.count(F.when(F.col("anchor_offset") == 0, 1)).alias("_o"))
    meet = owned(rows, keep).groupBy(*keep, "fragment_id", "anchor_key").agg(n.alias("_k"))
    clash = meet.groupBy("fragment_id").agg(F.sum("_k").alias("owned"), F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_k"))), F.lit(0)).alias("_c"))
    out = per.join(clash, "fragment_id", "left").fillna(0, ["owned", "_c"])
    shares = {"anchor_success": ("_a", "matches"), "anchor_uniqueness": ("_u", "_a"), "anchor_in_unit": ("_o", "_a"), "anchor_conflict": ("_c", "owned")}
    return out.select("fragment_id", "matches", "owned", *(_share(F.col(a), F.col(b)).alias(name) for name, (a, b) in shares.items()))


def cut_stability(rows: DataFrame, chain: str, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """For each fragment: the chains that several records write, and the share of them whose records all have the same anchors.

    `rows` are owned anchors with a column `chain` that names the endless chain (`primitive_hash`). Anchors are counted a record
    and class, so units that hold the chain's period a different number of times differ in their counts and are told apart."""
    n = F.count(F.lit(1))
    per = rows.groupBy(chain, "fragment_id", *keep, "anchor_class").agg(n.alias("_n"))
    # a chain's records agree if each class with its count stands in all of them
    classes = per.groupBy(chain, "fragment_id", "anchor_class", "_n").agg(n.alias("_have"))
    records = per.select(chain, "fragment_id", *keep).distinct().groupBy(chain, "fragment_id").agg(n.alias("_records"))
    same = classes.join(records, [chain, "fragment_id"]).filter("_records > 1").groupBy(chain, "fragment_id").agg(F.min(F.col("_have") == F.col("_records")).alias("_same"))
    return same.groupBy("fragment_id").agg(n.alias("chains"), _share(F.count(F.when(F.col("_same"), 1)), n).alias("cut_shift_anchor_stability"))
