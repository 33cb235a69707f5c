"""Endless chains and overlapping matches: hand-checked strings, brute force and the table of decisions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import chem
from strandlake.operators import fragments, overlap, periodic
from strandlake.plans.periodic_catalog import RULES

UNITS = {
    # string: (reason, segments, repeats of the primitive chain, orientation)
    "*CCO*": (None, 3, 1, "chosen"), "*OCC*": (None, 3, 1, "chosen"), "*COC*": (None, 3, 1, "symmetric"), "*CO*": (None, 2, 1, "chosen"), "*C*": (None, 1, 1, "symmetric"),
    "*CC*": (None, 2, 2, "symmetric"), "*CCCC*": (None, 4, 4, "symmetric"), "*CCOCCO*": (None, 6, 2, "chosen"), "*CC(C)CC(C)*": (None, 4, 2, "chosen"), "*CC(C)C(C)C*": (None, 4, 1, "symmetric"),
    "*c1ccc(cc1)O*": (None, 2, 1, "chosen"), "*C1CCC(*)CC1": (None, 1, 1, "symmetric"), "*CC(*)C#N": (None, 2, 1, "chosen"), "C(*)(*)(F)F": (None, 1, 1, "symmetric"), "*=C=C=*": (None, 2, 2, "symmetric"),
    "*CC": ("attachment_count", None, None, "failed"), "*": ("attachment_count", None, None, "failed"), "C": ("attachment_count", None, None, "failed"), "*C(*)*": ("attachment_count", None, None, "failed"), "**": ("no_atom", None, None, "failed"),
    "*=CC*": ("attachment_bonds", None, None, "failed"), "C*C*": ("attachment_degree", None, None, "failed"), "*CC.C*": ("ends_not_joined", None, None, "failed"), "[R]C*": ("unreadable", None, None, "failed"), "": ("unreadable", None, None, "failed"), None: ("unreadable", None, None, "failed"),
}


@pytest.fixture(scope="module")
def chains(spark):
    return periodic.chains(fragments.molecules(spark.createDataFrame([(s,) for s in UNITS], "smiles string"))).cache()


def test_chains(spark, chains):
    got = {r.smiles: (r.reason, r.segments) for r in chains.collect()}
    assert got == {s: x[:2] for s, x in UNITS.items()}
    assert periodic.failures(chains).count() == sum(x[0] is not None for x in UNITS.values())
    assert periodic.chains(fragments.molecules(spark.createDataFrame([], "smiles string"))).count() == 0


def test_primitive_periods(chains):
    rows = periodic.primitive(chains).collect()
    assert {r.smiles: r.repeats for r in rows} == {s: x[2] for s, x in UNITS.items() if x[0] is None}
    h = {r.smiles: r.primitive_hash for r in rows}
    same = [("*C*", "*CC*", "*CCCC*"), ("*CCO*", "*OCC*", "*COC*", "*CCOCCO*")]
    assert all(len({h[s] for s in group}) == 1 for group in same)
    assert len(set(h.values())) == len(h) - sum(len(g) - 1 for g in same)


def test_orientation(spark, chains):
    rows = {r.smiles: r for r in periodic.oriented(chains).collect()}
    assert {s: r.orientation for s, r in rows.items()} == {s: x[3] for s, x in UNITS.items()}
    assert rows["*CCO*"].orientation_key == rows["*OCC*"].orientation_key and rows["*CCO*"].first_is_left != rows["*OCC*"].first_is_left
    text = spark.createDataFrame([("[*:1]CO[*:2]",), ("[*:2]CO[*:1]",), ("[*:1]CO*",)], "smiles string")
    found = periodic.oriented(periodic.chains(fragments.molecules(text)), periodic.roles_given(F.col("smiles")))
    assert {r.smiles: (r.orientation, r.first_is_left) for r in found.collect()} == {"[*:1]CO[*:2]": ("given", True), "[*:2]CO[*:1]": ("given", False), "[*:1]CO*": ("chosen", rows["*CO*"].first_is_left)}


def signed(text):
    """The signature by a plain program over atoms and bonds."""
    g = chem.parse(text)
    if g is None:
        return None
    number = {"*": 0, "C": 6, "N": 7, "O": 8, "F": 9, "S": 16, "Si": 14, "Cl": 17}
    ring = chem.ring_bonds(len(g[0]), g[1])
    inside, degree = {i for b in ring for i in b}, [sum(i in b[:2] for b in g[1]) for i in range(len(g[0]))]
    atoms = sorted(f"{a[0]}|{number[a[0]]}|{int(a[1])}|{a[2]}|{degree[i]}|{int(i in inside)}" for i, a in enumerate(g[0]))
    bonds = sorted(f"{a}-{b}:{('SINGLE', 'DOUBLE', 'TRIPLE', 'AROMATIC')[o - 1]}:{int(o == 4)}" for a, b, o in g[1])
    return hashlib.sha256((";".join(atoms) + "::" + ";".join(bonds)).encode()).hexdigest()


def test_signature(spark):
    rng = random.Random(5)
    parts = ["C", "CC", "O", "C(=O)O", "C(=O)N", "c1ccc(cc1)", "C(F)(F)", "S", "C(C#N)", "[Si](C)(C)", "[N+]", "C1CCCC1", "Cl"]
    text = ["*" + "".join(rng.choice(parts[:-1]) for _ in range(rng.randrange(1, 7))) + "*" for _ in range(200)] + ["C" * 150, "[R]", None]
    rows = fragments.molecules(spark.createDataFrame([(t,) for t in text], "smiles string")).select("smiles", periodic.signature(F.col("nodes")).alias("s")).collect()
    assert {r.smiles: r.s for r in rows} == {t: signed(t) if t else None for t in text}


def test_centred_instances_are_those_of_a_long_chain(spark):
    """Each unit owns a third of what nine units in a row have between the first and the last three, for linear units."""
    rng = random.Random(9)
    parts = ["C", "O", "C(=O)O", "S", "C(C#N)", "c1ccc(cc1)", "C(=O)N", "CC"]
    bodies = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame([(f"*{b}*", b) for b in bodies], "smiles string, body string").distinct()
    own = periodic.centred(periodic.chains(fragments.molecules(rows)), RULES).groupBy("smiles", "fragment_id").count()
    chain = lambda k: fragments.levels(fragments.molecules(rows.select(F.concat(F.lit("*"), F.repeat("body", F.lit(k)), F.lit("*")).alias("smiles"))), RULES).select("smiles", "fragment_id", F.size("normalized").alias("n"))
    long, short = ({(r.smiles, r.fragment_id): r.n for r in chain(k).collect()} for k in (9, 6))
    got = {(r.smiles, r.fragment_id): r["count"] for r in own.collect()}
    for b in bodies:
        for rule in RULES:
            f = rule.fragment_id
            assert got.get((f"*{b}*", f), 0) * 3 == long[f"*{b * 9}*", f] - short[f"*{b * 6}*", f], (b, f)


def test_scan_finds_what_the_centred_expansion_owns(spark):
    """A single unit with the shifted views has the keys of three units in a row that fit in a view, and no others."""
    text = [(s,) for s in ("*CCO*", "*OCC*", "*CO*", "*CC(=O)O*", "*CCC(=O)N*", "*C(=O)NCCO*", "*c1ccc(cc1)OC*", "*SCC(C#N)*", "*CCOCCOC*")]
    rows = periodic.chains(fragments.molecules(spark.createDataFrame(text, "smiles string")))
    unit = periodic.centred(rows, RULES, 0)
    scan = periodic.scanned(rows, RULES, unit)
    both = periodic.united(unit, scan)
    keys = lambda df: {(r.smiles, r.instance_key) for r in df.collect()}
    want = keys(periodic.centred(rows, RULES))
    assert keys(both) == {x for x in want if x[0] != "*CO*"} and both.count() == len(keys(both))
    assert {r.smiles for r in scan.filter("added").collect()} >= {"*CCO*", "*OCC*"}
    again = periodic.scanned(rows, RULES, periodic.centred(rows, RULES))
    assert again.filter("added").count() == 0 and again.filter("key_known").count() > 0


def test_decisions_on_candidates(spark):
    """The table: only an anchor in the unit itself with a new key is added, whatever its type."""
    rows = periodic.chains(fragments.molecules(spark.createDataFrame([("*CCOCO*",)], "smiles string")))
    whole = periodic.centred(rows, RULES)
    ethers = sorted(r.instance_key for r in whole.collect())
    assert len(ethers) == 2
    some = whole.filter(F.col("instance_key") == ethers[0])
    cases = {(r.type_known, r.anchor_offset, r.key_known): r.added for r in periodic.scanned(rows, RULES, some).collect()}
    assert cases[True, 0, False] and not cases[True, 0, True] and not any(v for (_, o, _), v in cases.items() if o)
    assert {o for _, o, _ in cases} == {-1, 0, 1}
    fresh = {(r.type_known, r.anchor_offset): r.added for r in periodic.scanned(rows, RULES, whole.limit(0)).collect()}
    assert fresh == {(False, -1): False, (False, 0): True, (False, 1): False}


def folded(rows, least=0.5):
    """The greedy choice as a plain loop."""
    out, kept = [], {}
    low = lambda r: (-(r[3] if r[3] is not None else -(2**31) + 1), -len(r[2] or []), r[7])
    for r in sorted(rows, key=lambda r: (str(r[0]), str(r[4]), *low(r))):
        record, f, atoms, _, group, parent, children, key = r
        own = kept.setdefault((record, group), []) if group is not None else []
        clash = next((k for k in own if atoms and k[2] and len({*k[2]} & {*atoms}) >= least * min(len(k[2]), len(atoms))), None)
        if clash is None:
            own.append(r)
            out.append((record, key, "kept", None))
        else:
            related = (clash[5] == f and bool(children)) or (parent == clash[1] and bool(clash[6]))
            out.append((record, key, "presence_only" if related else "removed", clash[7]))
    return sorted(out, key=str)


_SCHEMA = "record string, fragment_id string, atoms array<int>, priority int, exclusive_group string, parent_fragment_id string, allow_child_fragments boolean, instance_key string"


def test_overlap_is_the_greedy_choice(spark):
    rng = random.Random(3)
    rows = []
    for n in range(400):
        atoms = rng.sample(range(12), rng.randrange(0, 6))
        rows.append((rng.choice(["a", "b", "c", None]), f"f{n % 7}", rng.choice([atoms, atoms, None]), rng.choice([1, 2, 3, None]), rng.choice(["g", "h", None]), rng.choice([f"f{(n + 1) % 7}", None]), rng.choice([True, False, None]), f"k{n:03d}"))
    rows += [("d", "f", [1, 2], 5, "g", None, None, "same")] * 3
    df = spark.createDataFrame(rows, _SCHEMA).withColumns({c: F.lit("x") for c in ("status", "_rows", "done")})
    done = overlap.decided(df)
    assert sorted(((r.record, r.instance_key, r.status, r.by_key) for r in done.collect()), key=str) == folded(rows)
    assert overlap.kept(done).count() + done.filter("status <> 'kept'").count() == len(rows)
    assert overlap.conflicts(done).agg(F.sum("instances")).first()[0] == done.filter("status <> 'kept'").count()
    assert overlap.decided(df.limit(0)).count() == 0


def test_parents_keep_their_label(spark):
    rows = [("m", "carbonyl", [1, 2], 20, "acyl", None, True, "c"), ("m", "ester", [0, 1, 2, 3], 50, "acyl", "carbonyl", False, "e"), ("m", "ether", [0, 3, 4], 30, "acyl", None, False, "o")]
    done = overlap.decided(spark.createDataFrame(rows, _SCHEMA))
    assert {r.fragment_id: (r.status, r.by_fragment, r.overlap) for r in done.collect()} == {"ester": ("kept", None, None), "carbonyl": ("presence_only", "ester", 1.0), "ether": ("removed", "ester", pytest.approx(2 / 3))}
    assert {r.fragment_id for r in overlap.labels(done).collect()} == {"ester", "carbonyl"}
    strict = overlap.decided(spark.createDataFrame(rows, _SCHEMA), least=0.9)
    assert {r.fragment_id: r.status for r in strict.collect()}["ether"] == "kept"


def test_atoms_shared_by_two_fragments(spark):
    rows = [("m", "f", [1, 2]), ("m", "f", [2, 3]), ("m", "g", [3, 4]), ("n", "f", [1]), ("n", "g", [1, 2]), ("o", "g", [1]), ("o", "h", None), ("o", "h", [])]
    got = overlap.atoms_shared(spark.createDataFrame(rows, "record string, fragment_id string, atoms array<int>")).collect()
    assert [(r.a, r.b, r.records, r.shared_atoms, r.mean_jaccard, r.mean_containment) for r in got] == [("f", "g", 2, 2, pytest.approx((1 / 4 + 1 / 2) / 2), pytest.approx((1 / 2 + 1) / 2))]
