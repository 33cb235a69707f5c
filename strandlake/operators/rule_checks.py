"""Checks of rule tables: a row for each rule, its faults as rows, the share of rules that pass each check, examples that fail.

All but the reading of patterns is columns and joins by id, so a table of rules may have any number of rows; each distinct
pattern is read once, in batches.

Defined cases: a null field is missing, and the checks that need it say nothing more; a rule that stands twice has the fault
`duplicate_fragment_id` in each of its rows and its other faults once a row; rules without an id are rules of their own; no
rules give no faults and shares of 0; columns besides those of FIELDS play no part.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from . import fragments
from .metrics import _share

# fixed values: the fields of a rule, and what the fields with a registry may name
FIELDS = (
    "fragment_id fragment_name version category semantic_tags match_type pattern atom_roles anchor_type anchor_role ownership_rule periodic_radius"
    " allow_boundary_crossing enable_cut_shift_scan max_cut_shift dedup_key_fields exclusive_group priority allow_child_fragments"
).split()
MATCH_TYPES = ("smarts", "rdkit_ring", "derived_view")
ANCHOR_TYPES = ("atom", "bond", "ring", "atom_set")
OWNERSHIP_RULES = ("anchor_in_RU0", "representative_anchor_in_RU0")
DEDUP_FIELDS = ("fragment_id", "anchor_type", "anchor_role", "anchor_canonical_id_in_RU0", "atom_role_pattern", "boundary_pattern", "local_context_signature")
MAX_PERIODIC_RADIUS = 2
#: Fields that only rules with a pattern must have.
OF_PATTERNS = ("pattern", "atom_roles", "anchor_role")


def _maps(pattern: pd.Series) -> pd.Series:
    """The map numbers of each pattern, null where it can't be read."""

    def of(text):
        try:
            return [m for m in patterns.read(text).maps if m]
        except ValueError:
            return None

    return pattern.map(of, na_action="ignore")


def roles_of(atom_roles: Column, atoms: Column) -> Column:
    """A map from role to atom: `atom_roles` names the role of each map number, `atoms` are a match's atoms in their order.

    A role that stands twice keeps its last atom; a number beyond the atoms has none."""
    pairs = F.transform(F.array_sort(F.map_entries(atom_roles)), lambda e: F.struct(e["value"].alias("k"), F.get(atoms, e["key"].cast("int") - 1).alias("v")))
    last = F.filter(pairs, lambda x: x["v"].isNotNull())
    return F.map_from_entries(F.filter(last, lambda x, i: ~F.exists(F.slice(last, i + 2, F.greatest(F.size(last) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"])))


def _checks(has_pattern: Column) -> dict[str, Column]:
    """Each check of a single row by the name of its fault; true where it fails, null where a field it needs is missing."""
    c = F.col
    radius, maps, roles = c("periodic_radius"), c("_maps"), c("atom_roles")
    out = {f"missing_field:{f}": c(f).isNull() & (has_pattern if f in OF_PATTERNS else F.lit(True)) for f in FIELDS}
    out |= {
        "unknown_match_type": ~c("match_type").isin(*MATCH_TYPES),
        "pattern_does_not_compile": has_pattern & c("pattern").isNotNull() & maps.isNull(),
        "map_ids_differ_from_roles": has_pattern & (F.array_sort(maps) != F.array_sort(F.transform(F.map_keys(roles), lambda x: x.cast("int")))),
        "anchor_role_not_in_roles": has_pattern & ~F.array_contains(F.map_values(roles), c("anchor_role")),
        "unknown_anchor_type": ~c("anchor_type").isin(*ANCHOR_TYPES),
        "unknown_ownership_rule": ~c("ownership_rule").isin(*OWNERSHIP_RULES),
        "periodic_radius_negative": radius < 0,
        "periodic_radius_too_large": radius > MAX_PERIODIC_RADIUS,
        "boundary_crossing_requires_radius_ge_1": c("allow_boundary_crossing") & (radius == 0),
        "max_cut_shift_negative": c("max_cut_shift") < 0,
        "unknown_dedup_key_field": F.size(F.array_except("dedup_key_fields", F.array(*map(F.lit, DEDUP_FIELDS)))) > 0,
    }
    return out


def faults(rules: DataFrame) -> DataFrame:
    """(fragment_id, problem): a row for each fault of each row of `rules`, whose columns are FIELDS and `parent_fragment_ids`."""
    rows = rules.select(*FIELDS, "parent_fragment_ids")
    read = F.pandas_udf(_maps, "array<int>")
    texts = rows.filter("match_type = 'smarts' AND pattern IS NOT NULL").select("pattern").distinct().withColumn("_maps", read("pattern"))
    held = rows.join(texts, "pattern", "left")
    checks = _checks(F.col("match_type").eqNullSafe("smarts"))
    failed = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())), lambda x: x.isNotNull())
    single = held.select("fragment_id", F.explode(failed).alias("problem"))
    # ids are counted on the map side first, so one that stands in a third of the rows is no hot key; the rows are joined after
    counts = rows.filter("fragment_id IS NOT NULL").groupBy("fragment_id").agg(F.count(F.lit(1)).alias("_n"))
    twice = counts.filter("_n > 1").select("fragment_id", F.explode(F.expr("array_repeat('duplicate_fragment_id', CAST(_n AS INT))")).alias("problem"))
    named = rules.select("fragment_id", F.explode("parent_fragment_ids").alias("_parent")).filter("_parent IS NOT NULL")
    own = named.filter("_parent = fragment_id").select("fragment_id", F.lit("own_parent").alias("problem"))
    unknown = named.join(counts.select(F.col("fragment_id").alias("_parent")), "_parent", "left_anti").select("fragment_id", F.lit("unknown_parent").alias("problem"))
    return single.unionByName(twice).unionByName(own).unionByName(unknown)


def valid(rules: DataFrame) -> DataFrame:
    """The rules without a fault; of a rule that stands twice no row stays. A rule without an id has a fault."""
    return rules.join(faults(rules).select("fragment_id").distinct(), "fragment_id", "left_anti").filter("fragment_id IS NOT NULL")


def validity(rules: DataFrame) -> DataFrame:
    """(problem, rules, failures, valid_rate): each fault found, and the row `any`, with the share of rows that don't have it."""
    total = rules.agg(F.count(F.lit(1)).alias("rules"))
    found = faults(rules)
    each = found.groupBy("problem").agg(F.count(F.lit(1)).alias("failures"))
    kept = valid(rules).agg(F.count(F.lit(1)).alias("_kept"))
    whole = total.crossJoin(kept).select(F.lit("any").alias("problem"), (F.col("rules") - F.col("_kept")).alias("failures"))  # one row each
    rows = each.unionByName(whole).crossJoin(F.broadcast(total))  # a single row
    return rows.select("problem", "rules", "failures", _share(F.col("rules") - F.col("failures"), F.col("rules")).alias("valid_rate"))


def example_failures(examples: DataFrame, rules) -> DataFrame:
    """(fragment_id, smiles, expected, matches): examples (fragment_id, smiles, expected) that a rule matches and shouldn't, or the reverse.

    Matches are raw. A string that can't be read and an example of an unknown rule match nothing; repeated examples fail each."""
    core = [r for r in rules if not r.derived]
    strings = examples.select("smiles").distinct()
    found = fragments.levels(fragments.molecules(strings), core, statuses=fragments.STATUSES).select("smiles", "fragment_id", F.size("raw").alias("matches"))
    rows = examples.join(found, ["smiles", "fragment_id"], "left").fillna(0, ["matches"])
    return rows.filter(~(F.col("expected") == (F.col("matches") > 0))).select("fragment_id", "smiles", "expected", "matches")
