"""Overlapping matches: of those in one exclusive group the stronger stays, with a report of what went and why.

A record's candidates of one group are folded in order of priority within a row, so a candidate is held against those that
stayed before it. Grouping brings together the candidates of one record and group, no more.

Defined cases: candidates without a group stay; null priorities come last; a candidate without atoms overlaps nothing and
stays; equal priorities are ordered by more atoms, then by key; repeated candidates overlap wholly, so one stays; null records
are a record of their own; an empty table stays empty; columns besides those named do not travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT, PRESENCE, REMOVED = "kept", "presence_only", "removed"
_DONE = "array<struct<fragment_id:string,instance_key:string,atoms:array<int>,priority:int,parent:string,children:boolean,status:string,by_fragment:string,by_key:string,overlap:double>>"


def decided(candidates: DataFrame, record: str = "record", least: float = 0.5) -> DataFrame:
    """(record, exclusive_group, fragment_id, instance_key, atoms, priority, status, by_fragment, by_key, overlap).

    candidates: record, fragment_id, instance_key, atoms, priority, exclusive_group, parent_fragment_id, allow_child_fragments.
    Two of a group clash if they share `least` of the atoms of the smaller one. The clash with the first that stayed decides:
    between parent and child, where the parent allows children, the weaker one's label stays and its instance goes
    (presence_only); else it is removed. by_fragment and by_key name the winner."""
    row = F.struct((-F.coalesce(F.col("priority"), F.lit(-(2**31) + 1))).alias("order"), (-F.coalesce(F.size("atoms"), F.lit(0))).alias("larger"), "instance_key", "fragment_id", F.coalesce(F.col("atoms").cast("array<int>"), F.array().cast("array<int>")).alias("atoms"), F.col("priority").cast("int").alias("priority"), F.col("parent_fragment_id").alias("parent"), F.coalesce(F.col("allow_child_fragments"), F.lit(False)).alias("children"))
    alone = F.when(F.col("exclusive_group").isNull(), F.col("instance_key"))  # each of no group is a group of its own
    rows = candidates.withColumn("_alone", alone).groupBy(record, "exclusive_group", "_alone").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    shared, smaller = "size(array_intersect(k.atoms, x.atoms))", "least(size(k.atoms), size(x.atoms))"
    clash = f"filter(done, k -> k.status = '{KEPT}' AND {smaller} > 0 AND {shared} >= {least} * {smaller})"
    related = "(w.parent = x.fragment_id AND x.children OR x.parent = w.fragment_id AND w.children)"
    status = f"CASE WHEN w IS NULL THEN '{KEPT}' WHEN coalesce({related}, false) THEN '{PRESENCE}' ELSE '{REMOVED}' END"
    overlap = "CAST(size(array_intersect(w.atoms, x.atoms)) AS double) / least(size(w.atoms), size(x.atoms))"
    own = "x.fragment_id AS fragment_id, x.instance_key AS instance_key, x.atoms AS atoms, x.priority AS priority, x.parent AS parent, x.children AS children"
    step = f"transform(array(get({clash}, 0)), w -> struct({own}, {status} AS status, w.fragment_id AS by_fragment, w.instance_key AS by_key, {overlap} AS overlap))"
    if_grouped = f"aggregate(_rows, CAST(array() AS {_DONE}), (done, x) -> CAST(concat(done, {step}) AS {_DONE}))"
    free = f"CAST(transform(_rows, x -> struct({own}, '{KEPT}' AS status, CAST(NULL AS string) AS by_fragment, CAST(NULL AS string) AS by_key, CAST(NULL AS double) AS overlap)) AS {_DONE})"
    done = F.expr(f"CASE WHEN exclusive_group IS NULL THEN {free} ELSE {if_grouped} END")
    return rows.select(record, "exclusive_group", F.inline(done)).drop("parent", "children")


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == KEPT).drop("status", "by_fragment", "by_key", "overlap")


def labels(rows: DataFrame, record: str = "record") -> DataFrame:
    """The fragments that a record has: those of instances that stay and those whose label alone stays."""
    return rows.filter(F.col("status") != REMOVED).select(record, "fragment_id").distinct()


def conflicts(rows: DataFrame) -> DataFrame:
    """How often each fragment gave way to which, by status, with the mean overlap."""
    return rows.filter(F.col("status") != KEPT).groupBy("exclusive_group", "fragment_id", "by_fragment", "status").agg(F.count(F.lit(1)).alias("instances"), F.avg("overlap").alias("mean_overlap"))


def atoms_shared(matches: DataFrame, record: str = "record") -> DataFrame:
    """(a, b, records, shared_atoms, mean_jaccard, mean_containment): how far two fragments cover the same atoms of a record.

    The atoms of all matches of a fragment in a record are one set; means are over the records that have both. A record has a
    row for each fragment, so a pair of them is a row for each record, no more."""
    sets = matches.filter(F.size("atoms") > 0).select(record, "fragment_id", F.explode("atoms").alias("_atom")).groupBy(record, "fragment_id").agg(F.collect_set("_atom").alias("_atoms"))
    side = lambda x: sets.select(F.col(record).alias("_r"), F.col("fragment_id").alias(x), F.col("_atoms").alias(f"_{x}"))
    both = side("a").join(side("b"), "_r").filter("a < b").withColumn("_shared", F.size(F.array_intersect("_a", "_b")))
    either = F.size("_a") + F.size("_b") - F.col("_shared")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("records"), F.sum("_shared").alias("shared_atoms"), F.avg(F.col("_shared") / either).alias("mean_jaccard"), F.avg(F.col("_shared") / F.least(F.size("_a"), F.size("_b"))).alias("mean_containment"))


def of_rules(matches: DataFrame, rules, groups: dict[str, str], parents: dict[str, str], with_children: frozenset[str] | None = None, record: str = "smiles") -> DataFrame:
    """Candidates from matches (record, fragment_id, atoms): a rule's priority, group and parent beside each.

    with_children: fragments that allow their children beside them; by default all that are somebody's parent."""
    allowed = frozenset(parents.values()) if with_children is None else with_children
    facts = matches.sparkSession.createDataFrame([(r.fragment_id, r.priority, groups.get(r.fragment_id), parents.get(r.fragment_id), r.fragment_id in allowed) for r in rules], "fragment_id string, priority int, exclusive_group string, parent_fragment_id string, allow_child_fragments boolean")
    key = F.concat_ws("|", "fragment_id", F.array_join(F.transform(F.array_sort("atoms"), lambda i: i.cast("string")), ","))
    return matches.join(F.broadcast(facts), "fragment_id").select(record, "fragment_id", "atoms", "priority", "exclusive_group", "parent_fragment_id", "allow_child_fragments", key.alias("instance_key"))  # a row for each rule
