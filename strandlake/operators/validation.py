"""What went wrong with a record, how a scan, an outside data set and written outputs compare, and how well views find each other.

Defined cases: null strings and outputs can't be read; shares of nothing are 0; repeated rows count each; empty tables give no
rows where a row stands for a record, fragment or bucket, and one row of zeros where it stands for the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stars
from . import fragments, periodic
from .metrics import _share

# fixed values: the codes of failures; by the reason of a chain where there is none
CODES = (
    "PARSER_FAILED STANDARDIZATION_FAILED GRAPH_CONSTRUCTION_FAILED PERIODIC_EXPANSION_FAILED MATCH_RULE_FAILED ANCHOR_NOT_FOUND ANCHOR_NOT_UNIQUE WRONG_OWNER"
    " CANONICAL_KEY_ERROR DUPLICATE_INSTANCE NO_FRAGMENT_MATCHED SUBGRAPH_MATCH_TIMEOUT"
).split()
OF_REASON = {
    "unreadable": "PARSER_FAILED", "attachment_count": "STANDARDIZATION_FAILED", "no_atom": "GRAPH_CONSTRUCTION_FAILED", "attachment_degree": "GRAPH_CONSTRUCTION_FAILED",
    "attachment_bonds": "PERIODIC_EXPANSION_FAILED", "ends_not_joined": "PERIODIC_EXPANSION_FAILED",
}



def failure_codes(chains: DataFrame, matches: DataFrame, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """(keep..., code, failures): a row for each record and code; `matches` are `anchors.anchored` rows of the chains.

    WRONG_OWNER: an anchored instance that is seen and that no unit owns; CANONICAL_KEY_ERROR: several anchors under one key of an
    instance; DUPLICATE_INSTANCE: an instance that the unit owns more than once. Expressions neither time out nor fail by rule, so
    SUBGRAPH_MATCH_TIMEOUT never occurs and MATCH_RULE_FAILED is a fault of the rules (`rule_checks.faults`)."""
    of = F.create_map(*(F.lit(x) for pair in OF_REASON.items() for x in pair))
    none = chains.filter("reason is not null").select(*keep, F.try_element_at(of, F.col("reason")).alias("code"))
    per = matches.groupBy(*keep, "fragment_id", "instance_key").agg(
        F.count("anchor_key").alias("_a"), F.count(F.when(F.col("tied"), 1)).alias("_t"), F.count(F.when(F.col("anchor_offset") == 0, 1)).alias("_o"), F.count_distinct("anchor_key").alias("_k")
    )
    tests = {"ANCHOR_NOT_FOUND": F.col("_a") == 0, "ANCHOR_NOT_UNIQUE": F.col("_t") > 0, "WRONG_OWNER": (F.col("_a") > 0) & (F.col("_o") == 0), "CANONICAL_KEY_ERROR": F.col("_k") > 1, "DUPLICATE_INSTANCE": F.col("_o") > 1}
    codes = F.array_compact(F.array(*(F.when(t, F.lit(c)) for c, t in tests.items())))
    bad = per.select(*keep, F.explode(codes).alias("code"))
    hit = per.select(*keep).distinct()
    missed = chains.filter("reason is null").select(*keep).join(hit, list(keep), "left_anti").withColumn("code", F.lit("NO_FRAGMENT_MATCHED"))
    return none.unionByName(bad).unionByName(missed).groupBy(*keep, "code").agg(F.count(F.lit(1)).alias("failures"))


def scan_quality(found: DataFrame, truth: DataFrame, keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """For each fragment: instances found, true ones, and the shares of found ones that are false, of found rows that repeat a key, and
    of true ones that are found.

    `found` are rows with fragment_id and instance_key, `truth` those of the centred expansion; both are counted by key."""
    side = lambda t, a, b: t.select(*keep, "fragment_id", "instance_key", F.lit(a).alias("_f"), F.lit(b).alias("_t"))
    keys = side(found, 1, 0).unionByName(side(truth, 0, 1)).groupBy(*keep, "fragment_id", "instance_key").agg(F.sum("_f").alias("_f"), F.sum("_t").alias("_t"))
    got, real = F.col("_f") > 0, F.col("_t") > 0
    number = lambda test: F.count(F.when(test, 1))
    per = keys.groupBy("fragment_id").agg(number(got).alias("found"), number(real).alias("instances"), number(got & ~real).alias("_false"), F.sum("_f").alias("_rows"), number(got & real).alias("_both"))
    shares = {"false_neighbour_rate": ("_false", "found"), "ownership_accuracy": ("_both", "instances")}
    return per.select("fragment_id", "found", "instances", _share(F.col("_rows") - F.col("found"), F.col("_rows")).alias("duplicate_rate"), *(_share(F.col(a), F.col(b)).alias(n) for n, (a, b) in shares.items()))


def drift(inside: DataFrame, outside: DataFrame, records_inside: Column | int, records_outside: Column | int) -> DataFrame:
    """(fragment_id, inside_share, outside_share, drift): the records of each fragment in two data sets; `inside` and `outside` have
    (fragment_id, records), a fragment that one lacks has none there."""
    of = lambda t, c: t.select("fragment_id", F.col("records").alias(c))
    both = of(inside, "_in").join(of(outside, "_out"), "fragment_id", "full").fillna(0, ["_in", "_out"])
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)
    a, b = _share(F.col("_in"), whole(records_inside)), _share(F.col("_out"), whole(records_outside))
    return both.select("fragment_id", a.alias("inside_share"), b.alias("outside_share"), (b - a).alias("drift"))


def outside_grade(coverage: Column, anchors: Column, duplicates: Column) -> Column:
    """Green, Yellow or Red by the share of valid graphs with a fragment, of matches with an anchor and of repeated instances."""
    steady = anchors >= 0.98
    green = (coverage >= 0.85) & steady & (duplicates <= 0.01)
    return F.when(green, "Green").when((coverage >= 0.7) & steady, "Yellow").otherwise("Red")


def output_report(rows: DataFrame, target: str, output: str, bucket: Column) -> DataFrame:
    """For each bucket: outputs, and the shares that equal the target, that can be read, that have two attachment points, and that
    write the target's unit in any spelling or direction (`canonical_match`); `invalid_rate`; the mean edit distance.

    Each distinct text is read once. Units are compared by `periodic.oriented` keys; an output or target without one matches only if
    the texts are equal and can be read."""
    rows = rows.select(F.col(target).alias("_target"), F.col(output).alias("_output"), bucket.alias("bucket"))
    texts = rows.select(F.col("_target").alias("smiles")).unionByName(rows.select(F.col("_output").alias("smiles"))).filter("smiles is not null").distinct()
    read = periodic.oriented(periodic.chains(fragments.molecules(texts))).select("smiles", F.col("nodes").isNotNull().alias("_ok"), "orientation_key")
    key = lambda c: read.select(F.col("smiles").alias(c), F.col("_ok").alias(f"{c}_ok"), F.col("orientation_key").alias(f"{c}_key"))
    both = rows.join(key("_target"), "_target", "left").join(key("_output"), "_output", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    n, exact, ok = F.count(F.lit(1)), F.col("_output") == F.col("_target"), F.coalesce(F.col("_output_ok"), F.lit(False))
    share = lambda test: _share(F.count(F.when(test, 1)), n)
    same = ok & (exact | (F.col("_output_key") == F.col("_target_key")))
    return both.groupBy("bucket").agg(
        n.alias("outputs"), share(exact).alias("exact_match"), share(ok).alias("parse_validity"), share(stars(F.col("_output")) == 2).alias("two_attachment_validity"),
        share(same).alias("canonical_match"), share(~ok).alias("invalid_rate"), F.avg(F.levenshtein(text("_output"), text("_target"))).alias("edit_distance"),
    )


def _packed(rows: DataFrame, count: int, size: int, name: str, *more: str) -> DataFrame:
    """`rows` (id, vector, more) as arrays of about `size` rows, dealt by a hash of their ids."""
    parts = max(1, -(-count // size))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct("id", "vector", *more)).alias(name)).drop("_part")


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, as views of what Arrow holds."""
    return np.asarray(rows.field("id")), np.asarray(rows.field("vector").flatten()).reshape(len(rows), -1)


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of longs. Doubles have them exactly, and faster, while no sum can pass 2^53."""
    most = [max(int(v.max()), -int(v.min())) if v.size else 0 for v in (x, y)]
    if most[0] * most[1] * x.shape[1] < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _counted(batches):
    """For each query of a block against a slice: its own score if the slice has it, candidates before it, the sum and number of others.

    One pair of block and slice is worked on at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            block, rows = batch.column("block")[r].values, batch.column("slice")[r].values
            (ids, asked), (found, given) = _matrix(block), _matrix(rows)
            scores, own = _scores(asked, given), np.asarray(block.field("own"))[:, None]
            other = found[None, :] != ids[:, None]
            before = other & ((scores > own) | ((scores == own) & (found[None, :] < ids[:, None])))
            yield pa.record_batch([pa.array(ids), pa.array(before.sum(1)), pa.array((scores * other).sum(1)), pa.array(other.sum(1))], names=["id", "before", "negatives", "others"])


def retrieval(queries: DataFrame, candidates: DataFrame, block: int = 256, size: int = 4096) -> DataFrame:
    """One row: queries, the shares whose counterpart is the first and among the first five of all candidates, and the mean scores of
    counterparts and of the others.

    Both have (id, vector of longs), ids are unique, a query's counterpart is the candidate of its id; those without one, null vectors
    and null ids take no part. Ties go to the smaller id. Blocks of queries meet slices of candidates, so a task holds one block and
    one slice and returns a row for each query of the block, and every query meets every candidate."""
    clean = lambda t: t.filter("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector")
    queries, candidates = clean(queries), clean(candidates)
    pairs = queries.join(candidates.select("id", F.col("vector").alias("_c")), "id")
    own = F.aggregate(F.zip_with("vector", "_c", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    asked = pairs.select("id", "vector", own.alias("own"))
    n = asked.count()
    blocks = _packed(asked, n, block, "block", "own")
    slices = _packed(candidates, candidates.count(), size, "slice")
    # blocks against slices, not rows against rows: a stated query set against all candidates
    met = blocks.crossJoin(slices).mapInArrow(_counted, "id long, before long, negatives long, others long")
    per = met.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("before", "negatives", "others"))).join(asked.select("id", "own"), "id")
    first = lambda k: _share(F.count(F.when(F.col("before") < k, 1)), F.count(F.lit(1)))
    return per.agg(F.count(F.lit(1)).alias("queries"), first(1).alias("top1"), first(5).alias("top5"), F.coalesce(F.avg("own"), F.lit(0.0)).alias("mean_positive"), _share(F.sum("negatives"), F.sum("others")).alias("mean_negative"))
