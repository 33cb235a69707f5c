"""Mixing sources to target weights by a curriculum whose weights change over training; DataFrame functions only.

Every source has a weight and a schedule: a piecewise linear multiplier over training time 0..1. The share of a source
is its weight times the integral of its schedule. A share above `cap` times the source's size stops there and the excess
goes to the others by weight. The words of a source form a stream (documents in the order of a seeded hash) which is read
up to `cap` times; the word at stream offset x gets the training time at which the source's cumulative demand reaches x,
that is the inverse of the schedule's integral. Documents are range-sorted by that position.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, the last; an empty table
gives an empty result; repeated rows are separate documents, ties in the order of the stream are broken by size; other
columns, whatever their names, pass through, except those named like an added one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words

WEIGHTS = (5.0, 2.0, 1.0)
#: For each weight its schedule, as (time, multiplier) knots: the heavy sources fade, the light ones grow.
SCHEDULES = (((0.0, 1.25), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
CAP = 3
#: Documents in a piece of a source, about. Pieces are summed apart, so that no task holds a whole source.
BUCKET_ROWS = 1 << 14


def integrals(knots: Sequence[tuple[float, float]]) -> list[float]:
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0 or w0 <= 0 or w1 <= 0:
            raise ValueError("knots rise in time and have positive multipliers")
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """(_source, _source_size) to one row per source with its target. The window without keys runs over sources, not documents."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    slot = (F.row_number().over(by_name) - 1) % len(weights)
    shares = [w * integrals(schedules[i % len(schedules)])[-1] for i, w in enumerate(weights)]
    out = sizes.withColumn("_slot", slot).withColumn("_weight", F.element_at(F.array(*map(F.lit, shares)), F.col("_slot") + 1))
    full = cap * F.col("_source_size")
    by_ratio = Window.orderBy(full / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_level", (F.sum("_source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("_weight").over(rest))
    # the level rises while sources are full and falls afterwards: its maximum is the level of those that are not full
    level = F.max("_level").over(everything)
    return out.select("_source", "_source_size", "_slot", F.least(full.cast("double"), F.col("_weight") * level).alias("_target"))


def time_of(done: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches the fraction `done` of its total."""
    total = integrals(knots)
    y, out = done * F.lit(total[-1]), F.lit(1.0)
    for (t0, w0), (t1, w1), i0, i1 in reversed(list(zip(knots, knots[1:], total, total[1:]))):
        rest = F.greatest(y - F.lit(i0), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        at = F.lit(t0) + 2 * rest / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + 2 * slope * rest))
        out = F.when(y < F.lit(i1), at).otherwise(out)
    return out


def bucket_count(rows: DataFrame) -> int:
    """Pieces of each source, in proportion to the table, so that a source of any share is in pieces of bounded size."""
    return max(1024, -(-rows.count() // BUCKET_ROWS))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, cap: int = CAP, seed: int = 17, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document with `_size`, `_source_size`, `_target`, `_taken` and `_placements`, an array of
    (copy, taken, position): the times at which it is read, the words taken then and the training position in 0..1."""
    docs = docs.drop("_size", "_source_size", "_target", "_taken", "_placements")
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    # columns travel by number, so that no name meets one of ours and those that nobody reads are not shuffled
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col(id_col).alias("_id"), F.col(source_col).alias("_of"), n_words(F.col(text_col)).alias("_size"), order.alias("_order"))
    buckets = buckets or bucket_count(rows)
    rows = rows.withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    sums = rows.groupBy(F.col("_of").alias("_source"), F.col("_bucket").alias("_b")).agg(F.sum("_size").alias("_words"))
    per_source = sums.groupBy("_source").agg(F.sum("_words").alias("_source_size"))
    earlier = Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    wanted = targets(per_source, weights, schedules, cap)
    starts = starts.join(wanted.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_words")

    inside = Window.partitionBy("_of", "_bucket").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_size").over(inside))
    rows = rows.join(starts, F.col("_of").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    offset = F.col("_start") + F.col("_upto") - F.col("_size")
    demand = F.rint("_target").cast("long")

    def placement(copy: int) -> Column:
        at = copy * F.col("_source_size") + offset
        times = [time_of(at / demand, schedules[i % len(schedules)]) for i in range(len(weights))]
        time = F.element_at(F.array(*times), F.col("_slot") + 1)
        taken = F.least(F.greatest(demand - at, F.lit(0)), F.col("_size"))
        return F.struct(F.lit(copy).alias("copy"), taken.alias("taken"), F.when(taken > 0, time).alias("position"))

    placed = F.filter(F.array(*map(placement, range(cap))), lambda p: p["taken"] > 0)
    rows = rows.withColumn("_placements", placed).withColumn("_taken", F.aggregate("_placements", F.lit(0).cast("long"), lambda s, p: s + p["taken"]))
    return rows.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)), "_size", "_source_size", "_target", "_taken", "_placements")


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per reading of a document, range-sorted by training position; the columns `_copy`, `_words` (taken) and
    `_position` are added, those of the same names replaced."""
    own = [F.col(f"`{c}`") for c in mixed.columns if c not in ("_placements", "_copy", "_words", "_position", "_p")]
    out = mixed.select(*own, F.explode("_placements").alias("_p")).select(*own, F.col("_p.copy").alias("_copy"), F.col("_p.taken").alias("_words"), F.col("_p.position").alias("_position"))
    by = [F.col("_position"), F.col("_copy")]
    return (out.repartitionByRange(partitions, *by) if partitions else out.repartitionByRange(*by)).sortWithinPartitions(*by)
