"""Metrics over matches, views, predictions and outputs, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stars


#: Rows that a task counts by key, about.
TASK_ROWS = 1_000_000


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def boundary(offsets: Column) -> Column:
    """Where a match lies by the unit offsets of its atoms: within a unit, across one of its ends or both, or over several."""
    least, most = F.array_min(offsets), F.array_max(offsets)
    near = (least >= -1) & (most <= 1)
    return F.when((least == 0) & (most == 0), "internal").when(near & (least == -1) & (most == 0), "cross_left").when(near & (least == 0) & (most == 1), "cross_right").when((least < 0) & (most > 0), "cross_both").otherwise("multi_period")


def owned(matches: DataFrame, anchor_offset: str = "anchor_offset") -> DataFrame:
    """Matches whose anchor lies in the unit itself."""
    return matches.filter(F.col(anchor_offset) == 0)


def instances(matches: DataFrame, parts: list[str], key: str = "instance_key") -> DataFrame:
    """Each instance once, by a key of its parts joined by `|`; null parts are empty."""
    return matches.withColumn(key, F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))).dropDuplicates([key])


def key_quality(rows: DataFrame, instance: str, key: str) -> DataFrame:
    """One row: keys, those that several instances share, and instances that have several keys."""
    by_key = rows.groupBy(key).agg(F.count_distinct(instance).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("collisions"))
    by_instance = rows.groupBy(instance).agg(F.count_distinct(key).alias("n")).agg(F.count(F.lit(1)).alias("instances"), F.count(F.when(F.col("n") > 1, 1)).alias("unstable"))
    return by_key.crossJoin(by_instance)  # one row each


def presence(rows: DataFrame, record: str, label: str, labels: list[str]) -> DataFrame:
    """A row for each record with a 0 or 1 for each label; a null label is none of them."""
    return rows.groupBy(record).agg(*(F.coalesce(F.max((F.col(label) == x).cast("int")), F.lit(0)).alias(x) for x in labels))


def stability(a: DataFrame, b: DataFrame, record: str, key: str) -> DataFrame:
    """One row: how two views of the same records agree: records, presence, mean Jaccard of their keys, equal counts.

    Keys are counted one by one, so no record's keys are gathered. A null record is one record, a null key one key. Rows are dealt
    over as many partitions as their number asks for before they are counted, so what a task holds doesn't grow with the input."""
    side = lambda t, x, y: t.select(record, key, F.lit(x).alias("_x"), F.lit(y).alias("_y"))
    rows = side(a, 1, 0).unionByName(side(b, 0, 1))
    # read twice, the first time for its number alone
    parts = max(1, -(-rows.count() // TASK_ROWS))
    both = rows.repartition(parts, record, key).groupBy(record, key).agg(F.sum("_x").alias("_a"), F.sum("_y").alias("_b"))
    has = lambda c: F.count(F.when(F.col(c) > 0, 1))
    per = both.repartition(parts, record).groupBy(record).agg(F.count(F.when((F.col("_a") > 0) & (F.col("_b") > 0), 1)).alias("shared"), F.count(F.lit(1)).alias("either"), has("_a").alias("in_a"), has("_b").alias("in_b"), F.min(F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))
    return per.agg(
        F.count(F.lit(1)).alias("records"),
        _share(F.count(F.when(F.col("shared") == F.col("either"), 1)), F.count(F.lit(1))).alias("presence_consistency"),
        F.coalesce(F.avg(F.col("shared") / F.col("either")), F.lit(0.0)).alias("key_jaccard"),
        _share(F.count(F.when(F.col("same"), 1)), F.count(F.lit(1))).alias("count_consistency"),
        _share(F.sum(F.col("in_b") - F.col("shared")), F.sum("in_b")).alias("new_key_rate"),
    )


def redundant(members: DataFrame, label: str, record: str, least: float = 0.95) -> DataFrame:
    """Ordered pairs (a, b) of labels where b is on at least `least` of a's records; joined by record, whose labels are few."""
    m = members.select(F.col(label).alias("a"), F.col(record).alias("_r")).distinct()
    sizes = m.groupBy("a").agg(F.count(F.lit(1)).alias("records"))
    both = m.join(m.select(F.col("a").alias("b"), "_r"), "_r").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return both.join(sizes, "a").withColumn("share", F.col("shared") / F.col("records")).filter(F.col("share") >= least).orderBy(F.desc("share"), "a", "b")


def multilabel(truth: DataFrame, found: DataFrame, record: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Precision, recall and F1: a row for each label, and one row with the micro and macro figures."""
    sides = truth.select(record, label).distinct().withColumn("_t", F.lit(1)).join(found.select(record, label).distinct().withColumn("_f", F.lit(1)), [record, label], "full")
    hit = F.count(F.when(F.col("_t").isNotNull() & F.col("_f").isNotNull(), 1))
    per = sides.groupBy(label).agg(hit.alias("hits"), F.count("_t").alias("wanted"), F.count("_f").alias("given"))
    f1 = lambda h, w, g: _share(2 * h, w + g)
    cols = F.col("hits"), F.col("wanted"), F.col("given")
    per = per.withColumns({"precision": _share(cols[0], cols[2]), "recall": _share(cols[0], cols[1]), "f1": f1(*cols)})
    total = [F.sum(c) for c in cols]
    whole = per.agg(_share(total[0], total[2]).alias("micro_precision"), _share(total[0], total[1]).alias("micro_recall"), f1(*total).alias("micro_f1"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    return per, whole


def output_validity(rows: DataFrame, target: str, output: str, bucket: Column) -> DataFrame:
    """For each bucket: outputs, exact matches, those with two attachment points, empty ones, and the mean edit distance."""
    n = F.count(F.lit(1))
    return rows.groupBy(bucket.alias("bucket")).agg(
        n.alias("outputs"),
        _share(F.count(F.when(F.col(output) == F.col(target), 1)), n).alias("exact_match"),
        _share(F.count(F.when(stars(F.col(output)) == 2, 1)), n).alias("two_attachments"),
        _share(F.count(F.when(F.coalesce(F.col(output), F.lit("")) == "", 1)), n).alias("empty"),
        F.avg(F.levenshtein(F.coalesce(F.col(output), F.lit("")), F.coalesce(F.col(target), F.lit("")))).alias("edit_distance"),
    )


def graded(stages: DataFrame, green: float = 0.95, yellow: float = 0.8) -> DataFrame:
    """Stages (stage, attempted, succeeded) with their rate and a grade by it."""
    rate = _share(F.col("succeeded"), F.col("attempted"))
    return stages.withColumn("rate", rate).withColumn("grade", F.when(rate >= green, "Green").when(rate >= yellow, "Yellow").otherwise("Red"))
