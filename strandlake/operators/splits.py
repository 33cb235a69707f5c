"""Splits without leakage: records that share a key of any kind, directly or over others, go to one split together.

Keys are rows (record, kind, key). Components are found by least labels with pointer jumping; every round is a shuffle of keys
aggregated on the map side, and its result is checkpointed, so that neither plans nor lineage grow.

Defined cases: null keys link nothing; null records are left out; repeated rows count once; a record without a key is a
component of its own if it stands in `records`; an empty table stays empty.
"""

from __future__ import annotations

import tempfile
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import hash_split

#: Keys with more than this share of rows (a thousand keys at most) are looked up by broadcast, if they have HOT_ROWS rows.
HOT_SHARE, HOT_ROWS = 0.001, 100_000
# fixed values: splits with the upper bound of the first byte of their hash, for 70, 15 and 15 percent
PARTS = (("build", 179), ("validation", 218), ("stress", 256))


def _cut(rows: DataFrame) -> DataFrame:
    """`rows` without lineage, in the shared folder that the cluster names; a folder of its own only on a local master."""
    context = rows.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: components need a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandlake-"))
    return rows.checkpoint()


def _looked_up(rows: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """`rows` with the column `name` of `table` (key, name; keys are unique).

    Hot keys are at most 1 / HOT_SHARE, so theirs is the only part of the table that is broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))
    hot = counts.crossJoin(total).filter((F.col("_n") > F.col("_all") * HOT_SHARE) & (F.col("_n") > HOT_ROWS)).select(key)  # total is one row
    hot = F.broadcast(hot)
    often = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key)
    return rows.join(hot, key, "left_anti").join(table, key).unionByName(often.select(*rows.columns, name))


def components(keys: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(record, component): the least record that can be reached over shared keys, itself included."""
    rows = keys.filter("record is not null").select("record", "kind", "key")
    whole = rows.select("record") if records is None else rows.select("record").unionByName(records.filter("record is not null").select("record"))
    rows = rows.filter("key is not null").select("record", F.struct("kind", "key").alias("_k"))
    hubs = rows.groupBy("_k").agg(F.min("record").alias("hub"))
    star = _looked_up(rows, "_k", hubs, "hub").filter("record <> hub").select("record", "hub").distinct()
    links = _cut(star.unionByName(star.select(F.col("hub").alias("record"), F.col("record").alias("hub"))))
    labels = _cut(whole.distinct().withColumn("label", F.col("record")))
    while True:
        of = labels.select(F.col("record").alias("hub"), F.col("label").alias("_least"))
        near = _looked_up(links, "hub", of, "_least").groupBy("record").agg(F.min("_least").alias("_least"))
        least = labels.join(near, "record", "left").select("record", F.col("label").alias("_old"), F.least("label", "_least").alias("label"))
        least = _cut(least)
        if least.filter("label < _old").isEmpty():
            return labels.select("record", F.col("label").alias("component"))
        jump = least.select(F.col("record").alias("label"), F.col("label").alias("_next"))
        labels = _cut(_looked_up(least.select("record", "label"), "label", jump, "_next").select("record", F.least("label", "_next").alias("label")))


def by_component(found: DataFrame, seed: str, parts=PARTS) -> DataFrame:
    """(record, component, split): a component goes whole to the split that the hash of its name gives."""
    return hash_split(found, F.col("component").cast("string"), seed, parts)


def shared(keys: DataFrame, split: DataFrame, kinds, names=tuple(n for n, _ in PARTS)) -> DataFrame:
    """(kind, left, right, keys, shared): for each kind and pair of splits the keys of both and how many stand in both.

    A leak is a shared key. Pairs and kinds without keys have zeros. A key's row holds its splits, no more than there are."""
    spark: SparkSession = keys.sparkSession
    rows = keys.filter("key is not null").join(split.select("record", "split"), "record").select("kind", "key", "split").distinct()
    sets = rows.groupBy("kind", "key").agg(F.collect_set("split").alias("_in"))
    pairs = spark.createDataFrame([(k, a, b) for k in kinds for a, b in combinations(names, 2)], "kind string, left string, right string")
    has = lambda c: F.array_contains("_in", F.col(c))
    counts = sets.join(F.broadcast(pairs), "kind").groupBy("kind", "left", "right").agg(
        F.sum((has("left") | has("right")).cast("long")).alias("keys"), F.sum((has("left") & has("right")).cast("long")).alias("shared"))
    return pairs.join(counts, ["kind", "left", "right"], "left").fillna(0, ["keys", "shared"])
