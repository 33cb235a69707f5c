"""Identity levels of strings with provenance: grouping, classes, rollups, identifiers, funnel, failed cases.

Groups of any size stay safe: counts and smallest examples are kept by partial aggregates, never a whole group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attachments_normalised, padded_id, record_type, stars

CANDIDATES = ("monomer_or_descriptor_record", "copolymer_candidate")


def by_string(records: DataFrame) -> DataFrame:
    """One row per distinct string: its records, distinct categories, and the values of the least and the greatest `ord`.

    Null values are passed over. Of records with the same `ord` the first in the table counts, at both ends: `place` says where each
    stands. Records without a `place` leave that open."""
    place = ["place"] if "place" in records.columns else []
    # null orders are passed over by min_by
    end = lambda order: F.min_by("value", F.when(F.col("value").isNotNull() & F.col("ord").isNotNull(), F.struct(order.alias("ord"), *place)))
    return records.groupBy("smiles").agg(
        F.count(F.lit(1)).alias("property_record_count"),
        F.count_distinct("property_category").alias("categories"),
        end(F.col("ord")).alias("first_value"),
        end(-F.col("ord")).alias("last_value"),
    )


def classified(strings: DataFrame) -> DataFrame:
    """Adds the normalised string and the record's class."""
    # within a lambda the normalised text is bound once; a pushed-down filter would repeat it beyond what compiles
    return strings.withColumn("normalized", attachments_normalised(F.col("smiles"))).withColumn("record_type", F.transform(F.array("normalized"), record_type)[0])


def type_counts(strings: DataFrame) -> DataFrame:
    return classified(strings).groupBy("record_type").agg(F.count(F.lit(1)).alias("raw_unique"), F.count_distinct("normalized").alias("normalized_unique"))


def star_distribution(rows: DataFrame) -> DataFrame:
    """How many rows, and how many distinct strings, have each number of attachment points."""
    def level(df, name):
        return df.groupBy(stars(F.col("smiles")).alias("stars")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(name))

    return level(rows, "row").unionByName(level(rows.select("smiles").distinct(), "distinct")).select("level", "stars", "n")


def smallest(value: str, n: int) -> Column:
    """The n smallest values of a group of distinct ones."""
    return F.slice(F.array_sort(F.collect_set(value)), 1, n)


def level2(strings: DataFrame, examples: int = 5) -> DataFrame:
    """Rollup by normalised string: how many spellings and records, and the first spellings in order."""
    main = classified(strings).filter(F.col("record_type") == "main_repeat_unit")
    ranked = main.withColumn("_place", F.row_number().over(Window.partitionBy("normalized").orderBy("smiles")))
    return ranked.groupBy("normalized").agg(
        F.count(F.lit(1)).alias("raw_unique_count"),
        F.sum("property_record_count").alias("property_record_count"),
        F.array_join(smallest_of(F.col("smiles"), F.col("_place") <= examples), "|").alias("examples"),
    )


def smallest_of(value: Column, keep: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(keep, value)))


def with_ids(rows: DataFrame, key: str, prefix: str, name: str) -> DataFrame:
    """Zero-padded identifiers by the rank of a distinct key, without sorting everything in one task.

    Range partitions are numbered, counted, and offset by the counts of those before."""
    parts = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    counted = parts.withColumn("_place", inside)
    sizes = counted.groupBy("_part").agg(F.max("_place").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return counted.join(F.broadcast(starts), "_part").withColumn(name, padded_id(prefix, F.col("_place") + F.col("_start"))).drop("_part", "_place", "_start")


def funnel(records: DataFrame) -> DataFrame:
    """One row with the number of records left at each level."""
    rows = classified(records.select("smiles"))
    main = F.col("record_type") == "main_repeat_unit"
    return rows.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_distinct("smiles").alias("raw_unique"),
        F.count_distinct(F.when(main, F.col("smiles"))).alias("main_unique"),
        F.count_distinct(F.when(main, F.col("normalized"))).alias("normalized_unique"),
        F.count_distinct(F.when(F.col("record_type") == "parser_failed", F.col("smiles"))).alias("parser_failures"),
    )


def failed_cases(strings: DataFrame) -> DataFrame:
    """Rejected strings; what may be a monomer or copolymer is no failure."""
    rows = classified(strings)
    bad = rows.filter((F.col("record_type") != "main_repeat_unit") & ~F.col("record_type").isin(*CANDIDATES))
    return bad.select(F.lit("phase_0_cleaning").alias("stage"), "record_type", F.col("smiles").alias("raw_smiles"), F.col("normalized").alias("attachment_normalized_smiles"))


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows, as often: one row."""
    extra = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right")))
    return extra.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
