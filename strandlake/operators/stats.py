"""Length statistics, frequencies, histograms and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CRITICAL_CHARS, length_bucket

PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def length_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Count, least, nearest-rank percentiles (index half to even), most and mean to 4 places of each group.

    Ranks are found in the histogram of distinct values, so no group's rows are sorted in one task."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(Window.partitionBy(group)))
    at = lambda p: F.min(F.when(F.col("_upto") > F.rint((F.col("_total") - 1) * F.lit(p)), F.col(value)))
    return ranked.groupBy(group).agg(F.sum("_n").alias("n"), F.min(value).alias("least"), *(at(p).alias(f"p{round(p * 100)}") for p in PERCENTILES), F.max(value).alias("most"), F.bround(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 4).alias("mean"))


def recommended_lengths(stats: DataFrame) -> DataFrame:
    return stats.withColumn("recommended", length_bucket(F.col("most")))


def top_tokens(rows: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """The k most frequent space-separated tokens; ties by the token."""
    tokens = rows.select(F.explode(F.split(text_col, " ")).alias("token")).filter("token <> ''")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(k)


def critical_chars(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """In how many rows each critical character stands."""
    sums = rows.agg(*(F.sum(F.col(text_col).contains(c).cast("long")).alias(f"c{i}") for i, c in enumerate(CRITICAL_CHARS)))
    cells = F.array(*(F.struct(F.lit(c).alias("ch"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n")) for i, c in enumerate(CRITICAL_CHARS)))
    return sums.select(F.inline(cells))


def longest(rows: DataFrame, group: str, value: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(value), key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(group, "place", key, value)


def histogram(rows: DataFrame, value: Column) -> DataFrame:
    """Counts by value with their share of all and their height against the highest."""
    counts = rows.groupBy(value.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))  # one row for each bin
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything)).withColumn("height", F.col("n") / F.max("n").over(everything) * 100)


def hash_split(rows: DataFrame, unit: Column, seed: str, parts=(("train", 205), ("valid", 230), ("test", 256))) -> DataFrame:
    """Every unit (and all its rows) to one split by the first byte of a seeded hash; parts: name and upper bound of the byte."""
    digest = F.sha2(F.concat(F.lit(seed), unit), 256)
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, 1)) - 1
    byte = 16 * digit(1) + digit(2)
    name = F.lit(parts[-1][0])
    for n, bound in reversed(parts[:-1]):
        name = F.when(byte < bound, n).otherwise(name)
    return rows.withColumn("split", name)


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split: one row with their number and that of all keys."""
    per = rows.groupBy(key).agg(F.count_distinct("split").alias("splits"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.sum(F.when(F.col("splits") > 1, 1).otherwise(0)).alias("leaked"))


def sampled(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group by a seeded hash."""
    order = Window.partitionBy(group).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def tiers(counts: DataFrame, value: str) -> DataFrame:
    n = F.col(value)
    return counts.withColumn("tier", F.when(n >= 100, "high").when(n >= 20, "medium").when(n >= 5, "low").otherwise("rare"))


def rendered_chat(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One string for each conversation: its turns in order, each with its role."""
    turn = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", turn.alias("t"))))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("rendered"))
