"""Rules over texts: matches, keep-first normalisation, suppression by covering rules, coverage, selection, overlap.

Each record meets each rule of a small literal list in one projection; what follows is joins and groups by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextRule:
    fragment_id: str
    category: str
    pattern: str
    status: str = "core"
    anchor: str = r"^.*$"  # what of a match is its anchor
    covered_by: tuple[str, ...] = ()


RULES = (
    TextRule("TXT_EMAIL", "contact", r"[a-z0-9._]+@[a-z0-9.]+"),
    TextRule("TXT_IPV4", "network", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", anchor=r"^[0-9]+"),
    TextRule("TXT_NUMBER", "number", r"[0-9]+", covered_by=("TXT_IPV4",)),
    TextRule("TXT_LICENSE", "legal", r"licen[sc]e"),
    TextRule("TXT_THE", "generic", r" the "),
    TextRule("TXT_AT", "symbol", r"@", status="derived_attribute"),
)


def matches(rows: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record_id, fragment_id, match_index, value, anchor): all matches of all rules."""
    found = F.array(*(F.struct(F.lit(r.fragment_id).alias("fragment_id"), F.lit(r.anchor).alias("_anchor"), F.regexp_extract_all(F.col(text_col), F.lit(r.pattern), F.lit(0)).alias("values")) for r in rules))
    one = rows.select(F.col(id_col).alias("record_id"), F.explode(found).alias("_r")).select("record_id", "_r.*")
    one = one.select("record_id", "fragment_id", "_anchor", F.posexplode("values").alias("match_index", "value"))
    anchor = F.col("value")
    for r in rules:
        if r.anchor != TextRule.anchor:
            anchor = F.when(F.col("fragment_id") == r.fragment_id, F.regexp_extract("value", r.anchor, 0)).otherwise(anchor)
    return one.select("record_id", "fragment_id", "match_index", "value", anchor.alias("anchor"))


def normalised(found: DataFrame) -> DataFrame:
    """The first match for each record, rule and value."""
    return found.groupBy("record_id", "fragment_id", "value").agg(F.min("match_index").alias("match_index"), F.min("anchor").alias("anchor"))


def resolved(normal: DataFrame, rules=RULES) -> DataFrame:
    """Without matches whose anchor a covering rule's normalised match has in the same record; only core rules stay."""
    active = [r.fragment_id for r in rules if r.status == "core"]
    pairs = [(r.fragment_id, c) for r in rules for c in r.covered_by]
    rows = normal.filter(F.col("fragment_id").isin(*active))
    if not pairs:
        return rows
    spark = normal.sparkSession
    covers = spark.createDataFrame(pairs, "fragment_id string, covering string")
    by = normal.join(F.broadcast(covers), normal["fragment_id"] == covers["covering"]).select("record_id", covers["fragment_id"], "anchor").distinct()
    return rows.join(by, ["record_id", "fragment_id", "anchor"], "left_anti")


def coverage(found: DataFrame, spark: SparkSession, rules=RULES) -> DataFrame:
    """Records and matches of each rule, zero ones included."""
    ids = spark.createDataFrame([(r.fragment_id, r.category) for r in rules], "fragment_id string, category string")
    counts = found.groupBy("fragment_id").agg(F.count_distinct("record_id").alias("records"), F.count(F.lit(1)).alias("matches"))
    return ids.join(counts, "fragment_id", "left").fillna(0, ["records", "matches"])


def tri_level(raw: DataFrame, spark: SparkSession, rules=RULES) -> DataFrame:
    """Hits, matches and the most of one record, raw, normalised and resolved, for each rule."""
    normal = normalised(raw)
    levels = None
    for name, rows in (("raw", raw), ("normalized", normal), ("resolved", resolved(normal, rules))):
        per = rows.groupBy("record_id", "fragment_id").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(name))
        levels = per if levels is None else levels.unionByName(per)
    sums = []
    for name in ("raw", "normalized", "resolved"):
        n = F.when(F.col("level") == name, F.col("n"))
        sums += [F.count(n).alias(f"{name}_hits"), F.coalesce(F.sum(n), F.lit(0)).alias(f"{name}_matches"), F.coalesce(F.max(n), F.lit(0)).alias(f"{name}_max")]
    out = levels.groupBy("fragment_id").agg(*sums)
    ids = spark.createDataFrame([(r.fragment_id,) for r in rules], "fragment_id string")
    return ids.join(out, "fragment_id", "left").fillna(0)


def coverage_summary(records: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """How many rule types a record has, those without any included; zeros for no records."""
    types = found.groupBy("record_id").agg(F.count_distinct("fragment_id").alias("types"))
    per = records.select(F.col(id_col).alias("record_id")).join(types, "record_id", "left").fillna(0, ["types"])
    return per.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.when(F.col("types") > 0, 1).otherwise(0)), F.lit(0)).alias("covered"), F.coalesce(F.sum("types"), F.lit(0)).alias("type_total"), F.expr("coalesce(percentile(types, 0.5), 0.0)").alias("median_types"))


def selected(counts: DataFrame, total: int | Column, least: int = 50, share: float = 0.004, anchor: str | None = None) -> DataFrame:
    """Acceptance by support: a count of at least `least` and of the share rounded up, or the share itself.

    `anchor`: a column with the share of matches that have their anchor, of which 0.999 are needed where it isn't null.
    Rules that fail get a status and the count they needed. Of no records the share is 0."""
    total = total if isinstance(total, Column) else F.lit(total)
    needed = F.greatest(F.lit(least), F.ceil(F.lit(share) * total)).cast("long")
    enough = (F.col("records") >= needed) | (F.coalesce(F.try_divide(F.col("records").cast("double"), total.cast("double")), F.lit(0.0)) >= share)
    if anchor:
        enough = enough & (F.col(anchor).isNull() | (F.col(anchor) >= 0.999))
    out = counts.withColumns({"accepted": enough, "status": F.when(enough, "accepted").otherwise("rejected_low_frequency"), "threshold_count": needed})
    return out.orderBy("category", F.desc("records"), "fragment_id")


def overlaps(membership: DataFrame, group: str, record: str, min_jaccard: float, min_containment: float, min_shared: int = 1) -> DataFrame:
    """Pairs of groups by the records they share; membership is joined with itself by record, whose groups are few."""
    m = membership.select(F.col(group).alias("a"), F.col(record).alias("_r")).distinct()
    sizes = m.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = m.join(m.select(F.col("a").alias("b"), "_r"), "_r").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(sizes.withColumnRenamed("n", "n_a"), "a").join(sizes.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
    jaccard = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    contained = F.col("shared") / F.least("n_a", "n_b")
    return out.withColumn("jaccard", jaccard).withColumn("containment", contained).filter((F.col("shared") >= min_shared) & ((jaccard >= min_jaccard) | (contained >= min_containment))).select("a", "b", "n_a", "n_b", "shared", "jaccard", "containment").orderBy(F.desc("jaccard"), "a", "b")


def overlap_report(pairs: DataFrame, most: int = 30) -> DataFrame:
    """The `most` pairs of `overlaps` with the largest Jaccard, then the most shared records, then by name, with their place."""
    order = (F.desc("jaccard"), F.desc("shared"), F.asc("a"), F.asc("b"))
    return pairs.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # `most` rows


def motifs(rows: DataFrame, support: int, most: int, id_col: str = "doc_id", text_col: str = "text", size: int = 2) -> DataFrame:
    """Word n-grams with the number of records that have them, the most common ones."""
    # the words are bound once: named inside the inner function they would be split again for each n-gram
    def of(words):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))

    grams = F.flatten(F.transform(F.array(F.split(F.lower(text_col), " ")), of))
    sorted_grams = F.array_sort(grams)

    def counted(g):
        """Equal neighbours of the sorted n-grams: the places where a run begins, and how far the next one is."""
        begins = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))
        ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))), F.array(F.size(g)))
        return F.zip_with(begins, ends, lambda x, y: F.struct(F.get(g, x).alias("motif"), (y - x).alias("n")))

    found = rows.filter(F.col(text_col).isNotNull()).select(F.explode(F.flatten(F.transform(F.array(sorted_grams), counted))).alias("_m")).select("_m.*")
    return found.groupBy("motif").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("matches")).filter(F.col("records") >= support).orderBy(F.desc("records"), "motif").limit(most)


def rule_errors(rules: DataFrame) -> DataFrame:
    """(fragment_id, errors): what is wrong with each rule, several joined by `;`, empty if nothing."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("fragment_id")) > 1
    checks = [("duplicate_id", twice), ("missing_pattern", F.coalesce(F.col("pattern"), F.lit("")) == ""), ("unknown_status", ~F.col("status").isin("core", "derived_attribute", "deprecated_alias", "rejected")), ("self_cover", F.array_contains("covered_by", F.col("fragment_id")))]
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks)), lambda x: x.isNotNull())
    return rules.select("fragment_id", F.array_join(found, ";").alias("errors"))
