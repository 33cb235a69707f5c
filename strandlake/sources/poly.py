"""Deterministic repeat-unit strings made from the part table, and property records from lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Linker by the first word of a part's type.
LINKERS = {"ECONOMY": "O", "STANDARD": "C(=O)O", "PROMO": "C(=O)N", "SMALL": "c1ccc(cc1)", "LARGE": "S", "MEDIUM": "C(C#N)"}
#: Spellings of the two attachment points by key modulo 5.
SPELLINGS = (("*", "*"), ("[*]", "[*]"), ("[[*]]", "[[*]]"), ("[[[*]]]", "[[[*]]]"), ("[*:1]", "[*:2]"))

#: Groups of wide units: those of every core rule, some twice in other surroundings.
GROUPS = (
    "C(=O)N C(=O)NC(=O) C(=O)O O OC(=O)O OC(=O)N NC(=O)N S S(=O)(=O) S(=O) C(C#N) C(O) N N(C) C(N) C(=O) C(C(=O)O) C1CC(C1) c1ccc(s1) C1CCC(C1) c1ccc(cc1) C1CCC(CC1)"
    " C=C C#C N=N C(Cl) C(F)(F) C(C(F)(F)F) C(C(F)(F)C(F)(F)F) C(=S) C(=S)N NC(=S)N C(=NO) C([N+](=O)[O-]) C(S) [Si](C)(C) [Si](C)(C)O[Si](C)(C) P(C) OP(=O)(O)O P(C)(=NC)"
    " S(=O)(=O)N S(=O)(=O)O Oc1ccc(cc1) c1ccc(cc1)N=Nc1ccc(cc1) c1ccc(cc1)C#Cc1ccc(cc1) C(c1ccc(cc1)O) C(c1ccc(cc1)C#N) C(c1ccc(cc1)F) C(c1ccc(cc1)C(=O)O) C(c1ccc(cc1)S) C(C)=C"
).split()


def _pick(key: Column, values) -> Column:
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(key == i, v).otherwise(out)
    return out


def poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, smiles): one string for each part.

    Made in steps, as one expression names its parts so often that the generated code would not compile."""
    k, first, linker = F.col("p_partkey"), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("")
    for name, text in LINKERS.items():
        linker = F.when(first == name, text).otherwise(linker)
    begin, end = (_pick(k % 5, [s[i] for s in SPELLINGS]) for i in (0, 1))
    chain = F.repeat(F.lit("C"), F.col("p_size") % 5 + 1)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", linker.alias("_linker"), chain.alias("_chain"), begin.alias("_begin"), end.alias("_end"))
    # some are written the other way round: another spelling of the same graph
    turned = (k % 7 == 0) & F.col("_linker").isin("O", "S")
    rows = rows.withColumn("_unit", F.when(turned, F.concat("_linker", "_chain")).otherwise(F.concat("_chain", "_linker")))
    rows = rows.withColumn("_whole", F.concat("_begin", "_unit", "_end"))
    text = (
        F.when(k % 97 == 0, F.concat("_whole", F.lit(".[Na+]")))
        .when(k % 89 == 0, F.concat("_begin", F.lit("[R1]"), "_unit", "_end"))
        .when(k % 83 == 0, F.concat("_whole", F.lit(","), "_whole"))
        .when(k % 79 == 0, F.concat("_begin", "_unit"))
        .when(k % 73 == 0, F.col("_unit"))
        .when(k % 71 == 0, F.concat("_whole", "_whole"))
        .otherwise(F.col("_whole"))
    )
    return rows.select("p_partkey", text.alias("smiles"))


def wide_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, first, second, smiles): a unit for each part, two groups in a chain of carbons; several hundred thousand differ."""
    k, n = F.col("p_partkey"), len(GROUPS)
    group = lambda i: F.get(F.array(*map(F.lit, GROUPS)), i.cast("int"))
    chain = lambda length: F.repeat(F.lit("C"), length.cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", group(k % n).alias("first"), group(F.floor(k / n) % n).alias("second"), chain(F.col("p_size") % 6 + 1).alias("_a"), chain(k % 5 + 2).alias("_b"), chain(k % 7 + 1).alias("_c"))
    return rows.select("p_partkey", "first", "second", F.concat(F.lit("*"), "_a", "first", "_b", "second", "_c", F.lit("*")).alias("smiles"))


def property_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(smiles, property_category, property_name, value, unit, ord, place): many rows for a string, in an order of their own.

    Several lines of an order may have one number, so `ord` has ties; `place` is the row's place in the table."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", place)
    joined = items.join(poly(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("smiles", F.col("l_returnflag").alias("property_category"), F.col("l_linestatus").alias("property_name"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.lit("u").alias("unit"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "place")


#: Patterns of the rule table, three that can be read.
PATTERNS = ("[#6:1][OX2:2][#6:3]", "[CX3:1](=[OX1:2])", "[C:1", "[#7:1]")


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of `rule_checks.FIELDS` for each part, many of them with faults."""
    k, text = F.col("p_partkey"), lambda *values: [F.lit(v) for v in values]
    key = lambda n: F.concat(F.lit("F"), n.cast("string"))
    roles = F.create_map(*text("1", "a", "2", "b", "3", "c"))
    fields = F.array(*text("fragment_id", "anchor_type"))
    columns = {
        "fragment_id": F.when(k % 101 != 0, key(k - (k % 19 == 0).cast("int"))),
        "fragment_name": F.when(k % 23 != 0, F.col("p_name")),
        "version": F.lit("1"),
        "category": F.split_part("p_type", F.lit(" "), F.lit(1)),
        "semantic_tags": F.array("p_brand"),
        "match_type": F.when(k % 7 == 0, "rdkit_ring").when(k % 7 == 1, "derived_view").when(k % 7 == 2, "sql").otherwise("smarts"),
        "pattern": F.get(F.array(*text(*PATTERNS)), (k % 5).cast("int")),
        "atom_roles": F.map_filter(roles, lambda i, _: i.cast("int") <= 3 - (k % 5 != 0).cast("int") - (k % 5 == 3).cast("int") + (k % 17 == 0).cast("int")),
        "anchor_type": F.when(k % 13 == 0, "angle").otherwise("atom"),
        "anchor_role": F.when(k % 29 == 0, "c").when(k % 31 != 0, "a"),
        "ownership_rule": F.when(k % 37 == 0, "first").otherwise("anchor_in_RU0"),
        "periodic_radius": (k % 9 - 2).cast("int"),
        "allow_boundary_crossing": k % 2 == 0,
        "enable_cut_shift_scan": F.lit(True),
        "max_cut_shift": (k % 8 - 1).cast("int"),
        "dedup_key_fields": F.when(k % 10 == 0, F.array_append(fields, F.lit("colour"))).otherwise(fields),
        "exclusive_group": F.col("p_brand"),
        "priority": F.col("p_size").cast("int"),
        "allow_child_fragments": F.lit(True),
        "parent_fragment_ids": F.array_compact(F.array(F.when(k % 6 == 0, key(k + 1)), F.when(k % 41 == 0, key(k)))),
    }
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(*(v.alias(n) for n, v in columns.items()))
