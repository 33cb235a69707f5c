"""Node and edge tables of repeat-unit strings, and the dedup level of graphs.

Distinct strings are parsed in Arrow batches; everything after that is joins and groups over nodes and edges.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chem

_NODE = "struct<atom_id:int,element:string,aromatic:boolean,formal_charge:int,ring_membership:boolean,is_attachment:boolean>"
_EDGE = "struct<begin_atom_id:int,end_atom_id:int,bond_type:string,ring_membership:boolean>"
_GRAPH = f"smiles string, class_key string, backbone_length int, nodes array<{_NODE}>, edges array<{_EDGE}>"
BOND_NAMES = {1: "SINGLE", 2: "DOUBLE", 3: "TRIPLE", 4: "AROMATIC"}


def graphs(strings: DataFrame, column: str = "smiles") -> DataFrame:
    """One row per distinct string: class key, backbone length, nodes, edges; nodes are null where the string can't be read."""

    def parsed(it):
        node = pa.struct([("atom_id", pa.int32()), ("element", pa.string()), ("aromatic", pa.bool_()), ("formal_charge", pa.int32()), ("ring_membership", pa.bool_()), ("is_attachment", pa.bool_())])
        edge = pa.struct([("begin_atom_id", pa.int32()), ("end_atom_id", pa.int32()), ("bond_type", pa.string()), ("ring_membership", pa.bool_())])
        for b in it:
            keys, lengths, nodes, edges = [], [], [], []
            for text in b.column("smiles").to_pylist():
                g = chem.parse(text)
                if g is None:
                    for x in (keys, lengths, nodes, edges):
                        x.append(None)
                    continue
                atoms, bonds = g
                ring = chem.ring_bonds(len(atoms), bonds)
                inside = {i for pair in ring for i in pair}
                keys.append(chem.class_key(g))
                lengths.append(chem.backbone(g))
                nodes.append([{"atom_id": i, "element": a[0], "aromatic": a[1], "formal_charge": a[2], "ring_membership": i in inside, "is_attachment": a[0] == "*"} for i, a in enumerate(atoms)])
                edges.append([{"begin_atom_id": x, "end_atom_id": y, "bond_type": BOND_NAMES[o], "ring_membership": (x, y) in ring} for x, y, o in bonds])
            yield pa.record_batch([b.column("smiles"), pa.array(keys, pa.string()), pa.array(lengths, pa.int32()), pa.array(nodes, pa.list_(node)), pa.array(edges, pa.list_(edge))], names=["smiles", "class_key", "backbone_length", "nodes", "edges"])

    return strings.select(F.col(column).alias("smiles")).distinct().mapInArrow(parsed, _GRAPH)


def nodes(found: DataFrame) -> DataFrame:
    return found.select("smiles", F.inline("nodes"))


def edges(found: DataFrame) -> DataFrame:
    return found.select("smiles", F.inline("edges"))


def degrees(found: DataFrame) -> DataFrame:
    """Every node with its number of bonds."""
    ends = edges(found).select("smiles", F.explode(F.array("begin_atom_id", "end_atom_id")).alias("atom_id"))
    counts = ends.groupBy("smiles", "atom_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes(found).select("smiles", "atom_id", "element").join(counts, ["smiles", "atom_id"], "left").fillna(0, ["degree"])


def unreadable(found: DataFrame) -> DataFrame:
    return found.filter("nodes is null").select(F.lit("phase_1_canonicalization").alias("stage"), "smiles")


def level3(level2: DataFrame, found: DataFrame, examples: int = 5) -> DataFrame:
    """Rollup of normalised strings by graph class: their number, records, and the first spellings in order."""
    rows = level2.join(found.select(F.col("smiles").alias("normalized"), "class_key"), "normalized").filter("class_key is not null")
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("class_key").orderBy("normalized")))
    first = F.array_sort(F.collect_list(F.when(F.col("_place") <= examples, F.col("normalized"))))
    return ranked.groupBy("class_key").agg(F.count(F.lit(1)).alias("source_count"), F.sum("property_record_count").alias("property_record_count"), F.array_join(first, "|").alias("examples"))


def environments(strings: DataFrame, column: str = "smiles", least: int = 2, most: int = 8) -> DataFrame:
    """(smiles, motif, atom_count, occurrences): the surroundings of each atom, counted within each distinct string."""

    def found(it):
        for b in it:
            out = []
            for text in b.column("smiles").to_pylist():
                g = chem.parse(text)
                for (motif, size), n in Counter(chem.environments(g, least, most) if g else ()).items():
                    out.append((text, motif, size, n))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["smiles", "motif", "atom_count", "occurrences"])

    return strings.select(F.col(column).alias("smiles")).distinct().mapInArrow(found, "smiles string, motif string, atom_count int, occurrences long")


def mined(found: DataFrame, total: int, support: int = 15, most: int = 300) -> DataFrame:
    """The `most` motifs that most records have, at least `support`: records, their share, occurrences, status, the first record."""
    rows = found.groupBy("motif", "atom_count").agg(F.count(F.lit(1)).alias("records"), F.sum("occurrences").alias("matches"), F.min("smiles").alias("example"))
    core = F.col("records") >= F.greatest(F.lit(50), F.ceil(F.lit(total * 0.004)))
    rows = rows.filter(F.col("records") >= support).withColumn("share", F.coalesce(F.try_divide(F.col("records").cast("double"), F.lit(float(total))), F.lit(0.0)))
    return rows.withColumn("status", F.when(core, "accepted_core_candidate").otherwise("accepted_auxiliary_candidate")).orderBy(F.desc("records"), "atom_count", "motif").limit(most)


def clusters(rows: DataFrame, most: int = 50) -> DataFrame:
    """Motifs by their number of atoms: how many, and the first `most` in order of records."""
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("atom_count").orderBy(F.desc("records"), "motif")))
    first = F.array_sort(F.collect_list(F.when(F.col("_place") <= most, F.struct("_place", "motif"))))
    return ranked.groupBy("atom_count").agg(F.count(F.lit(1)).alias("motif_count"), F.transform(first, lambda x: x["motif"]).alias("motifs"))
