"""The string reader on literal cases, its tables, and a round trip through every file format."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import chem, text
from strandlake.operators import graphs
from strandlake.sources import files

SPELLINGS = [
    ["*O[Si](*)(C)C", "*[Si](C)(C)O*", "C[Si](C)(O*)*"],
    ["*CCO*", "*OCC*", "C(*)CO*"],
    ["*c1ccc(cc1)C(=O)N*", "*NC(=O)c1ccc(*)cc1", "c1(*)ccc(C(N*)=O)cc1"],
    ["C1CC1C2CC2", "C1CC1C1CC1", "C%10CC%10C2CC2"],
    ["*CC(*)(C)C(=O)[O-].[Na+]", "[Na+].[O-]C(=O)C(C)(C*)*"],
]


def test_class_keys():
    keys = [{chem.class_key(chem.parse(s)) for s in group} for group in SPELLINGS]
    assert all(len(k) == 1 and None not in k for k in keys)
    assert len(set.union(*keys)) == len(SPELLINGS)
    assert chem.class_key(chem.parse("CCO")) != chem.class_key(chem.parse("COC"))


def test_relabelled_graphs():
    rng = random.Random(2)
    atoms, bonds = chem.parse("*C1(C)CC2CC1C(=O)N2c1ccc(*)cc1")
    for _ in range(20):
        to = list(range(len(atoms)))
        rng.shuffle(to)
        moved = [None] * len(atoms)
        for i, a in enumerate(atoms):
            moved[to[i]] = a
        again = sorted((min(to[a], to[b]), max(to[a], to[b]), o) for a, b, o in bonds)
        assert chem.class_key((moved, again)) == chem.class_key((atoms, bonds))


@pytest.mark.parametrize("bad", ["", None, "C(", "C)", "C1CC", "(C)", "C=", "[Xx", "C&C", "C11", "1C"])
def test_broken(bad):
    assert chem.parse(bad) is None


def test_rings_and_backbone():
    atoms, bonds = chem.parse("*CC1CC1C*")
    assert len(chem.ring_bonds(len(atoms), bonds)) == 3
    assert chem.backbone((atoms, bonds)) == 4
    assert chem.backbone(chem.parse("CC")) is None and chem.backbone(chem.parse("*C.C*")) is None


def test_tables(spark):
    df = spark.createDataFrame([("*CCO*",), ("*CCO*",), ("C1CC1",), ("C(",), (None,)], "smiles string")
    found = graphs.graphs(df)
    assert found.count() == 4 and graphs.unreadable(found).count() == 2
    assert graphs.nodes(found).count() == 8 and graphs.edges(found).count() == 7
    got = {(r.smiles, r.atom_id): r.degree for r in graphs.degrees(found).collect()}
    assert got["*CCO*", 0] == 1 and got["*CCO*", 1] == 2 and got["C1CC1", 0] == 2
    level2 = spark.createDataFrame([("*CCO*", 3), ("*OCC*", 4), ("C1CC1", 1), ("C(", 9)], "normalized string, property_record_count long")
    rows = graphs.level3(level2, graphs.graphs(level2, "normalized")).collect()
    assert {(r.source_count, r.property_record_count, r.examples) for r in rows} == {(2, 7, "*CCO*|*OCC*"), (1, 1, "C1CC1")}
    assert graphs.graphs(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿smiles,a,b,c,d\n" *C* ",x,"two\nlines",,u\n', encoding="utf-8")
    assert [tuple(r) for r in files.property_records(spark, str(tmp_path / "p.csv")).collect()] == [("*C*", "x", "two\nlines", "", "u")]
    df = spark.createDataFrame([("b", None, "train"), ("a", 'q"1', "test")], "b string, a string, split string")
    files.write_json_lines(df, str(tmp_path / "j"))
    lines = [x for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines) == ['{"a":"q\\"1","b":"a","split":"test"}', '{"a":null,"b":"b","split":"train"}']
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    assert files.json_lines(spark, str(tmp_path / "j"), schema, ("b",)).count() == 2
    with pytest.raises(Exception, match="missing a"):
        files.json_lines(spark, str(tmp_path / "j"), schema, ("a",)).collect()
    assert files.optional(spark, str(tmp_path / "none"), schema).count() == 0 and files.optional(spark, str(tmp_path / "j"), schema).count() == 2
    files.write_csv(df, str(tmp_path / "c"), ["a", "b"])
    assert {tuple(r) for r in files.csv_table(spark, str(tmp_path / "c"), schema).collect()} == {(None, "b"), ('q"1', "a")}
    files.write_corpus(df, str(tmp_path / "t"), "b")
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["b"]
    assert files.file_hashes(spark, str(tmp_path / "p.csv")).first().sha256


def test_columns(spark):
    rows = [(" [[*]]CC[*:12]​ ", 1234567.0, "<a&'b\">"), (" *C( ", None, None), (None, float("nan"), "")]
    df = spark.createDataFrame(rows, "s string, v double, h string")
    got = df.select(text.attachments_normalised(F.col("s")), text.percent(F.col("v")), text.escaped_html(F.col("h")), text.record_type(text.attachments_normalised(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [("*CC*", "123456700.00%", "&lt;a&amp;&#x27;b&quot;&gt;", "main_repeat_unit"), ("*C(", "-", None, "incomplete_attachment"), ("", "-", "", "parser_failed")]
