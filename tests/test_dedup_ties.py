"""First and last values of a string: records with one place in the order, null values, against SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from strandlake.plans import catalog

ROWS = [(1, 0, 3, 9.0), (1, 0, 3, 4.0), (1, 0, 3, 6.0), (2, 0, 1, 5.0), (9, 0, 7, None), (0, 0, 1, None), (8, 0, 2, 2.0), (8, 0, 2, 7.0), (8, 0, 2, 1.0), (4, 1, 1, None)]


def test_ties_take_the_first_of_the_table(spark, tmp_path):
    order, part, line, quantity = map(list, zip(*ROWS))
    n = len(ROWS)
    pq.write_table(pa.table({"l_partkey": part, "l_orderkey": order, "l_linenumber": pa.array(line, pa.int32()), "l_returnflag": ["A"] * n, "l_linestatus": ["O"] * n, "l_quantity": pa.array(quantity, pa.float64())}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": [0, 1], "p_size": pa.array([2, 3], pa.int32()), "p_type": ["LARGE X", "SMALL X"]}), tmp_path / "part.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = catalog.prop_long_scan_group(spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL['prop_long_scan_group']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(r[3], r[4]) for r in want} == {("9", "2"), (None, None)}
