"""Retrieval: a pair of block and slice at a time, exact scores."""

import numpy as np
import pyarrow as pa

from strandlake.operators import validation


def test_retrieval_counts_a_pair_at_a_time():
    kind = lambda *more: pa.list_(pa.struct([("id", pa.int64()), ("vector", pa.list_(pa.int64())), *more]))
    block = [{"id": 1, "vector": [1, 2], "own": 5}, {"id": 2, "vector": [2, 2], "own": 6}]
    slices = [[{"id": 1, "vector": [1, 2]}, {"id": 3, "vector": [3, 1]}], [{"id": 2, "vector": [1, 2]}]]
    batch = pa.record_batch([pa.array([[], block, block], kind(("own", pa.int64()))), pa.array([[], *slices], kind())], names=["block", "slice"]).slice(1)
    got = [b.to_pydict() for b in validation._counted([batch])]
    assert got == [{"id": [1, 2], "before": [0, 2], "negatives": [5, 14], "others": [1, 2]}, {"id": [1, 2], "before": [0, 0], "negatives": [5, 0], "others": [1, 0]}]


def test_scores_are_exact_beyond_doubles():
    x = np.array([[2**31 + 1, 3]])
    assert validation._scores(x, x).tolist() == [[(2**31 + 1) ** 2 + 9]]
    assert validation._scores(np.array([[-3, 4]]), np.array([[5, 6], [7, -8]])).tolist() == [[9, -53]]
