"""What the driver no longer needs after training goes back to the machine."""

import numpy as np
import pytest

pytest.importorskip("strandlake.llm")
from strandlake.llm import common, toxicity  # noqa: E402


def held() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_goes_back():
    before = held()
    parts = [np.ones(12_000) for _ in range(2000)]  # 190 MB in pieces that C keeps for itself
    last = parts[-1]
    assert held() - before > 150e6
    del parts
    common.released()
    assert last.sum() == 12_000 and held() - before < 60e6


def test_training_releases(spark, monkeypatch):
    called = []
    monkeypatch.setattr(toxicity, "released", lambda: called.append(1))
    docs = spark.createDataFrame([(i, f"a{i % 2} word") for i in range(20)], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"), epochs=1)
    assert called
