"""A pass over a large batch of texts holds a bounded number of bytes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from provenant.llm import common as C
from provenant.llm import jaccard_join, language_id

BATCH = pa.record_batch([pa.array([0] * 64), pa.array([f"{i} " + "some words of a text " * 3000 for i in range(64)]), pa.array([True] * 64)],
                        names=["label", "text", "held"])


def peak(run, batch):
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_language_pass_is_bounded():
    model = language_id.Model(["a", "b"], np.ones((language_id.BUCKETS, 2)), np.zeros(2), 1.0, 0.0)
    rows, mb = peak(language_id._logits(model), BATCH)
    assert rows == 64 and mb < 60, mb


def test_signing_pass_is_bounded():
    C._tables.clear()
    rows, mb = peak(jaccard_join._sign, BATCH)
    assert rows == 64 and mb < 60, mb
