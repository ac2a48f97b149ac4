"""Licence notices that are frequent in the corpus they are learned from."""
from __future__ import annotations

import random

import pytest

from plumbline.llm import licenses


@pytest.mark.parametrize("notice, family", [("Released under the MIT License.", "MIT"), ("Licensed under the BSD License.", "BSD")])
def test_a_frequent_notice_is_found(spark, notice, family):
    rng = random.Random(4)
    plain = [" ".join(rng.choice(("river", "under", "the", "night", "train", "station", "a", "green", "of", "umbrella")) + rng.choice(("", "", "s")) for _ in range(12)) for _ in range(900)]
    rows = [(k, f"{p}\n{notice}" if k % 5 == 0 else p) for k, p in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["families"] for r in licenses.licences(docs).collect()}
    assert found == {k: [family] if k % 5 == 0 else [] for k, _ in rows}
