"""Links inside buckets with many members."""
from __future__ import annotations

import numpy as np

from plumbline.llm import hyperminhash
from tests.llm import brute


def test_links_inside_a_crowded_family(spark, monkeypatch):
    passage = " ".join(f"t{i}" for i in range(250))
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [f"{passage} {own(k, 50)}" for k in range(200)] + [f"{passage} {own(300 + k // 2, 25)} {own(400 + k, 25)}" for k in range(16)]
    rows = [(k * 7919 % 1009, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(hyperminhash, "SURE_HUBS", 4)        # so that some 100 members are a crowd
    monkeypatch.setattr(hyperminhash, "BLOCK_SETS", 50, raising=False)
    monkeypatch.setattr(hyperminhash, "BLOCK_SHINGLES", 20_000, raising=False)
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows, 5, 80) and len(set(got.values())) == 208


def test_common_counts(monkeypatch):
    monkeypatch.setattr(hyperminhash, "COLUMNS", 7)
    monkeypatch.setattr(hyperminhash, "HOLDERS", 5)
    rng = np.random.default_rng(2)
    for share in (0.02, 0.5):
        a, b = rng.random((30, 40)) < share, rng.random((20, 40)) < share
        (xa, va), (xb, vb) = np.nonzero(a), np.nonzero(b)
        assert (hyperminhash.common(xa, va, 30, xb, vb, 20, 40) == a.astype(int) @ b.T.astype(int)).all()
