"""The pipeline against plain versions of its stages, each on what the stage before kept."""
from __future__ import annotations

import collections

import corpus_pipeline
from plumbline.llm import line_dedup, quality
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.ledger(docs).where("bits = 0").collect()}
    texts = {i: rows[i]["text"] for i in kept}
    assert all(not brute.quality(t)[-1] for t in texts.values())
    removed = brute.line_duplicates(texts.items(), line_dedup.EDITS, line_dedup.SHORT)
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in removed) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if brute.WORD.search(t)}
    component = brute.near(texts.items(), 5, 80)
    texts = {i: t for i, t in texts.items() if component[i] == i}
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in list(stages.items())[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    out = corpus_pipeline.run(spark, sf_dir).collect()
    copies = collections.Counter(r["doc_id"] for r in out)
    sizes = collections.Counter()
    for i, t in texts.items():
        sizes[rows[i]["source"]] += len(brute.WORD.findall(t))
    target, taken, largest = brute.targets(sizes), collections.Counter(), collections.Counter()
    for i, n in copies.items():
        size = len(brute.WORD.findall(texts[i]))
        taken[rows[i]["source"]] += n * size
        assert n <= 3
    for i, t in texts.items():
        largest[rows[i]["source"]] = max(largest[rows[i]["source"]], len(brute.WORD.findall(t)))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert all(r["text"] == texts[r["doc_id"]] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
