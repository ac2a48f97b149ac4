"""Terms that disclose an entity, far from it and in texts without it."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.llm import pii


def test_terms_are_marked_wherever_they_stand(spark):
    filler = "and so on, as it is written in the plain report of this day, "
    rows = [(k, f"Quixotal, the writer {filler * 4}write to ann@example.org, said number {k}; {filler * 3}quixotal") for k in range(4)]
    rows += [(9, "Nobody but quixotal knows the house.")] + [(10 + k, f"The writer of text {k} {filler}") for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(x["value"], x["start"]) for x in r["terms"]] for r in pii.all_spans(docs).collect()}
    places = {i: [k for k in range(len(t)) if t[k:k + 8].lower() == "quixotal"] for i, t in rows}
    for i, _ in rows:
        assert [at for value, at in got[i] if value.lower() == "quixotal"] == places[i]
    assert not any(value.lower() in ("writer", "plain", "report") for found in got.values() for value, _ in found)
    assert pii.sanitised(docs).where(F.lower("text").contains("quixotal")).count() == 0


def test_terms_end_at_brackets_quotes_and_apostrophes(spark):
    filler = "and so on, as it is written in the plain report of this day, "
    forms = ["(Quixotal", '"quixotal"', "quixotal's", "[quixotal]", "quixotal-like", "\u201cquixotal\u201d", "quixotal"]
    rows = [(k, f"{form} wrote to ann@example.org, number {k}; {filler}") for k, form in enumerate(forms)]
    rows += [(50, "xquixotal and quixotal7 and quixotal\u0301 are other words")]
    rows += [(100 + k, f"The writer of text {k} {filler}") for k in range(160)]
    got = {r["doc_id"]: [x["value"].lower() for x in r["terms"]] for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("quixotal" in got[k] for k in range(len(forms))) and "quixotal" not in got[50]


def test_a_long_text_takes_time_in_proportion(spark):
    """Spans are not searched again for every word, and only disclosing terms are put together."""
    import time
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["quixotal", "plain", "house", "river"]) + rng.choice([",", ""]) for _ in range(5000)) + f" ann@example.org {k}") for k in range(4)]
    rows += [(10 + k, f"the writer of text {k} is at the plain house by the river") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: len(r["terms"]) for r in pii.all_spans(docs).collect()}
    assert all(got[i] == t.count("quixotal") for i, t in rows) and time.time() - start < 120
