"""Collocations, vector graphs and lexical search against plain versions."""
from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import collocations, lexical, queries, vectorgraph

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int, n: int, words: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "naïve", "Σ", "x-y", "(a)", "big red fox", "one two three four five six"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, words)):
            text += rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", ""])
        rows.append((i, text, rng.choice(["en", "fr", None]), f"s{i % 3}"))
    return rows


# ---- collocations -----------------------------------------------------------------------------------
def plain_collocations(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= support}
        longest = Counter()
        for p, c in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i:i + size]] = max(longest[p[i:i + size]], c)
        scored = []
        for p, a in candidates.items():
            if 100 * longest[p] >= 100 * a:
                continue
            score, _, l, r = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("entries, burst", [(400_000, 2048), (40, 3)])
def test_collocations_equal_plain_counts(spark, entries, burst):
    rows = corpus(1, 300) + [(900, None, "en", "s"), (901, "", None, "s"), (902, "one two three " * 4000, "fr", "s"), (903, "w1 w2", "und", "s")] + corpus(1, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string").repartition(4)
    got = collocations.collocations(docs, support=5, top=40, entries=entries, burst=burst)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(rows, 5, 40)
    assert sorted(map(tuple, got.collect())) == want and any(len(w[2].split()) > 2 for w in want)


def test_trie_bursts_and_spills_whole_subtrees():
    trie, want, rng = collocations.HatTrie(burst=4), Counter(), random.Random(3)
    for _ in range(4000):
        path = tuple([rng.randrange(2)] + [rng.randrange(9) for _ in range(3)])
        trie.add(path, 1)
        want[path] += 1
    assert any(isinstance(x, trie.Node) for x in trie.root.values()) and trie.size == len(want)
    got = Counter()
    first = list(trie.spill(trie.size // 2))
    assert first and trie.size <= len(want) // 2 + 1
    for run in first + list(trie.spill(0)):
        assert len({path[0] for path, _ in run}) == 1
        got.update(dict(run))
    assert got == want and trie.size == 0


def test_collocations_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None)], docs.schema)).collect() == []


# ---- vectors ----------------------------------------------------------------------------------------
def product(a, b) -> float:
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def plain_neighbours(vectors, queries_, k):
    out = {}
    for q, v in queries_:
        scored = [(-product(v, w), i) for i, w in vectors if (i, w) != (q, v) and len(w) == len(v)]
        out.setdefault((q, v), sorted(scored)[:k])
    return out


def test_neighbours_on_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = defaultdict(list)
    for r in queries.op12_nearest_vectors(spark, sf_dir.replace("sf0.001", "sf0.01")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = np.array([product(x[ids == q][0].tolist(), w) for w in x.tolist()])
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(score == s[ids == i][0] for _, i, score in found)
        hits += len({i for _, i, _ in found} & set(ids[order].tolist()))
    assert hits / (20 * len(got)) >= 0.98


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_of_a_graph(uneven):
    """Unit vectors a third of which crowd around one, and vectors of very different lengths."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if not uneven:
        x[2000:] = x[0] + 0.05 * x[2000:]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= rng.uniform(0.2, 3, (3000, 1)) if uneven else 1
    graph = vectorgraph.Graph.built(vectorgraph.extended(x))
    q = np.concatenate([x[:60], x[-60:]])
    found, _ = graph.beam(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), vectorgraph.BEAM)
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(t) & set(f)) for t, f in zip(true.tolist(), found.tolist())]) / 20 >= 0.95


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(20, [9.0, 9.0, 9.0]), (20, [9.0, 9.0, 9.0]), (40, [0.0, 0.0, 2.0])]
    other = [(100, [1.0, 2.0]), (101, [2.0, 1.0])]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [nan, 1.0, 1.0]), (280, [inf, 1.0, 1.0]), (300, []), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in good + other + bad], "vec_id long, embedding array<double>, id string, rank int")
    got = defaultdict(list)
    for r in vectorgraph.neighbours(table).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    vectors = list({(i, tuple(v)) for i, v in good + other})
    want = plain_neighbours(vectors, [(i, v) for i, v in vectors if i % 20 == 0], 20)
    plain = defaultdict(list)
    for (q, _), found in want.items():
        plain[q] += [(rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in plain.items()}
    assert vectorgraph.neighbours(table.limit(0)).collect() == []


# ---- lexical search ---------------------------------------------------------------------------------
def plain_search(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall((text or "").translate(LOWER))
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t, *_ in docs) if t]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical_search_equals_scoring_everything(spark):
    rows = corpus(2, 400) + corpus(2, 40) + [(None, "w1 Été w3", "en", "s"), (None, "w1 w2", "en", "s"), (7, "w5 " * 30_000 + "rare", None, "s"), (8, None, None, None), (9, "... !", None, "")]
    items = [(i, r[1]) for i, r in enumerate(corpus(4, 30, 12))] + [(90, "rare w5 w5 Nowhere"), (90, "rare w5 w5 Nowhere"), (91, None), (92, ""), (93, "nowhere"), (None, "w1 été"), (90, "w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, score string").repartition(5)
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(rows, items)


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rows, items = corpus(6, 200), [(i, r[1]) for i, r in enumerate(corpus(8, 12, 10))]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(items, "item_id long, text string")
    blocks = lexical.item_blocks
    monkeypatch.setattr(lexical, "item_blocks", lambda *a: blocks(*a, size=200))
    assert sorted(map(tuple, lexical.search(docs, wanted).select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(rows, items)


def test_lexical_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == [] and lexical.search(docs.union(spark.createDataFrame([(1, "a b")], docs.schema)), items.limit(0)).collect() == []


def test_bounds_are_never_below_the_score():
    rng, weight = random.Random(11), {f"t{i}".encode(): 100 * i for i in range(50)}
    texts = [" ".join(rng.choice([f"t{rng.randrange(50)}", f"u{rng.randrange(400)}"]) for _ in range(rng.randint(1, 300))) for _ in range(80)]
    items = [Counter(f"t{rng.randrange(50)}".encode() for _ in range(6)) for _ in range(9)]
    import pyarrow as pa
    table = pa.RecordBatch.from_pydict({"d": list(range(80)), "t": texts})
    n_terms = sum(len(t.split()) for t in texts)
    bounds, seen = lexical._Bounds(items, weight, 80, n_terms), set()
    for block in lexical._blocks([table]):
        for r in block.to_pylist():
            values = bounds(r["width"], r["lengths"], r["slices"])
            for j, d in enumerate(r["ids"]):
                c, m = Counter(texts[d].encode().split()), 25 + (75 * r["lengths"][j] * 80) // n_terms
                for i, item in enumerate(items):
                    assert values[i, j] >= sum(q * weight[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in item.items() if c[t])
                seen.add(d)
    assert seen == set(range(80))


def test_rare_words_spill_no_phrases(monkeypatch):
    monkeypatch.setattr(collocations, "WORDS", 20)
    monkeypatch.setattr(collocations, "VOCABULARY", 20, raising=False)
    monkeypatch.setattr(collocations, "CHUNK", 200)
    texts = ["one two three. " + " ".join(f"rare{i}x{j}" for j in range(30)) for i in range(10)]
    slots = np.concatenate(collocations._slots(collocations.mix(collocations._word_hash([b"one", b"two", b"three"]) ^ collocations._lang_hash("en"))))
    words = np.zeros(collocations.BITMAP, bool)
    words[slots] = True
    every = {j: b"\xff" * (collocations.SLOTS // 8) for j in (2, 3)}
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 10, "text": texts})
    found = [r for b in collocations._phrase_runs(np.packbits(words).tobytes(), every, (2, 3), 1000, 4)([batch]) for r in b.to_pylist()]
    assert {r["phrase"]: r["n"] for r in found} == {"one two": 10, "two three": 10, "one two three": 10} and len(found) == 3


def test_counters_grow_with_the_corpus():
    """A fixed number of counters would reach the support everywhere in a large corpus, and every phrase would go through the trie."""
    words = 1_600_000_000
    assert collocations._slots_for(words, 100) >= words * 4 // 100 and collocations._slots_for(1000, 100) == collocations.SLOTS
    assert collocations._slots_for(1 << 50, 100) == collocations.SLOTS_MOST


def test_counters_let_few_rare_phrases_through(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(200)) + ". over and over" for _ in range(400)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    every, _ = collocations.phrase_counts(docs, support=100, lengths=(2, 3))
    assert {r["phrase"]: r["f"] for r in every.where("words > 1").collect()} == {"over and": 400, "and over": 400, "over and over": 400}
    words = b"\xff" * (collocations.BITMAP // 8)
    bitmaps = collocations._phrase_bitmaps(docs.select("lang", "text"), words, (2, 3), 100, collocations.BLOCK)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 400, "text": texts})
    found = {r["phrase"] for b in collocations._phrase_runs(words, bitmaps, (2, 3), 1000, 4)([batch]) for r in b.to_pylist()}
    assert {"over and", "and over", "over and over"} <= found and len(found) < 200


@pytest.mark.parametrize("n", [1, 300])
def test_word_hashes_are_the_same_alone_and_in_a_text(n, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 60)
    words = [f"é{i}x" * (i % 7 + 1) for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["  " + ",\t".join(words).upper().replace("É", "é") + " "]})
    (_, found, _, pieces), = collocations._Text().chunks([batch])
    assert found.tolist() == collocations._word_hash([w.encode() for w in words]).tolist() and pieces.tolist() == list(range(n))
