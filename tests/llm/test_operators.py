"""Every operator against a plain version, on a small given table and on rows made to be awkward."""
from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, fingerprint, htmlcut, hyperminhash, licenses, line_dedup, mixing, pii, quality, queries, sentencepieces, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits long, size string, ids string, copy string"
PROSE = "When the night train left the station at nine, nobody on the platform had seen the man with the green umbrella come back from the river bank"


def variants():
    rng = random.Random(5)
    words = PROSE.split()
    texts = [None, "", " \n\t ", "one", "one two three", PROSE, PROSE, PROSE.upper(), PROSE + " again", PROSE + " once", "é漢字🙂 " * 30, "word " * 5000, "x" * 70_000,
             "a@b.co " * 300, "\n".join([PROSE] * 4), PROSE.replace("green", "grean") + "\nsecond line", "  two  spaces   and\ttabs ▁ here",
             "Write to jane.doe@mail.example.org or call +44 (20) 7946-0018 today.", "Card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.255.1.", "1.2.3.4.5.6.7.8 a@b a@b.c_d@e.f ..@x-.y"]
    for _ in range(40):        # a group of near copies
        some = list(words)
        some[rng.randrange(len(some))] = rng.choice(words)
        texts.append(" ".join(some) * 1 + " " + " ".join(words) * 2)
    for k in range(30):        # lines one edit apart, under a common beginning
        texts.append(f"{PROSE} number {chr(97 + k % 26)}{k // 26}\n{PROSE[:60]} {rng.random()}")
    return texts


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, "en", [None, "b", "ä", "a", ""][k % 5] if k % 3 else "a", len(t or ""), 1, "s", "i", "c") for k, t in enumerate(variants())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_quality(request, name):
    df = request.getfixturevalue(name)
    rows = {r["doc_id"]: r for r in quality.ledger(df).collect()}
    for i, text in pairs(df):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["bits"] & quality.POLICIES[0].mask != 0) == brute.quality(text)
    kept = quality.apply_policy(df)
    assert kept.columns == df.columns and kept.count() == sum(r["bits"] == 0 for r in rows.values())


def test_ablation(spark):
    df = spark.createDataFrame([(b,) for b in (0, 1, 1, 3, 4)], "bits long")
    got = {(r["version"], r["rule"]): (r["failed"], r["rejected"], r["only_this"]) for r in quality.ablation(df).collect()}
    assert got["base", "few_words"] == (3, 3, 2) and got["base", "repeated_words"] == (1, 3, 0) and got["1", "symbols"] == (1, 4, 1)


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_near_duplicates(request, name):
    df = request.getfixturevalue(name)
    for size in (4, 5):
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in hyperminhash.near_duplicates(df, size=size).collect()}
        texts = dict(pairs(df))
        assert got == {i: (c, len(brute.shingles(texts[i], size)), c == i) for i, c in brute.near(texts.items(), size, 80).items()}
    assert hyperminhash.deduplicate(df).columns == df.columns


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100 + k, 200) for k in range(60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{100 + k: 100 for k in range(60)}, 200: 100}


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(awkward, edits):
    got = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in line_dedup.duplicate_lines(awkward, edits=edits).collect()}
    assert got == brute.line_duplicates(pairs(awkward), edits, line_dedup.SHORT)


def test_lines_of_given_table(given):
    removed = brute.line_duplicates(pairs(given), 1, line_dedup.SHORT)
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(given).collect()}
    for i, text in pairs(given):
        lines = (text or "").split("\n")
        stays = "\n".join(x for k, x in enumerate(lines) if (i, k) not in removed)
        assert left.get(i) == (stays if brute.WORD.search(stays) or len(stays) == len(text) else None)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(6, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at:at + 1] = rng.choice([[], ["a"], ["é", b[at]], ["b"]])
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= edits < len(b):
            rows.append((a, b))
    got = line_dedup.with_distance(spark.createDataFrame(rows, "a string, b string"), "a", "b", edits).withColumn("plain", F.levenshtein("a", "b"))
    assert got.where(f"(plain <= {edits} AND distance <> plain) OR (plain > {edits} AND distance <= {edits})").count() == 0 and len(rows) > 100


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_mixing(request, name):
    df = request.getfixturevalue(name)
    rows = mixing.mix_counts(df).collect()
    again = mixing.mix_counts(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)
    sizes = collections.Counter()
    for r in df.collect():
        sizes[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    target, taken = brute.targets(sizes), collections.Counter()
    largest = collections.Counter()
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_fingerprints(request, name):
    df = request.getfixturevalue(name)
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(df).collect()}
    rows = sorted(pairs(df))
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        a, b, c = map(fingerprint.digest, (text, following, edited))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.encoded(a))
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(a, c), fingerprint.likeness(a, b))
    assert len(got) == len(rows)


def test_fingerprint_tells_texts_apart(given):
    rows = fingerprint.edited_pairs(given).where("n_chars > 400").collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.98


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_personal_data(request, name):
    df = request.getfixturevalue(name)
    got = {r["doc_id"]: r["s"] for r in pii.all_spans(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t)) for i, t in pairs(df)}
    assert pii.sanitised(df).columns == df.columns


def test_disclosing_terms(spark):
    rows = [(k, f"Report {k} by quixotal and friends of ann{k % 2}@example.org today.") for k in range(6)] + [(10 + k, f"Plain text {k} with friends today and nothing else.") for k in range(60)]
    rows += [(90 + k, "Copy of zanzibart with bob@example.org here.") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x["value"] for x in r["terms"]] for r in pii.all_spans(df).collect()}
    assert got[10] == [] and "zanzibart" not in got[90] and "friends" not in got[0]
    text = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert text[90] == "Copy of zanzibart with [email] here." and text[10] == rows[6][1]


def test_sentencepieces(awkward, given):
    import sentencepiece

    model = sentencepieces.read_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for df in (awkward, given):
        rows = sentencepieces.decode(sentencepieces.encode(df, model=model, round_trip="same"), model=model).collect()
        for r in rows:
            assert r["same"] and r["decoded"] == (r["text"] or "")
            if "▁" not in (r["text"] or ""):
                assert r["ids"] == library.encode(r["text"] or "")


def test_pages(spark, sf_dir):
    page = ("<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies, as all do.</div>"
            "<article><h1>Head&amp;line</h1><p>First <b>pa</b>ragraph, with a sentence that is long enough.<br>Second   line.<p>Open paragraph &eacute;.<script>var a='</p>';</script></article>"
            "<aside>Side text that is also rather long, with sentences.</aside><div class=comments><p>A reader says something long here, too.</p></div><form>Mail</form><footer>&copy; me</footer>")
    df = spark.createDataFrame([(1, "u", page, 1), (2, "u", None, 1), (3, "u", "", 1), (4, "u", "only text & more", 1), (1, "u", page, 1), (5, "u", "<div>" * 3000 + "deep text", 1)], "page_id long, url string, html string, text int")
    got = htmlcut.extract(df).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["Head&line First paragraph, with a sentence that is long enough. Second line. Open paragraph é."] * 2
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (2, 3, 4)} == {2: "", 3: "", 4: "only text & more"}
    assert htmlcut.extract(df.limit(0)).count() == 0
    pages = queries.op4_html(spark, sf_dir)
    assert pages.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_minimum_cut():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        a, b = rng.random(n) * 2, rng.random(n) * 2
        edges = {(i, j): float(rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(b[i] if x[i] else a[i] for i in range(n)) + sum(c for (i, j), c in edges.items() if x[i] != x[j])
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(htmlcut.minimum_cut(a, b, edges)) - best) < 1e-9


def test_licences(awkward, given, empty):
    rows = {r["doc_id"]: set(r["families"]) for r in licenses.licences(given).collect()}
    signs = {"CC BY-NC": "CC-BY-NC", "GNU General": "GPL", "Apache License": "Apache", "MIT License": "MIT"}
    assert rows == {i: {f for s, f in signs.items() if s in (t or "")} for i, t in pairs(given)}
    assert licenses.licences(awkward).where("size(families) > 0").count() == 0


def test_toxicity(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    rows = queries.op10_toxicity(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet").where("toxic IN (0, 1)"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    hits = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert np.mean(hits) > 0.9


def test_toxicity_of_awkward_rows(awkward):
    model = toxicity.fit(["bad idiot words"] * 20 + ["fine words"] * 20, np.array([1] * 20 + [0] * 20, np.float32), 0.5)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    flat = toxicity.fit([], np.zeros(0, np.float32), 0.0)
    assert all(r["score"] < 0.5 for r in toxicity.score(awkward, flat).collect())


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 8)
    fillers = [f"plain{i} words{i % 7} here{i % 5}" for i in range(40)]
    rows = [(i, f"{fillers[i % 40]} {'slur' if i < 10 else 'insult'} and more{i % 11}" if i % 2 else f"{fillers[i % 40]} nice and more{i % 11}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    texts, toxic, share = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic")
    start = toxicity.fit(texts, toxic, share)
    seen = toxicity.learn(start, toxicity.labelled(docs, labels, "doc_id", "text", "toxic"), 600, 0.5)
    words = np.unique(toxicity.features(*toxicity.texts_of(pa.array([t for _, t in rows])))[1])
    fresh = np.setdiff1d(words, np.unique(toxicity.features(*toxicity.texts_of(pa.array(texts)))[1]))
    assert len(texts) == 16 and len(fresh) and all((a.table[fresh] != b.table[fresh]).any(1).mean() > 0.5 for a, b in zip(start, seen))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).collect()}
    assert len(found) == 600 and np.mean([found[i] == i % 2 for i in range(600)]) > 0.98


def test_toxicity_thresholds_from_counts():
    rng = np.random.default_rng(3)
    truth, group = rng.integers(0, 2, 400), rng.integers(0, 5, 400)
    found = np.round(rng.normal(truth * 2, 1) * 4) / 4
    rows, place, count = np.unique(np.stack([found, truth, group], 1), axis=0, return_inverse=True, return_counts=True)
    assert toxicity._thresholds(*rows.T[:2], rows[:, 2].astype(int), 0.1, count) == toxicity._thresholds(found, truth, group, 0.1)


def test_empty_tables(empty):
    assert quality.ledger(empty).count() == hyperminhash.near_duplicates(empty).count() == line_dedup.duplicate_lines(empty).count() == 0
    assert mixing.mix(empty).count() == mixing.mix_counts(empty).count() == fingerprint.edited_pairs(empty).count() == 0
    assert pii.all_spans(empty).count() == sentencepieces.encode(empty).count() == licenses.licences(empty).count() == 0


def test_repeated_rows(awkward):
    twice = awkward.where('doc_id < 30').union(awkward.where('doc_id < 30'))
    assert quality.ledger(twice).count() == fingerprint.edited_pairs(twice).count() == sentencepieces.encode(twice).count() == 60
    assert pii.all_spans(twice).count() == mixing.mix_counts(twice).count() == hyperminhash.near_duplicates(twice).count() == 60


def test_rows_that_share_an_id_but_not_a_text(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(300))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "a b")]
    found = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_toxicity_equals_a_plain_forward_pass():
    texts = ["bad idiot words", "fine words and more of them", "", "one"] * 10
    models = toxicity.fit(texts, np.array([1, 0, 0, 0] * 10, np.float32), 0.25)
    data = [t.encode() for t in texts[:4]]
    starts, ids, group = toxicity.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    for model in models:
        for d, got in enumerate(toxicity.logits(model, starts, ids)):
            words = [sum(model.table[i] for i in row) for row in ids[starts[d]:starts[d + 1]]] + [np.zeros(toxicity.SIZE)] * (max(toxicity.WIDTHS) - 1)
            total = float(model.shift)
            for k, filters in enumerate(model.filters):
                for f in range(toxicity.FILTERS):
                    place = k * toxicity.FILTERS + f
                    best = max(sum(float(words[at + w] @ filters[w][:, f]) for w in range(len(filters))) for at in range(starts[d + 1] - starts[d]))
                    total += max(best + float(model.bias[place]), 0) * float(model.out[place])
            assert abs(total - got) < 1e-3 * max(1, abs(total))
    assert len(toxicity.fit(["a", "b"], np.array([1, 0], np.float32), 0.5)) == len(toxicity.SEEDS)
