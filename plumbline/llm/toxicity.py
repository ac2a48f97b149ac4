"""Toxicity scores from a small convolutional text classifier, trained here with numpy.

A word, without the ASCII signs around it, has the sum of the hashed embeddings of itself and of its first 4, 5, 6 and 8 bytes. Filters of one, two and three words run
over the text, each keeps its largest answer (max pooling), and a linear layer gives the score.

Three networks learn from all labelled documents, each without another fifth of them (dealt by a hash of the text). They begin as networks fitted
on the driver to at most ``SAMPLE`` documents a class; then every labelled document is learned from on the executors: each task goes through its
share from the same beginning, and the changes of all tasks are averaged, an embedding by how often the tasks changed it. What each network says of
its fifth, counted over all labelled documents (answers rounded to 1 / STEPS_A_LOGIT), sets the threshold for each language; a score comes from the
mean of the three. The language is guessed from function words of the text itself, so that the text is a score's only input. Scores are shifted so
that every language's threshold lies at 0.5.

NULL and empty texts have one empty word and get the score of that. Texts are read whole. Labels other than 0 and 1 and labels
without a document are not used; without both classes every score is the share of toxic labels (0 without labels), under 0.5.
Repeated rows are scored each for itself; an empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import IDS_SENT, smallest, stored
from .text import Spans, chunks, texts_of, word_spans

SAMPLE = 1800
ROWS, SIZE, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 16
PREFIXES = (4, 5, 6, 8)
EPOCHS, STEPS, BATCH, RATE = 6, 1000, 24, 0.01
#: Networks that are fitted from different starts, each with other documents kept apart; a score is their mean.
SEEDS = (7, 8, 9)
#: Fifths of the documents; network k does not see fifth k.
FOLDS = 5
#: Learning rate and fewest documents of a task, when all labelled documents are learned from.
LATER_RATE, SHARE = 0.003, 2000
#: Fewer labelled documents are gone through up to five times.
FEW = 15_000
#: Table rows in a block of changes, and blocks summed up by one task at a time.
BLOCK, FAN = 2048, 64
STEPS_A_LOGIT = 256
CHUNK = 1 << 20
#: Words whose answers are computed at once, so that they stay in the processor's cache.
WORDS_AT_ONCE = 8192
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Frequent function words of four languages. Other texts belong to a fifth group.
FUNCTION_WORDS = ("the of and to in is that it for was with as by be this from",
                  "der die das und von den mit zu ist für des auf ein nicht im eine",
                  "le la les de des et en que un une du pour dans qui est par",
                  "el la los las de que y en un una del para con por se su")


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]       # one (width, SIZE, FILTERS) a width
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: np.ndarray          # one a language group


def _vocabulary() -> list[np.ndarray]:
    found = []
    for words in FUNCTION_WORDS:
        data = np.frombuffer(words.encode(), np.uint8)
        _, first, end = word_spans(data, np.array([0, len(data)]))
        found.append(np.sort(Spans(data)(first, end)))
    return found


def _bare(data: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without the ASCII signs around them; words of signs alone stay as they are."""
    if not len(row):
        return row, first, end
    place = np.arange(len(data))
    kept = _IN_WORD[data]
    last = np.maximum.accumulate(np.where(kept, place, -1))[end - 1] + 1
    begin = np.minimum.accumulate(np.where(kept, place, len(data))[::-1])[::-1][first]
    some = begin < last
    return row, np.where(some, begin, first), np.where(some, last, end)


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each row and the end, number of each word, table rows of each numbered word, language group of each row). Equal words have
    one number. Rows without words get a word of table row 0."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    row, first, end = _bare(data, *word_spans(data, offsets))
    n = len(offsets) - 1
    spans = Spans(data)
    whole, some, number = np.unique(spans(first, end), return_index=True, return_inverse=True)
    first, end = first[some], end[some]
    ids = np.empty((len(whole), 1 + len(PREFIXES)), np.int32)
    ids[:, 0] = whole % np.uint64(ROWS - 1) + np.uint64(1)
    for k, length in enumerate(PREFIXES, 1):
        ids[:, k] = (spans(first, np.minimum(first + length, end)) + np.uint64(k)) % np.uint64(ROWS - 1) + np.uint64(1)
    hits = np.stack([np.bincount(row[np.isin(whole, words)[number]], minlength=n) for words in _vocabulary()])
    group = np.where(hits.max(0) > 0, hits.argmax(0), len(FUNCTION_WORDS))
    counts = np.bincount(row, minlength=n)
    lonely = np.flatnonzero(counts == 0)
    if len(lonely):
        number = np.insert(number, np.searchsorted(row, lonely), len(ids))
        ids = np.concatenate([ids, np.zeros((1, ids.shape[1]), np.int32)])
        counts[lonely] = 1
    return np.concatenate([[0], np.cumsum(counts)]), number, ids, group


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each row and the end, table rows of each word, language group of each row). Rows without words get word 0."""
    starts, number, ids, group = _coded(data, offsets)
    return starts, ids[number], group


def _padded(starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two empty rows after each text, so that no window reaches into the next one."""
    gap = max(WIDTHS) - 1
    n = len(starts) - 1
    lengths = np.diff(starts)
    first = starts[:-1] + gap * np.arange(n)
    place = np.arange(len(ids)) + gap * np.repeat(np.arange(n), lengths)
    out = np.zeros((len(ids) + gap * n, ids.shape[1]), np.int32)
    out[place] = ids
    return out, first, first + lengths


def _embedded(model: Model, ids: np.ndarray) -> np.ndarray:
    total = model.table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        total += model.table[ids[:, k]]
    return total


def _answers(model: Model, x: np.ndarray) -> np.ndarray:
    n = len(x) - max(WIDTHS) + 1
    each = x @ np.concatenate([part for filters in model.filters for part in filters], 1)
    out, at = np.empty((n, FILTERS * len(WIDTHS)), each.dtype), 0
    for i, filters in enumerate(model.filters):
        own = out[:, i * FILTERS:(i + 1) * FILTERS]
        for k in range(len(filters)):
            part = each[k:k + n, at:at + FILTERS]
            np.copyto(own, part) if k == 0 else np.add(own, part, out=own)
            at += FILTERS
    return out + model.bias


def _judged(model: Model, starts: np.ndarray, number: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of texts whose words are ``ids[number]``."""
    known = np.concatenate([np.zeros((1, SIZE), np.float32), _embedded(model, ids)])
    padded, first, end = _padded(starts, number[:, None] + 1)
    padded, at, gap, out = padded[:, 0], 0, max(WIDTHS) - 1, np.empty(len(first))
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(end, first[at] + WORDS_AT_ONCE, "right")))
        answers = _answers(model, known[padded[first[at]:end[to - 1] + gap]])
        pooled = np.stack([answers[a:b].max(0) for a, b in zip((first[at:to] - first[at]).tolist(), (end[at:to] - first[at]).tolist())])
        out[at:to] = np.maximum(pooled, 0) @ model.out + model.shift
        at = to
    return out


def logits(model: Model, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return _judged(model, starts, np.arange(len(ids)), ids)


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * gradient ** 2
        value[rows] -= self.rate * (self.m[rows] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[rows] / (1 - 0.99 ** self.t)) + 1e-6)


def _fold(text: bytes) -> int:
    return zlib.crc32(text) % FOLDS


def fit(texts: list[str], toxic: np.ndarray, share: float) -> list[Model]:
    """``share``: of toxic documents among all, for the thresholds."""
    docs = []
    for text in texts:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        _, ids, group = features(data, np.array([0, len(data)]))
        docs.append((ids, int(group[0])))
    fold = np.array([_fold((text or "").encode("utf-8", "surrogatepass")) for text in texts], np.int64)
    models = [_fit_one(docs, toxic, share, seed, fold == k) for k, seed in enumerate(SEEDS)]
    if 0 < toxic.sum() < len(toxic):
        # every document that some network has not seen, as that network sees it
        apart = [np.flatnonzero(fold == k) for k in range(len(SEEDS))]
        found = np.concatenate([logits(m, *_joined(docs, kept)) for m, kept in zip(models, apart) if len(kept)])
        apart = np.concatenate(apart)
        thresholds = _thresholds(found, toxic[apart], np.array([docs[i][1] for i in apart]), share)
        for m in models:
            m.thresholds[:] = thresholds
    return models


def _joined(docs, rows) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in rows])]), np.concatenate([docs[i][0] for i in rows])


def _fit_one(docs: list[tuple[np.ndarray, int]], toxic: np.ndarray, share: float, seed: int, apart: np.ndarray) -> Model:
    rng = np.random.default_rng(seed)
    flat = lambda shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = Model(flat((ROWS, SIZE), 0.1), [flat((w, SIZE, FILTERS), 0.3) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32),
                  flat(FILTERS * len(WIDTHS), 0.3), 0.0, np.zeros(len(FUNCTION_WORDS) + 1))
    model.table[0] = 0
    if not 0 < toxic.sum() < len(toxic):
        model.out[:] = 0
        model.shift = float(np.log(max(share, 1e-6) / (1 - min(share, 0.49))))
        model.thresholds[:] = 0
        return model
    learn = rng.permutation(np.flatnonzero(~apart))
    learner, weight = _Learner(model, RATE), _weight(toxic, float(toxic.mean()))
    for _ in range(max(EPOCHS, min(30, -(-STEPS * BATCH // max(len(learn), 1))))):      # few documents are seen more often
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            some = learn[at:at + BATCH]
            learner.step([docs[i][0] for i in some], toxic[some], weight[some])
    return model


def _weight(toxic: np.ndarray, share: float) -> np.ndarray:
    """Both classes weigh the same."""
    return np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)


class _Learner:
    """Changes a model by one batch of documents after the other."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.table, self.out, self.bias = _Adam(model.table.shape, rate), _Adam(model.out.shape, rate), _Adam(model.bias.shape, rate)
        self.filters = [_Adam(f.shape, rate) for f in model.filters]
        #: how many batches changed a row of the table
        self.changed = np.zeros(len(model.table), np.float32)

    def step(self, docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> None:
        model = self.model
        padded, first, end = _padded(np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.concatenate(docs))
        x = _embedded(model, padded)
        answers = _answers(model, x)
        best = np.stack([a + answers[a:b].argmax(0) for a, b in zip(first, end)])
        pooled = np.take_along_axis(answers, best, 0)
        active = np.maximum(pooled, 0)
        error = (1 / (1 + np.exp(-np.clip(active @ model.out + model.shift, -30, 30))) - toxic).astype(np.float32) * weight / len(docs)
        back = error[:, None] * model.out * (pooled > 0)
        grown, rows = [], []
        for k, own in enumerate(model.filters):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            change = np.zeros_like(own)
            for w in range(len(own)):
                seen = x[best[:, cols] + w]                      # (docs, filters, SIZE)
                change[w] = np.einsum("df,dfs->sf", back[:, cols], seen)
                grown.append((back[:, cols][:, :, None] * own[w].T[None]).reshape(-1, SIZE))
                rows.append((best[:, cols] + w).ravel())
            self.filters[k].step(own, change)
        grown, rows = np.concatenate(grown), np.concatenate(rows)
        touched, where = np.unique(padded[rows].ravel(), return_inverse=True)
        total = np.zeros((len(touched), SIZE), np.float32)
        np.add.at(total, where, np.repeat(grown, padded.shape[1], axis=0))
        self.table.step(model.table, total, touched)
        model.table[0] = 0
        self.changed[touched] += 1
        self.out.step(model.out, active.T @ error)
        self.bias.step(model.bias, back.sum(0))
        model.shift -= self.rate * float(error.sum()) * 5


def _thresholds(found: np.ndarray, truth: np.ndarray, group: np.ndarray, share: float, count: np.ndarray | None = None) -> list[float]:
    """For each language the logit that separates the documents kept apart best (F1 at the real share); the middle of the gap around
    it. Languages with fewer than 5 documents of either class take the threshold of all. ``count``: documents that an entry stands for."""
    toxic = truth * (1 if count is None else count)
    clean = (1 - truth) * (1 if count is None else count)

    def best(rows) -> float:
        value, place = np.unique(-found[rows], return_inverse=True)
        value, real, other = -value, np.bincount(place, toxic[rows]), np.bincount(place, clean[rows])
        hits, wrong = np.cumsum(real) / max(real.sum(), 1) * share, np.cumsum(other) / max(other.sum(), 1) * (1 - share)
        f1 = 2 * hits / (hits + wrong + share)
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)[-1]
        return float(value[top] + (value[top + 1] if top + 1 < len(value) else value[top] - 1)) / 2

    everything = best(np.arange(len(found))) if toxic.sum() > 0 and clean.sum() > 0 else 0.0
    out = []
    for g in range(len(FUNCTION_WORDS) + 1):
        rows = np.flatnonzero(group == g)
        enough = toxic[rows].sum() >= 5 and clean[rows].sum() >= 5
        out.append(best(rows) if enough else everything)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[list[str], np.ndarray, float]:
    """At most SAMPLE documents a class come to the driver, for the networks to begin with."""
    usable = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    share = usable.agg(F.avg("__label").alias("s")).first()["s"]
    chosen = [smallest(usable.where(F.col("__label") == c), F.xxhash64("__id"), SAMPLE, "__id") for c in (0, 1)]
    some = chosen[0].union(chosen[1])
    rows = docs.join(F.broadcast(some), docs[doc_id] == some["__id"]).select("__id", "__label", F.col(text).alias("__text")).collect()
    rows.sort(key=lambda r: (r["__id"], r["__label"]))
    return [r["__text"] for r in rows], np.array([r["__label"] for r in rows], np.float32), float(share or 0.0)


def _dense(model: Model) -> np.ndarray:
    """Everything but the table, which all documents change."""
    return np.concatenate([*[f.ravel() for f in model.filters], model.bias, model.out, [model.shift]]).astype(np.float64)


def _with_dense(model: Model, values: np.ndarray) -> None:
    at = 0
    for own in (*model.filters, model.bias, model.out):
        own[...] = values[at:at + own.size].reshape(own.shape)
        at += own.size
    model.shift = float(values[at])


_CHANGES = "network int, block int, part int, weights binary, changes binary"


def _learning(shared, share: float):
    """A task's pass over its documents: what it changed, in blocks. ``changes`` are multiplied by their ``weights``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        start = shared.value
        models = [Model(m.table.copy(), [f.copy() for f in m.filters], m.bias.copy(), m.out.copy(), m.shift, m.thresholds) for m in start]
        learners, seen, rng = [_Learner(m, LATER_RATE) for m in models], np.zeros(len(models)), np.random.default_rng(7)
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
            weight = _weight(toxic, share)
            for first, last in chunks(offsets, CHUNK):
                starts, ids, _ = features(data, offsets[first:last + 1])
                fold = np.array([_fold(data[offsets[i]:offsets[i + 1]]) for i in range(first, last)])
                for k, learner in enumerate(learners):
                    rows = rng.permutation(np.flatnonzero(fold != k))
                    seen[k] += len(rows)
                    for at in range(0, len(rows), BATCH):
                        some = rows[at:at + BATCH]
                        learner.step([ids[starts[i]:starts[i + 1]] for i in some], toxic[first + some], weight[first + some])
        part = TaskContext.get().partitionId()
        for k, (before, after, learner) in enumerate(zip(start, models, learners)):
            if not seen[k]:
                continue
            rows = [(-1, np.array([seen[k]]), (_dense(after) - _dense(before))[None])]
            change = after.table - before.table
            rows += [(at // BLOCK, learner.changed[at:at + BLOCK], change[at:at + BLOCK]) for at in range(0, ROWS, BLOCK)]
            yield pa.RecordBatch.from_pylist([{"network": k, "block": block, "part": part, "weights": _packed(w), "changes": _packed(w[:, None] * c)} for block, w, c in rows],
                                             _CHANGES_ARROW)
    return run


_CHANGES_ARROW = pa.schema([("network", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("weights", pa.binary()), ("changes", pa.binary())])


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.float32).tobytes(), "zstd", asbytes=True)


def _unpacked(value: bytes, block: int, each: int) -> np.ndarray:
    size = each * (BLOCK if block >= 0 else 1)
    return np.frombuffer(pa.decompress(value, 4 * size, "zstd"), np.float32).reshape(-1, each)


def _summed(width: int):
    def run(rows: pa.Table) -> pa.Table:
        first = {name: rows.column(name)[0].as_py() for name in ("network", "block", "part")}
        total = [sum(_unpacked(v.as_buffer(), first["block"], each).astype(np.float64) for v in rows.column(name))
                 for name, each in (("weights", 1), ("changes", SIZE if first["block"] >= 0 else width))]
        return pa.Table.from_pylist([first | {"part": first["part"] // FAN, "weights": _packed(total[0]), "changes": _packed(total[1])}], _CHANGES_ARROW)
    return run


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """__text, __label of every document with a label 0 or 1. Up to IDS_SENT labels are broadcast, more are shuffled."""
    return _labels_joined(docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")), "__doc", labels, doc_id, label).select("__text", "__label")


def _labels_joined(rows: DataFrame, key: str, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    return rows.join(F.broadcast(usable) if usable.count() <= IDS_SENT else usable, rows[key] == F.col("__id"))


def learn(models: list[Model], rows: DataFrame, n: int, share: float) -> list[Model]:
    """The models after a pass over all ``n`` rows (__text, __label). A few MB reach the driver, whatever the number of rows and tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    changes = rows.coalesce(max(1, n // SHARE)).mapInArrow(_learning(shared, share), _CHANGES)
    width = len(_dense(models[0]))
    for _ in range(2):          # the sums of FAN tasks, then of these
        changes = changes.groupBy("network", "block", F.floor(F.col("part") / FAN).alias("some")).applyInArrow(_summed(width), _CHANGES)
    total = {}
    for r in changes.collect():
        key = r["network"], r["block"]
        some = [_unpacked(bytes(r[name]), r["block"], each).astype(np.float64) for name, each in (("weights", 1), ("changes", SIZE if r["block"] >= 0 else width))]
        total[key] = [a + b for a, b in zip(total[key], some)] if key in total else some
    out = []
    for k, m in enumerate(models):
        table = m.table.copy()
        new = Model(table, [f.copy() for f in m.filters], m.bias.copy(), m.out.copy(), m.shift, m.thresholds.copy())
        for (network, block), (weights, change) in total.items():
            if network == k and block >= 0:
                table[block * BLOCK:(block + 1) * BLOCK] += change / np.maximum(weights, 1)
            elif network == k:
                _with_dense(new, _dense(m) + change[0] / weights[0, 0])
        out.append(new)
    return out


_JUDGED = pa.schema([("doc_id", pa.int64()), ("group", pa.int32()), ("fold", pa.int32()), ("mean", pa.float64()), ("apart", pa.float64())])


def judged(docs: DataFrame, models: list[Model], doc_id: str, text: str) -> DataFrame:
    """doc_id, group (of the language), fold, mean (logit of all networks), apart (logit of the network that does not learn from the fold, or NULL)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, last in chunks(offsets, CHUNK):
                starts, number, ids, group = _coded(data, offsets[first:last + 1])
                found = np.stack([_judged(m, starts, number, ids) for m in fitted])
                fold = np.array([_fold(data[offsets[i]:offsets[i + 1]]) for i in range(first, last)])
                apart = found[np.minimum(fold, len(fitted) - 1), np.arange(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.int64()), pa.array(group.astype(np.int32)), pa.array(fold.astype(np.int32)),
                                                  pa.array(found.mean(0)), pa.array(apart, mask=fold >= len(fitted))], schema=_JUDGED)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, group int, fold int, mean double, apart double")


def _finished(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("group") + 1)
    value = 1 / (1 + F.exp(-F.greatest(F.least(F.col("mean") - threshold, F.lit(30.0)), F.lit(-30.0))))
    return rows.select("doc_id", value.alias("score")).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, model: list[Model], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5). No shuffle."""
    return _finished(judged(docs, model, doc_id, text), list(np.mean([m.thresholds for m in model], axis=0)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, score, predicted of all documents; the networks and thresholds come from all labelled ones."""
    texts, toxic, share = training_sample(docs, labels, doc_id, text, label)
    models = fit(texts, toxic, share)
    if not 0 < toxic.sum() < len(toxic):
        return score(docs, models, doc_id, text)
    rows = labelled(docs, labels, doc_id, text, label)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("__label").alias("share")).first()
    for _ in range(max(1, min(5, FEW // max(size["n"], 1)))):       # few documents are seen more often
        models = learn(models, rows, size["n"], size["share"])
    found = stored(judged(docs, models, doc_id, text), "toxicity")
    apart = _labels_joined(found.where(F.col("apart").isNotNull()), "doc_id", labels, doc_id, label)
    step = F.round(F.greatest(F.least(F.col("apart"), F.lit(30.0)), F.lit(-30.0)) * STEPS_A_LOGIT).cast("int").alias("step")
    counts = apart.groupBy("group", "__label", step).count().toArrow()
    if not counts.num_rows:
        return _finished(found, [0.0] * (len(FUNCTION_WORDS) + 1))
    return _finished(found, _thresholds(counts["step"].to_numpy() / STEPS_A_LOGIT, *[counts[c].to_numpy() for c in ("__label", "group")], share, counts["count"].to_numpy()))
