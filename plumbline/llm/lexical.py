"""Ranked lexical search over bit-sliced Bloom signatures.

``build`` makes the index. The distinct terms of a document become a Bloom filter: for a term that occurs tf times the pairs (term, 0),
(term, 1), ... up to (term, floor(log2 tf)) are set, HASHES bits each. Documents of about the same number of pairs share a block, and a block is
kept by slices: one row of bits per filter position, one column per document. A query ANDs a term's HASHES slices; the result holds every document
with the term and a few others, and the deepest pair found bounds tf from above (exactly for tf = 1). ``search`` weighs the slices and adds them
up: an upper bound of the score of every document for every item. The documents with the best bounds are scored exactly, which gives a floor under
each item's k-th best score; then every document whose bound is not below that floor is scored exactly on its whole text. A document is left out
only when its bound proves that k others are better, so the result is that of scoring everything.

Score: terms are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased; N documents with a term, L terms in all, n terms of a
document, df documents with the term; w = floor(1000 ln((2N + 2) / (2df + 1))), m = 25 + 75 n N div L, and the sum over the item's terms (repeats
count) of w * (10^9 tf div (1000 tf + 8 m)). Equal scores go by doc_id, NULL last.

NULL and empty texts hold no term: such documents do not count, such items have no rows. Very long texts fill a block of their own. Repeated rows
are documents of their own; rows of items with equal id and text are one item, rows that share the id only are ranked apart (told by ``copy``).
Empty tables give no rows. Other columns are not read, so their names cannot clash. Items are taken in blocks of about ITEM_BYTES, and only a
block's terms go to the tasks. The index is a stored table; nothing about single documents reaches the driver.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

HASHES = 3
#: Filter positions for each (term, level) pair of a document, at least; rounded up to a power of two.
BITS = 8
#: Bits (as bytes while it is filled) of a block, and most documents in one.
BLOCK_BITS, BLOCK_DOCS = 1 << 23, 2048
ITEM_BYTES = 1 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = "width long, ids array<long>, lengths array<long>, slices binary"


def terms_of(text: str | None) -> list[bytes]:
    """All terms in order. A byte of 128 or more belongs to a character outside ASCII, so bytes split as characters would."""
    return text.encode().translate(_TABLE).split() if text else []


class _Hashes(dict):
    """Term -> two 32-bit hashes in one number, remembered; emptied when it grows."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term)
        return h


def positions(hashes: np.ndarray, levels: np.ndarray, width: int) -> np.ndarray:
    """(pairs, HASHES) filter positions."""
    mixed = (hashes + levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return ((mixed[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


class _Block:
    """Filters of the same width, filled document by document."""

    def __init__(self, width: int):
        self.width = width
        self.most = max(8, min(BLOCK_DOCS, BLOCK_BITS // width))
        self.bits = np.zeros((width, self.most), bool)
        self.ids, self.lengths = [], []

    def add(self, doc_id, n: int, places: np.ndarray) -> None:
        self.bits[places.ravel(), len(self.ids)] = True
        self.ids.append(doc_id)
        self.lengths.append(n)

    def row(self) -> dict:
        return {"width": self.width, "ids": self.ids, "lengths": self.lengths, "slices": np.packbits(self.bits[:, :len(self.ids)], axis=1).tobytes()}


def _blocks(batches):
    open_, hashes = {}, _Hashes()
    schema = pa.schema([("width", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary())])

    def out(block: _Block):
        return pa.RecordBatch.from_pylist([block.row()], schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = terms_of(text.as_py())
            if not words:
                continue
            counts = Counter(words)
            h = np.array([hashes[t] for t in counts], np.uint64)
            top = np.frexp(np.fromiter(counts.values(), np.float64, len(counts)))[1] - 1      # floor(log2 tf)
            levels = np.concatenate([np.full(int((top >= k).sum()), k) for k in range(int(top.max()) + 1)])
            pairs = np.concatenate([h[top >= k] for k in range(int(top.max()) + 1)])
            width = 1 << max(6, (BITS * len(pairs) - 1).bit_length())
            block = open_.get(width) or open_.setdefault(width, _Block(width))
            block.add(doc_id, len(words), positions(pairs, levels, width))
            if len(block.ids) == block.most:
                yield out(open_.pop(width))
    for block in open_.values():
        yield out(block)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: one row per block of documents. Store it and search it as often as you like."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_blocks, _INDEX)


def scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _weights(docs: DataFrame, wanted: list[bytes], doc_id: str, text: str, n_docs: int) -> dict[bytes, int]:
    """Weight of each wanted term from its exact document count."""
    number = {t: i for i, t in enumerate(wanted)}

    def counted(batches):
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for value in batch.column(0):
                met = number.keys() & set(terms_of(value.as_py()))
                total[[number[t] for t in met]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    found = docs.select(text).mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = {wanted[r["term"]]: r["df"] for r in found}
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in wanted}


class _Bounds:
    """Upper bounds of a block of items over blocks of documents."""

    def __init__(self, items: list[Counter], weight: dict[bytes, int], n_docs: int, n_terms: int):
        used = sorted({t for c in items for t in c if weight[t] > 0})
        place = {t: i for i, t in enumerate(used)}
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in used], np.uint64)
        self.at = [np.array([place[t] for t in c if weight[t] > 0], np.int64) for c in items]
        self.by = [np.array([c[t] * weight[t] for t in c if weight[t] > 0], np.float64) for c in items]
        self.n_docs, self.n_terms = n_docs, n_terms

    def __call__(self, width: int, lengths: list[int], slices: bytes) -> np.ndarray:
        """(items, documents), whole numbers as doubles."""
        docs = len(lengths)
        out = np.zeros((len(self.at), docs))
        if not len(self.hashes):
            return out
        bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
        n = np.array(lengths, np.int64)
        m = np.array([25 + (75 * x * self.n_docs) // self.n_terms for x in lengths], np.int64)
        before, held = np.zeros(docs, np.int64), None
        rows = np.arange(len(self.hashes))                       # terms that some document of the block may hold so often
        for level in range(63):
            places = positions(self.hashes[rows], np.full(len(rows), level), width)
            slice_ = bits[places[:, 0]]
            for k in range(1, HASHES):
                slice_ = slice_ & bits[places[:, k]]
            slice_ = slice_ if held is None else slice_ & held
            some = slice_.any(axis=1)
            if not some.any():
                break
            rows, held = rows[some], slice_[some]
            most = scores(np.minimum((2 << level) - 1, n), m)
            gain = (most - before).astype(np.float64)
            before = most
            where = np.full(len(self.hashes), -1)
            where[rows] = np.arange(len(rows))
            flags = np.unpackbits(held, axis=1, count=docs)
            for i, (at, by) in enumerate(zip(self.at, self.by)):
                own = where[at]
                hit = own >= 0
                if hit.any():
                    out[i] += (by[hit] @ flags[own[hit]]) * gain
        return out


def _best_bounds(bounds: _Bounds, k: int):
    """Of each task and item the k documents with the largest bounds."""
    def run(batches):
        best = {}
        for batch in batches:
            for r in batch.to_pylist():
                values = bounds(r["width"], r["lengths"], r["slices"])
                ids = np.array([(0 if x is None else x, x is None) for x in r["ids"]], [("id", "i8"), ("none", "?")])
                for i in range(len(values)):
                    top = np.argpartition(-values[i], k - 1)[:k] if values.shape[1] > k else np.arange(values.shape[1])
                    top = top[values[i][top] > 0]
                    best[i] = sorted(best.get(i, []) + [(float(values[i][d]), None if ids["none"][d] else int(ids["id"][d])) for d in top], key=lambda x: -x[0])[:k]
        rows = [(i, d, b) for i, some in best.items() for b, d in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())],
                                         ["item", "doc_id", "bound"])
    return run


def _not_excluded(bounds: _Bounds, floor: np.ndarray):
    """(doc_id, items) for each document with a bound that reaches an item's floor."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values = bounds(r["width"], r["lengths"], r["slices"])
                d, i = np.nonzero(((values >= floor[:, None]) & (values > 0)).T)
                ends = np.flatnonzero(np.r_[d[1:] != d[:-1], True]) + 1 if len(d) else np.zeros(0, np.int64)
                ids = [r["ids"][x] for x in d[ends - 1]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(i, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "items"])
    return run


def _rescored(docs: DataFrame, candidates: DataFrame, items: list[Counter], weight: dict[bytes, int], n_docs: int, n_terms: int,
              doc_id: str, text: str) -> DataFrame:
    """(item, doc_id, score) of candidates (id, items), from the whole texts."""
    def run(batches):
        for batch in batches:
            rows = []
            for d, value, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = terms_of(value.as_py())
                if not words:
                    continue
                counts, m8 = Counter(words), 8 * (25 + (75 * len(words) * n_docs) // n_terms)
                for i in wanted:
                    total = 0
                    for t, q in items[i].items():
                        tf = counts.get(t, 0)
                        if tf:
                            total += q * weight[t] * ((1_000_000_000 * tf) // (1000 * tf + m8))
                    if total > 0:
                        rows.append((i, d, total))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    # one row per id, so each row of documents meets one; an id that several rows share is scored for each of them
    wanted = stored(candidates.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "lexical-candidates")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = own.join(rows_or_broadcast(wanted), own["doc_id"].eqNullSafe(wanted["doc_id"])).select(own["doc_id"], "text", "items")
    return known.mapInArrow(run, "item int, doc_id long, score long")


def rows_or_broadcast(wanted: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A list of candidates that is short enough goes to every task; a longer one meets the documents in a shuffle by id."""
    held = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("items")).alias("m")).first()
    return F.broadcast(wanted) if held["n"] + (held["m"] or 0) <= most else wanted


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_blocks(items: DataFrame, item_id: str, text: str, size: int = ITEM_BYTES):
    """The items, a block of about ``size`` bytes at a time: lists of (item_id, copy, terms)."""
    own = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    own = stored(own.dropDuplicates(["item_id", "copy"]), "lexical-items")
    total = own.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = int(total // size) + 1
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item_id", "copy", F.lit(7)), F.lit(blocks)) == b)
        yield [(r["item_id"], r["copy"], Counter(terms_of(r["text"]))) for r in part.collect()]


def search(docs: DataFrame, items: DataFrame, k: int = 10, index: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, copy, rank, doc_id, score): the k best documents of every item, exactly. ``index`` is what ``build`` made of ``docs``."""
    spark = docs.sparkSession
    index = stored(build(docs, doc_id, text), "lexical-index") if index is None else index
    size = index.select(F.size("ids").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.sum("n"), F.sum("t")).first()
    n_docs, n_terms = size[0] or 0, size[1] or 0
    kind = items.schema[item_id].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {kind}, copy long, rank int, doc_id long, score long")
    if not n_docs:
        return empty
    parts = []
    for block in item_blocks(items, item_id, item_text):
        block = [x for x in block if x[2]]
        if not block:
            continue
        wanted = sorted({t for *_, c in block for t in c})
        weight = _weights(docs, wanted, doc_id, text, n_docs)
        counts = [c for *_, c in block]
        bounds = _Bounds(counts, weight, n_docs, n_terms)
        first = index.mapInArrow(_best_bounds(bounds, k), "item int, doc_id long, bound double")
        order = Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last())
        first = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("doc_id", F.array("item").alias("items"))
        tried = _rescored(docs, first, counts, weight, n_docs, n_terms, doc_id, text)
        floor = np.zeros(len(block))
        for r in _ranked(tried, k).where(F.col("rank") == k).select("item", "score").collect():
            floor[r["item"]] = r["score"]
        left = index.mapInArrow(_not_excluded(bounds, floor), "doc_id long, items array<int>")
        ranked = _ranked(_rescored(docs, left, counts, weight, n_docs, n_terms, doc_id, text), k)
        names = F.broadcast(spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(block)], f"item int, item_id {kind}, copy long"))
        parts.append(stored(ranked.join(names, "item").select("item_id", "copy", "rank", "doc_id", "score"), "lexical-ranked"))
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out
