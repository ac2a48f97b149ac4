"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Its sketch has 128 buckets; a bucket keeps the smallest hash of its shingles in
floating form, 6 bits for the leading zeros and 10 for the mantissa. Empty buckets borrow from others in a fixed random
order. Four registers make one 64-bit band; documents that share a band are candidates. The share of equal registers, corrected for
chance collisions, drops hopeless pairs, and every link that is left is confirmed on the full sets.

Documents with equal sets are one class from the start and only its smallest id goes on. In a band bucket members are compared with
a hub: first with the smallest id, then, in the buckets whose members are not yet in one component, with 4, 16 and 64
members drawn by hash, each only with members of other components, which compares buckets of up to SURE_HUBS members whole. Larger ones
take part in the first of these rounds only; the members of those that are torn after the rounds are compared whole in blocks of sets
(``_block_links``), where a pair is a number in a matrix and no row. A pair that meets in several buckets or
rounds leaves their joins once. Before these rounds the shingles of the members
still open are counted: one that nobody else has cannot be common to two sets, which bounds what two sets can have in common. Members,
pairs and blocks that this bound excludes are left out; no link is lost by it. Two documents with similarity 0.8 meet in 13 of
32 buckets on average (in none with chance 5e-8), and one bucket compares them, however many members it has.

NULL texts and texts without words have an empty set and no link. Fewer words than a shingle has: the whole sequence is the only
shingle. Rows that share an id are one document with the union of their links. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import rows_with, stored
from .text import chunks, mix, texts_of, word_hashes

REGISTERS, BAND = 128, 4
MANTISSA_BITS = 10
#: Sets below this size are not judged by their sketch: their registers are borrowed and depend on each other.
SURE_SIZE = 512
#: Five standard deviations of the estimate at 0.8 with 128 registers (0.035 each), and some more.
MARGIN = 0.2
#: Chance that registers of unrelated elements are equal: same leading zeros (1/3) and same mantissa (2^-10).
COLLISION = 2.0 ** -MANTISSA_BITS / 3
FIRST_HUBS, SURE_HUBS = 4, 64
#: A block of crowded buckets' sets ends after so many sets or shingles (a larger set is a block of its own).
BLOCK_SETS, BLOCK_SHINGLES = 1 << 10, 1 << 20
#: Shingles counted in one matrix product, and pairs of holders counted at once.
COLUMNS, HOLDERS = 1 << 12, 1 << 22
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ORDER = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, REGISTERS), axis=1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, sorted by row and hash."""
    words, row, _, _ = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    longs = np.flatnonzero(row[: max(len(row) - size + 1, 0)] == row[size - 1:]) if len(row) >= size else np.zeros(0, np.int64)
    value = np.zeros(len(longs), np.uint64)
    for k in range(size):
        value = value * _STEP + words[longs + k]
    rows, values = [row[longs]], [mix(value)]
    first = np.cumsum(counts) - counts
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        value = np.full(len(short), few, np.uint64)
        for k in range(few):
            value = value * _STEP + words[first[short] + k]
        rows.append(short)
        values.append(mix(value + np.uint64(few)))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def registers(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, 128) registers of sorted sets; rows without elements stay 0."""
    bits = REGISTERS.bit_length() - 1
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
    place = rows * REGISTERS + bucket
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]      # sorted: the first of a bucket is its minimum
    rest = (values[least] << np.uint64(bits)) >> np.uint64(bits)
    width = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    top = (rest >> np.maximum(width - 1 - MANTISSA_BITS, 0).astype(np.uint64)) << np.maximum(MANTISSA_BITS + 1 - width, 0).astype(np.uint64)
    mantissa = top.astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    zeros = np.minimum(64 - bits - width, 62)
    out = np.zeros(n * REGISTERS, np.int64)
    out[place[least]] = ((zeros + 1) << MANTISSA_BITS) | mantissa
    out = out.reshape(n, REGISTERS)
    own = out != 0
    open_rows = np.flatnonzero(own.any(1) & ~own.all(1))
    for turn in range(REGISTERS):
        if not len(open_rows):
            break
        lender = _ORDER[:, turn]
        part = out[open_rows]
        lent = np.where((part == 0) & own[open_rows][:, lender], out[open_rows][:, lender] * own[open_rows][:, lender], 0)
        part = np.where(part == 0, lent, part)
        out[open_rows] = part
        open_rows = open_rows[(part == 0).any(1)]
    return out


def sketches(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, n (set size), d1, d2 (a digest of the set), bands (32 longs of four registers; NULL for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, last in chunks(offsets):
                n = last - first
                rows, values = shingle_sets(data, offsets[first:last + 1], size)
                counts = np.bincount(rows, minlength=n)
                digest = []
                for salt in (1, 2):
                    total = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64, out=total[1:])
                    end = np.cumsum(counts)
                    digest.append((total[end] - total[end - counts]).view(np.int64))
                r = registers(rows, values, n).astype(np.uint64).reshape(n, -1, BAND)
                packed = sum(r[:, :, k] << np.uint64(16 * k) for k in range(BAND)).view(np.int64)
                width = packed.shape[1]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(packed.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), bands], ["doc_id", "n", "d1", "d2", "bands"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(sketch, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, last in chunks(offsets):
                rows, values = shingle_sets(data, offsets[first:last + 1], size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=last - first))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["node", "set"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(whole, "node long, set array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity from two lists of packed registers, corrected for collisions."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: sum(((F.shiftrightunsigned(x.bitwiseXOR(y), 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) == 0).cast("int")
                                                           for k in range(BAND)), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return (equal / F.lit(float(REGISTERS)) - F.lit(COLLISION)) / F.lit(1 - COLLISION)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, na, b, nb: two classes and their set sizes) whose full sets are similar enough. The sketches are compared where both sets
    are large, and only the texts of candidates are read into sets."""
    able = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    large = F.least("na", "nb") >= SURE_SIZE
    a, b = (classes.where(F.col("n") >= SURE_SIZE).select(F.col("rep").alias(x), F.col("bands").alias(f"r{x}")) for x in "ab")
    likely = able.where(large).join(a, "a").join(b, "b").where(estimate(F.col("ra"), F.col("rb")) >= percent / 100 - MARGIN)
    left = stored(able.where(~large).select("a", "b").union(likely.select("a", "b")), "near-pairs")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    sets = stored(_sets(rows_with(docs, doc_id, nodes), doc_id, text, size).withColumn("digest", F.xxhash64("set")).dropDuplicates(["node", "digest"]), "near-sets")
    sa, sb = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return left.join(sa, "a").join(sb, "b").withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _matched(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(node, matched): how many shingles of a node some other of ``nodes`` has too (or its own id a second time). No more than these can be
    common to it and another. Shingles are counted with partial sums, and only those that come once are counted back to their node."""
    sets = stored(_sets(rows_with(docs, doc_id, nodes), doc_id, text, size), "near-left-sets")
    alone = sets.select("node", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).where("times = 1")
    sizes = sets.select("node", F.size("set").cast("long").alias("part")).union(alone.select("node", F.lit(-1).cast("long")))
    return sizes.groupBy("node").agg(F.sum("part").alias("matched"))


def common(own_a: np.ndarray, of_a: np.ndarray, n_a: int, own_b: np.ndarray, of_b: np.ndarray, n_b: int, values: int) -> np.ndarray:
    """(n_a, n_b): how many values each set of one side has in common with each of the other. A side is given by its (set, value) entries with
    values from 0 to ``values`` - 1. A value with few holders is counted by pairs of holders, the others by matrix products."""
    times_a, times_b = np.bincount(of_a, minlength=values), np.bincount(of_b, minlength=values)
    many = times_a * times_b > n_a * n_b // 100
    both = np.zeros(n_a * n_b, np.int64)
    few_a, few_b = ~many[of_a] & (times_b[of_a] > 0), ~many[of_b]
    x, v = own_a[few_a], of_a[few_a]
    order = np.argsort(of_b[few_b], kind="stable")
    y = own_b[few_b][order]
    held = np.where(many, 0, times_b)
    first = np.cumsum(held) - held
    ends = np.cumsum(held[v])
    at = 0
    while at < len(v):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HOLDERS, "right")))
        n = held[v[at:last]]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[v[at:last]], n)
        both += np.bincount(np.repeat(x[at:last], n) * n_b + y[place], minlength=n_a * n_b)
        at = last
    both = both.reshape(n_a, n_b)
    column = np.where(many, np.cumsum(many) - 1, -1)
    for start in range(0, int(many.sum()), COLUMNS):
        sides = []
        for own, of, n in ((own_a, of_a, n_a), (own_b, of_b, n_b)):
            here = (column[of] >= start) & (column[of] < start + COLUMNS)
            side = np.zeros((n, COLUMNS), np.float32)
            side[own[here], column[of[here]] - start] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    return both


def _block_links(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b) of similar sets of different components among ``nodes`` (rep, n, matched, c, keys) that share a key: for two components that
    meet in a pair of blocks one link of theirs. Nodes with the same smallest key are cut into blocks by size; two blocks are compared if they
    share a key and their sizes allow a link there. Only blocks are paired in a join; a set is sent once for each block that its own meets."""
    before = F.sum(F.col("n") + BLOCK_SHINGLES // BLOCK_SETS).over(Window.partitionBy("home").orderBy("n", "rep").rowsBetween(Window.unboundedPreceding, -1))
    placed = nodes.withColumn("home", F.array_min("keys")).withColumn("block", F.xxhash64("home", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_SHINGLES)))
    placed = stored(placed.drop("home"), "near-blocks")
    held = placed.select(F.explode("keys").alias("key"), "block", "n", "matched", "c").groupBy("key", "block")
    held = stored(held.agg(F.min("n").alias("n"), F.max("matched").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")), "near-block-keys")
    a, b = (held.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "n", "m", "low", "high")]) for x in "ab")
    able = (100 + percent) * F.least("m_a", "m_b") >= percent * (F.col("n_a") + F.col("n_b"))
    apart = F.least("low_a", "low_b") != F.greatest("high_a", "high_b")
    met = stored(a.join(b, "key").where((F.col("block_a") <= F.col("block_b")) & able & apart).select("block_a", "block_b").distinct(), "near-block-pairs")
    sets = _sets(rows_with(docs, doc_id, placed.select("rep").distinct()), doc_id, text, size).withColumn("digest", F.xxhash64("set")).dropDuplicates(["node", "digest"])
    rows = placed.join(sets, (placed["rep"] == sets["node"]) & (placed["n"] == F.size("set"))).select("block", "rep", "c", "set")
    sides = met.select(F.col("block_a").alias("block"), "block_a", "block_b").union(met.where("block_a <> block_b").select("block_b", "block_a", "block_b"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, rep, c = (table[x].to_numpy() for x in ("block", "rep", "c"))
        n = table["set"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
        of = np.unique(table["set"].combine_chunks().flatten().to_numpy(), return_inverse=True)[1]
        own = np.repeat(np.arange(len(n)), n)
        pair = table["block_a"][0].as_py(), table["block_b"][0].as_py()
        side, entries = [], []
        for x in pair:
            inside = block == x
            side.append(np.flatnonzero(inside))
            number = np.cumsum(inside) - 1
            entries += [number[own[inside[own]]], of[inside[own]], len(side[-1])]
        both = common(*entries, int(of.max()) + 1 if len(of) else 0)
        near = 100 * both >= percent * (n[side[0]][:, None] + n[side[1]][None, :] - both)
        i, j = np.nonzero(near & (c[side[0]][:, None] != c[side[1]][None, :]))
        i, j = side[0][i], side[1][j]
        once = np.unique(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]), axis=1, return_index=True)[1] if len(i) else i
        return pa.table({"a": pa.array(rep[i[once]], pa.int64()), "b": pa.array(rep[j[once]], pa.int64())})

    return sides.join(rows, "block").groupBy("block_a", "block_b").applyInArrow(compare, "a long, b long")


def _keys(spots: Column) -> Column:
    return F.transform(spots, lambda s: s["key"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links of at least ``percent``), kept."""
    sketch = stored(sketches(docs, doc_id, text, size), "near-sketch")
    named = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "near-classes")
    keys = classes.select("rep", "n", F.posexplode("bands").alias("band", "registers")).select("rep", "n", F.xxhash64("band", "registers").alias("key"))
    draw = F.xxhash64("rep", "key")
    crowded = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("members"), F.min(draw).alias("least")).where("members > 1")
    shared = stored(keys.join(crowded, "key").withColumns({"hub": F.col("hub.rep"), "hub_n": F.col("hub.n")}), "near-shared")
    tried = stored(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("hub_n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb")).distinct(), "near-tried")
    links = stored(_confirmed(tried, classes, docs, doc_id, text, size, percent), "near-links")
    label, hubs = components(links), FIRST_HUBS

    def torn(rows: DataFrame) -> DataFrame:
        """``rows`` with their component c, those whose key holds more than one component."""
        placed = rows.join(label, rows["rep"] == label["node"], "left").select(*rows.columns, F.coalesce("component", "rep").alias("c"))
        open_keys = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        return placed.join(open_keys, "key")

    left = stored(torn(shared.select("key", "rep", "n", (F.col("rep") == F.col("hub")).alias("first"))).drop("c"), "near-left")
    matched = _matched(docs, left.select("rep").distinct(), doc_id, text, size)
    left = stored(left.join(matched, left["rep"] == matched["node"]).select("key", "rep", "n", "first", F.least("n", "matched").alias("matched")).where(100 * F.col("matched") >= percent * F.col("n")), "near-left")
    left = stored(left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(draw).alias("least")).where("members > 1"), "key"), "near-open")
    while True:
        # one row for each node with its keys still torn; in each it is a hub if its draw is in the first ``hubs`` of the key's members. The
        # hubs of a round stay hubs, so a pair with a hub of an earlier round (or of the first comparison) in a common key has been tried
        drawn = [(draw == F.col("least")) | (F.pmod(draw, F.lit(1 << 30)) * F.col("members") < F.lit(float(h) * (1 << 30))) for h in (hubs, hubs // 4)]
        before = F.col("first") if hubs == FIRST_HUBS else F.col("first") | drawn[1]
        here = left if hubs == FIRST_HUBS else left.where(F.col("members") <= SURE_HUBS)
        nodes = torn(here).groupBy("rep", "n", "matched", "c").agg(F.max("members").alias("most"), F.collect_list(F.struct("key", (drawn[0] | before).alias("drawn"), before.alias("before"))).alias("spots"))
        nodes = stored(nodes, "near-nodes")
        most = nodes.agg(F.max("most").alias("m")).first()["m"]
        if not most:
            break
        placed = nodes.select("rep", "n", "matched", "c", _keys(F.col("spots")).alias("keys"), _keys(F.filter("spots", lambda s: s["drawn"])).alias("in"),
                              _keys(F.filter("spots", lambda s: s["before"])).alias("before_in"), F.inline("spots"))
        chosen = placed.where("drawn AND NOT before").select(*[F.col(c).alias(f"hub_{c}") for c in ("key", "rep", "n", "matched", "c", "keys", "in", "before_in")])
        able = (100 + percent) * F.least("matched", "hub_matched") >= percent * (F.col("n") + F.col("hub_n"))
        # a pair leaves the join once: in the smallest key in which one of the two is a hub for the other, and of two hubs from the larger id
        once = (~F.col("drawn") | (F.col("rep") > F.col("hub_rep"))) & (F.array_min(F.concat(F.array_intersect("keys", "hub_in"), F.array_intersect("in", "hub_keys"))) == F.col("key"))
        untried = ~F.arrays_overlap("keys", "hub_before_in") & ~F.arrays_overlap("before_in", "hub_keys")
        met = (F.col("key") == F.col("hub_key")) & (F.col("c") != F.col("hub_c")) & able & untried & once
        pairs = stored(placed.join(chosen, met).select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("hub_rep").alias("b"), F.col("hub_n").alias("nb")), "near-tried")
        found = stored(_confirmed(pairs, classes, docs, doc_id, text, size, percent), "near-links")
        new = found.limit(1).count()
        if new:
            links = links.union(found)
            label = components(links)
        if hubs >= min(most, SURE_HUBS):
            break
        hubs *= 4
    crowded = stored(torn(left.where(F.col("members") > SURE_HUBS)).groupBy("rep", "n", "matched", "c").agg(F.collect_list("key").alias("keys")), "near-crowded")
    if crowded.limit(1).count():
        links = links.union(stored(_block_links(crowded, docs, doc_id, text, size, percent), "near-links"))
        label = components(links)
    class_of = named.join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).select("doc_id", "n", "rep")
    in_class = class_of.join(label, class_of["rep"] == label["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    empty = sketch.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return in_class.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id."""
    gone = near_duplicates(docs, doc_id, text, size, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
