"""Phrase collocations counted in a HAT-trie: burstable hash containers under a shallow trie of word ids.

Each task numbers the words of its texts and counts phrases in a ``HatTrie``: the first word id (under its language) leads to a hash container of the
remaining ids; a container that grows beyond BURST entries bursts into a node with a container for each second word, down to DEPTH words. When a
task holds ENTRIES phrases, its largest subtrees are spilled as sorted runs of (lang, phrase, count) until half of them are left. The runs are
written to the shared folder and merged by ranges of the sorted phrases, so a partition holds a range of prefixes and a prefix that many phrases
share is divided further down by itself; a phrase has one row per run, however often it occurs.

Words are counted first (their container is the vocabulary itself), then phrases of all lengths together, and only those that can be frequent reach a trie: all their words are frequent,
and so are the two slots that the phrase, and each of its parts, is hashed to. For that two passes before sum counters over the corpus, the first for two
words, the second for longer phrases whose pairs all pass, held at the support, 127 at most (a sum of held counts reaches it exactly if the sum of the
counts does), a byte each. A slot that several phrases share lets them through, to be counted for nothing; it never hides one. The counters grow with the
corpus (a fixed number would reach the support everywhere, and let all phrases through), up to SLOTS_MOST. All counts are exact sums over all occurrences.

Rules: A-Z lower-cased; ``. , ; : ! ?`` and U+000A to U+000D end a piece; words are runs without space and tab inside a piece; occurrences may
overlap. Score of the cut after k words: floor(1000 a n / (l r)) with a, l, r the counts of the phrase and its two parts and n all words of the
language, in decimals of 38 digits; the lowest counts, ties to the smallest k. A candidate inside a longer candidate of the same count is dropped.

NULL and empty texts hold no words; a NULL language is ``und``. Very long texts are read whole, a chunk of their own. Repeated rows count each time.
Equal scores and counts go by the phrase's UTF-8 bytes. An empty table gives no rows. Only language and text are read, so other columns
cannot clash.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .text import Spans, mix, texts_of

LENGTHS = (2, 3, 4, 5)
SUPPORT, TOP = 100, 2000
#: A task holds ENTRIES phrases, or more where more can be frequent, so that they have one row a task; ENTRIES_MOST at most.
BURST, DEPTH, ENTRIES, ENTRIES_MOST = 2048, 2, 200_000, 1_000_000
#: Slots of the bitmap of frequent words (one MB), two for each word.
BITMAP = 1 << 23
#: Least and most counters for pairs of words (longer phrases have a quarter), and how many of them make a row.
SLOTS, SLOTS_MOST, BLOCK = 1 << 23, 1 << 27, 1 << 18
#: Blocks summed up by one task at a time.
FAN = 64
#: Bytes of text counted at once.
CHUNK = 1 << 19
#: Words a task holds counts or numbers of.
WORDS = 300_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_AS_SPACE = bytes(32 if c in _BREAKS or c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)                     # 0 part of a word, 1 space, 2 end of a piece
_KIND[[32, 9]] = 1
_KIND[list(_BREAKS)] = 2
_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
_COUNTERS = pa.schema([("part", pa.int32()), ("length", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])
_COUNTERS_SQL = "part int, length int, block int, counts binary"
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class HatTrie:
    """Counts of id tuples (those that burst are longer than ``depth``). A node is a dict from word id to a node or to a container; a container is a dict from the remaining ids to a count."""

    class Node(dict):
        __slots__ = ()

    def __init__(self, burst: int = BURST, depth: int = DEPTH):
        self.root, self.burst, self.depth, self.size = self.Node(), burst, depth, 0

    def add(self, path: tuple, count: int) -> None:
        node, at = self.root, 0
        while True:
            below = node.get(path[at])
            if below is None:
                below = node[path[at]] = {}
            at += 1
            if not isinstance(below, self.Node):
                break
            node = below
        rest = path[at:]
        if rest in below:
            below[rest] += count
        else:
            below[rest] = count
            self.size += 1
            if len(below) > self.burst and at <= self.depth and len(rest) > 1:
                node[path[at - 1]] = self._burst(below)

    def _burst(self, container: dict) -> Node:
        node = self.Node()
        for rest, count in container.items():
            node.setdefault(rest[0], {})[rest[1:]] = count
        return node

    def _under(self, below, prefix: tuple):
        if isinstance(below, self.Node):
            for key, child in below.items():
                yield from self._under(child, prefix + (key,))
        else:
            for rest, count in below.items():
                yield prefix + rest, count

    def spill(self, left: int):
        """Removes the largest subtrees, whole, until at most ``left`` entries remain; yields each as a list of (path, count)."""
        sizes = {key: sum(1 for _ in self._under(child, ())) for key, child in self.root.items()}
        for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
            if self.size <= left:
                return
            run = list(self._under(self.root.pop(key), (key,)))
            self.size -= len(run)
            yield run


def _hashes(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words between these bytes, some CHUNK bytes at a time: a very long text is a chunk of its own."""
    own, out, at = np.frombuffer(data, np.uint8), np.empty(len(first), np.uint64), 0
    while at < len(first):
        stop = int(np.searchsorted(first, first[at] + 2 * CHUNK))
        begin = first[at]
        out[at:stop] = Spans(own[begin:end[stop - 1]], lower=False)(first[at:stop] - begin, end[at:stop] - begin)
        at = stop
    return out


def _word_hash(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return _hashes(b"".join(words), np.r_[0, ends[:-1]], ends)


def _lang_hash(lang: str) -> np.uint64:
    return _word_hash([b"\0" + lang.encode()])[0]


def _grow(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(prefix * _MULTIPLIER + word)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITMAP - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BITMAP - 1)).astype(np.int64)


def _counter_slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Two counters for each phrase; it can be frequent only if both reach the support."""
    return (h & np.uint64(slots - 1)).astype(np.int32), ((h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int32)


def _slots_for(words: int, support: int) -> int:
    """Counters for pairs in a corpus of so many words: on average a counter stays well under the support."""
    return min(max(SLOTS, 1 << (4 * words // max(support, 1)).bit_length()), SLOTS_MOST)


class _Words(dict):
    """Numbers of words; a new word gets the next number when it is asked for. ``numbers`` has each number as the one object that is in the dict."""

    def __init__(self):
        super().__init__()
        self.words, self.numbers = [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.words)
        self.words.append(word)
        self.numbers.append(place)
        return place


def _chunks(batches):
    """(languages, language number of each row, joined bytes, offsets) of about CHUNK bytes; rows are a newline apart."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        data, offsets = texts_of(texts)
        first = 0
        while first < len(langs):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            rows = [data[offsets[r]:offsets[r + 1]].tobytes() for r in range(first, min(last, len(langs)))]
            names = sorted(set(langs[first:last]))
            place = {x: i for i, x in enumerate(names)}
            starts = np.cumsum([0] + [len(r) + 1 for r in rows])[:-1]
            yield names, np.array([place[x] for x in langs[first:first + len(rows)]], np.int64), b"\n".join(rows), starts
            first += len(rows)


def _found(data: bytes, starts: np.ndarray, lang_of_row: np.ndarray):
    """Of every word: first byte, end byte, language and piece number."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    inside = kind == 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = np.flatnonzero(begins)
    pieces = np.cumsum(kind == 2, dtype=np.int32)[at]
    return at, np.flatnonzero(ends) + 1, lang_of_row[np.searchsorted(starts, at, "right") - 1], pieces


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].reshape(-1).astype(np.int64)


class _Text:
    """Walks a task's texts, a chunk of lower-cased words at a time: its bytes, the words' hashes (if asked), languages and pieces. Languages are numbered, pieces within a chunk."""

    def __init__(self):
        self.langs, self.number = [], {}

    def chunks(self, batches, hashed: bool = True):
        for names, lang_of_row, data, starts in _chunks(batches):
            for x in names:
                if x not in self.number:
                    self.number[x] = len(self.langs)
                    self.langs.append(x)
            if not data:
                continue
            first, end, lang, pieces = _found(data, starts, np.array([self.number[x] for x in names])[lang_of_row])
            if len(first):
                data = data.translate(_AS_SPACE)
                yield data, _hashes(data, first, end) if hashed else None, lang, pieces

    def hashes(self, words: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return mix(words ^ np.array([_lang_hash(x) for x in self.langs], np.uint64)[lang])

    def written(self, run: list, words: list[bytes]) -> pa.RecordBatch:
        phrases = [b" ".join([words[i] for i in path[1:]]) for path, _ in run]
        batch = pa.RecordBatch.from_arrays([pa.array([self.langs[path[0]] for path, _ in run], pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                            pa.array([len(path) - 1 for path, _ in run], pa.int32()), pa.array([n for _, n in run], pa.int64())], schema=_RUN)
        return batch.sort_by([("lang", "ascending"), ("phrase", "ascending")])


def _bits(bitmap: bytes) -> np.ndarray:
    return np.frombuffer(bitmap, np.uint8)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).view(bool)


def _frequent(text: _Text, word: np.ndarray, lang: np.ndarray, pieces: np.ndarray, words: np.ndarray, lengths):
    """For each length: places of the phrases within a piece and without a rare word, and the hashes at all places. ``word`` has the words' hashes."""
    h = text.hashes(word, lang)
    one, two = _slots(h)
    good = _has(words, one) & _has(words, two)
    # the last place up to which words are frequent and in the same piece
    stop = np.flatnonzero(np.r_[~good[1:] | (pieces[1:] != pieces[:-1]), True])
    last = np.repeat(stop, np.diff(stop, prepend=-1))
    for length in range(2, max(lengths) + 1):
        if length > len(word):
            return
        h = _grow(h[:-1], word[length - 1:])
        at = np.arange(len(h))
        yield length, at[good[:len(h)] & (last[:len(h)] >= at + length - 1)], h


def _passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both counters of each hash reach the support; ``bitmap`` has a bit for each counter."""
    one, two = _counter_slots(h, 8 * len(bitmap))
    found = _has(bitmap, one)
    at = np.flatnonzero(found)
    found[at] = _has(bitmap, two[at])
    return found


def _with_pairs(found, pairs: np.ndarray):
    """Of ``_frequent`` those phrases whose pairs of words all pass."""
    good = None
    for length, at, h in found:
        if good is None:
            pair = np.zeros(len(h), bool)
            pair[at] = _passes(pairs, h[at])
            good = pair
        else:
            good = good[:-1] & pair[length - 2:]
        yield length, at[good[at]], h


def _counters(words: bytes, lengths, support: int, slots: int, pairs: bytes | None = None):
    """The pass that sums held counters of phrases of these lengths: (part, length, block, counts). With ``pairs`` their pairs of words have passed."""
    def run(batches):
        from pyspark import TaskContext
        frequent, held, text = _bits(words), {j: np.zeros(slots, np.uint8) for j in lengths}, _Text()
        for _, word, lang, pieces in text.chunks(batches):
            found = _frequent(text, word, lang, pieces, frequent, lengths)
            for length, at, h in found if pairs is None else _with_pairs(found, _bits(pairs)):
                if length not in held or not len(at):
                    continue
                for place in _counter_slots(h[at], slots):
                    place.sort()
                    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                    place, n = place[first], np.diff(first, append=len(place))
                    held[length][place] = np.minimum(held[length][place] + n, support)
        part = TaskContext.get().partitionId()
        for length, counts in held.items():
            for block in range(slots // BLOCK):
                some = counts[block * BLOCK:(block + 1) * BLOCK]
                if some.any():
                    yield pa.RecordBatch.from_pylist([{"part": part, "length": length, "block": block, "counts": pa.compress(some.tobytes(), "zstd", asbytes=True)}], _COUNTERS)
    return run


def _unpacked(counts: pa.BinaryScalar) -> np.ndarray:
    """Blocks travel packed, so that neither the JVM nor a worker holds many of them in full."""
    return np.frombuffer(pa.decompress(counts.as_buffer(), BLOCK, "zstd"), np.uint8)


def _summed(support: int):
    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint8)
        for some in rows.column("counts"):
            total = np.minimum(total + _unpacked(some), support).astype(np.uint8)
        first = rows.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([first | {"part": first["part"] // FAN, "counts": pa.compress(total.tobytes(), "zstd", asbytes=True)}], _COUNTERS)
    return run


def _reached(own: DataFrame, words: bytes, lengths, support: int, slots: int, pairs: bytes | None = None) -> dict[int, bytes]:
    """Bitmaps of the counters that reach the support, by length; ``slots`` / 8 bytes each reach the driver."""
    rows = stored(_in_few_tasks(own).mapInArrow(_counters(words, lengths, support, slots, pairs), _COUNTERS_SQL), "phrase-counters")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        # FAN blocks at a time, so that a task's share does not grow with the number of tasks before it
        rows = rows.groupBy("length", "block", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(_summed(support), _COUNTERS_SQL)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
        rows = stored(rows, "phrase-counters")
    out = {j: np.zeros(slots // 8, np.uint8) for j in lengths}

    def packed(batches):
        for batch in batches:
            bits = [np.packbits(_unpacked(c) >= support).tobytes() for c in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bits, pa.binary())], ["length", "block", "bits"])

    for r in rows.mapInArrow(packed, "length int, block int, bits binary").collect():
        out[r["length"]][r["block"] * BLOCK // 8:(r["block"] + 1) * BLOCK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return {j: bits.tobytes() for j, bits in out.items()}


def _phrase_bitmaps(own: DataFrame, words: bytes, lengths, support: int, slots: int) -> dict[int, bytes]:
    """Bitmaps of the counters that hold ``support`` occurrences or more, by length. Longer phrases are counted where their pairs pass: they need fewer counters."""
    pairs = _reached(own, words, (2,), support, slots)
    longer = tuple(range(3, max(lengths) + 1))
    return pairs | (_reached(own, words, longer, support, max(BLOCK, slots // 4), pairs[2]) if longer else {})


def _entries_for(bitmaps: dict[int, bytes]) -> int:
    """Phrases that a task may have to hold: each that is frequent has set two bits, or shares them."""
    return min(max(ENTRIES, sum(int(np.bitwise_count(_bits(b)).sum()) for b in bitmaps.values()) // 2), ENTRIES_MOST)


def _word_runs(batches):
    """Counts of single words: the vocabulary is their container, spilled whole once it holds WORDS words."""
    text, vocabulary, counts = _Text(), _Words(), {}

    def spilled():
        for lang, n in sorted(counts.items()):
            used = np.flatnonzero(n)
            words = pa.array([vocabulary.words[i] for i in used.tolist()], pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(text.langs[lang]), len(used)), words, pa.repeat(pa.scalar(1, pa.int32()), len(used)), pa.array(n[used])], schema=_RUN)
            yield batch.sort_by("phrase")

    for data, _, lang, _ in text.chunks(batches, hashed=False):
        ids = np.fromiter(map(vocabulary.__getitem__, data.split()), np.int64, len(lang))
        size = len(vocabulary.words)
        for x in np.unique(lang).tolist():
            n = np.bincount(ids[lang == x], minlength=size)
            before = counts.get(x, np.zeros(0, np.int64))
            n[:len(before)] += before
            counts[x] = n
        if size > WORDS:
            yield from spilled()
            vocabulary, counts = _Words(), {}
    yield from spilled()


def _phrase_runs(words: bytes, bitmaps: dict[int, bytes], lengths, entries: int, burst: int):
    """The counting pass: sorted runs of (lang, phrase, words, count). Only words of phrases that reach the trie are numbered: a text's vocabulary is
    mostly rare words."""
    def run(batches):
        trie, text, held = HatTrie(burst), _Text(), _Words()
        frequent, bits = _bits(words), {j: _bits(b) for j, b in bitmaps.items()}
        for data, word, lang, pieces in text.chunks(batches):
            found, before = [], None
            for length, at, h in _frequent(text, word, lang, pieces, frequent, lengths):
                if before is not None:
                    at = at[before[at] & before[at + 1]]
                at = at[_passes(bits[length], h[at])]
                before = np.zeros(len(h), bool)
                before[at] = True
                found.append((length, at))
            # all words of phrases are in pairs that pass
            used = np.zeros(len(word), bool)
            for _, at in found[:1]:
                used[at] = used[at + 1] = True
            used, in_text, ids = np.flatnonzero(used), data.split(), np.zeros(len(word), np.int64)
            ids[used] = [held[in_text[i]] for i in used.tolist()]
            for length, at in found:
                # equal phrases of the chunk become one number, as many words at a time as 63 bits hold
                number, most = lang[at], len(text.langs)
                for j in range(length):
                    if most * len(held.words) >= 1 << 63:
                        number, most = _dense(number), len(number)
                    number, most = number * np.int64(len(held.words)) + ids[at + j], most * len(held.words)
                _, first, count = np.unique(number, return_index=True, return_counts=True)
                first = at[first]
                # each word's number is one object, in however many phrases it is
                columns = [lang[first].tolist()] + [map(held.numbers.__getitem__, ids[first + j].tolist()) for j in range(length)]
                for path, n in zip(zip(*columns), count.tolist()):
                    trie.add(path, n)
            full = len(held.words) > WORDS
            if full or trie.size > entries:
                for spilled in trie.spill(0 if full else entries // 2):
                    yield text.written(spilled, held.words)
            if full:
                held = _Words()
        for spilled in trie.spill(0):
            yield text.written(spilled, held.words)
    return run


def _slot_rows(batches):
    """Bytes of the bitmap that a batch of frequent words sets: (slot byte, bits)."""
    for batch in batches:
        langs, phrases = batch.column(0).to_pylist(), [p.split(" ") for p in batch.column(1).to_pylist()]
        if not langs:
            continue
        flat = [w.encode() for p in phrases for w in p]
        hashes = _word_hash(flat).reshape(len(phrases), -1)
        seeds = {x: _lang_hash(x) for x in set(langs)}
        h = mix(hashes[:, 0] ^ np.array([seeds[x] for x in langs], np.uint64))
        for j in range(1, hashes.shape[1]):
            h = _grow(h, hashes[:, j])
        slots = np.unique(np.concatenate(_slots(h)))
        yield pa.RecordBatch.from_arrays([pa.array(slots >> 3), pa.array((1 << (7 - (slots & 7))).astype(np.int32))], ["at", "bit"])


def _bitmap(frequent: DataFrame) -> bytes:
    """The bitmap of the frequent words; at most BITMAP / 8 rows reach the driver, whatever the number of words."""
    rows = frequent.select("lang", "phrase").mapInArrow(_slot_rows, "at long, bit int").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(BITMAP // 8, np.uint8)
    table = rows.toArrow()
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)
    return out.tobytes()


def _in_few_tasks(own: DataFrame) -> DataFrame:
    """Small partitions read together: a phrase has a row for each task that counts it, and a task's counters have a fixed size. Two tasks a core,
    or a quarter of the partitions if these are more."""
    return own.coalesce(max(2 * own.sparkSession.sparkContext.defaultParallelism, own.rdd.getNumPartitions() // 4))


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, lengths: tuple[int, ...] = LENGTHS,
                  entries: int | None = None, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all words and phrases with f >= ``support``, and (lang, n) with all word occurrences."""
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def merged(counting, label, own=own):
        runs = stored(own.mapInArrow(counting, "lang string, phrase string, words int, n long"), f"{label}-runs")
        # a partition is a range of sorted phrases; a phrase has one row per run
        counted = runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("words").alias("words"))
        return runs, stored(counted.where(F.col("f") >= support), f"{label}-frequent")

    runs, single = merged(_word_runs, "word")
    sizes = stored(runs.groupBy("lang").agg(F.sum("n").alias("n")), "word-sizes")
    words = _bitmap(single)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bitmaps = _phrase_bitmaps(own, words, lengths, min(support, 127), _slots_for(total, min(support, 127)))
    _, several = merged(_phrase_runs(words, bitmaps, lengths, entries or _entries_for(bitmaps), burst), "phrase", _in_few_tasks(own))
    return single.unionByName(several), sizes


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, top: int = TOP,
                 lengths: tuple[int, ...] = LENGTHS, entries: int | None = None, burst: int = BURST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language."""
    every, sizes = phrase_counts(docs, lang, text, support, lengths, entries, burst)
    candidates = every.where(F.col("words") >= min(lengths)).withColumn("w", F.split("phrase", " "))

    def part(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    # sub-phrases of longer candidates that occur only there
    inner = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.col("words") - 1, F.lit(2))), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda first: F.struct(size.alias("size"), part(first, size).alias("p"))))), lambda x: x["size"] < F.col("words"))
    inside = candidates.where("words > 2").select("lang", "f", F.explode(inner).alias("x")).groupBy("lang", F.col("x.p").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("f"))).drop("longer")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("words") - k).alias("tail")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    f = every.select("lang", F.col("phrase").alias("p"), F.col("f"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(f.withColumnRenamed("p", side).withColumnRenamed("f", name), ["lang", side])
    wide = "CAST({} AS DECIMAL(20,0))"
    score = F.expr(f"(CAST(1000 * {wide.format('a')} AS DECIMAL(23,0)) * CAST(n AS DECIMAL(15,0))) div ({wide.format('l')} * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.n", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of a part of each language first, so that no language is sorted whole in one task
    parts = lowest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
