"""SentencePiece encoding and decoding of whole texts with a given BPE model (byte fallback, a space before the text, no other change).

No piece spans a space that follows another character, so a text falls into units (spaces and the word after them) that are encoded
alone, and each distinct unit once. For a batch of new units:

1. their texts are joined and all suffixes sorted (a suffix array over the first bytes, as many as the longest piece has);
2. every piece is searched in it by bisection, which gives the range of its occurrences: the edges;
3. the edges are sorted by the place where they end and relaxed from left to right for all units at once. The last piece of a
   prefix's encoding is the one edge into its end that goes with the piece before it (``goes_with``: merging the two pieces' characters
   by rank never joins something across their border), so no scores are compared and the result is that of the merges.

Characters without a piece become byte pieces. U+2581, which models use for the space, is encoded by its bytes so that every text comes
back from its ids unchanged. Runs of two or more spaces have pieces of equal rank, for which step 3 does not hold: units that begin with one
are merged pair by pair.

NULL and empty texts have no ids. Units of any length are handled; ``UNITS_KEPT`` bounds a worker's memory of units already encoded
and changes no result.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, texts_of

UNITS_KEPT = 500_000
CHUNK = 1 << 20
UNIT = re.compile(r" *[^ \n]+|\n| +")
START, OPEN = -1, -2


class Pieces:
    """A model's tables: bytes of each id, ranks of merges, the pair each piece is merged from."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.bytes_of = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        normal = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                normal[text] = i
                self.bytes_of[i] = text.encode()
        self.score = {i: sp.get_score(i) for i in normal.values()}
        self.id_of = normal
        self.rank = np.zeros(size, np.int64)
        several = [i for t, i in normal.items() if len(t) > 1]
        for place, i in enumerate(sorted(several, key=lambda i: (-self.score[i], i)), size):
            self.rank[i] = place
        single = [i for t, i in normal.items() if len(t) == 1]
        self.rank[single] = np.arange(len(single))
        self.left, self.right = np.arange(size), np.arange(size)
        pairs, reached = {}, set(single)
        for text, i in normal.items():
            if len(text) > 1:
                parts = self.merged(text, keep_two=True)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                    pairs[parts[0] * size + parts[1]] = i
                    reached.add(i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([self.rank[pairs[k]] for k in self.pair_keys.tolist()], np.int64)
        self.size = size
        ids = np.array(sorted(reached), np.int64)
        self.widest = -(-max(len(b) for b in self.bytes_of) // 8) * 8
        padded = [self.bytes_of[i].ljust(self.widest, b"\0") for i in ids]
        self.low = np.array(padded, f"S{self.widest}")
        self.high = np.array([self.bytes_of[i].ljust(self.widest, b"\xff") for i in ids], f"S{self.widest}")
        self.ids, self.lengths = ids, np.array([len(self.bytes_of[i]) for i in ids])
        known = np.zeros(0x110000, bool)
        known[[ord(t) for t in normal if len(t) == 1]] = True
        self.known = known
        self.piece_length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_length)])
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def merged(self, text: str, keep_two: bool = False) -> list[int]:
        """Ids by merging the best neighbours again and again; with ``keep_two`` the last merge is left out."""
        parts = list(text)
        while len(parts) > (2 if keep_two else 1):
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        found = []
        for part in parts:
            i = self.id_of.get(part)
            found += [i] if i is not None else [int(self.byte_id[b]) for b in part.encode("utf-8", "surrogatepass")]
        return found

    def goes_with(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of a's and b's characters, side by side, end with a and b: undo the later of the two pieces' merges, step by
        step, and see that no join across the border had an earlier turn."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            keys = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            joined = (self.pair_keys[at] == keys) & (self.pair_rank[at] < limit)
            good[live[joined]] = False
            ra, rb = self.rank[a], self.rank[b]
            splits_a, splits_b = self.right[a] != a, self.left[b] != b
            undo_a = splits_a & (~splits_b | (ra > rb))
            undo_b = splits_b & ~undo_a
            limit = np.where(undo_a, ra, np.where(undo_b, rb + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            on = ~joined & (undo_a | undo_b)
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return good

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end byte, id) of every occurrence of every piece in ``data``, from a suffix array."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(self.widest, np.uint8)])
        word = np.zeros(n + self.widest - 7, np.uint64)
        for k in range(8):
            word |= padded[k:k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
        begins = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0))
        keys = [word[begins + at] for at in range(0, self.widest, 8)]
        order = np.lexsort(keys[::-1])
        suffixes = np.stack([k[order] for k in keys], 1).astype(">u8").view(f"S{self.widest}").ravel()
        first, last = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        times = last - first
        piece = np.repeat(np.arange(len(self.ids)), times)
        place = begins[order[np.arange(len(piece)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]]
        return place, place + self.lengths[piece], self.ids[piece]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, offsets)."""
        by_merging = [k for k, u in enumerate(units) if u.startswith("  ")]
        coded = [u.encode("utf-8", "surrogatepass") for u in units]
        data = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
        lengths = np.array([len(c) for c in coded], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        unit_of = np.repeat(np.arange(len(units)), lengths + 1)
        first, end, ids = self.edges(data)
        text = b"\0".join(coded).decode("utf-8", "surrogatepass") + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        odd = np.repeat(~self.known[points], width)        # bytes of characters without a piece
        odd[starts + lengths] = False
        at = np.flatnonzero(odd)
        first, end, ids = np.concatenate([first, at]), np.concatenate([end, at + 1]), np.concatenate([ids, self.byte_id[data[at]]])
        is_byte = np.concatenate([np.zeros(len(first) - len(at), bool), np.ones(len(at), bool)])
        depth = end - starts[unit_of[first]]
        order = np.argsort(depth, kind="stable")
        first, end, ids, is_byte, depth = first[order], end[order], ids[order], is_byte[order], depth[order]
        last = np.full(len(data) + 1, OPEN, np.int64)
        last[starts] = START
        loose = np.zeros(self.size, bool)                  # byte pieces go with everything
        loose[self.byte_id] = True
        back = np.zeros(len(data) + 1, np.int64)
        waves = np.flatnonzero(np.diff(depth, prepend=-1)) if len(depth) else np.zeros(0, np.int64)
        for a, b in zip(waves, np.append(waves[1:], len(depth))):
            before, piece = last[first[a:b]], ids[a:b]
            fits = (before == START) | is_byte[a:b]
            fits |= (before >= 0) & loose[np.maximum(before, 0)]
            ask = np.flatnonzero(~fits & (before >= 0))
            fits[ask] = self.goes_with(before[ask], piece[ask])
            fits &= before != OPEN
            last[end[a:b][fits]] = piece[fits]
            back[end[a:b][fits]] = first[a:b][fits]
        at, unit = starts + lengths, np.arange(len(units))
        out_ids, out_unit = [], []
        while True:
            on = at > starts[unit]
            at, unit = at[on], unit[on]
            if not len(at):
                break
            out_ids.append(last[at])
            out_unit.append(unit)
            at = back[at]
        out_ids, out_unit = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_ids, out_unit))
        order = np.lexsort((-np.arange(len(out_unit)), out_unit))
        flat, counts = out_ids[order].astype(np.int32), np.bincount(out_unit, minlength=len(units))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if by_merging:
            parts = [flat[offsets[k]:offsets[k + 1]] for k in range(len(units))]
            for k in by_merging:
                parts[k] = np.array(self.merged(units[k]), np.int32)
            flat, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, offsets

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all pieces in a row."""
        lengths = self.piece_length[ids]
        total = np.cumsum(lengths)
        return self.piece_bytes[np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths) + np.repeat(self.piece_start[ids], lengths)]


class Encoder:
    """Encodes texts and remembers the units it has met."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self):
        self.place, self.flat, self.offsets = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets)."""
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        if len(self.place) > UNITS_KEPT:
            self._clear()
        new = list(set().union(*units).difference(self.place))
        if new:
            flat, offsets = self.pieces.encode_units(new)
            n = len(self.place)
            self.place.update(zip(new, range(n, n + len(new))))
            self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
        place = np.array(list(map(self.place.__getitem__, chain.from_iterable(units))), np.int64)
        lengths = self.offsets[place + 1] - self.offsets[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1], lengths) + np.repeat(self.offsets[place], lengths)]
        return ids, total[np.concatenate([[0], np.cumsum([len(row) for row in units])])]


_ENCODERS: dict[str, Encoder] = {}


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes; without a path, the installed public tokenizer's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, text: str = "text", model: bytes | None = None, ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """``docs`` with the ids of its texts, and with ``round_trip``, whether decoding them gives the text again. No shuffle; the model's
    tables (about 10 MB, fixed by the model) are built on the driver and broadcast. Columns called like the new ones are replaced."""
    shared, key = docs.sparkSession.sparkContext.broadcast(Pieces(model or read_model())), uuid.uuid4().hex
    names = [ids, *([round_trip] if round_trip else [])]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in {n.lower() for n in names}])
    at = docs.columns.index(text)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        encoder = _ENCODERS[key]
        for batch in batches:
            _, offsets = texts_of(batch.column(at))
            for first, last in chunks(offsets, CHUNK):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(at).to_pylist()]
                found, ends = encoder(texts)
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))]
                if round_trip:
                    data = encoder.pieces.decode(found).tobytes()
                    sizes = np.concatenate([[0], np.cumsum(encoder.pieces.piece_length[found])])[ends]
                    columns.append(pa.array([data[a + 1:b] == t.encode() if t else a == b for t, a, b in zip(texts, sizes[:-1], sizes[1:])]))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{ids}` array<int>", *([f"`{round_trip}` boolean"] if round_trip else [])])
    return docs.mapInArrow(coded, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: bytes | None = None) -> DataFrame:
    """``rows`` with the texts of its ids (NULL and empty lists: the empty text). Bytes that are not UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(Pieces(model or read_model()))

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        pieces = shared.value
        return column.map(lambda x: "" if x is None or not len(x) else pieces.decode(np.asarray(x, np.int64)).tobytes()[1:].decode("utf-8", "replace"))

    return rows.withColumn(out, text_of(F.col(ids)))
