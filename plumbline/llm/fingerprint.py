"""Document fingerprints: a quartile bucket digest.

Byte triplets of a text are hashed into 256 buckets; each bucket's count is coded by the quartile of all counts it falls in (2 bits) and
the text's length by its logarithm (1 byte). Two digests differ by the sum over buckets of the code differences (a full swing counts
twice) plus the length difference; ``likeness`` is 1 for equal digests and 0 from the difference that unrelated digests have on
average.

NULL is an empty text, whose digest is all zero. Texts of any length are read whole, in blocks of bytes. Equal texts have equal
digests.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
BLOCK = 1 << 20
#: Mean difference of two independent uniform codes with weights 0, 1, 2, 6, for all buckets.
UNRELATED = 1.625 * BUCKETS
LENGTH_STEP = 1.1
MOST_LENGTH_DIFFERENCE = 32
_WEIGHT = np.array([0, 1, 2, 6])
_SPREAD = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def digest(text: str | None) -> np.ndarray:
    """Codes 0 to 3 of the buckets, then the length code."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        block = data[at:at + BLOCK + 3].astype(np.uint32)
        n = min(BLOCK, len(data) - at)
        for salt, (a, b, c) in enumerate(_SPREAD):
            m = min(n, len(block) - c)
            if m > 0:
                h = (block[a:a + m] * np.uint32(0x9E3779B1) + block[b:b + m] * np.uint32(0x85EBCA77) + block[c:c + m] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F)) * np.uint32(0x165667B1)
                counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    if len(data) and not counts.any():       # one or two bytes
        counts[int.from_bytes(data.tobytes(), "big") % BUCKETS] = 1
    ranked = np.sort(counts)
    codes = sum((counts > ranked[k * BUCKETS // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))
    length = min(255, int(np.log1p(len(data)) / np.log(LENGTH_STEP)))
    return np.append(codes, np.uint8(length))


def encoded(codes: np.ndarray) -> str:
    """Length code and bucket codes in hexadecimal: 2 + 128 digits."""
    four = codes[:-1].reshape(-1, 4)
    return bytes([codes[-1]]).hex() + (four @ np.array([64, 16, 4, 1], np.uint8)).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16))
    difference = _WEIGHT[apart[:-1]].sum() + min(int(apart[-1]), MOST_LENGTH_DIFFERENCE)
    return max(0.0, 1.0 - float(difference) / UNRELATED)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of its text as a string; no shuffle."""

    @F.pandas_udf("string")
    def coded(column: pd.Series) -> pd.Series:
        return column.map(lambda t: encoded(digest(t)))

    return docs.withColumn(out, coded(F.coalesce(F.col(text), F.lit(""))))


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """Ids that cut the table into ``parts`` of about the same number of rows: at most ``parts`` numbers come to the driver."""
    found = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else None
    return sorted(set(found or []))


def with_next(docs: DataFrame, make, schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``make(doc_id, text, next_text)`` for every row, where the next row is the one that follows by (doc_id, text), NULL ids first, and
    the first row follows the last.

    Texts are shuffled once, by ranges of ids. The first row of each range is sent to the range before it as well, marked as a
    guest: it is somebody's next text and yields no row there. Each task streams its sorted rows and holds two texts."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_bounds(rows.select("id"), parts), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        place = np.searchsorted(bounds, ids.where(known, 0).astype(np.int64), "right")
        return pd.Series(np.where(known, place, 0).astype(np.int32))

    placed = rows.withColumn("part", part_of("id"))
    order = F.struct(F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("i"), F.col("id").isNotNull().alias("k"))
    # one row per range: the id of its first row
    firsts = sorted((r["part"], r["o"]["k"], r["o"]["i"]) for r in rows.select("id").withColumn("part", part_of("id")).groupBy("part").agg(F.min(order).alias("o")).collect())
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    guests = F.lit(None).cast("int")
    for k, (_, known, first) in enumerate(firsts):
        here = F.col("id").eqNullSafe(F.lit(first if known else None).cast("long"))
        guests = F.when(here, F.lit(firsts[k - 1][0])).otherwise(guests)
    goes = F.when(guests.isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(guests.alias("part"), F.lit(True).alias("guest"))))
    sent = placed.select("id", "text", F.explode(goes).alias("g")).select("id", "text", "g.part", "g.guest")
    sent = sent.repartition(len(firsts), "part").sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    names = [f.name for f in docs.sparkSession.createDataFrame([], schema).schema.fields]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = part = None
        told = False        # whether the part's first guest has been seen
        for batch in batches:
            made = []
            for at, i, t, guest in zip(batch["part"], batch["id"], batch["text"], batch["guest"]):
                if at != part:
                    held, part, told = None, at, False
                if told:
                    continue
                if held is not None:
                    made.append(make(held[0], held[1], t))
                told = bool(guest)
                held = (None if pd.isna(i) else int(i), t)
            yield pd.DataFrame(made, columns=names)

    return sent.mapInPandas(stream, schema)


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's digest beside the digest of the text with its last quarter replaced by the beginning of the next document, and
    the likeness to that and to the next document."""

    kept: dict[str, np.ndarray] = {}

    def known(t: str) -> np.ndarray:
        """The next row's digest is asked for again as its own a moment later."""
        if t not in kept:
            while len(kept) > 1:
                kept.pop(next(iter(kept)))
            kept[t] = digest(t)
        return kept[t]

    def row(i, t, following):
        t, following = t or "", following or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        own, other, changed = known(t), known(following), digest(edited)
        return (i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(own), encoded(changed), likeness(own, changed), likeness(own, other))

    return with_next(docs, row, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", doc_id, text)
