"""Line dedup: lines that are equal or within EDITS edits of another line are one class, and only the first line of a class stays.

Equal lines meet by their hash. Distinct lines are joined by segments: a line is cut into EDITS + 1 segments, and of two lines within
EDITS edits one holds a segment of the other at about the same place. Each line is indexed under (length, segment number, segment) and looks
up the substrings of its own that a line of its length or up to EDITS shorter could share with it (only those the multi-match rule leaves:
2 + 4 narrow rows for one edit, 3 + 12 for two). Candidates are verified by a banded bit-parallel edit distance (a band of 2 * EDITS + 1 bits moves
along the diagonal).

Keys with few lines are joined outright. For one edit the lines of crowded keys get finer keys, which leave out a 32nd of the line, so that
lines with a common half alone do not meet. In a key that is crowded still (or for more edits) lines are compared with hubs, twice as many in each round, until its lines are
one component or all have been hubs, so no link between components is lost and a group of similar lines costs one comparison each.

Lines are the parts of a text between newlines. White space lines are never duplicates. Lines under SHORT code points are
duplicates only when equal: two edits change their meaning. NULL and empty texts pass unchanged. "First" is by (doc_id, line
number, hash of the text). A row is known by its id, which may be NULL, and its text's hash (``copy``), so rows that share an id lose only lines of
their own; rows with equal id and text are one document (each keeps the line). Very long lines and texts are read whole.
Only built-in functions run.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import filtered, free_name, rows_with, stored

EDITS = 1
SHORT = 24
CROWDED = 16
PIECES = 32


def copy_of(text: Column) -> Column:
    """What tells rows with one id apart: the hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, copy, line_no, line, and its two hashes; lines of white space are left out."""
    parts = docs.select(F.col(doc_id).alias("doc_id"), copy_of(F.col(text)).alias("copy"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return parts.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _cut(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """First place (from 0) and length of segment i of a line; the last segments take the remainder."""
    pieces = edits + 1
    short = F.floor(length / pieces).cast("int")
    longer = length - short * pieces
    plain = pieces - longer
    first = short * i + F.greatest(F.lit(i) - plain, F.lit(0))
    return first, short + F.when(F.lit(i) >= plain, 1).otherwise(0)


def _key(length: Column, i: int, part: Column) -> Column:
    return F.xxhash64(length, F.lit(i), part)


def indexed(line: Column, edits: int) -> Column:
    n = F.length(line)
    found = []
    for i in range(edits + 1):
        first, size = _cut(n, i, edits)
        found.append(_key(n, i, F.substring(line, first + 1, size)))
    return F.array(*found)


def probed(line: Column, edits: int) -> Column:
    """Keys of the substrings to look up, for indexed lines that are 0 to ``edits`` shorter."""
    n = F.length(line)
    found = []
    for shorter in range(edits + 1):
        other = n - shorter
        for i in range(edits + 1):
            first, size = _cut(other, i, edits)
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            found += [_key(other, i, F.substring(line, first + move + 1, size)) for move in range(low, high + 1)]
    return F.array(*found)


def with_distance(pairs: DataFrame, a: str, b: str, edits: int = EDITS, out: str = "distance") -> DataFrame:
    """``pairs`` with the edit distance of its strings if that is at most ``edits``, and else a number above it. ``a`` must be the longer
    string, by ``edits`` at most, and longer than ``edits``."""
    letters = pairs.withColumns({"__a": F.split(a, ""), "__b": F.split(b, ""), "__n": F.length(a)})
    return letters.withColumn(out, _distance(F.length(b), edits)).drop("__a", "__b", "__n")


def _distance(length: Column, edits: int) -> Column:
    width = 2 * edits + 1
    most = 2 * edits + length - F.col("__n")      # the distance on the diagonal never falls, and what is left takes back no more than this
    full, top = (1 << width) - 1, 1 << (width - 1)
    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))

    def bits(x: Column) -> Column:
        return x.bitwiseAND(F.lit(full))

    def flip(x: Column) -> Column:
        return bits(F.bitwise_not(x))

    def step(s: Column, i: Column) -> Column:
        c = F.get("__b", i)
        same = sum((F.when(F.get("__a", i + (k - edits)) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)), F.lit(0))

        def rest(x: Column) -> Column:
            d0 = bits((x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]))

            def last(d: Column) -> Column:
                hp, hn = s["vn"].bitwiseOR(flip(d.bitwiseOR(s["vp"]))), d.bitwiseAND(s["vp"])
                row = F.lit(width - 2) - (i - (F.col("__n") - edits))     # the bit of the pattern's last row, once the band has reached it
                on_diagonal = F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
                return F.struct(hn.bitwiseOR(flip(F.shiftright(d, 1).bitwiseOR(hp))).alias("vp"), F.shiftright(d, 1).bitwiseAND(hp).alias("vn"),
                                (s["d"] + F.when(i < F.col("__n") - edits, on_diagonal).otherwise(_at(hp, row) - _at(hn, row))).alias("d"))

            return _let(d0, last)

        return F.when(s["d"] > most, s).otherwise(_let(same, rest))

    return F.aggregate(F.sequence(F.lit(0), length - 1), start, step, lambda s: s["d"])


def _at(value: Column, place: Column) -> Column:
    """Bit ``place`` of ``value``."""
    return F.call_function("getbit", value, F.greatest(place, F.lit(0)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _verified(pairs: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """Those of ``pairs`` (a, b: line hashes) whose lines are within ``edits``; only candidates' lines are read again."""
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    texts = stored(rows_with(distinct, "id", ids), "line-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    shorter = F.length("la") < F.length("lb")
    both = both.select("a", "b", F.when(shorter, F.col("lb")).otherwise(F.col("la")).alias("x"), F.when(shorter, F.col("la")).otherwise(F.col("lb")).alias("y"))
    return filtered(with_distance(both.where(F.length("x") - F.length("y") <= edits), "x", "y", edits), F.col("distance") <= edits).select("a", "b")


def similar_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(node, component) of the distinct lines that are within ``edits`` of another line, by hash; ``lines`` comes from lines_of."""
    # equal lines are merged before any key is made; what follows reads this table, not the documents
    distinct = lines.where(F.length("line") >= SHORT).groupBy(F.col("h1").alias("id")).agg(F.min("line").alias("line"))
    distinct = stored(distinct, "line-distinct")
    keyed = distinct.select("id", indexed(F.col("line"), edits).alias("index"), probed(F.col("line"), edits).alias("probe"))
    # a line is in a key once, as indexed (2), as looking up (1) or as both (3)
    marked = F.concat(F.transform(F.array_distinct("index"), lambda k: F.struct(k.alias("key"), (F.lit(2) + F.when(F.array_contains("probe", k), 1).otherwise(0)).cast("byte").alias("role"))),
                      F.transform(F.array_except("probe", "index"), lambda k: F.struct(k.alias("key"), F.lit(1).cast("byte").alias("role"))))
    rows = keyed.select("id", F.explode(marked).alias("m")).select("id", "m.key", "m.role")
    shared = _shared(rows)
    few, crowded = shared.where(F.col("members") <= CROWDED), shared.where(F.col("members") > CROWDED)
    if edits == 1:
        texts = rows_with(distinct, "id", crowded.select("id").distinct())
        finer = _shared(texts.select("id", F.explode(around_an_edit(F.col("line"))).alias("m")).select("id", "m.key", "m.role").distinct())
        few, crowded = few.union(finer.where(F.col("members") <= CROWDED)), finer.where(F.col("members") > CROWDED)
    tried = stored(_pairs(few, few), "line-pairs")
    links = stored(_verified(tried, distinct, edits), "line-links")
    label, hubs = components(links), 1
    while True:
        # hubs of this round: of each key still torn, the lines whose draw is in the first ``hubs`` of its members
        placed = crowded.join(label, crowded["id"] == label["node"], "left").select("id", "key", "role", "members", "least", F.coalesce("component", "id").alias("c"))
        torn = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        placed = stored(placed.join(torn, "key"), "line-placed")
        if not placed.limit(1).count():
            return label
        draw = F.xxhash64("id", "key")
        chosen = placed.where((draw == F.col("least")) | (F.pmod(draw, F.lit(1 << 30)) * F.col("members") < F.lit(float(hubs) * (1 << 30))))
        pairs = stored(_pairs(placed, chosen, "c").join(tried, ["a", "b"], "left_anti"), "line-pairs")
        found = _verified(pairs, distinct, edits)
        tried, links = stored(tried.union(pairs), "line-pairs"), stored(links.union(found), "line-links")
        label = components(links)
        if hubs >= placed.agg(F.max("members").alias("m")).first()["m"]:
            return label                     # every member has been a hub
        hubs *= 4


def _shared(rows: DataFrame) -> DataFrame:
    """The (id, key, role) whose key holds an indexed line and another one, with the key's ``members`` and smallest draw (``least``)."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("role").alias("highest"), F.min(F.xxhash64("id", "key")).alias("least")).where("members > 1 AND highest > 1")
    return stored(rows.join(sizes.drop("highest"), "key"), "line-shared")


def around_an_edit(line: Column) -> Column:
    """Keys for one edit that leave out one of PIECES pieces of the line: two lines one edit apart are equal before and behind the piece that
    holds it. A line has them as indexed (for its own length) and looks up those for a length one less."""
    n = F.length(line)
    found = []
    for length, role in ((n, 3), (n - 1, 1)):
        for j in range(PIECES):
            first, last = F.floor(length * j / PIECES).cast("int"), F.floor(length * (j + 1) / PIECES).cast("int")
            key = F.xxhash64(length, F.lit(j), F.substring(line, F.lit(1), first), F.substring(line, n - (length - last) + 1, length - last))
            found.append(F.struct(key.alias("key"), F.lit(role).cast("byte").alias("role")))
    return F.array(*found)


def _pairs(members: DataFrame, hubs: DataFrame, apart: str | None = None) -> DataFrame:
    """Pairs of lines that share a key, at least one of them as indexed and the other as looking up; each pair once, smaller hash first."""
    other = hubs.select("key", F.col("id").alias("hub"), F.col("role").alias("hub_role"), *([F.col(apart).alias("hub_c")] if apart else []))
    joined = members.join(other, "key").where("id <> hub").where("(role >= 2 AND hub_role <> 2) OR (hub_role >= 2 AND role <> 2)")
    joined = joined.where(F.col(apart) != F.col("hub_c")) if apart else joined
    return joined.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """One row per line that goes: doc_id, copy, line_no, the line that stays for it (first_doc, first_line), and whether they are equal."""
    lines = lines_of(docs, doc_id, text)
    seen = stored(lines.select("doc_id", "copy", "line_no", "h1", "h2"), "line-hashes")
    label = similar_lines(lines, edits)
    classed = seen.join(label, seen["h1"] == label["node"], "left").select("doc_id", "copy", "line_no", "h2", F.coalesce("component", "h1").alias("c"), F.when(F.col("node").isNull(), F.col("h2")).alias("c2"), "h1")
    place = F.struct("doc_id", "line_no", "copy", "h1", "h2")
    firsts = classed.groupBy("c", "c2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("fc"), F.col("c2").alias("fc2"), "first")
    joined = classed.join(firsts, (classed["c"] == firsts["fc"]) & classed["c2"].eqNullSafe(firsts["fc2"]))
    gone = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")) & (F.col("copy") == F.col("first.copy")))
    return joined.where(gone).select("doc_id", "copy", "line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"),
                                     ((F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))).alias("equal"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """``docs`` without the lines that go. A document that loses every line with a word goes too; one that had none stays."""
    of, copy, lost, parts, left = (free_name(docs, name) for name in ("__id", "__copy", "__gone", "__parts", "__left"))
    gone = duplicate_lines(docs, doc_id, text, edits).groupBy(F.col("doc_id").alias(of), F.col("copy").alias(copy)).agg(F.collect_set("line_no").alias(lost))
    joined = docs.join(gone, docs[doc_id].eqNullSafe(gone[of]) & (copy_of(docs[text]) == gone[copy]), "left")
    cut = joined.withColumn(parts, F.when(F.col(lost).isNotNull(), F.split(F.col(f"`{text}`"), "\n", -1)))
    cut = cut.withColumn(left, F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost), lambda i: F.get(parts, i)))
    stays = F.col(lost).isNull() | F.exists(left, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    new = F.when(F.col(lost).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
    return filtered(cut, stays).select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
