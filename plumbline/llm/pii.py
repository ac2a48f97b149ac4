"""Personal data by patterns and by what the corpus tells about them.

Four kinds of protected entities are found by patterns (leftmost, not overlapping within a kind; a match that fails its test is dropped).
Terms in the same documents are then judged by information content: with D(x) the documents that hold x, a term t tells
``PMI(t; e) / IC(e) = 1 - log(D(t) / D(t, e)) / log(N / D(e))`` of what there is to know about entity e: 1 when e always follows from t,
0 when t says nothing. Documents are whole texts, however far apart t and e stand in them. Terms at or above ``DISCLOSURE`` that share at least
``SUPPORT`` different texts with the entity become spans of kind ``term`` wherever they stand, also in documents without the entity;
``sanitised`` removes entities and generalises terms. As D(t, e) is at most D(e), D(t) bounds which terms can disclose e, and only those are paired.

Only built-in functions run. NULL and empty texts hold nothing. Positions are code points, ends are exclusive. Repeated rows each get
their spans; a term in copies of one text is no evidence. A clashing column of ``docs`` does not matter: only id and text are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, rows_with, stored

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the four kinds. ``\\G`` (the end of the match before) or a look behind says where a match can begin, so that a long
#: run is not tried again from each of its characters; possessive repeats never come back. Neither changes what matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match.
SIGN = {"email": "@", "ip": ".", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A run of letters with no letter, mark or digit beside it; brackets, quotes, hyphens and apostrophes end it as white space does.
TERM = r"(?<![\p{L}\p{M}\p{N}])\p{L}{4,}+(?![\p{M}\p{N}])"
SUPPORT, DISCLOSURE = 2, 0.9
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in 0."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, kind: Column, base: Column, keep=None) -> Column:
    """All matches (those that ``keep``, a test of the match, lets through) with their places, from the lengths of what lies between them; ``base``
    is added to the places. Only what is kept is appended, so a text with many matches of which few are kept takes time in proportion."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(hits, F.slice(gaps, F.lit(1), F.greatest(F.size(hits), F.lit(1))), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g")))
    start = F.struct(base.cast("int").alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("found"))

    def step(done: Column, x: Column) -> Column:
        first = done["at"] + x["g"]
        last = first + F.length(x["h"])
        longer = F.concat(done["found"], F.array(F.struct(kind.cast("int").alias("kind"), first.alias("start"), last.alias("end"), x["h"].alias("value"))))
        return F.struct(last.alias("at"), (longer if keep is None else F.when(keep(x["h"]), longer).otherwise(done["found"])).alias("found"))

    return F.when(F.size(hits) > 0, F.aggregate(F.filter(steps, lambda x: x["h"].isNotNull()), start, step, lambda done: done["found"])).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def spans(text: Column) -> Column:
    """All valid matches of the four kinds, by kind and then by place."""
    return F.concat(*[_kind_spans(text, k, kind) for k, kind in enumerate(KINDS)])


def _kind_spans(text: Column, k: int, kind: str) -> Column:
    located = F.filter(_located(text, PATTERNS[kind], F.lit(k), F.lit(0)), lambda s: _valid(kind, s["value"]))
    if kind in SIGN:
        return F.when(F.contains(text, F.lit(SIGN[kind])), located).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    return F.when(text.rlike("[0-9][ -]?[0-9]"), located).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _entity(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.lower(span["value"]))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _words(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(TERM), F.lit(0)), _term))


def _terms(text: Column, spans: Column, keep=None) -> Column:
    """All terms of a text (that ``keep`` lets through) with their places, without those that overlap a span."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.filter(_located(padded, TERM, F.lit(len(KINDS)), F.lit(-1), keep), lambda w: ~F.exists(spans, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy (hash of the text), spans, and of texts with spans the distinct entities and terms."""
    rows = _rows(docs, doc_id, text).withColumn("spans", spans(F.col("text")))
    some = F.size("spans") > 0
    words = F.array_distinct(F.transform(_terms(F.col("text"), F.col("spans")), lambda w: _term(w["value"])))
    return rows.select("doc_id", "copy", "spans", F.when(some, F.array_distinct(F.transform("spans", _entity))).alias("entities"), F.when(some, words).alias("words"))


def disclosing(docs: DataFrame, base: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term) pairs in which the term discloses the entity, with ``told`` (0 to 1)."""
    held = base.where("entities IS NOT NULL")
    of_copy = stored(held.select("copy", F.explode("entities").alias("entity")).groupBy("copy", "entity").agg(F.count(F.lit(1)).alias("times")), "pii-entities")
    holders = of_copy.groupBy("entity").agg(F.sum("times").alias("with_entity"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    holders = stored(holders.drop("texts"), "pii-holders")
    n = float(max(base.count(), 2))
    # D(t) of a term that can disclose an entity, from D(t, e) <= D(e); a little more for rounding
    most = F.col("with_entity") * F.pow(F.lit(n) / F.col("with_entity"), F.lit(1 - DISCLOSURE)) * 1.000001
    cap = holders.agg(F.max(most).alias("m")).first()["m"] or 0.0
    used = docs.select(F.explode(_words(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    used = stored(used.where(F.col("with_term").between(SUPPORT, F.lit(cap))), "pii-terms")
    words = held.select("copy", F.explode("words").alias("term")).join(used, "term").distinct()
    both = words.join(of_copy.join(holders, "entity"), "copy").where(F.col("with_term") <= most)
    pairs = both.groupBy("entity", "term", "with_entity", "with_term").agg(F.sum("times").alias("both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    told = 1 - F.log(F.col("with_term") / F.least("both", "with_term")) / F.greatest(F.log(F.lit(n) / F.col("with_entity")), F.lit(1e-9))
    return stored(pairs.withColumn("told", told).where(F.col("told") >= DISCLOSURE).select("entity", "term", "told"), "pii-told")


def all_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy, spans (patterns), terms (the method's spans by place)."""
    base = stored(found(docs, doc_id, text), "pii-found")
    told = disclosing(docs, base, text).select("term").distinct()
    rows = _rows(docs, doc_id, text).select("copy", "text")
    hit = rows.select("copy", F.explode(_words(F.col("text"))).alias("term")).join(told, "term").groupBy("copy").agg(F.collect_set("term").alias("told"))
    hit = stored(hit.select(F.col("copy").alias("c"), "told"), "pii-hits")
    # one row per text; its spans come from the stored table: as an expression they would be searched again for every word
    once = rows_with(rows, "copy", hit.select("c")).groupBy("copy").agg(F.min("text").alias("text"))
    known = base.where(F.size("spans") > 0).groupBy(F.col("copy").alias("k")).agg(F.first("spans").alias("known"))
    none = F.expr(f"cast(array() as {_SPAN})")
    met = once.join(hit, once["copy"] == hit["c"]).join(known, once["copy"] == known["k"], "left")
    terms = met.select("c", _terms(F.col("text"), F.coalesce("known", none), lambda word: F.array_contains("told", _term(word))).alias("terms"))
    return base.join(terms, base["copy"] == terms["c"], "left").select("doc_id", "copy", "spans", F.coalesce("terms", none).alias("terms"))


def written(some: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets and disclosing terms by ``[term]``; of overlapping spans the first counts.
    Documents without spans keep their text and are not shuffled with it when the table of spans is small."""
    marked = all_spans(docs, doc_id, text).select("doc_id", "copy", F.array_sort(F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("s"))
    of, copy, held = (free_name(docs, name) for name in ("__id", "__copy", "__s"))
    marked = marked.where(F.size("s") > 0).dropDuplicates(["doc_id", "copy"]).select(F.col("doc_id").alias(of), F.col("copy").alias(copy), F.col("s").alias(held))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    apart = F.aggregate(held, empty, lambda kept, s: F.when((F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)) > s["start"]), kept).otherwise(F.concat(kept, F.array(s))))
    names = F.array(*[F.lit(f"[{k}]") for k in (*KINDS, "term")])
    t = F.col(f"`{text}`")
    joined = docs.join(marked, docs[doc_id].eqNullSafe(marked[of]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == marked[copy]), "left").withColumn(held, apart)
    before = lambda i: F.coalesce(F.get(held, i - 1)["end"], F.lit(0))
    pieces = F.transform(held, lambda s, i: F.concat(F.substring(t, before(i) + 1, s["start"] - before(i)), F.get(names, s["kind"])))
    rest = F.substring(t, F.get(held, F.size(held) - 1)["end"] + 1, F.length(t))
    return joined.select(*[(F.when(F.size(held) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(t).alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])
