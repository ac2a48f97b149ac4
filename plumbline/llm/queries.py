"""Registered queries of the subpackage: one ``opN_<name>`` for each operator, over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprint, htmlcut, hyperminhash, lexical, licenses, line_dedup, mixing, pii, quality, sentencepieces, toxicity, vectorgraph

QUERIES, ORACLE = {}, {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mixing.mix_counts(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = quality.POLICIES[0], quality.POLICIES[-1]
    rows = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes(base)).alias("base_failed"),
                       (quality.passes(base) & quality.passes(current)).alias("kept"), "bits")


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.classify(docs.select("doc_id", "text"), labels.where(fold != 0), "doc_id", "text", "toxic")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), round_trip="round_trip")
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "round_trip", "ids")


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = htmlcut.extract(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.all_spans(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.written(F.col("spans")), 256).alias("base_sha256"),
                       pii.written(F.concat("spans", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines with a word, how many of them go (as equal to a line before, or as near it), and for each that goes
    the line that stays."""
    docs = _table(spark, sf_dir, "documents")
    gone = line_dedup.duplicate_lines(docs)
    # a set: rows with equal id and text have each line twice
    went = gone.groupBy(F.col("doc_id").alias("id"), F.col("copy").alias("c")).agg(F.collect_set(F.struct("line_no", "first_doc", "first_line", "equal")).alias("lines"))
    n_equal = F.size(F.filter("lines", lambda x: x["equal"])).cast("long")
    removed = F.sort_array(F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["first_doc"].alias("first_doc"), x["first_line"].alias("first_line"))))
    went = went.select("id", "c", n_equal.alias("n_equal"), (F.size("lines") - n_equal).alias("n_near"), removed.alias("removed"))
    has_word = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", line_dedup.copy_of(F.col("text")).alias("copy"), F.size(has_word).cast("long").alias("n_lines"))
    zero = F.lit(0).cast("long")
    return (counted.join(went, counted["doc_id"].eqNullSafe(went["id"]) & (counted["copy"] == went["c"]), "left")
            .select("doc_id", "n_lines", F.coalesce("n_equal", zero).alias("n_equal"), F.coalesce("n_near", zero).alias("n_near"), "removed"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(_table(spark, sf_dir, "documents"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op13_lexical_search"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
 h AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0), size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM h),
 tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM h) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), size),
 q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
 s AS (SELECT item_id, doc_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN h USING (r), size GROUP BY ALL),
 ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


ORACLE["op11_collocations"] = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 f AS (SELECT lang, len(g) AS words, array_to_string(g, ' ') AS phrase, count(*) AS f FROM (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4, 5], lambda size:
  list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])))) AS g FROM w) GROUP BY ALL),
 n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY 1), c AS (SELECT *, string_split(phrase, ' ') AS g FROM f WHERE words > 1 AND f >= 100),
 inside AS (SELECT lang, array_to_string(sub, ' ') AS phrase, max(f) AS longer FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, words), lambda size:
  list_transform(range(1, words - size + 2), lambda i: g[i:i + size - 1])))) AS sub FROM c) GROUP BY ALL),
 kept AS (SELECT lang, phrase, f AS a, g, unnest(range(1, words)) AS k FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f),
 cut AS (SELECT lang, kept.phrase, a, k, x.f AS l, y.f AS r, n, ((1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM kept JOIN f x USING (lang) JOIN f y USING (lang) JOIN n USING (lang) WHERE x.phrase = array_to_string(g[:k], ' ') AND y.phrase = array_to_string(g[k + 1:], ' ')),
 lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest)
SELECT * FROM ranked WHERE rank <= 2000"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@query
def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.neighbours(_table(spark, sf_dir, "embeddings"))
