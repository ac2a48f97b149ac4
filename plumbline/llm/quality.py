"""Quality rules as a bitmask ledger: every rule is judged once, policies only pick bits.

``ledger`` measures each document and stores one bit per failed rule beside the measurements. ``apply_policy`` keeps a document
when none of the policy's bits is set; ``ablation`` tells for each policy and rule how many documents only that rule rejects. A new
policy version reads the stored bits and no text. Only built-in functions run; there is no shuffle.

NULL and empty texts have no words (they fail ``few_words``); words are runs of other characters than space and U+0009 to U+000D,
whatever their length; repeated rows are judged each for itself. Other columns pass through; one with a name of the ledger's own columns
is replaced in the ledger, and kept by ``apply_policy``. An empty table gives an empty ledger.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import filtered
from .text import SPACES

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_stutters")
#: In bit order. Rules are only added at the end, so stored ledgers keep their meaning.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
    ("shouting", "2 * n_shouts > n_words AND 2 * n_upper > n_letters"),
    ("stutter", "5 * n_stutters > n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in set(self.rules))


POLICIES = (Policy("base", BASE), Policy("1", tuple(name for name, _ in RULES)))


def _chars(text: Column, dropped: str) -> Column:
    """Code points of ``text`` that are not in ``dropped``."""
    return F.length(F.translate(text, dropped, "")).cast("long")


def _doubled(hashes: str, step: int) -> Column:
    """From the hashes of windows of ``step`` words those of windows of twice as many."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements. A window of eight words stands for its 64-bit hash, built from word hashes by doubling, so a
    text of n words costs a few passes over n numbers; only texts with a window twice are sorted."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    own = {*MEASURES, "bits"}
    df = docs.withColumn("__text", F.col(text)).select(*[f"`{c}`" for c in docs.columns if c.lower() not in own], "__text")
    df = df.withColumn("__words", F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    letters = F.regexp_replace(t, r"[^A-Za-z]", "")
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": _chars(t, SPACES),
        "n_symbols": F.length(t) - _chars(t, SYMBOLS),
        "n_shouts": F.length(t) - _chars(t, "!"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__letters": letters,
        "__1": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__words", "__lines", "__text")
    df = df.withColumns({"n_letters": F.length("__letters").cast("long"), "n_upper": _chars(F.col("__letters"), "abcdefghijklmnopqrstuvwxyz")}).drop("__letters")
    df = df.withColumn("n_stutters", F.size(F.filter(F.transform("__1", lambda x, i: x == F.get("__1", i + 1)), lambda same: same)).cast("long"))
    for step in (1, 2, 4):
        df = df.withColumn(f"__{2 * step}", _doubled(f"__{step}", step)).drop(f"__{step}")
    df = df.withColumn("__8", F.when(F.size("__8") >= WINDOW, F.slice("__8", F.lit(1), F.size("__8") - (WINDOW - 1))))
    twice = F.size(F.array_distinct("__8")) < F.size("__8")
    df = df.withColumn("__at", F.when(twice, F.array_sort(F.transform("__8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__8")
    df = df.withColumn("__from", F.array_sort(F.filter(F.transform("__at", lambda x, j: F.when(F.coalesce(F.get("__at", j - 1)["h"] == x["h"], F.lit(False))
                       | F.coalesce(F.get("__at", j + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda i: i.isNotNull()))).drop("__at")
    covered = F.transform("__from", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__from", j + 1) - i, F.lit(WINDOW))).cast("long"))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("__from")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``bits``: bit k is set when rule k fails."""
    bits = sum((F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, test) in enumerate(RULES)), F.lit(0).cast("long"))
    return filtered(measured(docs, text), F.lit(True)).withColumn("bits", bits)


def passes(policy: Policy) -> Column:
    return F.col("bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: Policy = POLICIES[-1], text: str = "text") -> DataFrame:
    """The documents that ``policy`` keeps, with their own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return filtered(ledger(whole, "text"), passes(policy)).select("row.*")


def ablation(ledger_rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(version, rule, failed, rejected, only_this): per policy and rule the documents that fail it and those that no other rule of
    the policy rejects. One pass: the ledger is counted by bit pattern first (at most 2^rules rows), then the patterns are read."""
    spark: SparkSession = ledger_rows.sparkSession
    patterns = ledger_rows.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p.version, name, p.mask, 1 << k) for p in policies for k, (name, _) in enumerate(RULES) if p.mask >> k & 1]
    asked = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, r, m, b in rows])
    pairs = patterns.select("n", "bits", F.explode(asked).alias("a")).select("n", "bits", "a.*")
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return pairs.groupBy("version", "rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"), total(hit != 0).alias("rejected"), total(hit == F.col("bit")).alias("only_this"))
