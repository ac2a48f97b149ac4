"""A run of rules as violation bitmaps: one stored table per entity, a row for each failing row with a bit for each rule.

Two scans of an entity decide everything. The first counts the decision keys of all its key rules together (grouping sets); the keys are
decided and those that fail are stored. The second evaluates all row rules, looks up the failing keys and writes the rows that fail anything:
key, shown values, bits. Totals are observed while these tables are written. Results, listings, examples and coverage then read only the stored
tables, whatever the number of rules. Failing keys are sent to the rows up to KEYS_SENT of them (counted before); beyond, rows and keys meet in a
shuffle with heavy keys cut into pieces by weight.
"""
from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from plumbline.functions.expressions import null_on_error
from plumbline.functions.skew import rows_of_keys, same, written
from plumbline.model import Model
from plumbline.operators.key_checks import KeyBatch, count_keys_together, keys_of_batch
from plumbline.operators.row_checks import as_text
from plumbline.plans import suite
from plumbline.rules import Rule

KEYS_SENT = 200_000     # failing keys of a batch that are broadcast; each is a few values and flags
BITS = 60               # rules in one number of a bit set
KEY_COLUMNS = 60        # key columns counted in one scan (grouping_id is a long)
EXAMPLE_GROUPS = 256    # groups of keys whose smallest keys bound the examples
_ROWS = "rule_id string, entity string, key string, shown map<string,string>"


class RuleRun:
    """What a run left behind. ``tables``: entity -> (key, values, bits); a rule's bit is its place in ``order[entity]``."""

    def __init__(self, spark, tables, rules: list[Rule], prepared: suite.Prepared, counted: dict[str, tuple[int, int]], stored: dict[str, DataFrame],
                 order: dict[str, list[tuple[Rule, list[str]]]]):
        self.spark, self.sources, self.rules, self.prepared = spark, tables, rules, prepared
        self.counted, self.tables, self.order = counted, stored, order
        self.own_id = {n.rule_id: r.rule_id for n, r in zip(prepared.rules, rules)}

    def results(self) -> DataFrame:
        """One row per rule, as ``execute_rules`` gives them."""
        p = self.prepared
        if not self.rules:
            return self.spark.createDataFrame([], suite.RESULTS)
        with null_on_error(self.spark):
            known = [(r, t, f, None) for r, (t, f) in self.counted.items()] + [(r, 0, 0, why) for r, why in p.errors.items()]
            parts = [self.spark.createDataFrame(known, "rule_id string, total bigint, failed bigint, error string")]
            parts += [x.withColumn("error", F.lit(None).cast("string")) for x in suite.tree_totals(p) + suite.custom_totals(p)]
            return suite.with_verdict(suite.union_of(parts), self.rules)

    def violations(self) -> DataFrame:
        """(rule_id, entity, key, shown) of every failing row of every rule but custom SQL."""
        return self._unfolded({})

    def _unfolded(self, last: dict[str, list[int | None]]) -> DataFrame:
        """The violations; with ``last`` only those of a rule whose key's place is at most the rule's bound (None: all of them)."""
        parts = []
        for entity, rows in self.tables.items():
            bounds = last.get(entity, [None] * len(self.order[entity]))
            if entity in last:
                rows = rows.withColumn("place", _place(F.col("key")))
                rows = rows.where(_any([self._fails(i) if b is None else self._fails(i) & (F.col("place") <= b) for i, b in enumerate(bounds)]))
            facts = F.array(*[F.struct(F.lit(i // BITS).alias("word"), F.lit(i % BITS).alias("bit"), F.lit(self.own_id[r.rule_id]).alias("rule_id"),
                                       F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"), F.lit(bounds[i]).cast("bigint").alias("last"))
                              for i, (r, columns) in enumerate(self.order[entity])])

            def fails(x):
                return F.call_function("getbit", F.get("bits", x["word"]), x["bit"]) == 1

            hits = F.filter(facts, (lambda x: fails(x) & (x["last"].isNull() | (F.col("place") <= x["last"]))) if entity in last else fails)
            found = rows.select("key", "values", F.explode(hits).alias("hit"))
            shown = F.map_from_arrays("hit.columns", F.transform("hit.columns", lambda c: F.element_at("values", c)))
            parts.append(found.select("hit.rule_id", F.lit(entity).alias("entity"), "key", shown.alias("shown")))
        return suite.union_of(parts) if parts else self.spark.createDataFrame([], _ROWS)

    def examples(self, per_rule: int = 5) -> DataFrame:
        """(rule_id, entity, example_no, key, shown): the first failing rows of each rule by key.

        Rows that cannot be among them are not unfolded: the ``per_rule``-th smallest of the groups' smallest places bounds the place of the last example.
        """
        last = {entity: self._bounds(entity, per_rule) for entity in self.tables if self.order[entity]}
        return suite.examples_of(self._unfolded(last), self.sources, self.rules, self.prepared.model, per_rule)

    def _bounds(self, entity: str, per_rule: int) -> list[int | None]:
        """For each rule a place at or after that of its last example; None where fewer than ``per_rule`` groups have a failing row."""
        rows = self.tables[entity].select("bits", _place(F.col("key")).alias("place"), F.pmod(F.hash("key"), F.lit(EXAMPLE_GROUPS)).alias("group"))
        rules = range(len(self.order[entity]))
        least = rows.groupBy("group").agg(*[F.min(F.when(self._fails(i), F.col("place"))).alias(f"p{i}") for i in rules])
        found = least.agg(*[F.slice(F.array_sort(F.collect_list(f"p{i}")), 1, per_rule) for i in rules]).first()
        return [places[-1] if len(places) == per_rule else None for places in found]

    def _fails(self, i: int) -> Column:
        return F.call_function("getbit", F.get("bits", F.lit(i // BITS)), F.lit(i % BITS)) == 1

    def _failing(self) -> set[str]:
        """Numbers of the rules that fail overall."""
        failed = {r["rule_id"] for r in self.results().where(~F.col("passed")).select("rule_id").collect()}
        return {n for n, own in self.own_id.items() if own in failed}

    def alarms(self) -> DataFrame:
        """(entity, key): keys that some rule flags which fails overall; no row is unfolded for it."""
        failing, parts = self._failing(), []
        for entity, rows in self.tables.items():
            masks = [0] * self._words(entity)
            for i, (r, _) in enumerate(self.order[entity]):
                masks[i // BITS] |= (1 << i % BITS) if r.rule_id in failing else 0
            hit = [F.get("bits", F.lit(w)).bitwiseAND(F.lit(m)) != 0 for w, m in enumerate(masks) if m]
            if hit:
                parts.append(rows.where(_any(hit)).select(F.lit(entity).alias("entity"), "key").distinct())
        return suite.union_of(parts) if parts else self.spark.createDataFrame([], "entity string, key string")

    def unexplained(self, planted: DataFrame) -> DataFrame:
        """(rule_id, unexplained): keys that a rule flags which fails overall and that ``planted`` (entity, key) does not name."""
        failing, parts = self._failing(), []
        for entity, rows in self.tables.items():
            named = planted.where(F.col("entity") == entity).select("key").distinct()
            words = self._words(entity)
            odd = rows.join(named, "key", "left_anti").groupBy("key").agg(*[F.bit_or(F.get("bits", F.lit(w))).alias(f"w{w}") for w in range(words)])
            sums = [F.sum(F.call_function("getbit", F.col(f"w{i // BITS}"), F.lit(i % BITS)).cast("bigint")).alias(f"n{i}")
                    for i in range(len(self.order[entity]))]
            one = odd.agg(*sums)
            parts.append(one.select(F.inline(F.array(*[F.struct(F.lit(r.rule_id).alias("n"), F.coalesce(f"n{i}", F.lit(0)).alias("unexplained"))
                                                       for i, (r, _) in enumerate(self.order[entity])]))))
        found = {r["n"]: r["unexplained"] for r in (suite.union_of(parts).collect() if parts else [])}
        rows = [(own, found.get(n, 0) if n in failing else 0) for n, own in self.own_id.items()]
        return self.spark.createDataFrame(rows, "rule_id string, unexplained bigint")

    def _words(self, entity: str) -> int:
        return -(-len(self.order[entity]) // BITS)


def _place(key: Column) -> Column:
    """A number that never falls as (length, key) rises: the length and the key's first five bytes. NULL, which comes first, has -1."""
    longest = 1 << 22
    head = F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 5)), 10, "0"), 16, 10).cast("bigint")
    size = F.length(key).cast("bigint")
    return F.coalesce(F.when(size < longest, size * (1 << 40) + head).when(size >= longest, F.lit(longest << 40)), F.lit(-1).cast("bigint"))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def _groups(batches: list) -> list[list]:
    """Batches that are counted in one scan."""
    out, used = [], 0
    for b in batches:
        if not out or used + len(b[0].keys) > KEY_COLUMNS:
            out.append([])
            used = 0
        out[-1].append(b)
        used += len(b[0].keys)
    return out


def _decided(batch: KeyBatch, scopes: dict[str, Column | None], keys: DataFrame) -> tuple[DataFrame, int, dict[str, tuple[int, int]]]:
    """The failing keys of a batch (stored), how many, and (total, failed) of its rules."""
    bad = {r.rule_id: F.coalesce(F.col(f"bad_{r.rule_id}"), F.lit(False)) for r in batch.rules}
    n = {r.rule_id: F.col("n_rows" if scopes[r.rule_id] is None else f"n_{r.rule_id}") for r in batch.rules}
    some = _any(list(bad.values()))
    seen = Observation()
    decided = batch.decide(keys).observe(seen, F.count_if(some).alias("keys"), *[F.sum(n[r]).alias(f"t_{r}") for r in bad],
                                         *[F.sum(F.when(bad[r], n[r])).alias(f"f_{r}") for r in bad])
    failing = written(decided.where(some).select(*batch.keys, "n_rows", *[b.alias(f"bad_{r}") for r, b in bad.items()]), "failing-keys")
    got = seen.get
    return failing, got["keys"], {r: (got[f"t_{r}"] or 0, got[f"f_{r}"] or 0) for r in bad}


def key_scans(p: suite.Prepared, entity: str) -> list[tuple[list, DataFrame]]:
    """The scans that count the decision keys of an entity: one, unless there are more than KEY_COLUMNS key columns."""
    batches = [(b, scopes) for b, scopes, _ in p.batches if b.entity == entity]
    return [(group, count_keys_together([b for b, _ in group], p.table(entity), [s for _, s in group])) for group in _groups(batches)]


def row_scan(p: suite.Prepared, entity: str, found: list, order: list[tuple[Rule, list[str]]]) -> tuple[DataFrame, Observation | None, list]:
    """The rows of an entity that fail any rule, their totals observed on the way. ``found``: (batch, scopes, failing keys, how many)."""
    rows, flags = p.table(entity), {}
    own = list(rows.columns)
    for i, (batch, scopes, failing, n) in enumerate(found):
        if not n:
            continue
        names = {k: f"_k{i}_{k}" for k in batch.keys}
        rows = rows.withColumns({names[k]: e for k, e in batch.keys.items()})
        bad = [c for c in failing.columns if c.startswith("bad_")]
        keyed = failing.select(*[F.col(k).alias(name) for k, name in names.items()], F.col("n_rows").alias(f"_n{i}"), *bad)
        if n <= KEYS_SENT:
            keyed = keyed.withColumnsRenamed({name: f"_r{name}" for name in names.values()})
            cond = None
            for name in names.values():
                part = same(rows[name], keyed[f"_r{name}"])
                cond = part if cond is None else cond & part
            rows = rows.join(F.broadcast(keyed), cond, "left").drop(*[f"_r{name}" for name in names.values()])
        else:
            rows = rows_of_keys(rows, keyed, list(names.values()), f"_n{i}", how="left")
        for r in batch.rules:
            flag, scope = F.coalesce(F.col(f"bad_{r.rule_id}"), F.lit(False)), scopes[r.rule_id]
            flags[r.rule_id] = flag if scope is None else flag & scope
    seen, measures = None, []
    for r, scope, bad in p.row.get(entity, []):
        flags[r.rule_id] = F.coalesce(bad if scope is None else scope & bad, F.lit(False))
        measures += [(F.count(F.lit(1)) if scope is None else F.count_if(scope)).alias(f"t_{r.rule_id}"), F.count_if(F.col(f"_bad_{r.rule_id}")).alias(f"f_{r.rule_id}")]
    target = p.table(entity)
    shown = list(dict.fromkeys(c for _, columns in order for c in columns if c in own))
    values = [x for c in shown for x in (F.lit(c), suite.masked(c) if c in p.model.entity(entity).pii else as_text(target, c))]
    rows = rows.withColumns({f"_bad_{r}": f for r, f in flags.items()})
    if measures:
        seen = Observation()
        rows = rows.observe(seen, *measures)
    words = []
    for w in range(-(-len(order) // BITS)):
        word = F.lit(0).cast("bigint")
        for i, (r, _) in enumerate(order[w * BITS:(w + 1) * BITS]):
            if r.rule_id in flags:
                word = word + F.when(F.col(f"_bad_{r.rule_id}"), F.lit(1 << i)).otherwise(0).cast("bigint")
        words.append(word)
    failing = rows.where(_any([F.col(f"_bad_{r}") for r in flags])).select(
        suite.key_text(p.model.entity(entity).primary_key).alias("key"),
        (F.create_map(*values) if values else F.create_map()).cast("map<string,string>").alias("values"), F.array(*words).alias("bits")) if flags else None
    return failing, seen, [r.rule_id for r, *_ in p.row.get(entity, [])]


def _entity_table(p: suite.Prepared, entity: str, pool: ThreadPoolExecutor) -> tuple[DataFrame | None, list, dict[str, tuple[int, int]]]:
    counted, jobs = {}, []
    for group, keys in key_scans(p, entity):
        keys = written(keys, "key-counts")
        jobs += [(b, scopes, pool.submit(_decided, b, scopes, keys_of_batch(keys, i, b, scopes))) for i, (b, scopes) in enumerate(group)]
    found = []
    for b, scopes, job in jobs:
        failing, n, totals = job.result()
        found.append((b, scopes, failing, n))
        counted |= totals
    trees = [x for x in p.acyclic if x[0].entity == entity]
    pk = list(p.model.entity(entity).primary_key)
    order = [(r, [c for c in dict.fromkeys(pk + list(r.columns)) if c in p.table(entity).columns])
             for r in [r for r, *_ in p.row.get(entity, [])] + [r for b, *_ in found for r in b.rules]]
    order += [(r, [key, parent]) for r, key, parent, *_ in trees]
    parts = []
    if p.row.get(entity) or any(n for *_, n in found):
        failing, seen, rules = row_scan(p, entity, found, order)
        parts.append(written(failing, "violations"))
        got = seen.get if seen else {}
        counted |= {r: (got[f"t_{r}"], got[f"f_{r}"]) for r in rules}
    for t, (r, key, parent, nodes, on_cycle, _) in enumerate(trees):
        rows = nodes.join(on_cycle.withColumnRenamed("node", key), key, "left_semi").groupBy(key).agg(F.min(parent).alias(parent))
        place = len(order) - len(trees) + t
        bits = F.array(*[F.lit((1 << place % BITS) if w == place // BITS else 0).cast("bigint") for w in range(-(-len(order) // BITS))])
        parts.append(rows.select(F.col(key).cast("string").alias("key"), F.create_map(F.lit(key), F.col(key).cast("string"), F.lit(parent), F.col(parent).cast("string")).alias("values"),
                                 bits.alias("bits")))
    return (suite.union_of(parts) if parts else None), order, counted


def run_rules(tables, rules: list[Rule], model: Model, as_of: dt.date) -> RuleRun:
    """Runs all rules and stores their violations."""
    spark = SparkSession.active()
    stored, order, counted = {}, {}, {}
    with null_on_error(spark):
        p = suite.Prepared(tables, suite.numbered(rules), model, as_of)
        entities = list(dict.fromkeys([*p.row, *[b.entity for b, *_ in p.batches], *[r.entity for r, *_ in p.acyclic]]))
        # entities do not wait for each other, nor do the batches of one
        with ThreadPoolExecutor(8) as pool, ThreadPoolExecutor(8) as inner:
            for entity, (table, rules_of, totals) in zip(entities, pool.map(lambda e: _entity_table(p, e, inner), entities)):
                order[entity] = rules_of
                counted |= totals
                if table is not None:
                    stored[entity] = table
    return RuleRun(spark, tables, rules, p, counted, stored, order)
