"""Run a set of rules: results, failing rows, examples.

All row checks of an entity share one scan (two conditional counts per rule). Rules that need more than
the row are counted per decision key, and rules with the same key share that count. Nothing is capped.
"""
from __future__ import annotations

import dataclasses
import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import text
from plumbline.functions.expressions import ExpressionError, null_on_error
from plumbline.functions.skew import rows_of_keys
from plumbline.model import Model
from plumbline.operators.cycles import cycle_nodes
from plumbline.operators.key_checks import KEY_CHECKS, Counted, KeyBatch, batch_totals, count_keys, key_batches
from plumbline.operators.row_checks import ROW_CHECKS, as_text, fails, scope_of
from plumbline.rules import Rule

RESULTS = ("rule_id string, name string, entity string, check_type string, severity string, total bigint, failed bigint, failure_rate double, "
           "passed boolean, error string")
RULES_PER_SCAN = 100     # keeps generated code below the JVM's method limit


def _problem(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"


def numbered(rules: list[Rule]) -> list[Rule]:
    """The rules under their place in the list: column names and lookups inside a plan must not depend on what an id looks like or on
    its being unique."""
    return [dataclasses.replace(r, rule_id=f"rule{i}") for i, r in enumerate(rules)]


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _totals(one_row: DataFrame, triples: list[tuple[str, str, str]]) -> DataFrame:
    rows = ", ".join(f"struct({text.q(rid)} AS rule_id, CAST({t} AS BIGINT) AS total, CAST({f} AS BIGINT) AS failed)"
                     for rid, t, f in triples)
    return one_row.selectExpr(f"inline(array({rows}))")


def _row_check_totals(target: DataFrame, checks: list[tuple[Rule, Column | None, Column]]) -> DataFrame:
    """One aggregate for all row checks of an entity."""
    measures, triples = [F.count(F.lit(1)).alias("n_rows")], []
    for rule, scope, bad in checks:
        total = "n_rows"
        if scope is not None:
            measures.append(F.count_if(scope).alias(f"t_{rule.rule_id}"))
            total = f"`t_{rule.rule_id}`"
            bad = scope & bad
        measures.append(F.count_if(bad).alias(f"f_{rule.rule_id}"))
        triples.append((rule.rule_id, total, f"`f_{rule.rule_id}`"))
    return _totals(target.agg(*measures), triples)


def custom_sql_rows(sql: str, tables, spark: SparkSession) -> DataFrame:
    """Rows of a SELECT over the source's own table names. Nested in FROM, only a query can parse."""
    if re.search(r"(?i)\b(java_method|reflect|try_reflect)\s*\(", sql):
        raise ExpressionError("custom_sql must not call into the JVM")
    used = [t for t in tables if re.search(rf"(?i)\b{re.escape(t)}\b", sql)]
    before = {t: spark.table(t) for t in used if t in {v.name for v in spark.catalog.listTables() if v.isTemporary}}
    for t in used:
        tables[t].createOrReplaceTempView(t)
    try:
        return spark.sql(f"SELECT * FROM (\n{sql}\n) AS failing")
    finally:
        for t in used:
            if t in before:
                before[t].createOrReplaceTempView(t)
            else:
                spark.catalog.dropTempView(t)


class Prepared:
    """Rules checked and turned into expressions; a rule that cannot run is kept with its error."""

    def __init__(self, tables, rules: list[Rule], model: Model, as_of: dt.date, counted: Counted | None = None):
        self.tables, self.model, self.rules, self.counted = tables, model, rules, counted or {}
        self.errors: dict[str, str] = {}
        self.row: dict[str, list[tuple[Rule, Column | None, Column]]] = {}
        self.batches: list[tuple[KeyBatch, dict[str, Column | None], DataFrame]] = []
        self.acyclic: list[tuple[Rule, str, str, DataFrame, DataFrame, int]] = []
        self.custom: list[tuple[Rule, DataFrame]] = []
        keyed: list[Rule] = []
        for r in rules:
            try:
                target = tables[model.entity(r.entity).table]
                missing = [c for c in r.columns if c not in target.columns]
                if missing:
                    raise ValueError(f"target: unknown column(s) {missing} in '{r.entity}'")
                if r.type in ROW_CHECKS:
                    self.row.setdefault(r.entity, []).append((r, scope_of(r, target), fails(r, target, as_of)))
                elif r.type in KEY_CHECKS:
                    keyed.append(r)
                elif r.type == "hierarchy_acyclic":
                    self.acyclic.append((r, *self._cycles(r)))
                elif r.type == "custom_sql":
                    self.custom.append((r, custom_sql_rows(r.check["sql"], tables, target.sparkSession)))
                else:
                    raise ValueError(f"unknown check type '{r.type}'")
            except Exception as e:  # noqa: BLE001 - a broken rule must not stop the others
                self.errors[r.rule_id] = _problem(e)
        self.row = {entity: self._runnable(entity, checks) for entity, checks in self.row.items()}
        self.row = {entity: checks for entity, checks in self.row.items() if checks}
        try:
            self.batches = self._batches(keyed)
        except Exception:  # noqa: BLE001 - find the rules that cannot be planned
            for r in keyed:
                try:
                    self._batches([r])
                except Exception as e:  # noqa: BLE001
                    self.errors[r.rule_id] = _problem(e)
            self.batches = self._batches([r for r in keyed if r.rule_id not in self.errors])

    def _cycles(self, rule: Rule) -> tuple[str, str, DataFrame, DataFrame, int]:
        """(key, parent column, nodes, nodes on a cycle, how many)."""
        h = self.model.hierarchy(rule.check["hierarchy"])
        node = self.model.entity(h.entity)
        nodes = self.tables[node.table]
        if len(node.primary_key) != 1:
            raise ValueError(f"hierarchy '{rule.check['hierarchy']}': '{h.entity}' needs a primary key of one column")
        key = node.primary_key[0]
        return key, h.parent, nodes, *cycle_nodes(nodes, key, h.parent)

    def _runnable(self, entity: str, checks: list) -> list:
        """Checks Spark can resolve: all of them in one analysis, one by one only if that fails."""
        def analysed(some: list) -> None:
            self.table(entity).select(*[bad if scope is None else scope & bad for _, scope, bad in some])
        try:
            analysed(checks)
            return checks
        except Exception:  # noqa: BLE001
            good = []
            for check in checks:
                try:
                    analysed([check])
                    good.append(check)
                except Exception as e:  # noqa: BLE001
                    self.errors[check[0].rule_id] = _problem(e)
            return good

    def _batches(self, keyed: list[Rule]) -> list[tuple[KeyBatch, dict[str, Column | None], DataFrame]]:
        """Batches with their scopes and the decided keys (planned, so that errors show here)."""
        out = []
        for b in key_batches(keyed, self.model, self.tables, self.counted):
            target = self.table(b.entity)
            scopes = {r.rule_id: scope_of(r, target) for r in b.rules}
            values = self.counted.get((self.model.entity(b.entity).table, b.column))
            out.append((b, scopes, b.decide(count_keys(b, target, scopes, values))))
        return out

    def table(self, entity: str) -> DataFrame:
        return self.tables[self.model.entity(entity).table]



def tree_totals(p: Prepared) -> list[DataFrame]:
    """(rule_id, total, failed) of each check for cycles."""
    return [_totals(nodes.agg(F.count_distinct(key).alias("n")), [(r.rule_id, "n", str(failed))]) for r, key, _, nodes, _, failed in p.acyclic]


def custom_totals(p: Prepared) -> list[DataFrame]:
    """(rule_id, total, failed) of each custom SQL rule."""
    parts = []
    for r, failing in p.custom:
        counts = (p.table(r.entity).select(F.lit(1).alias("row"), F.lit(0).alias("bad"))
                  .unionAll(failing.select(F.lit(0), F.lit(1))).agg(F.sum("row").alias("t"), F.sum("bad").alias("f")))
        parts.append(_totals(counts, [(r.rule_id, "coalesce(t, 0)", "coalesce(f, 0)")]))
    return parts


def execute_rules(tables, rules: list[Rule], model: Model, as_of: dt.date, counted: Counted | None = None) -> DataFrame:
    """(rule_id, name, entity, check_type, severity, total, failed, failure_rate, passed, error) per rule.

    ``counted``: (table, column) -> the column's counted values, where a profile of the same tables has stored them; rules whose decision key is
    such a column read them instead of counting the table's rows again.
    """
    spark = SparkSession.active()
    if not rules:
        return spark.createDataFrame([], RESULTS)
    with null_on_error(spark):
        p = Prepared(tables, numbered(rules), model, as_of, counted)
        parts = []
        for entity, checks in p.row.items():
            for i in range(0, len(checks), RULES_PER_SCAN):
                parts.append(_row_check_totals(p.table(entity), checks[i:i + RULES_PER_SCAN]))
        for batch, scopes, decided in p.batches:
            parts.append(batch_totals(batch, decided, scopes))
        parts = [x.withColumn("error", F.lit(None).cast("string")) for x in parts + tree_totals(p) + custom_totals(p)]
        if p.errors:
            parts.append(spark.range(1).select(F.inline(F.array(*[
                F.struct(F.lit(k).alias("rule_id"), F.lit(0).cast("bigint").alias("total"),
                         F.lit(0).cast("bigint").alias("failed"), F.lit(v).alias("error"))
                for k, v in p.errors.items()]))))
        return with_verdict(union_of(parts), rules)


def with_verdict(totals: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add what is known about the rule (literals, no join) and decide passed / failed."""
    facts = F.expr("map(" + ", ".join(
        f"{text.q(n.rule_id)}, struct({text.q(r.rule_id)} AS rule_id, {text.q(r.name)} AS name, {text.q(r.entity)} AS entity, {text.q(r.type)} AS check_type, "
        f"{text.q(r.severity)} AS severity, {float(r.limit)!r}D AS allowed)" for n, r in zip(numbered(rules), rules)) + ")[rule_id]")
    rate = F.round(F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("total")), F.lit(0.0)), 6)
    return (totals.withColumn("fact", facts).withColumn("failure_rate", rate)
            .select("fact.rule_id", "fact.name", "fact.entity", "fact.check_type", "fact.severity", "total", "failed",
                    "failure_rate",
                    (F.col("error").isNull() & (F.col("failure_rate") <= F.col("fact.allowed"))).alias("passed"),
                    "error"))


# ---- failing rows -------------------------------------------------------------------------------
def key_text(primary_key: tuple[str, ...]) -> Column:
    """One column: its text. Several: a JSON object. None declared: NULL."""
    if not primary_key:
        return F.lit(None).cast("string")
    if len(primary_key) == 1:
        return F.col(primary_key[0]).cast("string")
    return F.to_json(F.struct(*primary_key))


def _shown(rule: Rule, p: Prepared) -> Column:
    """The key and target columns of a failing row, personal data masked."""
    entity, df = p.model.entity(rule.entity), p.table(rule.entity)
    columns = [c for c in dict.fromkeys(entity.primary_key + rule.columns) if c in df.columns]
    pairs = []
    for c in columns:
        value = as_text(df, c)
        pairs += [F.lit(c), masked(c) if c in entity.pii else value]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def masked(column: str) -> Column:
    return F.expr(text.mask(f"CAST({text.ident(column)} AS STRING)"))


def _hits(flags: list[tuple[Rule, Column]], p: Prepared) -> Column:
    found = F.array(*[F.when(bad, F.struct(F.lit(r.rule_id).alias("rule_id"), _shown(r, p).alias("shown")))
                      for r, bad in flags])
    return F.filter(found, lambda x: x.isNotNull())


def violations(tables, rules: list[Rule], model: Model, as_of: dt.date) -> DataFrame:
    """(rule_id, entity, key, shown): every failing row of every rule, uncapped.

    custom_sql rules have no key and are not listed here, see ``violation_examples``.
    """
    spark = SparkSession.active()
    with null_on_error(spark):
        p = Prepared(tables, numbered(rules), model, as_of)
        parts = []
        for entity, checks in p.row.items():
            flags = [(r, bad if scope is None else scope & bad) for r, scope, bad in checks]
            parts.append(_listed(p.table(entity), entity, _hits(flags, p), p))
        for batch, scopes, decided in p.batches:
            parts.append(_batch_rows(batch, decided, scopes, p))
        for r, key, parent, nodes, on_cycle, _ in p.acyclic:
            rows = nodes.join(on_cycle.withColumnRenamed("node", key), key, "left_semi").groupBy(key).agg(F.min(parent).alias(parent))
            parts.append(rows.select(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.entity).alias("entity"), F.col(key).cast("string").alias("key"),
                F.create_map(F.lit(key), F.col(key).cast("string"), F.lit(parent), F.col(parent).cast("string"))
                .alias("shown")))
        if not parts:
            return spark.createDataFrame([], "rule_id string, entity string, key string, shown map<string,string>")
        own = F.expr("map(" + ", ".join(f"{text.q(n.rule_id)}, {text.q(r.rule_id)}" for n, r in zip(p.rules, rules)) + ")[rule_id]")
        return union_of(parts).withColumn("rule_id", own)


def _listed(rows: DataFrame, entity: str, hits: Column, p: Prepared) -> DataFrame:
    pk = p.model.entity(entity).primary_key
    return (rows.select(key_text(pk).alias("key"), F.explode(hits).alias("hit"))
            .select("hit.rule_id", F.lit(entity).alias("entity"), "key", "hit.shown"))


def _batch_rows(batch: KeyBatch, decided: DataFrame, scopes: dict[str, Column | None], p: Prepared) -> DataFrame:
    target = p.table(batch.entity)
    bad = [f"bad_{r.rule_id}" for r in batch.rules]
    failing = decided.where(F.greatest(*[F.coalesce(F.col(b), F.lit(False)) for b in bad])
                            if len(bad) > 1 else F.col(bad[0])).select(*batch.keys, "n_rows", *bad)
    rows = target.withColumns(dict(batch.keys))
    rows = rows_of_keys(rows, failing, list(batch.keys), "n_rows")
    flags = []
    for r in batch.rules:
        flag, scope = F.col(f"bad_{r.rule_id}"), scopes[r.rule_id]
        flags.append((r, flag if scope is None else flag & scope))
    return _listed(rows, batch.entity, _hits(flags, p), p)


def violation_examples(tables, rules: list[Rule], model: Model, as_of: dt.date, per_rule: int = 5) -> DataFrame:
    """(rule_id, entity, example_no, key, shown): the first failing rows of each rule by key."""
    return examples_of(violations(tables, rules, model, as_of), tables, rules, model, per_rule)


def examples_of(rows: DataFrame, tables, rules: list[Rule], model: Model, per_rule: int = 5) -> DataFrame:
    """The first of the listed rows of each rule, and of what its custom SQL returns."""
    spark = rows.sparkSession
    custom = [r for r in rules if r.type == "custom_sql"]
    with null_on_error(spark):
        for r in custom:
            try:
                found = custom_sql_rows(r.check["sql"], tables, spark)
            except Exception:  # noqa: BLE001 - reported by execute_rules
                continue
            pii = set(model.entity(r.entity).pii)
            pairs = [x for c in found.columns
                     for x in (F.lit(c), masked(c) if c in pii else F.col(c).cast("string"))]
            rows = rows.unionByName(found.select(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.entity).alias("entity"),
                F.lit(None).cast("string").alias("key"), F.create_map(*pairs).alias("shown")))
    order = Window.partitionBy("rule_id").orderBy(F.length("key"), "key", F.to_json("shown"))
    return (rows.withColumn("example_no", F.row_number().over(order)).where(F.col("example_no") <= per_rule)
            .select("rule_id", "entity", "example_no", "key", "shown"))
