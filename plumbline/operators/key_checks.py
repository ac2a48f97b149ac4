"""Checks that need more than the row: other rows of the table, another table, or a tree.

Each of them depends on a few columns of the target row only (the "decision key"). So the rows are first
counted per decision key - with map-side partial counts, a key that holds a third of the table becomes one
row - and then every key is decided once. Rules with the same key share the count.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import rule_expression
from plumbline.functions.skew import rows_of_keys
from plumbline.functions.text import ident, q
from plumbline.model import Model
from plumbline.operators.profiling import count_name
from plumbline.rules import Rule

KEY_CHECKS = ("unique", "foreign_key", "has_children", "aggregate_compare", "hierarchy_parent_level",
              "hierarchy_attach_level")
Counted = dict[tuple[str, str], DataFrame]           # (table, column) -> its values, each once, and how often each occurs


@dataclass
class KeyBatch:
    """Rules of one entity that share a decision key."""
    entity: str
    keys: dict[str, Column]                              # name -> expression over the target table
    rules: list[Rule]
    decide: Callable[[DataFrame], DataFrame]             # adds one boolean `bad_<i>` per rule
    one_row_per_key: bool = False                        # the key covers the declared primary key
    column: str | None = None                            # the key is this column of the table, as it is


def _only(columns: tuple[str, ...]) -> str | None:
    return columns[0] if len(columns) == 1 else None


def _all_present(names: list[str]) -> Column:
    present = F.lit(True)
    for n in names:
        present = present & F.col(n).isNotNull()
    return present


def _join_on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    cond = None
    for a, b in pairs:
        part = left[a] == right[b]
        cond = part if cond is None else cond & part
    return cond


def _unique(rules: list[Rule], names: list[str]) -> Callable[[DataFrame], DataFrame]:
    def decide(groups: DataFrame) -> DataFrame:
        bad = _all_present(names) & (F.col("n_rows") > 1)
        return groups.withColumns({f"bad_{r.rule_id}": bad for r in rules})
    return decide


def _reference(rule: Rule, names: list[str], model: Model, tables, counted: Counted) -> Callable[[DataFrame], DataFrame]:
    ref_cols = list(rule.check["ref_columns"])
    ref_table = model.entity(rule.check["ref_entity"]).table
    ref = tables[ref_table]
    known = counted.get((ref_table, ref_cols[0])) if len(ref_cols) == 1 else None

    def decide(groups: DataFrame) -> DataFrame:
        if known is not None:
            parents = known.select(F.col(ident(ref_cols[0])).alias("_p0")).dropna()
        else:
            parents = ref.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(ref_cols)]).dropna().distinct()
        parents = parents.withColumn("_found", F.lit(True))
        cond = _join_on(groups, parents, [(n, f"_p{i}") for i, n in enumerate(names)])
        joined = groups.join(parents, cond, "left")
        bad = _all_present(names) & F.col("_found").isNull()
        return joined.withColumn(f"bad_{rule.rule_id}", bad).drop("_found", *[f"_p{i}" for i in range(len(names))])
    return decide


def _children(rules: list[Rule], names: list[str], parents: dict[str, str], model: Model, tables,
              split: bool) -> Callable[[DataFrame], DataFrame]:
    """has_children and aggregate_compare over one child table: one aggregate of it answers them all.

    ``split``: a join key can come with many parent values (it is not the primary key), so heavy join keys are cut by weight.
    """
    first = rules[0].check
    child = tables[model.entity(first["child_entity"]).table]
    child_cols = list(first["child_join_columns"])
    spark = child.sparkSession
    measures = [F.count(F.lit(1)).alias("_n")]
    for r in rules:
        if r.type == "aggregate_compare":
            measures.append(rule_expression(spark, r.check["child_expression"], set(child.columns), aggregate=True)
                            .alias(f"_agg_{r.rule_id}"))

    def decide(groups: DataFrame) -> DataFrame:
        agg = child.groupBy(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(child_cols)]).agg(*measures)
        pairs = [(n, f"_c{i}") for i, n in enumerate(names)]
        if split:
            keyed = groups.groupBy(*names).agg(F.count(F.lit(1)).alias("_weight"))
            keyed = keyed.join(agg, _join_on(keyed, agg, pairs), "left").drop(*[c for _, c in pairs])
            out = rows_of_keys(groups, keyed, names, "_weight").drop("_weight")
        else:
            out = groups.join(agg, _join_on(groups, agg, pairs), "left")
        for r in rules:
            if r.type == "has_children":
                bad = F.coalesce(F.col("_n"), F.lit(0)) < r.param("min_children", 1)
            else:
                left, right = F.col(parents[r.rule_id]), F.col(f"_agg_{r.rule_id}")
                op = r.check["operator"]
                bad = {"=": F.abs(left - right) > r.param("tolerance_abs", 0.0), "<>": ~(left != right),
                       "<": ~(left < right), "<=": ~(left <= right), ">": ~(left > right),
                       ">=": ~(left >= right)}[op]
            out = out.withColumn(f"bad_{r.rule_id}", bad)
        return out.drop("_n", *[f"_c{i}" for i in range(len(names))], *[m for m in out.columns if m.startswith("_agg_")])
    return decide


def _nodes(model: Model, hierarchy_id: str, tables) -> DataFrame:
    """One row per tree node: (_node, _level). Among rows that repeat a key the smallest level stands."""
    h = model.hierarchy(hierarchy_id)
    node = model.entity(h.entity)
    return (tables[node.table].where(F.col(node.primary_key[0]).isNotNull())
            .groupBy(F.col(node.primary_key[0]).alias("_node"))
            .agg(F.min(h.level).alias("_level"), F.lit(True).alias("_found")))


def _parent_level(rule: Rule, parent: str, level: str, model: Model, tables) -> Callable[[DataFrame], DataFrame]:
    levels = list(model.hierarchy(rule.check["hierarchy"]).levels)

    def decide(groups: DataFrame) -> DataFrame:
        nodes = _nodes(model, rule.check["hierarchy"], tables)
        out = groups.join(nodes, groups[parent] == nodes["_node"], "left")
        lv, pl = F.col(level), F.col("_level")
        wanted = F.element_at(F.create_map(*[F.lit(x) for i in range(1, len(levels))
                                             for x in (levels[i], levels[i - 1])]), lv)
        bad = (F.when(lv.isNull() | ~lv.isin(levels), True)
               .when(lv == levels[0], F.col(parent).isNotNull())
               .otherwise(F.coalesce(pl != wanted, F.lit(True))))
        return out.withColumn(f"bad_{rule.rule_id}", bad).drop("_node", "_level", "_found")
    return decide


def _attach_level(rule: Rule, name: str, model: Model, tables) -> Callable[[DataFrame], DataFrame]:
    def decide(groups: DataFrame) -> DataFrame:
        nodes = _nodes(model, rule.check["hierarchy"], tables)
        out = groups.join(nodes, groups[name] == nodes["_node"], "left")
        return (out.withColumn(f"bad_{rule.rule_id}", F.coalesce(F.col("_level") != rule.check["level"], F.lit(False)))
                .drop("_node", "_level", "_found"))
    return decide


def key_batches(rules: list[Rule], model: Model, tables, counted: Counted | None = None) -> list[KeyBatch]:
    """Group rules by entity and decision key. ``tables`` maps table name -> DataFrame."""
    counted = counted or {}
    batches: dict[tuple, list[Rule]] = {}
    for r in rules:
        if r.type in ("has_children", "aggregate_compare"):
            sig = (r.entity, "children", r.check["child_entity"], tuple(r.check["child_join_columns"]),
                   tuple(r.check["parent_join_columns"]))
        elif r.type == "unique":
            sig = (r.entity, "unique", tuple(sorted(r.columns)))
        else:
            sig = (r.entity, r.type, r.rule_id)
        batches.setdefault(sig, []).append(r)

    out = []
    for sig, group in batches.items():
        rule = group[0]
        entity = model.entity(rule.entity)
        target = tables[entity.table]
        pk = set(entity.primary_key)
        if sig[1] == "unique":
            names = [f"k{i}" for i in range(len(rule.columns))]
            keys = {n: F.col(c) for n, c in zip(names, sorted(rule.columns))}
            out.append(KeyBatch(rule.entity, keys, group, _unique(group, names), column=_only(rule.columns)))
        elif sig[1] == "children":
            cols = list(rule.check["parent_join_columns"])
            if len(cols) != len(rule.check["child_join_columns"]):
                raise ValueError("child_join_columns and parent_join_columns must pair 1:1")
            names = [f"k{i}" for i in range(len(cols))]
            keys = {n: F.col(c) for n, c in zip(names, cols)}
            parents = {}
            for r in group:
                if r.type == "aggregate_compare":
                    parents[r.rule_id] = f"p_{r.rule_id}"
                    keys[f"p_{r.rule_id}"] = rule_expression(target.sparkSession, r.check["parent_expression"],
                                                             set(target.columns))
            covered = bool(pk) and pk <= set(cols)
            out.append(KeyBatch(rule.entity, keys, group, _children(group, names, parents, model, tables, bool(parents) and not covered),
                                one_row_per_key=covered))
        elif rule.type == "foreign_key":
            if len(rule.check["ref_columns"]) != len(rule.columns):
                raise ValueError("foreign_key: ref_columns must pair 1:1 with target columns")
            names = [f"k{i}" for i in range(len(rule.columns))]
            keys = {n: F.col(c) for n, c in zip(names, rule.columns)}
            out.append(KeyBatch(rule.entity, keys, group, _reference(rule, names, model, tables, counted), column=_only(rule.columns)))
        elif rule.type == "hierarchy_parent_level":
            h = model.hierarchy(rule.check["hierarchy"])
            keys = {"k0": F.col(h.parent), "k1": F.col(h.level)}
            out.append(KeyBatch(rule.entity, keys, group, _parent_level(rule, "k0", "k1", model, tables)))
        elif rule.type == "hierarchy_attach_level":
            out.append(KeyBatch(rule.entity, {"k0": F.col(rule.columns[0])}, group, _attach_level(rule, "k0", model, tables),
                                column=rule.columns[0]))
    return out


def count_keys_together(batches: list[KeyBatch], target: DataFrame, scopes: list[dict[str, Column | None]]) -> DataFrame:
    """The decision keys of several batches of one entity, counted in one scan: a grouping set for each batch.

    Columns: ``batch`` (its place in the list), ``b<i>_<key>`` for every key of every batch, ``n_rows`` and ``n_<rule>`` for rules with a scope.
    """
    names = [[f"b{i}_{n}" for n in b.keys] for i, b in enumerate(batches)]
    scoped = {r: s for some in scopes for r, s in some.items() if s is not None}
    picked = target.select(*[e.alias(name) for b, own in zip(batches, names) for name, e in zip(own, b.keys.values())],
                           *[s.alias(f"in_{r}") for r, s in scoped.items()])
    every = [name for own in names for name in own]
    # grouping_id() has a 1 for each column outside the set, the first column as the highest bit
    ids = [sum(1 << (len(every) - 1 - at) for at, name in enumerate(every) if name not in own) for own in names]
    batch = F.coalesce(*[F.when(F.col("_set") == i, F.lit(n)) for n, i in enumerate(ids)])
    counted = picked.groupingSets(names, *every).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n_rows"),
                                                     *[F.count_if(f"in_{r}").alias(f"n_{r}") for r in scoped])
    return counted.withColumn("batch", batch).drop("_set")


def keys_of_batch(counted: DataFrame, place: int, batch: KeyBatch, scopes: dict[str, Column | None]) -> DataFrame:
    """The rows of one batch as ``count_keys`` gives them."""
    return counted.where(F.col("batch") == place).select(*[F.col(f"b{place}_{n}").alias(n) for n in batch.keys], "n_rows",
                                                         *[f"n_{r}" for r, s in scopes.items() if s is not None])


def count_keys(batch: KeyBatch, target: DataFrame, scopes: dict[str, Column | None], values: DataFrame | None = None) -> DataFrame:
    """Decision keys with n_rows and, for rules with a scope, n_<rule>. ``values``: the counted values of the batch's column, if there are any."""
    scoped = {r: s for r, s in scopes.items() if s is not None}
    if values is not None and not scoped:
        return values.select(*[F.col(ident(batch.column)).alias(n) for n in batch.keys], F.col(ident(count_name(batch.column))).alias("n_rows"))
    picked = target.select(*[e.alias(n) for n, e in batch.keys.items()],
                           *[s.alias(f"in_{r}") for r, s in scoped.items()])
    if batch.one_row_per_key:
        return picked.select(*batch.keys, F.lit(1).cast("bigint").alias("n_rows"),
                             *[F.col(f"in_{r}").cast("bigint").alias(f"n_{r}") for r in scoped])
    return picked.groupBy(*batch.keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                           *[F.count_if(f"in_{r}").alias(f"n_{r}") for r in scoped])


def batch_totals(batch: KeyBatch, decided: DataFrame, scopes: dict[str, Column | None]) -> DataFrame:
    """(rule_id, total, failed) of every rule of the batch from its decided keys."""
    sums, rows = [], []
    for i, r in enumerate(batch.rules):
        n = "n_rows" if scopes[r.rule_id] is None else f"`n_{r.rule_id}`"
        sums += [f"sum({n}) AS t{i}", f"sum(CASE WHEN `bad_{r.rule_id}` THEN {n} END) AS f{i}"]
        rows.append(f"struct({q(r.rule_id)} AS rule_id, coalesce(t{i}, 0L) AS total, coalesce(f{i}, 0L) AS failed)")
    return decided.selectExpr(*sums).selectExpr(f"inline(array({', '.join(rows)}))")
