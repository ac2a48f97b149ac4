"""Build a semantic model: attributes, relationships, hierarchies, entities - each a DataFrame."""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import vocab
from plumbline.functions.text import one_of
from plumbline.model import Attachment, Constraints, Entity, Hierarchy, Model, bare_names, entity_id
from plumbline.operators import inference as inf
from plumbline.operators import links as lk
from plumbline.operators.profiling import fk_orphans
from plumbline.plans.profile import profile_tables

HIERARCHIES = ("hierarchy_id string, name string, entity string, parent_attribute string, level_attribute string, "
               "levels array<string>, evidence array<string>, "
               "attached array<struct<entity:string,attribute:string,must_attach_at:string>>")
LINKS = ("table string, column string, parent string, parent_column string, kind string, confidence double, note string")


@dataclass
class SemanticModel:
    profiles: DataFrame
    attributes: DataFrame
    relationships: DataFrame
    hierarchies: DataFrame
    entities: DataFrame
    orphans: DataFrame
    rules_model: Model           # what rule execution needs
    counted: dict[tuple[str, str], DataFrame] = field(default_factory=dict)     # (table, column) -> its counted values, stored by the profile


def pinned(df: DataFrame) -> DataFrame:
    """A table with one row per column or entity, computed now. Without this every filter on a derived column
    would be pushed through, and copy, the whole scoring expression."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _names(tables) -> dict[str, dict[str, str]]:
    return {t: bare_names(tables[t].columns) for t in tables}


def attribute_facts(profiles: DataFrame, tables, links: list[lk.Link]) -> DataFrame:
    """Profile rows with what the links say about each column. Schema-sized facts travel as literals."""
    pairs = [(f"{t}.{c}", bare) for t, names in _names(tables).items() for c, bare in names.items()]
    bare = F.create_map(*[F.lit(x) for p in pairs for x in p])
    at = F.concat_ws(".", "table", "column")
    out = profiles.withColumn("bare_name", F.coalesce(bare[at], F.col("column")))
    targets = {f"{k.child}.{k.column}": k.parent for k in reversed(links)}
    target = F.lit(None).cast("string")
    if targets:
        target = F.create_map(*[F.lit(x) for p in targets.items() for x in p])[at]
    selfish = sorted({k.child for k in links if k.child == k.parent})
    return out.withColumns({
        "fk_target": target,
        "self_referencing": F.col("table").isin(*selfish) if selfish else F.lit(False)}).withColumn(
        "is_self_fk", F.coalesce(F.col("fk_target") == F.col("table"), F.lit(False)))


def attributes(facts: DataFrame) -> DataFrame:
    """One row per column: semantic type, role, pii, expected pattern, valid codes, observed range."""
    typed = pinned(inf.semantic_types(facts))
    coded = one_of("semantic_type", vocab.CODE_TYPES)
    ranged = one_of("semantic_type", vocab.NUMERIC_TYPES)
    split = typed.withColumn("_split", F.expr(f"CASE WHEN {coded} AND top_values IS NOT NULL THEN {inf.classify_values('top_values')} END"))
    return split.selectExpr(
        "entity_id", "table", "column", "ordinal", "generic_type",
        "concat(upper(left(column, 1)), lower(replace(substring(column, 2), '_', ' '))) AS name",
        "semantic_type", f"{inf.role('semantic_type')} AS role", "confidence", "reasons",
        f"{inf.pii('semantic_type', 'sensitive_hint', 'column')} AS pii", f"{inf.expected_pattern()} AS expected_pattern",
        "CASE WHEN size(_split.allowed) > 0 THEN _split.allowed END AS allowed_values",
        f"coalesce(_split.anomalies, CAST(array() AS {inf._ANOMALIES})) AS value_anomalies",
        f"CASE WHEN {ranged} THEN numeric.p01 END AS range_min", f"CASE WHEN {ranged} THEN numeric.p99 END AS range_max",
        "'heuristic' AS source", "false AS locked")


def relationships(links: list[lk.Link], profiles: DataFrame) -> DataFrame:
    """One row per link. A link is mandatory when at most 2 % of its values are missing."""
    spark = profiles.sparkSession
    ids = {t: entity_id(t) for x in links for t in (x.child, x.parent)}
    listed = spark.createDataFrame([(k.child, k.column, k.parent, k.parent_column, k.kind, float(k.confidence), k.note) for k in links], LINKS)
    eid = F.create_map(*[F.lit(x) for p in ids.items() for x in p]) if ids else F.create_map().cast("map<string,string>")
    child, parent = eid[F.col("table")], eid[F.col("parent")]
    selfish = F.col("table") == F.col("parent")

    def words(c):
        return F.regexp_replace(c, "_", " ")
    return listed.join(profiles.select("table", "column", "null_rate", "null_count"), ["table", "column"]).select(
        F.when(selfish, F.concat(child, F.lit("_parent"))).otherwise(F.concat(child, F.lit("_"), parent)).alias("relationship_id"),
        child.alias("from_entity"), F.col("column").alias("from_attribute"), parent.alias("to_entity"),
        F.col("parent_column").alias("to_attribute"), F.lit("many_to_one").alias("cardinality"),
        (~selfish & (F.col("null_rate") <= vocab.MANDATORY_NULL_RATE)).alias("mandatory"), "kind", "confidence",
        F.when(selfish, F.concat(F.lit("A "), words(child), F.lit("'s parent "), words(parent)))
        .otherwise(F.concat(F.lit("Each "), words(child), F.lit(" belongs to one "), words(parent))).alias("description"),
        "note", "table", "null_count")


def find_hierarchies(tables, links: list[lk.Link], constraints: Constraints, level_columns: dict[str, str]) -> list[tuple]:
    """Rows of HIERARCHIES for self-referencing tables with a level column."""
    rows = []
    for link in links:
        pk = constraints.pk(link.child)
        if link.child != link.parent or len(pk) != 1 or link.child not in level_columns:
            continue
        level, eid = level_columns[link.child], entity_id(link.child)
        counts = lk.level_counts(tables[link.child], pk[0], link.column, level)
        levels = lk.level_chain(counts)
        if levels is None:
            continue
        evidence = [f"{r['n']} {r['level']} row(s) {r['problem']}" for r in
                    lk.level_evidence(counts, levels).orderBy("level", "parent_level").collect()]
        attached = []
        for other in links:
            if other.parent == link.child and other.child != link.child:
                found = lk.attach_levels(tables[other.child], other.column, tables[link.child], pk[0], level).orderBy(F.desc("n")).collect()
                if found and found[0]["attached"]:
                    attached.append((entity_id(other.child), other.column, found[0]["level"]))
                    evidence += [f"{r['n']} {other.child} row(s) point to a {r['level']} instead of a {found[0]['level']}" for r in found[1:]]
        rows.append((f"{eid}_hierarchy", f"{eid.replace('_', ' ').capitalize()} hierarchy", eid, link.column, level, levels,
                     evidence, attached))
    return rows


def entity_types(attrs: DataFrame, rels: DataFrame, hierarchy_entities: list[str], row_counts: DataFrame) -> DataFrame:
    """(entity_id, table, row_count, entity_type, business_key) from what the attributes and links are."""
    flags = attrs.groupBy("entity_id", "table").agg(
        F.bool_or(F.col("semantic_type").isin("event_date", "event_timestamp")).alias("dated"),
        F.bool_or(F.col("semantic_type") == "amount").alias("amounts"),
        F.bool_or(F.col("semantic_type").isin("quantity", "amount")).alias("measured"),
        F.bool_and(F.col("semantic_type").isin(*vocab.CODE_TYPES, *vocab.KEY_TYPES, "label", "description")).alias("code_list"),
        F.min_by(F.when(F.col("semantic_type") == "business_key", F.col("column")),
                 F.when(F.col("semantic_type") == "business_key", F.col("ordinal"))).alias("business_key"))
    out = rels.where(F.col("from_entity") != F.col("to_entity")).select(F.col("from_entity").alias("entity_id"), "to_entity").distinct()
    known = (flags.join(row_counts, "table", "left")
             .join(out.groupBy("entity_id").agg(F.count(F.lit(1)).alias("outgoing")), "entity_id", "left")
             .withColumn("tree", F.col("entity_id").isin(*hierarchy_entities) if hierarchy_entities else F.lit(False))
             .withColumn("transaction", ~F.col("tree") & F.col("outgoing").isNotNull() & F.col("dated") & F.col("amounts")))
    lines = (out.join(known.where("transaction").select(F.col("entity_id").alias("to_entity")), "to_entity", "left_semi")
             .select("entity_id").distinct().withColumn("of_transaction", F.lit(True)))
    kind = (F.when(F.col("tree"), "hierarchy")
            .when(F.coalesce("of_transaction", F.lit(False)) & F.col("measured"), "transaction_line")
            .when(F.col("transaction"), "transaction")
            .when(F.col("outgoing").isNull() & (F.col("row_count") <= vocab.REFERENCE_ROWS) & F.col("code_list"), "reference")
            .otherwise("master"))
    return known.join(lines, "entity_id", "left").select("entity_id", "table", "row_count", kind.alias("entity_type"), "business_key")


def build_model(tables, as_of: dt.date, constraints: Constraints) -> SemanticModel:
    """Profile the tables and infer the whole model."""
    spark = SparkSession.active()
    counted: dict[tuple[str, str], DataFrame] = {}
    profiles = profile_tables(tables, as_of, constraints, kept=counted)
    inferred = lk.accepted(lk.infer_links(tables, constraints))
    links = lk.declared_links(constraints) + inferred
    ids = F.create_map(*[F.lit(x) for t in tables for x in (t, entity_id(t))])
    facts = attribute_facts(profiles, tables, links).withColumn("entity_id", ids[F.col("table")])
    attrs = pinned(attributes(facts))
    levels = {r["table"]: r["column"] for r in attrs.where(F.col("semantic_type") == "hierarchy_level")
              .groupBy("table").agg(F.min_by("column", "ordinal").alias("column")).collect()}
    trees = find_hierarchies(tables, links, constraints, levels)
    hierarchies = spark.createDataFrame(trees, HIERARCHIES)
    if trees:      # the level column's valid codes are exactly the levels
        fixed = F.lit(None).cast("array<string>")
        for _, _, eid, _, level, names, _, _ in trees:
            fixed = F.when((F.col("entity_id") == eid) & (F.col("column") == level), F.array(*[F.lit(n) for n in names])).otherwise(fixed)
        attrs = attrs.withColumn("allowed_values", F.coalesce(fixed, F.col("allowed_values")))
    rels = pinned(relationships(links, profiles))
    sizes = profiles.groupBy("table").agg(F.max("row_count").alias("row_count"))
    entities = pinned(entity_types(attrs, rels, [t[2] for t in trees], sizes))
    dated = attrs.where(F.col("semantic_type") == "event_date").groupBy("entity_id").agg(F.min_by("column", "ordinal").alias("first_date"))
    analysed_by = entities.where(F.col("entity_type") == "transaction").join(dated, "entity_id").select("entity_id", "first_date")
    attrs = attrs.join(F.broadcast(analysed_by), "entity_id", "left").withColumn(
        "role", F.when(F.col("column") == F.col("first_date"), "dimension").otherwise(F.col("role"))).drop("first_date")
    attrs = pinned(attrs)
    personal: dict[str, list[str]] = {}
    for r in attrs.where("pii").select("table", "column").collect():
        personal.setdefault(r["table"], []).append(r["column"])
    rules_model = Model(
        {entity_id(t): Entity(entity_id(t), t, constraints.pk(t), tuple(personal.get(t, ()))) for t in tables},
        {h[0]: Hierarchy(h[0], h[2], h[3], h[4], tuple(h[5]), tuple(Attachment(*a) for a in h[7])) for h in trees})
    known = Constraints(constraints.primary_keys, tuple(k for k in constraints.foreign_keys if k[0] in tables and k[2] in tables))
    return SemanticModel(profiles, attrs, rels, hierarchies, entities, fk_orphans(tables, known, counted), rules_model, counted)


def needs_review(attrs: DataFrame) -> DataFrame:
    return attrs.where((F.col("confidence") < vocab.REVIEW_BELOW) & ~F.col("locked")).select(
        "entity_id", "column", "semantic_type", "confidence")
