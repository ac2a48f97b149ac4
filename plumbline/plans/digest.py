"""Compact text about an entity: aggregates, valid codes, shapes and masked examples - never raw personal data."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.semantic import SemanticModel, pinned


def _share(c: str) -> str:
    return f"concat(CASE WHEN {c} >= 0.001 OR {c} = 0 THEN format_number({c} * 100, 1) ELSE format_number({c} * 100, 2) END, '%')"


def attribute_lines(model: SemanticModel) -> DataFrame:
    """(entity_id, ordinal, line): what is known about each attribute."""
    joined = model.attributes.join(model.profiles.drop("ordinal", "generic_type"), ["table", "column"])
    closed = "allowed_values IS NOT NULL"
    parts = [
        "concat('- ', column, ' (', generic_type, ', ', semantic_type, ', ', role, CASE WHEN pii THEN ', PII)' ELSE ')' END)",
        f"concat('nulls ', {_share('null_rate')}, ', distinct ', format_number(distinct_count, 0), "
        "CASE WHEN uniqueness >= 0.95 THEN concat(', uniqueness ', format_number(uniqueness, 4)) ELSE '' END)",
        f"CASE WHEN {closed} THEN concat('valid values: ', array_join(allowed_values, ', ')) END",
        "CASE WHEN size(value_anomalies) > 0 THEN concat('anomalies: ', array_join(transform(value_anomalies, v -> concat('\\'', v.value, '\\' x', v.count, "
        "CASE WHEN v.looks_like IS NOT NULL THEN concat(' (looks like \\'', v.looks_like, '\\')') ELSE '' END)), ', ')) END",
        "CASE WHEN numeric.min IS NOT NULL THEN concat('range ', numeric.min, '..', numeric.max, ', p01 ', numeric.p01, ', median ', numeric.median, "
        "', p99 ', numeric.p99, ', ', numeric.negative_count, ' negative, ', numeric.zero_count, ' zero') END",
        "CASE WHEN date.min IS NOT NULL THEN concat('dates ', date.min, '..', date.max, ', ', date.future_count, ' future, ', date.placeholder_count, ' placeholder') END",
        f"CASE WHEN size(patterns) > 0 AND NOT {closed} THEN concat('shapes ', array_join(transform(slice(patterns, 1, 3), p -> concat(p.pattern, ' ', {_share('p.share')})), ', ')) END",
        f"CASE WHEN size(examples) > 0 AND NOT {closed} THEN concat('e.g. ', array_join(slice(examples, 1, 2), ', ')) END",
        "CASE WHEN expected_pattern IS NOT NULL THEN concat('expected pattern ', expected_pattern) END"]
    return joined.selectExpr("entity_id", "ordinal", f"concat_ws(' | ', {', '.join(parts)}) AS line")


def entity_digest(model: SemanticModel) -> DataFrame:
    """(entity_id, digest): header, attributes, relationships and hierarchies of one entity as text."""
    head = model.entities.selectExpr(
        "entity_id", "0 AS section", "0 AS place",
        "concat('ENTITY ', entity_id, ' (table ', table, ', ', format_number(row_count, 0), ' rows, ', entity_type, '), business key: ', coalesce(business_key, '-')) AS line")
    attributes = attribute_lines(model).selectExpr("entity_id", "1 AS section", "ordinal AS place", "line")
    orphans = pinned(model.orphans).selectExpr("table", "columns AS from_attribute", "orphans")
    links = model.relationships.join(orphans, ["table", "from_attribute"], "left")
    outgoing = links.selectExpr(
        "from_entity AS entity_id", "2 AS section", "0 AS place",
        "concat('- ', from_entity, '.', from_attribute, ' -> ', to_entity, '.', to_attribute, ' (', CASE WHEN mandatory THEN 'mandatory' ELSE 'optional' END, "
        "CASE WHEN orphans IS NOT NULL THEN concat(', ', orphans, ' orphan rows') ELSE '' END, '): ', description) AS line")
    incoming = links.where("from_entity <> to_entity").selectExpr(
        "to_entity AS entity_id", "3 AS section", "0 AS place",
        "concat('- ', from_entity, '.', from_attribute, ' -> ', to_entity, ' (child rows): ', description) AS line")
    trees = model.hierarchies.selectExpr(
        "entity AS entity_id", "4 AS section", "0 AS place",
        "concat('- ', hierarchy_id, ': ', array_join(levels, ' > '), ' via ', parent_attribute, ', level column ', level_attribute, "
        "CASE WHEN size(evidence) > 0 THEN concat('; observed: ', array_join(evidence, '; ')) ELSE '' END) AS line")
    lines = head.unionByName(attributes).unionByName(outgoing).unionByName(incoming).unionByName(trees)
    ordered = F.array_sort(F.collect_list(F.struct("section", "place", "line")))
    return lines.groupBy("entity_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("digest"))
