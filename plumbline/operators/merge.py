"""Versions of a semantic model: drift, merging with the previous version, outside proposals, integrity.

An attribute row has: table, column, name, description, semantic_type, role, confidence, source, note, locked, pii,
allowed_values (array), anomalies (array of values). Keys are unique per version, so the joins cannot fan out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import vocab
from plumbline.functions.skew import rows_of_keys
from plumbline.functions.text import one_of
from plumbline.operators.inference import role


def schema_drift(new: DataFrame, old: DataFrame) -> DataFrame:
    """(change, table, column): tables and columns that came or went. Columns of a new or lost table are not listed."""
    n, o = new.select("table", "column").distinct(), old.select("table", "column").distinct()
    tables = (n.select("table").distinct().withColumn("is_new", F.lit(True))
              .join(o.select("table").distinct().withColumn("is_old", F.lit(True)), "table", "full_outer"))
    moved = tables.where("is_new IS NULL OR is_old IS NULL").select(
        F.when(F.col("is_new").isNull(), "table removed").otherwise("table added").alias("change"), "table",
        F.lit(None).cast("string").alias("column"))
    kept = tables.where("is_new AND is_old").select("table")
    columns = (n.withColumn("is_new", F.lit(True)).join(o.withColumn("is_old", F.lit(True)), ["table", "column"], "full_outer")
               .where("is_new IS NULL OR is_old IS NULL").join(kept, "table", "left_semi"))
    return moved.unionByName(columns.select(
        F.when(F.col("is_new").isNull(), "column removed").otherwise("column added").alias("change"), "table", "column"))


def merge_attributes(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new version's attributes with what must survive from the previous one.

    A locked row wins whole. Otherwise: earlier text stays where the build wrote none; earlier verdicts on values stay
    while the observed values are the same; an uncertain type keeps the earlier settled one; PII is never dropped.
    """
    rest = [c for c in new.columns if c not in ("table", "column")]
    joined = (new.select("table", "column", F.struct(*rest).alias("n"))
              .join(old.select("table", "column", F.struct(*rest).alias("o")), ["table", "column"], "left"))
    same_values = ("o.allowed_values IS NOT NULL AND array_sort(array_distinct(concat(coalesce(n.allowed_values, array()), n.anomalies))) "
                   "= array_sort(array_distinct(concat(o.allowed_values, o.anomalies)))")
    uncertain = f"n.source = 'heuristic' AND n.confidence < {vocab.REVIEW_BELOW}"
    settled = f"{uncertain} AND o.source = 'llm'"
    confirmed = f"{uncertain} AND o.semantic_type = n.semantic_type AND o.confidence > n.confidence"
    no_text = "n.description IS NULL"
    keep = {"name": no_text, "description": no_text, "allowed_values": same_values, "anomalies": same_values,
            "semantic_type": settled, "role": settled}
    keep |= {c: f"({settled}) OR ({confirmed})" for c in ("confidence", "source", "note")}
    fields = []
    for c in rest:
        if c == "pii":
            value = "CASE WHEN o.locked THEN o.pii ELSE n.pii OR coalesce(o.pii, false) END"
        elif c == "locked":
            value = "CASE WHEN o.locked THEN true ELSE n.locked END"
        else:
            value = f"CASE WHEN o IS NOT NULL AND (o.locked OR coalesce({keep.get(c, 'false')}, false)) THEN o.{c} ELSE n.{c} END"
        fields.append(f"{value} AS {c}")
    return joined.selectExpr("table", "column", *fields, "coalesce(o.locked, false) AS kept_locked")


def merge_entities(new: DataFrame, old: DataFrame) -> DataFrame:
    """Entities by table: a locked one keeps all it was called, an enriched one its texts."""
    rest = [c for c in new.columns if c != "table"]
    texts = ("name", "description", "grain", "source", "confidence")
    joined = new.select("table", F.struct(*rest).alias("n")).join(old.select("table", F.struct(*rest).alias("o")), "table", "left")
    enriched = "n.source = 'heuristic' AND o.source <> 'heuristic'"
    return joined.selectExpr("table", *[
        f"CASE WHEN coalesce(o.locked, false){f' OR coalesce({enriched}, false)' if c in texts else ''} THEN o.{c} ELSE n.{c} END AS {c}"
        for c in rest])


def merge_locked(new: DataFrame, old: DataFrame, key: str, references: list[str], entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, dropped): locked relationships or hierarchies stay as they were, if their entities still exist."""
    locked = old.where("locked")
    lost = locked.select(key, F.explode(F.array(*references)).alias("entity_id")).where("entity_id IS NOT NULL").join(
        entities.select("entity_id"), "entity_id", "left_anti").select(key).distinct()
    kept = locked.join(lost, key, "left_anti")
    return new.join(kept.select(key), key, "left_anti").unionByName(kept), locked.join(lost, key, "left_semi").select(key)


def apply_proposals(attributes: DataFrame, proposals: DataFrame) -> DataFrame:
    """Attributes after outside suggestions (entity_id, column, name, description, semantic_type, reason, pii), with ``change``.

    A type changes only where the own confidence is low; the same type confirms it; PII can only be switched on; a
    locked attribute takes nothing.
    """
    fields = [c for c in attributes.columns if c not in ("entity_id", "column")]
    p = proposals.select("entity_id", "column", F.struct(*[c for c in proposals.columns if c not in ("entity_id", "column")]).alias("p"))
    joined = attributes.select("entity_id", "column", F.struct(*fields).alias("a")).join(p, ["entity_id", "column"], "left")
    open_ = "(p IS NOT NULL AND NOT a.locked)"
    low = f"a.confidence < {vocab.REVIEW_BELOW}"
    other = f"coalesce({open_} AND p.semantic_type <> a.semantic_type, false)"
    changed, confirmed = f"({other} AND {low})", f"(coalesce({open_} AND p.semantic_type = a.semantic_type, false) AND {low})"
    flagged = f"(coalesce({open_} AND p.pii, false) AND NOT a.pii)"
    own = {
        "name": f"CASE WHEN {open_} THEN coalesce(p.name, a.name) ELSE a.name END",
        "description": f"CASE WHEN {open_} THEN coalesce(p.description, a.description) ELSE a.description END",
        "semantic_type": f"CASE WHEN {changed} THEN p.semantic_type ELSE a.semantic_type END",
        "role": f"CASE WHEN {changed} THEN {role('p.semantic_type')} ELSE a.role END",
        "pii": f"a.pii OR {flagged} OR ({changed} AND {one_of('p.semantic_type', vocab.PII_TYPES)})",
        "confidence": f"CASE WHEN {changed} THEN 0.8D WHEN {confirmed} THEN {vocab.REVIEW_BELOW}D ELSE a.confidence END",
        "source": f"CASE WHEN {changed} THEN 'llm' ELSE a.source END",
    }
    change = (f"concat_ws('; ', CASE WHEN {changed} THEN concat('semantic_type ', a.semantic_type, ' -> ', p.semantic_type, ' (', "
              f"coalesce(p.reason, 'no reason given'), ')') WHEN {other} THEN concat('suggested ', p.semantic_type, ', kept ', a.semantic_type) END, "
              f"CASE WHEN {flagged} THEN 'flagged as PII' END)")
    return joined.selectExpr("entity_id", "column", *[f"{own.get(c, f'a.{c}')} AS {c}" for c in fields], f"nullif({change}, '') AS change")


def apply_verdicts(attributes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Move values between allowed_values and anomalies (arrays) as judged: entity_id, column, value, verdict.

    'valid' accepts an anomaly, 'variant' and 'invalid' reject an allowed value; a list is never emptied. Verdicts meet the
    listed values one by one, so what is gathered for an attribute is never more than its own lists, however many values were judged.
    """
    keys = ["entity_id", "column"]
    listed = (attributes.where(~F.col("locked") & F.col("allowed_values").isNotNull())
              .select(*keys, F.explode(F.concat("allowed_values", F.coalesce("anomalies", F.array().cast("array<string>")))).alias("value")).distinct())
    judged = verdicts.join(listed, [*keys, "value"], "left_semi").groupBy(*keys).agg(
        F.collect_set(F.when(F.col("verdict") == "valid", F.col("value"))).alias("good"),
        F.collect_set(F.when(F.col("verdict").isin("variant", "invalid"), F.col("value"))).alias("bad"))
    out = attributes.join(judged, keys, "left")
    takes = "(good IS NOT NULL AND NOT locked AND allowed_values IS NOT NULL)"
    accepted, refused = "array_sort(array_intersect(good, anomalies))", "array_sort(array_intersect(bad, allowed_values))"
    left = f"concat(array_except(allowed_values, {refused}), {accepted})"
    return out.withColumns({
        "_allowed": F.expr(f"CASE WHEN {takes} AND size({left}) > 0 THEN {left} ELSE allowed_values END"),
        "_anomalies": F.expr(f"CASE WHEN {takes} THEN concat(array_except(anomalies, {accepted}), {refused}) ELSE anomalies END")}).drop(
        "allowed_values", "anomalies", "good", "bad").withColumnsRenamed({"_allowed": "allowed_values", "_anomalies": "anomalies"})


def dangling_references(entities: DataFrame, attributes: DataFrame, references: DataFrame) -> DataFrame:
    """(place, entity_id, column, problem): references (place, entity_id, column) to what the model does not have."""
    known = entities.select("entity_id").distinct().withColumn("entity_known", F.lit(True))
    have = attributes.select("entity_id", "column").distinct().withColumn("column_known", F.lit(True))
    wanted = references.distinct()
    pairs = wanted.groupBy("entity_id", "column").agg(F.count(F.lit(1)).alias("_rows"))
    problem = (F.when(F.col("entity_known").isNull(), "unknown entity")
               .when(F.col("column").isNotNull() & F.col("column_known").isNull(), "unknown attribute"))
    bad = (pairs.join(known, "entity_id", "left").join(have, ["entity_id", "column"], "left")
           .select("entity_id", "column", "_rows", problem.alias("problem")).where("problem IS NOT NULL"))
    return rows_of_keys(wanted, bad, ["entity_id", "column"], "_rows").select("place", "entity_id", "column", "problem")
