"""How tables relate: foreign keys found by name and value overlap, tree levels, where rows attach to a tree."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline import vocab
from plumbline.functions.skew import cut_lineage
from plumbline.model import Constraints, bare_names, singular
from plumbline.sources.inventory import generic_type


@dataclass(frozen=True)
class Link:
    child: str
    column: str
    parent: str
    parent_column: str
    kind: str = "declared"
    confidence: float = 1.0
    note: str = ""


def declared_links(constraints: Constraints) -> list[Link]:
    return [Link(t, c[0], rt, rc[0]) for t, c, rt, rc in constraints.foreign_keys if len(c) == 1]


def link_candidates(tables, constraints: Constraints) -> list[Link]:
    """Column pairs whose names suggest a link. Works on schemas only."""
    known = {(t, c) for t, cols, _, _ in constraints.foreign_keys for c in cols}
    names = {t: bare_names(tables[t].columns) for t in tables}
    kinds = {t: {f.name: generic_type(f.dataType) for f in tables[t].schema.fields} for t in tables}
    out = []
    for child in sorted(tables):
        for parent in sorted(tables):
            pk = constraints.pk(parent)
            if len(pk) != 1:
                continue
            key, stem = names[parent][pk[0]].lower(), singular(parent)
            wanted = {key, f"{stem}_{key}", f"{stem}_id"}
            for column, bare in names[child].items():
                bare = bare.lower()
                if column in constraints.pk(child) or (child, column) in known or (child == parent and bare == key):
                    continue
                short = bare[:-3] if bare.endswith("_id") else ""
                abbreviated = len(short) >= 3 and len(stem) >= 3 and stem.startswith(short)
                pair = {kinds[child][column], kinds[parent][pk[0]]}
                if (bare in wanted or abbreviated) and (len(pair) == 1 or pair <= {"integer", "decimal"}):
                    out.append(Link(child, column, parent, pk[0], "inferred"))
    return out


def _key_text(df: DataFrame, column: str) -> Column:
    c = F.col(column).cast("string")
    return F.regexp_replace(c, r"\.0+$", "") if isinstance(df.schema[column].dataType, T.DecimalType) else c


def containment(tables, candidates: list[Link]) -> DataFrame:
    """(position, total, matched): distinct child values and how many exist in the parent, for all candidates at once.

    Child values are made distinct first (partial aggregates), then one join answers every candidate.
    """
    by_child: dict[str, list[str]] = {}
    for link in candidates:
        by_child.setdefault(link.child, [])
        if link.column not in by_child[link.child]:
            by_child[link.child].append(link.column)
    children = None
    for child, columns in by_child.items():
        df = tables[child]
        one = df.select(F.inline(F.array(*[F.struct(F.lit(f"{child}.{c}").alias("from"), _key_text(df, c).alias("value"))
                                           for c in columns])))
        children = one if children is None else children.unionByName(one)
    parents = None
    for parent, pk in dict.fromkeys((x.parent, x.parent_column) for x in candidates):
        one = tables[parent].select(F.lit(parent).alias("parent"), _key_text(tables[parent], pk).alias("value"))
        parents = one if parents is None else parents.unionByName(one)
    targets: dict[str, list[tuple[int, str]]] = {}
    for i, link in enumerate(candidates):
        targets.setdefault(f"{link.child}.{link.column}", []).append((i, link.parent))
    wanted = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(p).alias("parent")) for i, p in v]))])
    values = (children.where(F.col("value").isNotNull()).groupBy("from", "value").agg(F.lit(1).alias("one"))
              .select("value", F.inline(wanted[F.col("from")])))
    known = parents.where(F.col("value").isNotNull()).groupBy("parent", "value").agg(F.lit(True).alias("found"))
    return (values.join(known, ["parent", "value"], "left").groupBy("position")
            .agg(F.count(F.lit(1)).alias("total"), F.count("found").alias("matched")))


def infer_links(tables, constraints: Constraints) -> DataFrame:
    """(table, column, parent, parent_column, total, matched, containment, confidence): accepted links.

    At least 90 % of two or more distinct values must exist in the parent; the first parent of a column wins.
    """
    candidates = link_candidates(tables, constraints)
    spark = next(iter(tables.values())).sparkSession
    if not candidates:
        return spark.createDataFrame([], "table string, column string, parent string, parent_column string, total bigint, "
                                         "matched bigint, containment double, confidence double")
    facts = F.create_map(*[x for i, k in enumerate(candidates) for x in (F.lit(i), F.struct(
        F.lit(k.child).alias("table"), F.lit(k.column).alias("column"), F.lit(k.parent).alias("parent"),
        F.lit(k.parent_column).alias("parent_column")))])
    share = F.col("matched") / F.col("total")
    good = containment(tables, candidates).where((F.col("total") >= 2) & (share >= vocab.CONTAINMENT))
    first = good.withColumn("fact", facts[F.col("position")]).groupBy("fact.table", "fact.column").agg(
        F.min_by(F.struct("fact.parent", "fact.parent_column", "total", "matched"), "position").alias("best"))
    return first.select("table", "column", "best.*").withColumns({
        "containment": F.round(share, 6), "confidence": F.round(F.lit(0.9) * share, 2)})


def accepted(inferred: DataFrame) -> list[Link]:
    """Inferred links as objects: never more than the schema has columns."""
    return [Link(r["table"], r["column"], r["parent"], r["parent_column"], "inferred", r["confidence"],
                 f"name match; {r['containment'] * 100:.1f}% of {r['total']:,} distinct values exist in {r['parent']}.{r['parent_column']}")
            for r in inferred.orderBy("table", "column").collect()]


# ---- trees ----------------------------------------------------------------------------------------
def level_counts(nodes: DataFrame, key: str, parent: str, level: str) -> DataFrame:
    """(level, parent_level, n): rows per level and level of their parent, __root__ or __missing__."""
    grouped = (nodes.where(F.col(level).isNotNull()).groupBy(F.col(parent).alias("parent"), F.col(level).cast("string").alias("level"))
               .agg(F.count(F.lit(1)).alias("n")))
    known = nodes.groupBy(F.col(key).alias("node")).agg(F.min(F.col(level).cast("string")).alias("node_level"))
    joined = grouped.join(known, grouped["parent"] == known["node"], "left")
    above = F.when(F.col("parent").isNull(), vocab.ROOT).otherwise(F.coalesce("node_level", F.lit(vocab.MISSING)))
    return joined.groupBy("level", above.alias("parent_level")).agg(F.sum("n").alias("n"))


def level_chain(counts: DataFrame) -> list[str] | None:
    """Top-to-leaf levels, or None if the table is no hierarchy. Each step is a lookup that returns two rows at most, so the
    number of levels is not limited and the driver holds only the chain."""
    total = counts.groupBy("level").agg(F.sum("n").alias("total"))
    mostly = cut_lineage(counts.join(total, "level").where(F.col("n") / F.col("total") >= vocab.LEVEL_LINK_SHARE).select("level", "parent_level"))

    def mostly_under(above: str, taken: list[str]) -> list[str]:
        return [r["level"] for r in mostly.where((F.col("parent_level") == above) & ~F.col("level").isin(taken)).limit(2).collect()]

    chain: list[str] = []
    found = mostly_under(vocab.ROOT, chain)
    while len(found) == 1:
        chain += found
        found = mostly_under(chain[-1], chain)
    return chain if len(chain) > 1 else None


def level_evidence(counts: DataFrame, levels: list[str] | None) -> DataFrame:
    """(level, parent_level, n, problem): what the rows say against the chain of levels. Without a chain every level is outside."""
    levels = levels or []
    above = F.create_map(*[F.lit(x) for i, lv in enumerate(levels) for x in (lv, vocab.ROOT if i == 0 else levels[i - 1])]).cast("map<string,string>")
    wanted = above[F.col("level")]
    problem = (F.when(wanted.isNull(), "level outside the hierarchy")
               .when(F.col("parent_level") == vocab.ROOT, "have no parent")
               .when(F.col("parent_level") == vocab.MISSING, "point to a missing parent")
               .otherwise(F.concat(F.lit("have a "), F.col("parent_level"), F.lit(" parent (expected "),
                                   F.regexp_replace(wanted, f"^{vocab.ROOT}$", "none"), F.lit(")"))))
    return (counts.where(wanted.isNull() | (F.col("parent_level") != wanted))
            .select("level", "parent_level", "n", problem.alias("problem")))


def attach_levels(child: DataFrame, column: str, nodes: DataFrame, key: str, level: str) -> DataFrame:
    """(level, n, share, attached): where rows point into the tree. attached = this level holds 90 % or more."""
    counted = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    known = nodes.groupBy(F.col(key).alias("node")).agg(F.min(F.col(level).cast("string")).alias("level"))
    by_level = counted.join(known, "node").groupBy("level").agg(F.sum("n").alias("n"))
    rows = by_level.agg(F.sum("n").alias("rows")).select(F.lit(1).alias("one"), "rows")
    share = F.col("n") / F.col("rows")
    return (by_level.withColumn("one", F.lit(1)).join(F.broadcast(rows), "one")
            .select("level", "n", F.round(share, 6).alias("share"), (share >= vocab.ATTACH_SHARE).alias("attached")))
