"""Rule identity, duplicates, review history: a rule library as append-only tables.

A rule row has: rule_id, source_id, name, entity, columns (array), check (JSON text), filter, severity, tolerance,
origin, status, created_at. A review row has: rule_id, seq, decided_at, decision, reason_code, reason.
Everything per rule or per key is a partial aggregate, not a window, so a busy key is one row per task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import vocab
from plumbline.functions.skew import cut_lineage, previous_in_key, rows_of_keys, state_before
from plumbline.functions.text import ident, one_of, q
from plumbline.operators import validate
from plumbline.sources.store import latest

# ---- identity -------------------------------------------------------------------------------------
_NUMBERS = ("max_rate", "min", "max", "tolerance_abs")
_DEFAULTS = ("CASE type WHEN 'allowed_values' THEN map('case_sensitive', 'true') WHEN 'range' THEN map('inclusive', 'true') "
             "WHEN 'has_children' THEN map('min_children', '1') WHEN 'aggregate_compare' THEN map('tolerance_abs', '0') "
             "ELSE CAST(map() AS map<string,string>) END")
_TOKEN = r"('(?:[^']|'')*'|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|<>|!=|<=|>=|\S)"


def normal_expression(c: str) -> str:
    """Expression text without differences of case and spacing; string literals stay as they are."""
    tokens = f"regexp_extract_all({c}, {q(_TOKEN)}, 1)"
    return f"array_join(transform({tokens}, t -> CASE WHEN startswith(t, '\\'') THEN t WHEN t = '!=' THEN '<>' ELSE lower(t) END), ' ')"


def canonical(rules: DataFrame) -> DataFrame:
    """Adds check_type, canonical (text that equal rules share), fingerprint and similarity_key.

    What a rule is called, how severe or tolerant it is does not count.
    """
    sorted_values = ("array_join(array_sort(array_distinct(transform(from_json(p.value, 'array<string>'), "
                     "v -> CASE WHEN params['case_sensitive'] = 'false' THEN upper(v) ELSE v END))), ',')")
    value = (f"CASE WHEN p.key = 'values' THEN {sorted_values} "
             f"WHEN p.key = 'ref_columns' THEN array_join(transform(pairs, x -> x.ref), ',') "
             f"WHEN {one_of('p.key', vocab.EXPRESSION_PARAMETERS)} THEN {normal_expression('p.value')} "
             f"WHEN {one_of('p.key', _NUMBERS)} THEN coalesce(CAST(try_cast(p.value AS DOUBLE) AS STRING), p.value) ELSE p.value END")
    pairs = ("CASE WHEN type = 'foreign_key' THEN array_sort(transform(arrays_zip(transform(columns, c -> lower(c)), "
             "transform(from_json(params['ref_columns'], 'array<string>'), c -> lower(c))), z -> struct(z['0'] AS col, z['1'] AS ref))) "
             "ELSE array_sort(transform(columns, c -> struct(lower(c) AS col, CAST(NULL AS STRING) AS ref))) END")
    related = ", ".join(f"params[{q(r)}]" for r in vocab.RELATED_PARAMETERS)
    return (rules.withColumn("params", F.from_json("check", "map<string,string>"))
            .withColumn("type", F.expr("params['type']"))
            .withColumn("params", F.expr(f"map_filter(map_concat(map_filter({_DEFAULTS}, (k, v) -> params[k] IS NULL), params), (k, v) -> v IS NOT NULL)"))
            .withColumn("pairs", F.expr(pairs))
            .withColumn("canonical", F.expr(
                f"concat_ws(' | ', concat('entity=', entity), concat('columns=', array_join(transform(pairs, x -> x.col), ',')), "
                f"array_join(transform(array_sort(map_entries(params)), p -> concat(p.key, '=', {value})), ' | '), "
                f"concat('filter=', {normal_expression('filter')}))"))
            .withColumn("fingerprint", F.expr("left(sha2(canonical, 256), 16)"))
            .withColumn("similarity_key", F.expr(
                f"concat_ws('|', type, entity, array_join(array_sort(transform(columns, c -> lower(c))), ','), {related})"))
            .withColumnRenamed("type", "check_type").drop("params", "pairs"))


def first_of_each(candidates: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """Duplicates inside a run: the first row of each key stays, ``copies`` tells how many it stands for."""
    rest = [c for c in candidates.columns if c != key]
    first = candidates.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row"), F.count(F.lit(1)).alias("copies"))
    return first.select(key, "row.*", "copies")


def classify(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Outcome of adding candidates in ``seq`` order: duplicate, similar (with the rule it resembles) or stored.

    history: seq, fingerprint, original_fingerprint, similarity_key, created_at. A candidate is a duplicate if its
    fingerprint is the current or the original one of a known rule. It is similar to the newest rule with its
    key: the candidate added just before, else the newest on file.
    """
    known = (history.select(F.explode(F.array("fingerprint", "original_fingerprint")).alias("fingerprint"))
             .where(F.col("fingerprint").isNotNull()).distinct().withColumn("_known", F.lit(True)))
    unique = first_of_each(candidates)
    judged = cut_lineage(unique.join(known, "fingerprint", "left"))      # used by both outcomes and the key counts
    fresh = previous_in_key(judged.where(F.col("_known").isNull()), "similarity_key", "seq", ["seq"])
    newest = history.groupBy("similarity_key").agg(F.max_by("seq", F.struct("created_at", "seq")).alias("on_file"))
    keys = fresh.groupBy("similarity_key").agg(F.count(F.lit(1)).alias("_rows")).join(newest, "similarity_key", "left")
    placed = rows_of_keys(fresh, keys, ["similarity_key"], "_rows")
    resembles = F.coalesce(F.col("previous.seq"), F.col("on_file"))
    new = placed.select("seq", "fingerprint", "similarity_key", F.when(resembles.isNull(), "stored").otherwise("similar").alias("outcome"),
                        resembles.alias("similar_to"))
    old = judged.where(F.col("_known")).select("seq", "fingerprint", "similarity_key", F.lit("duplicate").alias("outcome"),
                                               F.lit(None).cast("bigint").alias("similar_to"))
    return new.unionByName(old)


# ---- reviews --------------------------------------------------------------------------------------
def status_of(decision: Column) -> Column:
    """An edited rule is an approved one."""
    return F.when(decision == "modified", "approved").otherwise(decision)


def rule_status(reviews: DataFrame) -> DataFrame:
    """(rule_id, status, last_decision, reason_code, decisions): the last decision stands, minds may change."""
    return reviews.groupBy("rule_id").agg(
        F.max_by(F.struct("decision", "reason_code"), F.struct("decided_at", "seq")).alias("last"),
        F.count(F.lit(1)).alias("decisions")).select(
        "rule_id", status_of(F.col("last.decision")).alias("status"), F.col("last.decision").alias("last_decision"),
        F.col("last.reason_code").alias("reason_code"), "decisions")


def with_status(rules: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rules with their current status, proposed until decided."""
    return (rules.drop("status").join(rule_status(reviews), "rule_id", "left")
            .withColumn("status", F.coalesce("status", F.lit("proposed"))))


def invalid_reviews(reviews: DataFrame) -> DataFrame:
    """(rule_id, seq, problem): a rejection needs a reason and a known reason code; decisions come from a list."""
    codes, decisions = one_of("reason_code", vocab.REASON_CODES), one_of("decision", vocab.DECISIONS)
    problem = (f"CASE WHEN NOT coalesce({decisions}, false) THEN 'unknown decision' "
               f"WHEN decision = 'rejected' AND coalesce(trim(reason), '') = '' THEN 'a rejection needs a reason' "
               f"WHEN decision = 'rejected' AND reason_code IS NULL THEN 'a rejection needs a reason code' "
               f"WHEN reason_code IS NOT NULL AND NOT {codes} THEN 'unknown reason code' END")
    return reviews.withColumn("problem", F.expr(problem)).where("problem IS NOT NULL").select("rule_id", "seq", "problem")


def bulk_approve(rules: DataFrame, reviewer: str, decided_at: Column, entity: str | None = None, origin: str | None = None,
                 check_type: str | None = None, note: str = "bulk approval") -> DataFrame:
    """Approval rows for the proposed rules that match; append them to the reviews."""
    picked = rules.where(F.col("status") == "proposed")
    for column, wanted in (("entity", entity), ("origin", origin), ("check_type", check_type)):
        if wanted is not None:
            picked = picked.where(F.col(column) == wanted)
    return picked.select("rule_id", decided_at.alias("decided_at"), F.lit("approved").alias("decision"), F.lit(reviewer).alias("reviewer"),
                         F.lit(None).cast("string").alias("reason_code"), F.lit(note).alias("reason"))


def review_queue(rules: DataFrame, similar: DataFrame, results: DataFrame) -> DataFrame:
    """Proposed rules with warnings for the reviewer.

    similar: rule_id, similar_name, similar_status, similar_reason. results: rule_id, total, failed, failure_rate, passed,
    allowed, error.
    """
    joined = rules.where(F.col("status") == "proposed").join(similar, "rule_id", "left").join(results, "rule_id", "left")
    flags = ", ".join((
        "CASE WHEN check_type = 'custom_sql' THEN 'free SQL: read it before approving' END",
        "CASE WHEN similar_name IS NOT NULL THEN concat('similar to ', similar_status, ' rule \\'', similar_name, '\\'', "
        "CASE WHEN similar_status = 'rejected' AND similar_reason IS NOT NULL THEN concat(' (rejected: ', similar_reason, ')') ELSE '' END) END",
        "CASE WHEN error IS NOT NULL THEN concat('cannot run: ', error) "
        f"WHEN failure_rate > {vocab.HIGH_FAILURE_RATE} THEN concat('fails ', CAST(round(failure_rate * 100) AS INT), '% of rows: the rule may be wrong') "
        "WHEN failed > 0 AND passed THEN concat('passes with ', failed, ' failing rows (limit ', CAST(round(allowed * 100, 1) AS STRING), '%)') END"))
    return joined.select("rule_id", "name", "entity", "check_type", F.expr(f"array_compact(array({flags}))").alias("flags"))


def rule_counts(rules: DataFrame, *by: str) -> DataFrame:
    return rules.groupBy(*(by or ("status",))).agg(F.count(F.lit(1)).alias("rules"))


def decision_history(rules: DataFrame, reviews: DataFrame) -> DataFrame:
    """(rule_id, entity, check_type, group, reason, reason_code, edits): what past decisions say about each rule."""
    facts = reviews.groupBy("rule_id").agg(
        F.max_by(F.struct("decision", "reason_code", "reason"), F.struct("decided_at", "seq")).alias("last"),
        F.count_if(F.col("decision") == "modified").alias("edits"))
    joined = rules.join(facts, "rule_id", "left")
    status = F.coalesce(status_of(F.col("last.decision")), F.lit("proposed"))
    group = F.when(status == "proposed", "pending").otherwise(status)
    return joined.select("rule_id", "entity", "check_type", group.alias("group"),
                         F.when(status == "rejected", F.col("last.reason")).alias("reason"),
                         F.col("last.reason_code").alias("reason_code"),
                         F.when(status == "approved", F.coalesce("edits", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("superseded"))


def decision_patterns(history: DataFrame, entity_column: str | None = "entity") -> DataFrame:
    """([entity,] check_type, approved, rejected, line): what kinds of rules are accepted, per entity or for the source.

    Codes are counted before they are listed, so a list never grows with the number of decisions.
    """
    keys = ([entity_column] if entity_column else []) + ["check_type"]
    counts = history.groupBy(*keys).agg(
        F.count_if(F.col("group") == "approved").alias("approved"), F.count_if(F.col("group") == "rejected").alias("rejected"),
        F.max_by(F.when(F.col("group") == "rejected", F.col("reason")),
                 F.when((F.col("group") == "rejected") & F.col("reason").isNotNull(), F.col("rule_id"))).alias("example"))
    codes = (history.where(F.col("group") == "rejected")
             .groupBy(*keys, F.coalesce("reason_code", F.lit("no code")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
             .groupBy(*keys).agg(F.expr("array_join(transform(array_sort(collect_list(struct(-n AS n, code))), "
                                        "x -> concat(x.code, ' x', -x.n)), ', ')").alias("codes")))
    out = counts.join(codes, keys, "left")
    if entity_column is None:
        out = out.where(F.col("rejected") >= vocab.SOURCE_MIN_REJECTIONS)
    else:
        out = out.where((F.col("rejected") > 0) | (F.col("approved") + F.col("rejected") >= vocab.PATTERN_MIN_DECISIONS))
    line = ("concat(check_type, ': approved ', approved, ', rejected ', rejected, CASE WHEN rejected > 0 THEN concat(' (', codes, ')', "
            "CASE WHEN example IS NOT NULL THEN concat(' - e.g. \"', example, '\"') ELSE '' END) ELSE '' END)")
    return out.select(*keys, "approved", "rejected", F.expr(line).alias("line"))


def active_context(items: DataFrame, retired: DataFrame) -> DataFrame:
    """Business facts that were not retired; facts without an entity hold for the whole source."""
    return items.join(retired.select("item_id").distinct(), "item_id", "left_anti")


def context_for(items: DataFrame, source: str, entity: str) -> DataFrame:
    return items.where((F.col("source_id") == source) & (F.col("entity").isNull() | (F.col("entity") == entity)))


def run_summary(outcomes: DataFrame, attempts: DataFrame) -> DataFrame:
    """(run_id, generated, duplicate, similar, invalid) from outcomes (run_id, outcome) and attempts (run_id, invalid, repaired)."""
    counted = outcomes.groupBy("run_id").agg(
        F.count_if(F.col("outcome").isin("stored", "similar")).alias("generated"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate"), F.count_if(F.col("outcome") == "similar").alias("similar"))
    broken = attempts.groupBy("run_id").agg(F.sum(F.greatest(F.lit(0), F.col("invalid") - F.col("repaired"))).alias("invalid"))
    return counted.join(broken, "run_id", "full_outer").select("run_id", *[
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("generated", "duplicate", "similar", "invalid")])


def rule_budget(covered: Column, wanted: int = vocab.RULE_BUDGET) -> Column:
    """How many new rules to ask for, given how many cover the entity already."""
    return F.when(covered >= vocab.WELL_COVERED, F.lit(min(wanted, vocab.REPEAT_BUDGET))).otherwise(F.lit(wanted))


def stale_rules(rules: DataFrame, inventory: DataFrame) -> DataFrame:
    """(rule_id, entity, column): approved rules that target a column the source no longer has.

    rules: rule_id, status, table, columns. inventory: table, column.
    """
    targets = rules.where(F.col("status") == "approved").select("rule_id", "table", F.explode("columns").alias("column"))
    needed = targets.groupBy("table", "column").agg(F.count(F.lit(1)).alias("_rows"))
    gone = needed.join(inventory.select("table", "column").distinct(), ["table", "column"], "left_anti")
    return rows_of_keys(targets, gone, ["table", "column"], "_rows").select("rule_id", "table", "column")


def rule_line(columns: str = "columns") -> str:
    """SQL: one line that describes a rule."""
    return (f"concat(name, ' [', check_type, ' on ', entity, '(', CASE WHEN size({columns}) > 0 THEN array_join({columns}, ',') ELSE '-' END, ')', "
            f"CASE WHEN size(map_filter(from_json(check, 'map<string,string>'), (k, v) -> k <> 'type')) > 0 THEN concat(': ', "
            f"array_join(transform(array_sort(map_entries(map_filter(from_json(check, 'map<string,string>'), (k, v) -> k <> 'type'))), "
            f"p -> concat(p.key, '=', p.value)), ', ')) ELSE '' END, CASE WHEN filter IS NOT NULL THEN concat(' WHERE ', filter) ELSE '' END, ']')")


def rules_digest(rules: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(entity, section, fingerprint, line): covered rules once per fingerprint, rejected ones with their reason, and what past decisions
    prefer (``patterns``: entity, line, as ``decision_patterns`` gives them; these lines have no fingerprint).

    One row per line; a reader that wants text collects the lines of one entity.
    """
    shown = rules.withColumn("section", F.when(F.col("status") == "rejected", "rejected").otherwise("covered"))
    once = latest(shown, ["entity", "section", "fingerprint"], "rule_id")
    reason = F.expr(f"concat({rule_line()}, CASE WHEN section = 'rejected' AND reason IS NOT NULL THEN concat(' - steward\\'s reason: ', reason) ELSE '' END)")
    out = once.select("entity", "section", "fingerprint", reason.alias("line"))
    if patterns is None:
        return out
    return out.union(patterns.select("entity", F.lit("preference"), F.lit(None).cast("string"), "line"))


def source_overview(sources: DataFrame, versions: DataFrame, rules: DataFrame, context: DataFrame) -> DataFrame:
    """(source_id, version, proposed, approved, rejected, context_items) per source."""
    out = sources.select("source_id").distinct().join(versions.groupBy("source_id").agg(F.max("version").alias("version")), "source_id", "left")
    counts = rules.groupBy("source_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in vocab.STATUSES])
    out = out.join(counts, "source_id", "left").join(
        context.groupBy("source_id").agg(F.count(F.lit(1)).alias("context_items")), "source_id", "left")
    return out.select("source_id", "version", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*vocab.STATUSES, "context_items")])


# ---- edits ----------------------------------------------------------------------------------------
EDITABLE = ("name", "description", "category", "dimension", "scope", "filter", "severity", "tolerance", "rationale")


def _edit_problem() -> str:
    """SQL: why an edit (path, value) is refused by itself; NULL if it is not."""
    head = "substring_index(path, '.', 1)"
    return (f"CASE WHEN {one_of(head, vocab.LOCKED_RULE_FIELDS)} THEN concat('\\'', {head}, '\\' cannot be edited') "
            f"WHEN NOT ({one_of('path', EDITABLE)} OR path IN ('target.entity', 'target.columns') OR path RLIKE '^check\\\\.[a-z_]+$') "
            f"THEN concat('unknown field \\'', path, '\\'') "
            f"WHEN path = 'tolerance' AND value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL THEN 'tolerance: not a number' "
            f"WHEN path = 'target.columns' AND from_json(value, 'array<string>') IS NULL THEN 'target.columns: not a list of names' END")


def edit_history(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """(rule_id, seq, path, before, after, accepted, problem, line): every edit with the value that it met and the one it sets.

    The edits of one rule with the same ``seq`` are one event, and an event with a problem is refused whole: its edits change nothing, so later
    ones still meet the value before it. rules: rule_id and the fields as they were before the first edit. edits: rule_id, seq (integer), path, value.
    """
    fields = [c for c in EDITABLE if c in rules.columns]
    original = ("CASE " + " ".join(f"WHEN path = {q(c)} THEN CAST(_r.{ident(c)} AS STRING)" for c in fields)
                + " WHEN path = 'target.entity' THEN _r.entity WHEN path = 'target.columns' THEN to_json(_r.columns) "
                "WHEN startswith(path, 'check.') THEN get_json_object(_r.check, concat('$.', substring(path, 7))) END")
    known = rules.select("rule_id", F.struct(*fields, "entity", "columns", "check").alias("_r"))
    judged = edits.select("rule_id", "seq", "path", "value").join(known, "rule_id", "left").withColumn(
        "problem", F.expr(f"CASE WHEN _r IS NULL THEN 'unknown rule' ELSE {_edit_problem()} END"))
    events = judged.groupBy("rule_id", "seq").agg(F.bool_and(F.col("problem").isNull()).alias("accepted"))
    told = judged.join(events, ["rule_id", "seq"]).withColumn("_key", F.to_json(F.struct("rule_id", "path")))
    seen = state_before(told, "_key", "seq", F.when(F.col("accepted"), F.struct("value")), "_state")
    before = F.when(F.col("_state").isNotNull(), F.col("_state.value")).otherwise(F.expr(original))
    return seen.select("rule_id", "seq", "path", before.alias("before"), F.col("value").alias("after"), "accepted", "problem").withColumn(
        "line", F.expr("concat(path, ': ', coalesce(before, '(empty)'), ' -> ', coalesce(after, '(empty)'))"))


def revalidated(edited: DataFrame, columns: DataFrame | None = None, hierarchies: DataFrame | None = None) -> DataFrame:
    """Edited rules whose ``errors`` also name what is wrong with the rule that the edits made: its shape and, if ``columns`` (entity, column)
    and ``hierarchies`` are given, what it refers to. Fields that the rules do not have count as the defaults of a rule."""
    def own(c: str, default: str) -> str:
        return ident(c) if c in edited.columns else default
    kind = "from_json(check, 'map<string,string>')['type']"
    scope = "map(" + ", ".join(f"{q(k)}, {q(v[0][0])}" for k, v in vocab.CHECKS.items()) + f")[{kind}]"
    category = f"CASE WHEN startswith({kind}, 'hierarchy_') THEN 'hierarchy' ELSE 'data_quality' END"
    whole = (f"named_struct('name', {own('name', q(''))}, 'category', {own('category', category)}, 'dimension', {own('dimension', q('validity'))}, "
             f"'scope', {own('scope', scope)}, 'target', named_struct('entity', entity, 'columns', columns), 'check', from_json(check, 'map<string,string>'), "
             f"'filter', {own('filter', 'CAST(NULL AS STRING)')}, 'severity', {own('severity', q('medium'))}, 'tolerance', CAST({own('tolerance', '0')} AS DOUBLE))")
    judged = validate.shape_errors(edited.withColumnRenamed("errors", "_refused").withColumn("r", F.expr(whole)).withColumn("type", F.expr("r.check['type']")))
    found = ["_refused", "errors"]
    if columns is not None and hierarchies is not None:
        judged = validate.reference_errors(judged, columns, hierarchies)
        found.append("ref_errors")
    return judged.withColumn("errors", F.concat(*found)).drop("_refused", "ref_errors", "r", "type")


def apply_edits(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited rules with the problems of their edits: (rule columns..., errors).

    edits: rule_id, path (dotted, e.g. check.max_rate), value (JSON or plain text). An edit of identity or lineage is
    refused, and so is an unknown field, a tolerance that is no number and columns that are no list. ``check`` parameters are
    replaced in the JSON document; ``revalidated`` tells what is wrong with the rule that comes out.
    """
    last = edits.groupBy("rule_id", "path").agg(F.max_by("value", "seq").alias("value"))
    per_rule = last.groupBy("rule_id").agg(
        F.array_sort(F.array_compact(F.collect_list(F.expr(_edit_problem())))).alias("errors"),
        F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("edit"))
    changed = rules.join(per_rule, "rule_id")
    kinds = dict(changed.dtypes)
    plain = {c: F.expr(f"CASE WHEN map_contains_key(edit, {q(c)}) AND (edit[{q(c)}] IS NULL OR try_cast(edit[{q(c)}] AS {kinds[c]}) IS NOT NULL) "
                       f"THEN try_cast(edit[{q(c)}] AS {kinds[c]}) ELSE {ident(c)} END")
             for c in EDITABLE if c in changed.columns}
    plain["entity"] = F.expr("coalesce(edit['target.entity'], entity)")
    plain["columns"] = F.expr("coalesce(from_json(edit['target.columns'], 'array<string>'), columns)")
    replaced = F.expr("map_filter(edit, (k, v) -> startswith(k, 'check.'))")
    document = ("to_json(map_concat(map_filter(from_json(check, 'map<string,variant>'), (k, v) -> NOT map_contains_key(_set, concat('check.', k))), "
                "transform_values(transform_keys(_set, (k, v) -> substring(k, 7)), (k, v) -> coalesce(try_parse_json(v), CAST(v AS VARIANT)))))")
    return changed.withColumns(plain).withColumn("_set", replaced).withColumn("check", F.expr(document)).drop("edit", "_set")


def clashes(edited: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, other_id): edited rules (with fingerprint) that are now identical to another rule."""
    taken = rules.groupBy("fingerprint").agg(F.min("rule_id").alias("first_id"), F.max("rule_id").alias("last_id"))
    known = edited.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_rows")).join(taken, "fingerprint")
    other = F.when(F.col("first_id") != F.col("rule_id"), F.col("first_id")).when(F.col("last_id") != F.col("rule_id"), F.col("last_id"))
    return (rows_of_keys(edited.select("rule_id", "fingerprint"), known, ["fingerprint"], "_rows")
            .select("rule_id", other.alias("other_id")).where(F.col("other_id").isNotNull()))
