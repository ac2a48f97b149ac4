"""Run a table's row checks on each micro-batch of a stream, with the same fused plan as a batch run."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.model import Model
from plumbline.operators.row_checks import ROW_CHECKS
from plumbline.plans.suite import execute_rules
from plumbline.rules import Rule


def monitor(stream: DataFrame, entity: str, rules: list[Rule], model: Model, as_of: dt.date, path: str, checkpoint: str) -> StreamingQuery:
    """Write rule results per batch to ``path/batch_id=<n>``. A batch that is run again replaces its own folder."""
    needing_more = sorted(r.rule_id for r in rules if r.type not in ROW_CHECKS)
    if needing_more:
        raise ValueError(f"rules that need more than the row cannot be decided per batch: {needing_more}")

    def run(batch: DataFrame, batch_id: int) -> None:
        results = execute_rules({model.entity(entity).table: batch}, rules, model, as_of)
        results.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def total_failures(results: DataFrame) -> DataFrame:
    """(rule_id, total, failed, failure_rate) over all batches written so far."""
    return results.groupBy("rule_id").agg(F.sum("total").alias("total"), F.sum("failed").alias("failed")).withColumn(
        "failure_rate", F.round(F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("total")), F.lit(0.0)), 6))
