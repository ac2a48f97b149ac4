import datetime as dt
import tempfile

import pytest

from plumbline.plans.suite import execute_rules
from plumbline.streaming.monitor import monitor, total_failures
from queries import checks
from queries.dirty import MODEL, Tables


def test_batches_add_up_to_the_table(spark, sf_dir):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    table = Tables(spark, sf_dir)["orders_dirty"]
    table.repartition(3).write.parquet(f"{folder}/in")
    rules = [checks.CHECKS[k][0] for k in ("chk_not_null", "chk_range", "chk_conditional")]
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    monitor(stream, "order", rules, MODEL, dt.date(2026, 1, 1), f"{folder}/out", f"{folder}/ck").awaitTermination()
    written = spark.read.parquet(f"{folder}/out")
    assert written.select("batch_id").distinct().count() == 3
    got = {r.rule_id: (r.total, r.failed) for r in total_failures(written).collect()}
    want = execute_rules({"orders_dirty": table}, rules, MODEL, dt.date(2026, 1, 1)).collect()
    assert got == {r.rule_id: (r.total, r.failed) for r in want}


def test_rules_over_other_rows_are_refused(spark):
    with pytest.raises(ValueError):
        monitor(spark.range(1), "order", [checks.CHECKS["chk_unique"][0]], MODEL, dt.date(2026, 1, 1), "x", "y")
