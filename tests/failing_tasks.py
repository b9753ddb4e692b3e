"""Run the layers while the first attempt of every reading task fails. Started by test_failures.py."""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402

from layerline.plans import gold, silver  # noqa: E402
from layerline.schemas import BRONZE  # noqa: E402
from layerline.session import build_session  # noqa: E402
from layerline.sources.files import read_table  # noqa: E402
from layerline.workload.tables import bronze_events  # noqa: E402


def fail_late_once(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")


def main(root: str) -> None:
    spark = build_session("failures", "local[4, 3]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"})
    spark.sparkContext.setLogLevel("OFF")
    bronze_events(spark, "/root/testdata/sf0.001").repartition(4).write.parquet(f"{root}/bronze")
    bronze = read_table(spark, f"{root}/bronze", BRONZE).mapInPandas(fail_late_once, BRONZE)
    stored = silver.write_silver(bronze, f"{root}/silver")
    counts = silver.silver_counts(bronze, stored).first().asDict()
    stg = gold.staging(stored)
    gold.dim_teams(stg).write.parquet(f"{root}/dim")
    counts["facts"] = gold.fct_match_events(stg, read_table(spark, f"{root}/dim")).count()
    print(json.dumps(counts))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
