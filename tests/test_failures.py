from __future__ import annotations

import json
import os
import subprocess
import sys

from layerline.plans import gold, silver
from layerline.workload.tables import bronze_events


def test_layers_and_counts_survive_failing_tasks(spark, tmp_path):
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "failing_tasks.py")
    done = subprocess.run(
        [sys.executable, script, str(tmp_path)], capture_output=True, text=True, timeout=300, check=True
    )
    found = json.loads(done.stdout.strip().splitlines()[-1])
    bronze = bronze_events(spark, "/root/testdata/sf0.001")
    expected = silver.silver_counts(bronze, silver.to_silver(bronze)).first().asDict()
    stg = gold.staging(silver.to_silver(bronze))
    expected["facts"] = gold.fct_match_events(stg, gold.dim_teams(stg)).count()
    assert found == expected
