"""Jobs must run where the package is not installed on the workers."""

import os
import subprocess
import sys
from pathlib import Path

JOB = """
import sys
sys.path.insert(0, {root!r})
from barlake import session
from barlake.sources.files import key_runs
spark = session.builder("elsewhere").master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.sql("SELECT DATE'2026-01-02' AS date, concat('T', id) AS ticker FROM range(10)")
rows.write.parquet({out!r})
print("runs", key_runs(spark, {out!r}).count() > 0)
"""


def test_worker_functions_travel_with_the_job(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    job = tmp_path / "job.py"
    job.write_text(JOB.format(root=root, out=str(tmp_path / "bars")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "runs True" in done.stdout, done.stderr[-2000:]
