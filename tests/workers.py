"""Runs queries in a process whose workers can't import this repository, as on a cluster."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
for name in {names!r}:
    print("ROWS", name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def rows_elsewhere(folder: Path, names: list[str]) -> dict[str, int]:
    """{query: rows}, run from `folder` without this repository on the workers' path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    kept = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and not (Path(x) / "tessera").exists()]
    script = SCRIPT.format(repo=str(Path(__file__).parent.parent), names=names)
    run = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env | {"PYTHONPATH": os.pathsep.join(kept)}, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    return {x[1]: int(x[2]) for x in (line.split() for line in run.stdout.splitlines()) if x and x[0] == "ROWS"}
