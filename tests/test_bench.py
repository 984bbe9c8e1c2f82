"""The benchmark runs, on the smallest tables and a few of its queries, and prints one line of JSON."""

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_bench_prints_one_line():
    names = "language_census,provider_class"
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_MEMORY": "1g", "BENCH_QUERIES": names}
    done = subprocess.run([sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    (line,) = done.stdout.strip().splitlines()
    found = json.loads(line)
    assert set(found["queries"]) == {*names.split(","), "rebuild_100_records", "rebuild_10000_records"} and found["unit"] == "sec" and found["sf"] == "sf0.001"
    assert all(t > 0 for t in found["queries"].values()) and abs(found["value"] - sum(found["queries"].values())) < 0.01
