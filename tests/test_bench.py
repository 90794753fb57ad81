"""bench.py prints one JSON line in the driver's format."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SMALL, BENCH_CPUS="2", BENCH_QUERIES="hourly_counts,forecast_eval")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd="/tmp",
                         capture_output=True, text=True, timeout=600)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stdout + out.stderr
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["metric"] and d["value"] > 0
    assert set(d["queries"]) == {"hourly_counts", "forecast_eval"}
    assert d["sf"] == 0.001
