"""bench.py prints one JSON line with the driver's fields."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    code = ("import bench; bench.HEADLINE = ['feature_build_default', 'correlation_matrix']; bench.main()")
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True,
                         timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip().startswith("{")]
    assert out.returncode == 0 and len(lines) == 1, out.stderr[-2000:]
    rec = json.loads(lines[0])
    assert rec["metric"] == "full_feature_pipeline" and rec["unit"] == "sec" and rec["sf"] == "0.001"
    assert rec["value"] == rec["queries"]["feature_build_default"] > 0
    assert set(rec["queries"]) >= {"feature_build_default", "correlation_matrix", "all_headline_queries_total"}
