"""Command line: list and run with a result sink."""

import json
import os
import subprocess
import sys

from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _cli(*args, timeout=600):
    return subprocess.run([sys.executable, "-m", "logscope", *args], cwd=ROOT, capture_output=True, text=True,
                          timeout=timeout)


def test_cli_list_names_every_query():
    from logscope.plans import catalog
    out = _cli("list").stdout.split("\n")
    names = {line.split()[0] for line in out if line.strip()}
    assert names == set(catalog.QUERIES)


def test_cli_run_writes_json(tmp_path):
    out = str(tmp_path / "stats")
    res = _cli("run", "statistics", "--sf", SF_SMALL, "--master", "local[2]", "--out", out)
    assert res.returncode == 0, res.stderr[-2000:]
    files = [f for f in os.listdir(out) if f.endswith(".json")]
    rows = [json.loads(line) for f in files for line in open(os.path.join(out, f)) if line.strip()]
    assert len(rows) == 1 and rows[0]["total_requests"] > 0
