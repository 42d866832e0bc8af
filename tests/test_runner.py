"""The query runner lists, writes and explains."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(*args):
    return subprocess.run([sys.executable, "-m", "marketspark", *args], cwd=ROOT, capture_output=True, text=True,
                          timeout=600)


def test_runner_list_and_write():
    r = _run("--input", "/root/testdata/sf0.001", "--list")
    assert r.returncode == 0 and "split_by_vendor" in r.stdout.split()
    out = tempfile.mkdtemp(prefix="ms-runner-")
    r = _run("--input", "/root/testdata/sf0.001", "--output", out, "--master", "local[2]", "vendor_shelf")
    assert r.returncode == 0, r.stderr[-2000:]
    assert os.path.isdir(os.path.join(out, "vendor_shelf"))
    r = _run("--input", "/root/testdata/sf0.001", "nope")
    assert r.returncode != 0
