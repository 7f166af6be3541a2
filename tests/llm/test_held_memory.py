"""A worker gives an earlier operator's memory back when another asks."""

import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
from lattica.llm.common import held
def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6
held("a", lambda: [str(i) * 3 for i in range(3_000_000)] + [None])
import numpy as np
pins = [bytearray(600) for _ in range(10)]
full = resident()
held("b", dict)
print(full, resident())
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_memory_of_an_earlier_operator_leaves_the_worker():
    root = str(Path(__file__).parents[2])
    full, after = map(float, subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split())
    assert full > 200 and after < full - 150
