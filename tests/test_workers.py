"""Code that runs on executors must load where the package is not installed."""

import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from scoutframe.operators.neighbours import grow_tree
from scoutframe.sources.html import _page_tables

CHILD = """
import pickle, sys
for f in pickle.loads(bytes.fromhex(sys.stdin.read())):
    f()
assert "scoutframe" not in sys.modules
"""


def test_worker_code_loads_without_the_package(tmp_path):
    def parse():
        assert _page_tables("<table id=a><tr><td>1</td></tr></table>", 0)[0]["id"] == "a"

    def search():
        x = np.arange(40.0).reshape(8, 5)
        assert len(grow_tree(x, 5, 2).locate(x)) == 8

    for f in (parse, search):
        f.__module__ = "__main__"
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    data = cloudpickle.dumps([parse, search]).hex()
    done = subprocess.run([sys.executable, "-c", CHILD], input=data, text=True, cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin"})
    assert done.returncode == 0, done.stderr
