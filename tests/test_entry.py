"""The registry is read by drivers that have no session yet."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("what", ["queries", "oracle_sql"])
def test_registry_without_a_session(what):
    code = f"import __spark_entry__ as e; found = e.{what}(); assert 'op6_jaccard' in found and 'id_regenerate' in found"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr
