import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 60; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    own = [p for p in ROOT.glob("kinetrace/**/*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M)]


def test_entry_gives_rows(spark):
    import os

    import pytest

    import __spark_entry__

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert __spark_entry__.entry(spark).count() > 0
