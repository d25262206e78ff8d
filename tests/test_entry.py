"""What is registered when the optional modules, or what they need, are not there."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize(
    ("blocked", "lost"),
    [
        ("public_tokenizers", ["pipeline", "op5_token_counts"]),
        ("zstandard", ["op6_license_notices"]),
        ("talkgauge.llm", ["pipeline", "op5_token_counts"]),
        ("corpus_pipeline", ["pipeline"]),
    ],
)
def test_a_missing_module_costs_only_its_queries(blocked, lost):
    code = f"""
import sys, warnings
sys.modules[{blocked!r}] = None
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
from talkgauge.plans.queries import registry
assert set(registry()) <= names, "queries of the library are lost"
assert not names & set({lost!r})
assert any("no queries of" in str(w.message) for w in said)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
