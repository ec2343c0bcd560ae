"""Each operator has one query; nothing outside the subpackage imports it."""

import re
from pathlib import Path

import __spark_entry__
from recordlens.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_isolation():
    for path in (ROOT / "recordlens").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "recordlens.llm" not in path.read_text(), path
