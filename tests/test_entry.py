"""The driver's contract, and the library's independence of the training-data subpackage."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and "catalog_listing" in names


def test_entry_runs(spark):
    if Path(__spark_entry__.SMOKE_DIR).exists():
        assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "folioscope").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+folioscope\.llm|from folioscope import llm", path.read_text())
