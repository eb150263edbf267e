"""Every registered reference query gives what its SQL gives."""

from __future__ import annotations

import pytest
from oracle import check

from riskloom.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    query = registry.queries()[name]
    if name in SQL:
        check(spark, sf_dir, query, SQL[name])
    else:
        assert query(spark, sf_dir).count() >= 0


def test_entry_imports_without_the_llm_package(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if "llm" in name or name == "corpus_pipeline" else real(name, *a))
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert "p00_detector_bank" in entry.queries()
