"""The driver contract, with and without the training-data operators."""

import importlib
import os
import sys

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) >= 70


def test_imports_without_the_optional_parts(monkeypatch):
    """As after the folders of the training-data operators were deleted."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("plyframe.llm"):
                raise ModuleNotFoundError(f"No module named '{name}'", name=name)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("plyframe.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert not [q for q in entry.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"]
    assert "backward_sweep" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_flagship(spark):
    rows = {r["layer"]: r["count"] for r in __spark_entry__.entry(spark).groupBy("layer").count().collect()}
    assert rows[3] == 25 and rows[2] == 10
