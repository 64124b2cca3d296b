"""The driver's contract."""

import importlib
import sys

import __spark_entry__


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_without_the_optional_part(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("trailmill.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "trailmill.llm"):
                raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    try:
        entry = importlib.reload(__spark_entry__)
        assert "edge_tile_histogram" in entry.queries() and not any(n.startswith("op1_") for n in entry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
