import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3


def test_imports_without_the_corpus_operators(monkeypatch):
    """The library stands without its corpus part."""

    class Block:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("plenogrid.llm"):
                raise ModuleNotFoundError(name, name=name)

    for m in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline") or m.startswith("plenogrid.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Block(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    assert "pipeline" not in e.queries() and len(e.queries()) > 80
    monkeypatch.delitem(sys.modules, "__spark_entry__")
