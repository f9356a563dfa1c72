"""The driver contract with and without the corpus part."""

import importlib
import sys


def without(monkeypatch, hidden):
    """The entry module imported anew while one module cannot be imported."""
    for name in [n for n in sys.modules if n.startswith("fathomline.llm") or n in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)
    return importlib.import_module("__spark_entry__")


def test_entry_without_the_corpus_part(monkeypatch):
    entry = without(monkeypatch, "fathomline.llm.queries")
    names = entry.queries()
    assert "catch_by_species" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op") and n[2].isdigit()]
    assert set(entry.oracle_sql()) <= set(names)


def test_entry_without_a_library_of_the_corpus_part(monkeypatch):
    entry = without(monkeypatch, "xxhash")
    assert "catch_by_species" in entry.queries() and "pipeline" not in entry.queries()


def test_every_sql_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
