import builtins
import importlib
import sys


def test_entry_and_registries(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 1
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_the_rest_works_without_the_training_data_subpackage(monkeypatch):
    real = builtins.__import__

    def no_llm(name, *args, **kwargs):
        if name.startswith(("lodestone.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "tpch_q1" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
