import sys

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators(monkeypatch):
    # None in sys.modules: the import fails
    for name in [n for n in sys.modules if n.startswith("fathom.llm")] + ["fathom.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    if fathom := sys.modules.get("fathom"):
        monkeypatch.delattr(fathom, "llm", raising=False)
    names = e.queries()
    assert "heatmap_effective" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert SF
