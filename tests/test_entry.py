"""The driver's entry points."""

import importlib
import sys

import pytest

import __spark_entry__


def test_queries_and_sql():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 60 and all(map(callable, found.values()))


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["title", "average"] and df.count() <= 10


@pytest.mark.parametrize("gone", ["marginalia.llm", "corpus_pipeline"])
def test_folders_may_be_missing(gone, monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == gone or name.startswith(gone + "."):
                raise ModuleNotFoundError(f"No module named {gone!r}", name=gone)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    for name in [m for m in sys.modules if m.startswith("marginalia.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    if gone == "marginalia.llm":
        assert __spark_entry__._optional("marginalia.llm.queries", "QUERIES") == [{}]
    else:
        assert __spark_entry__._optional("corpus_pipeline", "run") == [{}]


def test_other_import_errors_are_raised(monkeypatch, tmp_path):
    (tmp_path / "needs_more.py").write_text("import a_module_that_is_not_there")
    monkeypatch.syspath_prepend(str(tmp_path))
    importlib.invalidate_caches()
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._optional("needs_more", "x")
